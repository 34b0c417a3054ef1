"""Token ids by the tokenizers library, at the speed of distinct words.

The tokenizers of this kind drop white space, so a text's ids are those of its blank-separated
words one after the other, and each different word of a slice is encoded once.  A worker keeps the
ids of short parts of words in a table of ``SLOTS`` places, each of which holds the last part that
fell there, so its size is fixed and it can outlast tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from strandmill.llm.store import worker_state
from strandmill.llm.words import BLANKS, Words, mix, slices

SLOTS = 1 << 20
SHORT = 16  # bytes of a part that is kept
FEW = 8  # ids of a part that is kept
RUN = 2000  # parts encoded in one call
SLICE = 4 << 20
END = 2
# Latin letters make one part and the ASCII marks after them another; such words need no more care.
_PLAIN = r"^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[!-/:-@\[-`{-~]*)\z"
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Where a file of the installed public vocabularies lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def whole_tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Known:
    """The ids of short parts: two lanes of eight bytes name a part exactly, its hash tells its place."""

    def __init__(self, kind):
        self.lanes = np.zeros((2, SLOTS), np.uint64)
        self.sizes = np.zeros(SLOTS, np.uint8)
        self.ids = np.zeros((SLOTS, FEW), kind)

    @staticmethod
    def lanes_of(parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(two lanes of each part, bytes of each part); lanes of longer parts tell their first bytes only."""
        parts = parts.cast(pa.large_binary())
        offsets = np.frombuffer(parts.buffers()[1], np.int64)[parts.offset : parts.offset + len(parts) + 1]
        data = (parts.buffers()[2].to_pybytes() if parts.buffers()[2] is not None else b"") + bytes(SHORT)
        at = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
        size = np.diff(offsets)
        lanes = np.empty((2, len(parts)), np.uint64)
        for lane in range(2):
            left = np.clip(size - 8 * lane, 0, 8).astype(np.uint64)
            some = left > 0
            lanes[lane] = 0
            lanes[lane, some] = at[offsets[:-1][some] + 8 * lane] & (_ALL >> (np.uint64(64) - left[some] * np.uint64(8)))
        return lanes, size

    @staticmethod
    def place(lanes: np.ndarray) -> np.ndarray:
        return (mix(lanes[0] ^ mix(lanes[1])) & np.uint64(SLOTS - 1)).astype(np.int64)

    def put(self, lanes: np.ndarray, place: np.ndarray, flat: np.ndarray, at: np.ndarray, size: np.ndarray) -> None:
        place, pick = np.unique(place, return_index=True)
        self.lanes[:, place] = lanes[:, pick]
        self.sizes[place] = size[pick]
        inner = np.arange(FEW)
        filled = inner < size[pick, None]
        self.ids[place] = np.where(filled, flat[np.where(filled, at[pick, None] + inner, 0)], 0)


class Encoder:
    """Ids of distinct words; the parts of words stay known between batches."""

    def __init__(self, path: str):
        self.whole = whole_tokenizer(path)
        self.byte_chars = {b: ord(c) for b, c in enumerate(_byte_chars()) if b != 32}
        names = self.whole.get_vocab()
        top = max(names.values(), default=0)
        self.known = Known(np.uint16 if top < 1 << 16 else np.uint32)
        # The same model alone: parts stand between blanks, and need no rules for cutting.
        self.model, self.last = _model_alone(self.whole), np.zeros(top + 1, bool)
        suffix = getattr(self.whole.model, "end_of_word_suffix", None)
        if suffix:
            self.last[[i for name, i in names.items() if name.endswith(suffix)]] = True

    def _coded(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each part) of parts that are not empty."""
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for lo in range(0, len(parts), RUN):
            some = parts[lo : lo + RUN]
            text = " ".join(some)
            text = text if text.isascii() else text.encode().decode("latin-1").translate(self.byte_chars)
            found = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            size = np.diff(np.flatnonzero(self.last[found]), prepend=-1)
            if len(size) != len(some) or size.sum() != len(found):
                # A vocabulary that does not tell where words end: one part at a time.
                each = [[t.id for t in self.whole.model.tokenize(x)] for x in text.split(" ")]
                found, size = np.array(list(chain.from_iterable(each)), np.uint32), np.array([len(x) for x in each])
            ids.append(found)
            sizes.append(size)
        return np.concatenate(ids), np.concatenate(sizes)

    def _known(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(index of each part, flat, at, size): the ids of different part ``d`` are ``flat[at[d]:at[d] + size[d]]``."""
        coded = parts.dictionary_encode()
        if not len(parts):
            return coded.indices.to_numpy(), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        lanes, length = Known.lanes_of(coded.dictionary)
        place = Known.place(lanes)
        hit = (length <= SHORT) & (self.known.lanes[:, place] == lanes).all(axis=0) | (length == 0)
        size = np.where(hit & (length > 0), self.known.sizes[place], 0).astype(np.int64)
        rows = np.flatnonzero(size)
        flat = self.known.ids[place[rows]][np.arange(FEW) < size[rows, None]].astype(np.uint32)
        new = np.flatnonzero(~hit)
        ids, size[new] = self._coded(coded.dictionary.take(pa.array(new)).to_pylist())
        at = np.zeros(len(size), np.int64)
        at[rows] = np.cumsum(size[rows]) - size[rows]
        at[new] = len(flat) + np.cumsum(size[new]) - size[new]
        flat = np.concatenate([flat, ids])
        kept = new[(length[new] <= SHORT) & (size[new] <= FEW) & (size[new] > 0)]
        if len(kept):
            self.known.put(lanes[:, kept], place[kept], flat, at[kept], size[kept])
        return coded.indices.to_numpy(), flat, at, size

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat, at, size): the ids of word ``w`` are ``flat[at[w]:at[w] + size[w]]``."""
        split = pc.extract_regex(words, _PLAIN)
        plain = split.is_valid().to_numpy(zero_copy_only=False)
        letters, marks = pc.struct_field(split, "letters"), pc.struct_field(split, "marks")
        odd = [x.ids for x in self.whole.encode_batch(words.filter(pa.array(~plain)).to_pylist(), add_special_tokens=False)]
        first, first_ids, first_at, first_size = self._known(pc.utf8_lower(letters).drop_null())
        second, second_ids, second_at, second_size = self._known(marks.drop_null())
        odd_size = np.array([len(x) for x in odd], np.int64)
        odd_ids = np.fromiter(chain.from_iterable(odd), np.uint32, int(odd_size.sum()))
        store = np.concatenate([first_ids, second_ids, odd_ids])
        length = np.concatenate([first_size, second_size, odd_size, [0]])
        starts = np.concatenate([first_at, second_at + len(first_ids), np.cumsum(odd_size) - odd_size + len(first_ids) + len(second_ids), [0]])
        one, two = np.empty(len(plain), np.int64), np.full(len(plain), len(length) - 1)
        one[plain], two[plain] = first, second + len(first_size)
        one[~plain] = np.arange(len(odd)) + len(first_size) + len(second_size)
        size = length[one] + length[two]
        at = np.cumsum(size) - size
        flat = np.empty(int(size.sum()), np.uint32)
        for run, shift in ((one, 0), (two, length[one])):
            each = length[run]
            inner = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
            flat[np.repeat(at + shift, each) + inner] = store[np.repeat(starts[run], each) + inner]
        return flat, at, size


def _byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1
    characters stand for themselves, the others for 256, 257, ... in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def _model_alone(whole):
    from tokenizers import Tokenizer, pre_tokenizers

    alone = Tokenizer(whole.model)
    alone.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
    return alone


def encoder(path: str) -> Encoder:
    state = worker_state()
    if ("encoder", path) not in state:
        state["encoder", path] = Encoder(path)
    return state["encoder", path]


def encode(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, bounds): the ids of text ``r``, its end id included, are ``ids[bounds[r]:bounds[r + 1]]``."""
    words = Words(texts, BLANKS)
    coded = words.array().dictionary_encode()
    flat, at, size = encoder(path).encode(coded.dictionary.cast(pa.large_string()))
    word = coded.indices.to_numpy(zero_copy_only=False)
    each = size[word]
    # A text is its words and then the end id: place the words, leave one place after each text.
    total = np.concatenate([[0], np.cumsum(each)])
    bounds = total[words.first] + np.arange(words.rows + 1)
    ids = np.full(int(bounds[-1]), END, np.uint32)
    # Half-width places where they suffice: these arrays are the largest in the worker.
    kind = np.int32 if bounds[-1] < 1 << 31 and len(flat) < 1 << 31 else np.int64
    inner = np.arange(int(total[-1]), dtype=kind) - np.repeat(total[:-1].astype(kind), each)
    taken = flat[np.repeat(at[word].astype(kind), each) + inner]
    inner += np.repeat((total[:-1] + words.row_of()).astype(kind), each)
    ids[inner] = taken
    return ids, bounds


def encoded(batches: Iterator[pa.RecordBatch], text_col: str, path: str):
    """(slice of rows, ids, bounds) for slices of the batches."""
    for batch in batches:
        for part in slices(batch, text_col, SLICE):
            yield part, *encode(part.column(text_col), path)
