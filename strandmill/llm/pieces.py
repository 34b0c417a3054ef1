"""SentencePiece ids of whole texts and back, by backtracking instead of merging.

A model of the merge type joins the two neighbours whose union has the best score until no union is
a piece.  The result is the only sequence of pieces in which each piece, and each two neighbours,
come out unchanged when merged anew.  So a text is read from the left: an Aho-Corasick automaton
gives the longest piece at each place, a neighbour check by re-merging refuses what does not fit the
piece before, then the next shorter piece is tried, and from a place where none fits the last piece
is taken back and the place is marked in a bitfield as failed.  Each place fails once at most, so
the work grows in proportion to the text.

No piece reaches from another character into the space sign, nor from a letter into some marks;
texts are cut there, the different new parts of a slice of texts are walked in step, and a worker
keeps the ids of about ``CACHE`` parts.  Characters that are no piece become the pieces of their
UTF-8 bytes.

Null texts count as empty; an empty text has its begin and end ids only.  Repeated rows are encoded
each.  A column with the name of an output is replaced, all others stay.  Texts are read as they are
(the space sign U+2581 in a text is a space, as in the library).  Model files with other rules than
identity normalization, a space put in front and byte fallback are refused.
"""

from __future__ import annotations

import codecs
import re
from array import array
from collections.abc import Iterator
from itertools import pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.llm.store import worker_state
from strandmill.llm.tokens import vocabulary
from strandmill.llm.words import mix, slices

MODEL = "piece_bpe_32k.model"
CACHE = 200_000  # parts whose ids a worker keeps
PAIRS = 1 << 20  # slots for the neighbour checks that it keeps
LONG_PART = 64  # longer parts are not kept
WINDOW = 1 << 20  # characters that the automaton reads at once
SLICE = 1 << 20
MARKS = ".,;:!?|"
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
SPACE = "▁"
_PROBES = ["", " ", "  two  blanks ", "a,b. C!", "1 2\n3\t", "é①\U0001D518 日本", "the end?", SPACE * 40 + "x"]


class Decoder:
    """What each id of a model file stands for."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        every = range(self.model.get_piece_size())
        self.text = [self.model.id_to_piece(i) for i in every]
        self.control = {i for i in every if self.model.is_control(i)}
        self.byte_ids = [self.model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.plain = [b"" if i in self.control else t.replace(SPACE, " ").encode() for i, t in enumerate(self.text)]
        for b, i in enumerate(self.byte_ids):
            self.plain[i] = bytes([b])
        self.plain[self.model.unk_id()] = " ⁇ ".encode()

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: control ids vanish and end a run of bytes, the space put in front goes,
        and each byte that is no UTF-8 becomes U+FFFD."""
        listed = ids.tolist()
        first = next((n for n, i in enumerate(listed) if i not in self.control), len(listed))
        listed = listed[first:]
        while listed and listed[-1] in self.control:
            listed.pop()
        runs = [b""]
        if self.control.isdisjoint(listed):
            runs = [b"".join(map(self.plain.__getitem__, listed))]
        else:
            for i in listed:
                if i in self.control:
                    runs.append(b"")
                else:
                    runs[-1] += self.plain[i]
        if listed and self.text[listed[0]].startswith(SPACE):
            runs[0] = runs[0][1:]
        return "".join([run.decode("utf-8", _each_byte()) for run in runs])


class Pieces(Decoder):
    """The pieces of a model file, with encoding of lists of texts."""

    def __init__(self, path: str):
        super().__init__(path)
        model, every = self.model, range(len(self.text))
        self.begin, self.end = model.bos_id(), model.eos_id()
        special = {i for i in every if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        self.score = {self.text[i]: model.get_score(i) for i in every if i not in special}
        # Pieces that no merging yields never come out.
        self.id_of = {self.text[i]: i for i in every if i not in special and self.merged(self.text[i]) == [self.text[i]]}
        self.size = np.array([len(t) for t in self.text])
        self.most = int(self.size.max())
        self.shorter = np.array([self._prefix(t) if t in self.id_of else -1 for t in self.text])
        self.found = ahocorasick.Automaton()
        for text, i in self.id_of.items():
            self.found.add_word(text, i)
        self.found.make_automaton()
        self.pair_key, self.pair_fits = np.full(PAIRS, -1, np.int64).view(np.uint64), np.zeros(PAIRS, bool)
        self.parts: dict[str, bytes] = {}
        self.cut = re.compile(self._cuts(), re.DOTALL).findall
        for probe in _PROBES:
            want = [self.begin, *model.encode(probe), self.end]
            if np.frombuffer(self.encode_all([probe])[0], "<u4").tolist() != want or self.decode(np.array(want)) != model.decode(want):
                raise ValueError(f"{path} is not a merge model with byte fallback and plain normalization")

    def _prefix(self, text: str) -> int:
        return next((self.id_of[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in self.id_of), -1)

    def _cuts(self) -> str:
        """A pattern of parts between which no piece reaches."""
        if any(re.search(f"[^{SPACE}]{SPACE}", t) for t in self.score):
            return ".+"
        marks = "".join(re.escape(c) for c in MARKS if not any(re.search(rf"[{LETTERS}]{re.escape(c)}", t) for t in self.score))
        word = rf"{SPACE}*[{LETTERS}]+(?=[{SPACE}{marks}]|\Z)"
        return rf"{word}|{SPACE}*[^{SPACE}]+|{SPACE}+"

    def merged(self, text: str) -> list[str]:
        """``text`` by the rule itself: the best union first, the leftmost of equal ones."""
        parts, score, none = list(text), self.score.get, float("-inf")
        union = [score(a + b, none) for a, b in pairwise(parts)]
        while union:
            best = max(union)
            if best == none:
                break
            at = union.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del union[at]
            if at:
                union[at - 1] = score(parts[at - 1] + parts[at], none)
            if at < len(union):
                union[at] = score(parts[at] + parts[at + 1], none)
        return parts

    def _fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each two neighbours come out unchanged when merged anew.  Checks already made are
        looked up in a table of bounded size; a later pair takes the slot of an earlier one."""
        key = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slot = (mix(key) & np.uint64(PAIRS - 1)).astype(np.int64)
        out = self.pair_fits[slot]
        new = np.flatnonzero(self.pair_key[slot] != key)
        if len(new):
            pairs, back = np.unique(key[new], return_inverse=True)
            made = np.empty(len(pairs), bool)
            for n, pair in enumerate(pairs.tolist()):
                a, b = self.text[pair >> 32], self.text[pair & 0xFFFFFFFF]
                made[n] = self.merged(a + b) == [a, b]
            out[new] = made[back]
            self.pair_key[slot[new]], self.pair_fits[slot[new]] = key[new], out[new]
        return out

    def _longest(self, text: str) -> np.ndarray:
        """The longest piece that starts at each place, -1 where there is none."""
        longest = np.full(len(text) + 1, -1, np.int64)
        for lo in range(0, len(text), WINDOW):
            part = text[lo : lo + WINDOW + self.most]
            found = np.fromiter(self.found.iter(part), np.dtype([("last", np.int64), ("piece", np.int64)]))
            start = found["last"] + 1 - self.size[found["piece"]]
            mine = start < WINDOW
            longest[start[mine] + lo] = found["piece"][mine]  # ends come in order: the longest stays
        return longest

    def _walk(self, text: str, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, pieces) of the parts ``text[first:last]``, all walked in step; piece -1 is a
        character that is none."""
        longest = self._longest(text)
        failed = np.zeros((len(text) >> 3) + 1, np.uint8)
        taken = np.full(len(text) + 1, -2, np.int32)  # the piece taken at a place
        came = np.full(len(text) + 1, -1, np.int64 if len(text) >> 31 else np.int32)  # where the piece before a place starts
        start, end, at = first.copy(), last.copy(), first.copy()
        before = np.full(len(at), -1)
        piece = longest[at]
        while len(at):
            none = longest[at] < 0
            stop = np.where(none, at + 1, at + self.size[np.maximum(piece, 0)])
            good = none | ((piece >= 0) & (stop <= end))
            stop[~good] = at[~good]
            good &= (failed[stop >> 3] >> (stop & 7).astype(np.uint8) & 1) == 0
            check = np.flatnonzero(good & ~none & (before >= 0))
            good[check] = self._fit(before[check], piece[check])
            shorter = ~good & ~none & (piece >= 0)
            dead = ~good & ~shorter
            go = np.flatnonzero(good)
            taken[at[go]] = before[go] = np.where(none[go], -1, piece[go])
            came[stop[go]] = at[go]
            at[go] = stop[go]
            piece[go] = longest[stop[go]]
            piece[shorter] = self.shorter[piece[shorter]]
            stuck = np.flatnonzero(dead)
            if len(stuck):
                np.bitwise_or.at(failed, at[stuck] >> 3, np.left_shift(1, at[stuck] & 7).astype(np.uint8))
                back = came[at[stuck]].astype(np.int64)
                old = taken[back]
                taken[back] = -2
                at[stuck] = back
                piece[stuck] = np.where(old >= 0, self.shorter[np.maximum(old, 0)], -1)
                before[stuck] = np.where(back > start[stuck], taken[came[back]], -1)
            left = at < end
            if not left.all():
                start, end, at, before, piece = start[left], end[left], at[left], before[left], piece[left]
        places = np.flatnonzero(taken >= -1)
        return places, taken[places]

    def _walk_one(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The same for a single long part, place by place."""
        longest, size, shorter = self._longest(text), self.size, self.shorter
        failed = bytearray((len(text) >> 3) + 1)
        taken, seen = array("i"), {}
        at, piece = 0, int(longest[0])
        while at < len(text):
            before = taken[-1] if taken else -1
            stop = at + 1
            if longest[at] >= 0:
                while piece >= 0:
                    stop = at + int(size[piece])
                    if not failed[stop >> 3] >> (stop & 7) & 1:
                        if before < 0:
                            break
                        if (before, piece) not in seen:
                            seen[before, piece] = bool(self._fit(np.array([before]), np.array([piece]))[0])
                        if seen[before, piece]:
                            break
                    piece = int(shorter[piece])
                if piece < 0:
                    failed[at >> 3] |= 1 << (at & 7)
                    old = taken.pop()
                    at -= int(size[old]) if old >= 0 else 1
                    piece = int(shorter[old]) if old >= 0 else -1
                    continue
            taken.append(piece if longest[at] >= 0 else -1)
            at = stop
            piece = int(longest[at])
        found = np.array(taken, np.int32)
        step = np.where(found >= 0, size[np.maximum(found, 0)], 1)
        return np.cumsum(step) - step, found

    def _ids(self, parts: list[str]) -> list[bytes]:
        """The ids of each part."""
        whole = [self.id_of.get(part, -1) for part in parts]
        out = [array("I", [i]).tobytes() if i >= 0 else b"" for i in whole]
        rest = [n for n, i in enumerate(whole) if i < 0 and parts[n]]
        if not rest:
            return out
        text = "".join([parts[n] for n in rest])
        last = np.cumsum([len(parts[n]) for n in rest])
        first = np.concatenate([[0], last[:-1]])
        # The automaton sees the parts side by side; what reaches over an edge is cut off.
        places, found = self._walk(text, first, last) if len(rest) > 1 or len(text) <= LONG_PART else self._walk_one(text)
        bounds = np.searchsorted(places, np.append(first, len(text))).tolist()
        ids = found.astype("<u4").tobytes()
        odd = set(np.searchsorted(first, places[found < 0], "right") - 1)
        for k, n in enumerate(rest):
            lo, hi = bounds[k], bounds[k + 1]
            if k in odd:
                run = zip(places[lo:hi].tolist(), found[lo:hi].tolist(), strict=True)
                out[n] = array("I", [i for at, p in run for i in ([p] if p >= 0 else [self.byte_ids[b] for b in text[at].encode()])]).tobytes()
            else:
                out[n] = ids[4 * lo : 4 * hi]
        return out

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Begin id, ids and end id of each text as little-endian 32-bit integers."""
        cut = [self.cut(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        known = self.parts
        if len(known) > CACHE:
            known.clear()
        new = list({p for parts in cut for p in parts if p not in known})
        short = [p for p in new if len(p) <= LONG_PART]
        known.update(zip(short, self._ids(short), strict=True))
        long = {p: i for p in new if len(p) > LONG_PART for i in self._ids([p])}
        of = (known | long if long else known).__getitem__
        begin, end = array("I", [self.begin]).tobytes(), array("I", [self.end]).tobytes()
        return [b"".join([begin, *map(of, parts), end]) for parts in cut]


def _each_byte() -> str:
    """The name of an error handler that replaces one byte at a time."""
    codecs.register_error("strandmill_each_byte", lambda e: ("�", e.start + 1))
    return "strandmill_each_byte"


def _worker(kind: type, path: str):
    """The worker's own ``kind`` of that file."""
    state = worker_state()
    if (kind.__name__, path) not in state:
        state[kind.__name__, path] = kind(path)
    return state[kind.__name__, path]


def encoder(model: str = MODEL) -> Column:
    """A function of a text column: its ids as little-endian 32-bit integers in one binary value."""
    @F.arrow_udf("binary")
    def ids_of(values: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coded = _worker(Pieces, vocabulary(model))
        for texts in values:
            for part in slices(pa.RecordBatch.from_arrays([texts], ["text"]), "text", SLICE):
                yield pa.array(coded.encode_all(part.column("text").to_pylist()), pa.binary())

    return ids_of


def decoder(model: str = MODEL) -> Column:
    """A function of such a binary column: the decoded text; null for null."""
    @F.arrow_udf("string")
    def text_of(values: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coded = _worker(Decoder, vocabulary(model))
        for ids in values:
            for part in slices(pa.RecordBatch.from_arrays([ids], ["ids"]), "ids", SLICE):
                yield pa.array([None if i is None else coded.decode(np.frombuffer(i, "<u4")) for i in part.column("ids").to_pylist()], pa.string())

    return text_of


def encode(df: DataFrame, text_col: str = "text", ids_col: str = "piece_ids", model: str = MODEL) -> DataFrame:
    """All columns and ``ids_col``, the ids of each whole text with begin and end."""
    return df.withColumn(ids_col, encoder(model)(F.col(text_col)))


def decode(df: DataFrame, ids_col: str = "piece_ids", text_col: str = "decoded", model: str = MODEL) -> DataFrame:
    """All columns and ``text_col``, the text that the ids stand for."""
    return df.withColumn(text_col, decoder(model)(F.col(ids_col)))
