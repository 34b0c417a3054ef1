"""Words of Arrow text columns as numpy spans and 64-bit hashes.

A whole slice of rows is handled at once: one ``bytes.translate`` maps letters and turns
separators into blanks, boolean masks find the word edges, and hashes are made from eight-byte
lanes.  Null texts count as empty.  Nothing here is per word, apart from words over
``LONG_WORD`` bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

LONG_WORD = 256
SLICE_BYTES = 4 << 20
_MIX1 = np.uint64(0xFF51AFD7ED558CCD)
_MIX2 = np.uint64(0xC4CEB9FE1A85EC53)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(32)

_BLANK = bytes(range(9, 14)) + b" "


def blank_table(lower: bool) -> bytes:
    """Words are runs of bytes other than blank, tab, line feed, VT, FF and CR."""
    return bytes(
        32 if b in _BLANK else b + 32 if lower and 65 <= b <= 90 else b for b in range(256)
    )


def alnum_table() -> bytes:
    """Lower-cased words of ASCII letters, digits and all bytes over 0x7F."""
    def kind(b: int) -> int:
        if 65 <= b <= 90:
            return b + 32
        return b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32

    return bytes(kind(b) for b in range(256))


BLANKS = blank_table(lower=False)
BLANKS_LOWER = blank_table(lower=True)
ALNUM_LOWER = alnum_table()


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of ``batch`` with about ``limit`` bytes of text each, one row at least."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = (np.cumsum(sizes, dtype=np.int64) - sizes) // limit
    cuts = np.flatnonzero(np.diff(group)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        yield batch.slice(lo, hi - lo)


class Words:
    """The words of some texts: ``first[r]:first[r + 1]`` are those of row ``r``."""

    def __init__(self, texts: pa.Array, table: bytes):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        low, high = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
        self.data = (data[low:high].to_pybytes() if data is not None and high > low else b"").translate(table)
        buf = np.frombuffer(self.data, np.uint8)
        bounds = offsets - low
        inside = np.zeros(len(buf) + 1, bool)
        inside[:-1] = buf != 32
        edge = np.zeros(len(buf) + 1, bool)
        edge[bounds] = True
        before = np.zeros(len(buf) + 1, bool)
        before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (edge | ~before))
        self.end = np.flatnonzero(before & (edge | ~inside))
        self.first = np.searchsorted(self.start, bounds)
        self.rows = len(texts)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.counts)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]]

    def array(self) -> pa.Array:
        """All words as one binary column."""
        buf = np.frombuffer(self.data, np.uint8)
        offsets = np.concatenate([[0], np.cumsum(self.end - self.start)])
        return pa.Array.from_buffers(
            pa.large_binary(), len(self), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(buf[buf != 32])])

    def text(self, lo: int, hi: int) -> bytes:
        """Words ``lo:hi`` joined by one blank."""
        return b" ".join(self.data[self.start[lo] : self.end[hi - 1]].split()) if hi > lo else b""

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        size = self.end - self.start
        out = size.astype(np.uint64) * _STEP
        lanes = np.ndarray((len(self.data) + 1,), "<u8", self.data + bytes(8), 0, (1,))
        at, todo = 0, np.flatnonzero(size <= LONG_WORD)
        while len(todo):
            lane = lanes[self.start[todo] + at]
            left = np.minimum(size[todo] - at, 8).astype(np.uint64)
            lane &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - left * np.uint64(8))
            out[todo] = mix(out[todo] ^ lane)
            at += 8
            todo = todo[size[todo] > at]
        for i in np.flatnonzero(size > LONG_WORD).tolist():
            out[i] = xxhash.xxh3_64_intdigest(self.word(i))
        return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> _SHIFT)) * _MIX1
    x = (x ^ (x >> _SHIFT)) * _MIX2
    return x ^ (x >> _SHIFT)


def roll(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive values, built by doubling."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, part, have, acc, length = np.uint64(_STEP), h, 1, None, 0
    with np.errstate(over="ignore"):
        while True:
            if width & have:
                acc = part[: len(h) - have + 1] if acc is None else (
                    acc[: len(h) - have - length + 1] * power + part[length : len(h) - have + 1])
                length += have
            if length == width:
                return mix(acc[:n])
            part = part[:-have] * power + part[have:]
            power, have = power * power, have * 2


def slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) of each run of ``width`` consecutive values."""
    part, have = values, 1
    while have * 2 <= width:
        part = pick(part[:-have], part[have:])
        have *= 2
    rest = width - have
    return pick(part[: len(part) - rest], part[rest:]) if rest else part
