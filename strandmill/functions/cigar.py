"""Vectorised reading of a batch of CIGAR strings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# Fixed values of the alignment format: which operations advance which sequence, and
# which of them end a run of exact matches.  "M" does neither here.
ON_TARGET = b"=XDN"
ON_QUERY = b"=XIS"
ENDS_RUN = b"XISDNH"


def operations(cigars: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, length, op byte) of every operation in the batch."""
    flat = cigars.cast(pa.large_binary())
    bounds = np.frombuffer(flat.buffers()[1], dtype=np.int64)[flat.offset:flat.offset + len(flat) + 1]
    text = np.frombuffer(flat.buffers()[2] or b"", dtype=np.uint8)[: bounds[-1]]
    digit = (text >= 48) & (text <= 57)
    at = np.flatnonzero(~digit)
    at = at[at >= bounds[0]]
    row = np.searchsorted(bounds, at, side="right") - 1
    left = np.maximum(np.concatenate(([-1], at[:-1])) + 1, bounds[row])
    width = at - left
    length = np.zeros(len(at), dtype=np.int64)
    for place in range(int(width.max(initial=0))):
        has = width > place
        length[has] += (text[at[has] - 1 - place].astype(np.int64) - 48) * 10**place
    return row, length, text[at]


def _before(row: np.ndarray, advance: np.ndarray) -> np.ndarray:
    """Sum of ``advance`` over the earlier operations of the same row."""
    total = np.cumsum(advance) - advance
    first = np.concatenate(([True], row[1:] != row[:-1]))
    return total - np.repeat(total[first], np.diff(np.append(np.flatnonzero(first), len(row))))


def exact_runs(cigars: pa.Array, min_len: int):
    """(row, target offset, query offset, length) of the runs of ``=`` long enough."""
    row, length, op = operations(cigars)
    if not len(row):
        return row, length, length, length
    advance = lambda kinds: np.where(np.isin(op, np.frombuffer(kinds, np.uint8)), length, 0)
    on_target, on_query = _before(row, advance(ON_TARGET)), _before(row, advance(ON_QUERY))
    stretch = np.cumsum(np.isin(op, np.frombuffer(ENDS_RUN, np.uint8)))
    same = np.flatnonzero(op == ord("="))
    if not len(same):
        return row[:0], length[:0], length[:0], length[:0]
    new = np.concatenate(([True], (row[same][1:] != row[same][:-1])
                          | (stretch[same][1:] != stretch[same][:-1])))
    heads = np.flatnonzero(new)
    total = np.add.reduceat(length[same], heads)
    first = same[heads]
    long = total >= min_len
    first, total = first[long], total[long]
    return row[first], on_target[first], on_query[first], total


# What a copy is made of, and what advances which sequence with "M" as a match.
COPIED = b"=M"


def copied_runs(cigars: pa.Array):
    """(row, target offset, query offset, length) of every step that both sequences share."""
    row, length, op = operations(cigars)
    if not len(row):
        return row, length, length, length
    moves = [np.where(np.isin(op, np.frombuffer(kinds + b"M", np.uint8)), length, 0) for kinds in (ON_TARGET, ON_QUERY)]
    on_target, on_query = (_before(row, m) for m in moves)
    same = np.flatnonzero(np.isin(op, np.frombuffer(COPIED, np.uint8)) & (length > 0))
    return row[same], on_target[same], on_query[same], length[same]
