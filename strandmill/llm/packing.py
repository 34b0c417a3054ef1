"""Packing by minimum bin slack.

A document is cut into full windows; what is left has a length below the window.  Only the table
of these lengths with their counts (at most ``window - 1`` entries) is planned on the driver:

* Around the longest length left, a bitset dynamic program over (length, count) finds the
  reachable sum closest to the window, and walking its stages back gives how often each length is
  used.  That pattern is applied as often as the counts allow, which uses up one length.
* Where even the best pattern has more than ``slack`` free, the length goes to the tail.  The tail
  is laid one after the other and cut at window borders, and its last, partly filled sequence is
  cut at powers of two, so that it needs no padding.

Rows find their place from their rank among equal lengths, which is counted in blocks of rows and
carried over the blocks, so that no length gathers in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandmill.llm import tokens
from strandmill.llm.store import kept
from strandmill.llm.wavelet import crc_of
from strandmill.llm.words import slices

WINDOW = 4096
SLACK = 4
PLACE_BYTES = 8 << 20


def best_fill(counts: dict[int, int], window: int) -> dict[int, int]:
    """How often to use each length so that the sum is as close to ``window`` as possible.

    Longer lengths come first.  Each count is split into powers of two, and bit ``s`` of a stage
    says that the sum ``s`` can be reached with the lengths so far.
    """
    mask, reach = (1 << (window + 1)) - 1, 1
    stages = []
    for length in sorted(counts, reverse=True):
        left, take = min(counts[length], window // length), 1
        while left:
            take = min(take, left)
            stages.append((reach, length, take))
            reach |= (reach << (length * take)) & mask
            left, take = left - take, take * 2
        if reach >> window & 1:
            break
    total = reach.bit_length() - 1
    used: dict[int, int] = {}
    for before, length, take in reversed(stages):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + take
            total -= length * take
    return used


def plan(counts: dict[int, int], window: int = WINDOW, slack: int = SLACK) -> tuple[list[tuple[int, dict[int, int]]], dict[int, int]]:
    """(patterns as (times, {length: uses}), counts left over for the tail)."""
    left, tail, patterns = {k: v for k, v in counts.items() if v}, {}, []
    while left:
        # The longest is the hardest to place, so each pattern is built around it.
        longest = max(left)
        others = {k: v - (k == longest) for k, v in left.items() if v > (k == longest) and k <= window - longest}
        used = best_fill(others, window - longest)
        used[longest] = used.get(longest, 0) + 1
        if sum(k * v for k, v in used.items()) < window - slack:
            tail[longest] = left.pop(longest)
            continue
        times = min(left[k] // v for k, v in used.items())
        patterns.append((times, used))
        for k, v in used.items():
            left[k] -= times * v
            if not left[k]:
                del left[k]
    return patterns, tail


def _layout(counts: dict[int, int], window: int, slack: int) -> tuple[dict[str, np.ndarray], int, int]:
    """Arrays that tell where the remainder of a given length and rank goes.

    Slots of one length are numbered in plan order: rows (length, rank_from, sequence, uses, offset)
    say that ranks from rank_from on lie in sequence + (rank - rank_from) // uses, at offset +
    ((rank - rank_from) % uses) * length.  Tail rows have uses 0 and offset = place in the tail.
    """
    patterns, left = plan(counts, window, slack)
    rows, seen, sequence = [], {}, 0
    for times, used in patterns:
        offset = 0
        for length in sorted(used, reverse=True):
            rows.append((length, seen.get(length, 0), sequence, used[length], offset))
            seen[length] = seen.get(length, 0) + times * used[length]
            offset += used[length] * length
        sequence += times
    place = 0
    for length in sorted(left, reverse=True):
        rows.append((length, seen.get(length, 0), sequence, 0, place))
        place += left[length] * length
    rows.sort()
    columns = {n: np.array([r[i] for r in rows], np.int64) for i, n in enumerate(("length", "rank", "sequence", "uses", "offset"))}
    return columns, sequence, place


def _tail_pieces(place: int, length: int, total: int, window: int, first: int) -> list[tuple[int, int, int, int]]:
    """(start, length, sequence, offset) of a run at ``place`` of a tail of ``total`` ids."""
    whole = total // window
    rest = total - whole * window
    out, at, end = [], place, place + length
    while at < end:
        number = at // window
        if number < whole:
            base, size, sequence = number * window, window, first + number
        else:
            base, sequence, size, left = whole * window, first + whole, 0, rest
            while left:  # the part that holds ``at``, largest power of two first
                size = 1 << (left.bit_length() - 1)
                if at < base + size:
                    break
                base, left, sequence = base + size, left - size, sequence + 1
        stop = min(end, base + size)
        out.append((at - place, stop - at, sequence, at - base))
        at = stop
    return out


def _encoded(docs: DataFrame, id_col: str, text_col: str, path: str, window: int) -> DataFrame:
    """One row per document: n ids, of which n mod window are its remainder ``rest``.

    block is the task that read it; full_before counts full windows of the block before the row,
    rank its rows before with the same remainder.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fulls, seen = 0, np.zeros(window, np.int64)
        for part, ids, bounds in tokens.encoded(batches, "text", path):
            size = np.diff(bounds)
            rest, full = size % window, size // window
            order = np.argsort(rest, kind="stable")
            ordered = rest[order]
            first = np.searchsorted(ordered, ordered)
            rank = np.empty(len(rest), np.int64)
            rank[order] = np.arange(len(rest)) - first
            rank += seen[rest]
            seen += np.bincount(rest, minlength=window)
            before = fulls + np.cumsum(full) - full
            raw = ids.astype("<u4")
            if len(raw) and raw.max() < 65536:
                raw = raw.astype("<u2")
            width = raw.dtype.itemsize
            blobs = pa.Array.from_buffers(
                pa.large_binary(), part.num_rows, [None, pa.py_buffer((bounds * width).astype(np.int64)), pa.py_buffer(raw.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("block"), pa.array(size), pa.array(rest),
                 pa.array(rank), pa.array(before), pa.array(np.full(len(size), width, np.int32)), blobs.cast(pa.binary())],
                ["id", "block", "n", "rest", "rank", "full_before", "width", "ids"])
            fulls += int(full.sum())

    kind = docs.schema[id_col].dataType.simpleString()
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.spark_partition_id().alias("block"))
    return named.mapInArrow(scan, f"id {kind}, block int, n long, rest long, rank long, full_before long, width int, ids binary")


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None,
    window: int = WINDOW, slack: int = SLACK,
) -> DataFrame:
    """(id, start, length, sequence_id, offset, doc_tokens, ids array<int>): one row per piece.

    ``start`` counts the document's ids before the piece, ``offset`` the sequence's.  Null texts
    count as empty and hold the end id alone; null and repeated ids are kept as they are.
    Sequences are as long as the window, but for some with up to ``slack`` ids less and the
    last ones, whose lengths are powers of two.
    """
    return _packed(docs, id_col, text_col, vocabulary, window, slack, "ids", "array<int>", _lists)


def _lists(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))


def pack_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, window: int = WINDOW, slack: int = SLACK) -> DataFrame:
    """Like ``pack``, with the CRC-32 of a piece's ids instead of the ids."""
    return _packed(docs, id_col, text_col, vocabulary, window, slack, "ids_crc32", "long", crc_of)


def _packed(docs, id_col, text_col, vocabulary, window, slack, column, column_kind, make) -> DataFrame:
    rows = kept(_encoded(docs, id_col, text_col, vocabulary or tokens.vocabulary(), window), "encoded", "zstd")
    kind = rows.schema["id"].dataType.simpleString()
    # Per block and remainder: rows before.  Both tables are far smaller than the rows.
    per = rows.groupBy("rest", "block").agg(F.count("*").alias("m"))
    along = Window.partitionBy("rest").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ranks = per.select("rest", "block", F.coalesce(F.sum("m").over(along), F.lit(0)).alias("rank_before"))
    histogram = {r.rest: r.m for r in per.where("rest > 0").groupBy("rest").agg(F.sum("m").alias("m")).collect()}
    layout, tail_first, tail = _layout(histogram, window, slack)
    after = tail_first + tail // window + (tail % window).bit_count()
    blocks = rows.groupBy("block").agg(F.sum(F.expr(f"n div {window}")).alias("fulls"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", F.coalesce(F.sum("fulls").over(before), F.lit(0)).alias("block_fulls"))
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(layout)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        step = np.int64(1) << np.int64(44)
        keys = plan["length"] * step + plan["rank"]
        for batch in (part for whole in batches for part in slices(whole, "ids", PLACE_BYTES)):
            get = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("n", "rest", "rank", "fulls", "rank_before", "width")}
            source, start, length, sequence, offset = [], [], [], [], []
            full = get["n"] // window
            spot = np.searchsorted(keys, get["rest"] * step + get["rank"] + get["rank_before"], "right") - 1
            for r in range(batch.num_rows):
                pieces = [(i * window, window, after + int(get["fulls"][r]) + i, 0) for i in range(int(full[r]))]
                if rest := int(get["rest"][r]):
                    at, base = int(spot[r]), int(full[r]) * window
                    inner = int(get["rank"][r] + get["rank_before"][r] - plan["rank"][at])
                    if uses := int(plan["uses"][at]):
                        pieces.append((base, rest, int(plan["sequence"][at]) + inner // uses, int(plan["offset"][at]) + inner % uses * rest))
                    else:
                        place = int(plan["offset"][at]) + inner * rest
                        pieces += [(base + a, b, c, d) for a, b, c, d in _tail_pieces(place, rest, tail, window, tail_first)]
                for a, b, c, d in pieces:
                    source.append(r)
                    start.append(a)
                    length.append(b)
                    sequence.append(c)
                    offset.append(d)
            raw = [np.frombuffer(x.as_buffer(), "<u4" if w == 4 else "<u2") for x, w in zip(batch.column("ids"), get["width"].tolist(), strict=True)]
            ids = np.concatenate(raw)
            bounds = np.concatenate([[0], np.cumsum(length)])
            take = pa.array(source, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(take), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(sequence, pa.int64()),
                 pa.array(offset, pa.int64()), batch.column("n").take(take), make(ids, bounds)],
                ["id", "start", "length", "sequence_id", "offset", "doc_tokens", column])

    # Both tables on the right have few rows: one per task and remainder, one per task.
    bases = ranks.join(blocks, "block")
    joined = rows.join(bases, ["block", "rest"]).select(
        "id", "n", "rest", "rank", "rank_before", (F.col("full_before") + F.col("block_fulls")).alias("fulls"), "width", "ids")
    return joined.mapInArrow(place, f"id {kind}, start long, length long, sequence_id long, offset long, doc_tokens long, `{column}` {column_kind}")
