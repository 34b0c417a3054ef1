"""Near-duplicates by the share of five-word runs that two texts have in common.

Two texts are linked if the Jaccard similarity of their sets of runs is ``SIMILAR`` or more.
Candidates agree in one of ``BANDS`` groups of ``ROWS`` MinHash values, which a pair at 0.8 misses
with probability 0.0002 and one at 0.9 practically never; each candidate is verified on the sets.

Texts of equal words are one node.  A bucket is first linked through one leader, which settles
groups of copies in a row per member.  What stays apart is then compared pair by pair in buckets of
up to ``BUCKET`` nodes, and in larger ones with further leaders, another in each bucket and
round, until a round finds no link.  What then still is apart in one bucket is paired wherever the
rarest runs of two sets meet, which they do for all sets as similar as asked, so no link is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm.bitmap import bitmap_of, passes
from strandmill.llm.near_dup import components, first_of, rows_of
from strandmill.llm.store import kept
from strandmill.llm.words import BLANKS_LOWER, Words, mix, roll, slices

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 16, 4
BUCKET = 24
LEAST_ROUNDS = 3
LEVELS = (2, 16, 128)
SKETCH = 512
SLICE = 1 << 20  # bytes of text whose runs are laid out at a time
_STEP = np.uint64(0x9E3779B97F4A7C15)
_DRAWN = np.random.default_rng(77).integers(0, 1 << 63, (2, BANDS * ROWS)).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code of each text's words, hashes of all runs, bounds of each text's runs).

    A text with fewer words than a run has one run, one without words has code 0 and no run.
    """
    words = Words(texts, BLANKS_LOWER)
    hashes, counts = words.hashes(), words.counts
    codes = np.zeros(words.rows, np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return codes, hashes, np.zeros(words.rows + 1, np.int64)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(counts.max()), _STEP))
        place = np.arange(len(hashes)) - np.repeat(words.first[:-1], counts)
        codes[some] = mix(np.add.reduceat(hashes * power[place], words.first[:-1][some]) + counts[some].astype(np.uint64))
    sizes = np.where(counts < SHINGLE, np.minimum(counts, 1), counts - SHINGLE + 1)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    row = np.repeat(np.arange(words.rows), sizes)
    start = words.first[row] + np.arange(len(row)) - bounds[row]
    rolled = roll(hashes, SHINGLE)
    out = codes[row]
    whole = counts[row] >= SHINGLE
    out[whole] = rolled[start[whole]]
    return codes, out, bounds


def _bands(runs: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts with runs, BANDS): one key per text and band."""
    starts = bounds[:-1][np.diff(bounds) > 0]
    keys = np.empty((len(starts), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for band in range(BANDS):
            key = np.full(len(starts), np.uint64(band + 1))
            for i in range(band * ROWS, band * ROWS + ROWS):
                key = mix(key * _STEP + np.minimum.reduceat((runs ^ _DRAWN[0, i]) * _DRAWN[1, i], starts))
            keys[:, band] = key
    return keys


def _prints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, node, runs, bands, __hash), one row per row of ``docs``; ``__hash`` is the XXH64 of the whole text."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, SLICE):
                codes, runs, bounds = _runs(part.column(text_col))
                sizes = np.diff(bounds)
                keys = _bands(runs, bounds) if len(runs) else np.zeros((0, BANDS), np.uint64)
                ends = np.concatenate([[0], np.cumsum((sizes > 0) * BANDS)]).astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(id_col), pa.array(codes.view(np.int64)), pa.array(sizes), bands, part.column("__hash")],
                    [id_col, "node", "runs", "bands", "__hash"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(id_col, text_col, F.xxhash64(text_col).alias("__hash"))
    return rows.mapInArrow(scan, f"`{id_col}` {kind}, node long, runs long, bands array<long>, `__hash` long")


def _sets(docs: DataFrame, members: DataFrame, text_col: str) -> DataFrame:
    """(node, set): the sorted different runs, as 32-bit hashes, of all nodes in ``members`` and few others."""
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(mix(batch.column("node").to_numpy().view(np.uint64)).view(np.int64))], ["h"])

    shared = docs.sparkSession.sparkContext.broadcast(bitmap_of(members.select("node").distinct().mapInArrow(hashed, "h long"), "h"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            for part in slices(batch, text_col, SLICE):
                codes, runs, bounds = _runs(part.column(text_col))
                node, found = [], []
                for r in np.flatnonzero(passes(shared.value, mix(codes))).tolist():
                    if (code := int(codes[r])) not in done:
                        if len(done) < 1 << 16:
                            done.add(code)
                        node.append(code)
                        found.append(np.unique((runs[bounds[r] : bounds[r + 1]] >> np.uint64(32)).astype(np.uint32).view(np.int32)))
                ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                values = np.concatenate(found) if found else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(node, np.uint64).view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], ["node", "set"])

    return docs.select(text_col).mapInArrow(scan, "node long, set array<int>").groupBy("node").agg(F.first("set").alias("set"))


def _verified(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """The (a, b) of ``pairs`` whose sets are similar."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            good = np.zeros(batch.num_rows, bool)
            for r in range(batch.num_rows):
                one, two = x[r].values.to_numpy(), y[r].values.to_numpy()
                both = len(np.intersect1d(one, two, assume_unique=True))
                good[r] = both >= similar * (len(one) + len(two) - both) - 1e-9
            yield batch.select(["a", "b"]).filter(pa.array(good))

    second = pairs.join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    return second.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").select("a", "b", "x", "y").mapInArrow(scan, "a long, b long")


def _pairs(rows: DataFrame) -> DataFrame:
    """Different (a, b) of (one, two)."""
    return rows.where("one != two").select(F.least("one", "two").alias("a"), F.greatest("one", "two").alias("b")).distinct()


def _met(sets: DataFrame) -> DataFrame:
    """(run, n): the runs of ``sets`` (root, set) that sets of different roots have, and how many sets have them.

    A batch sends a run once.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            run = batch.column("set").flatten().to_numpy(zero_copy_only=False)
            root = np.repeat(batch.column("root").to_numpy(), batch.column("set").value_lengths().to_numpy())
            order = np.lexsort((root, run))
            run, root = run[order], root[order]
            ends = np.flatnonzero(np.diff(run, append=run[-1:] - 1))
            first = np.concatenate([[0], ends + 1])[: len(ends)]
            columns = [run[first], ends - first + 1, root[first], root[ends]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["run", "n", "lo", "hi"])

    rows = sets.select("root", "set").mapInArrow(scan, "run int, n long, lo long, hi long")
    found = rows.groupBy("run").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return found.where("lo != hi").select("run", "n")


def _places(run: np.ndarray) -> np.ndarray:
    """Well-mixed hashes of 32-bit runs."""
    return mix((run.astype(np.int64).view(np.uint64) + np.uint64(1)) * _STEP)


def _common(met: DataFrame) -> list[tuple[np.ndarray, int]]:
    """Bitmaps of the runs in ``met`` that many sets have, one for each number in ``LEVELS``."""
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_places(batch.column("run").to_numpy()).view(np.int64))], ["h"])

    return [bitmap_of(met.where(F.col("n") >= level).mapInArrow(hashed, "h long"), "h") for level in LEVELS]


def _rarest(sets: DataFrame, common: list[tuple[np.ndarray, int]], similar: float) -> DataFrame:
    """(node, root, n, sketch, more, less) of the ``sets`` (node, root, set) that may be similar to one of another root.

    ``more`` are so many of the rarest runs of a set that one of them is in every similar set, ``less`` those of which
    one is in every similar set that is no smaller.  ``sketch`` tells for each of ``SKETCH`` classes of runs whether
    their number is odd.
    """
    shared = sets.sparkSession.sparkContext.broadcast(common)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, sizes, sketches, more, less = [], [], [], [], []
            for r, runs in enumerate(batch.column("set")):
                run = runs.values.to_numpy()
                place = _places(run)
                level = sum(passes(bits, place).astype(np.int8) for bits in shared.value)
                # Runs of no other root come first in the order and meet nothing.
                met = np.flatnonzero(level)
                left = len(met) - _least(len(run), similar) + 1
                if left <= 0:
                    continue
                order = met[np.lexsort((run[met], level[met]))]
                keep.append(r)
                sizes.append(len(run))
                more.append(run[order[:left]])
                less.append(run[order[: max(0, len(met) - _least(2 * len(run), similar / (1 + similar)) + 1)]])
                odd = np.bincount((place & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1
                sketches.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("node").take(take), batch.column("root").take(take), pa.array(sizes, pa.int64()),
                 pa.array(sketches, pa.list_(pa.int64())), pa.array(more, pa.list_(pa.int32())), pa.array(less, pa.list_(pa.int32()))],
                ["node", "root", "n", "sketch", "more", "less"])

    return sets.select("node", "root", "set").mapInArrow(scan, "node long, root long, n long, sketch array<long>, more array<int>, less array<int>")


def _least(n: int, share: float) -> int:
    return math.ceil(n * share - 1e-9)


def _meeting(rest: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """Pairs (one, two) of the (node, root) in ``rest`` with different roots that may be similar.

    Similar sets share ``similar`` of each, so of the first runs of both in any one order, as many as may be missing
    and one more, at least one is the same.  The order starts with the rarest, which few sets have.  Sets whose
    sketches differ in more classes than similar sets differ in runs are no pair.
    """
    own = kept(rest.join(sets, "node").select("node", "root", "set"), "own")
    first = kept(_rarest(own, _common(kept(_met(own), "met")), similar), "rarest")
    large = first.select(F.col("node").alias("one"), "root", "n", "sketch", F.explode("more").alias("run"))
    small = first.select(F.col("node").alias("two"), F.col("root").alias("root2"), F.col("n").alias("n2"), F.col("sketch").alias("sketch2"), F.explode("less").alias("run"))
    odd = sum(F.bit_count(F.col("sketch")[i].bitwiseXOR(F.col("sketch2")[i])) for i in range(SKETCH // 64))
    both = F.ceil((F.col("n") + F.col("n2")) * F.lit(similar / (1 + similar)) - 1e-9)
    return large.join(small, "run").where(
        (F.col("root") != F.col("root2")) & ((F.col("n") > F.col("n2")) | ((F.col("n") == F.col("n2")) & (F.col("one") > F.col("two"))))
        & (F.col("n2") >= F.lit(similar) * F.col("n") - 1e-9) & (odd <= F.col("n") + F.col("n2") - 2 * both)).select("one", "two")


def links(docs: DataFrame, nodes: DataFrame, text_col: str, similar: float = SIMILAR, bucket: int = BUCKET) -> DataFrame:
    """(fp, root) of the nodes that have a link; ``nodes`` are different (node, bands)."""
    spread = nodes.select(F.explode("bands").alias("key"), "node")
    first = F.min_by("node", F.struct(F.xxhash64("node"), "node"))
    heads = kept(spread.groupBy("key").agg(F.count("*").alias("n"), first.alias("leader")).where("n > 1"), "heads")
    members = kept(spread.join(heads, "key"), "members")
    sets = kept(_sets(docs, members, text_col), "sets")
    checked = kept(_pairs(members.select(F.col("node").alias("one"), F.col("leader").alias("two"))), "pairs")
    found = kept(_verified(checked, sets, similar), "verified")
    roots = kept(components(found), "roots")
    members = members.select("key", "n", "node")
    turn = 0
    while True:
        turn += 1
        placed = members.join(roots.withColumnRenamed("fp", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
        placed = kept(placed, "placed")
        next_one = F.min_by(F.struct("node", "root"), F.struct(F.xxhash64("key", "node", F.lit(turn)), "node"))
        apart = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), next_one.alias("leader")).where("lo != hi")
        open_rows = placed.join(apart.select("key", "leader"), "key")
        rows = open_rows.where((F.col("n") > bucket) & (F.col("root") != F.col("leader.root"))).select(F.col("node").alias("one"), F.col("leader.node").alias("two"))
        if turn == 1:
            small = open_rows.where(F.col("n") <= bucket).select("key", "node", "root")
            other = small.select("key", F.col("node").alias("two"), F.col("root").alias("root2"))
            rows = rows.unionByName(small.withColumnRenamed("node", "one").join(other, "key").where("one < two and root != root2").select("one", "two"))
        fresh = kept(_pairs(rows).join(checked, ["a", "b"], "left_anti"), "pairs")
        more = kept(_verified(fresh, sets, similar), "verified")
        ended = more.isEmpty()
        if ended and (turn >= LEAST_ROUNDS or fresh.isEmpty()):
            rest = kept(open_rows.where(F.col("n") > bucket).select("node", "root").distinct(), "rest")
            if rest.isEmpty():
                return roots
            last = _pairs(_meeting(rest, sets, similar)).join(checked.unionByName(fresh), ["a", "b"], "left_anti")
            more = kept(_verified(last, sets, similar), "verified")
            return roots if more.isEmpty() else kept(components(found.unionByName(more)), "roots")
        if not ended:
            found = found.unionByName(more)
            roots = kept(components(found), "roots")
        checked = checked.unionByName(fresh)
        members = members.where(F.col("n") > bucket)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR, bucket: int = BUCKET, among: DataFrame | None = None,
) -> DataFrame:
    """(id, node, root, __hash): one row per row of ``docs``, rows of one root are a group; ``__hash`` is the XXH64
    of the whole text.  With ``among``, only the rows that ``near_dup.rows_of`` finds for it."""
    prints = _prints(docs, id_col, text_col)
    prints = kept(prints if among is None else rows_of(prints, among, id_col), "prints")
    nodes = kept(prints.groupBy("node").agg(F.first("bands").alias("bands")), "nodes")
    roots = links(docs, nodes, text_col, similar, bucket).withColumnRenamed("fp", "node")
    named = prints.select(id_col, "node", "__hash").join(roots, "node", "left")
    return named.select(id_col, "node", F.coalesce("root", "node").alias("root"), "__hash")


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR, bucket: int = BUCKET, among: DataFrame | None = None,
) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that with the smallest id.

    Without an id, or among equal ids, it is one with the smallest node.  ``among`` as in ``near_duplicates``.
    """
    found = near_duplicates(docs, id_col, text_col, similar, bucket, among)
    return rows_of(docs, first_of(found, id_col, "node"), id_col, text_col)
