"""Hard negatives of anchor vectors, exact, behind rotated one-bit codes.

Vectors become integers (``floor(scale * x)``) and are turned by a pseudo-rotation.  The signs of the
turned vector are its code; stored with it is the alignment, the inner product of the vector with the
unit vector that the code stands for.  What that leaves over is orthogonal to the code vector and gets
a code and alignment of its own, ``LEVELS`` times, with the length of the rest stored each time.

An anchor is cut into bit planes, so its inner products with code vectors are popcounts.  Summed with
the alignments they estimate its score with a row, and by Cauchy-Schwarz the error is at most the
length of the row's rest times that of the part of the anchor orthogonal to the last code vector, plus
the known error of the bit planes.  A row whose interval cannot reach the places asked for is dropped,
level by level; rows that stay are scored on the integers.  No row that belongs to the result is lost, whatever
the vectors.

Anchors meet all rows in groups of one part of the anchors and one part of the rows, dealt by a
hash of the id: a frequent label or vector makes no group larger.

Rows with a null id, label or vector, with null or non-finite components, or with another number of
components than most take no part.  Of rows that share an id the one with the smallest label,
then vector, counts, so repeated rows count once.  Ties go to the smaller id.  Integers beyond what
keeps every score in 63 bits saturate (2^28 for 64 components).  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.llm.neighbours import turned
from strandmill.llm.store import kept

LEVELS = 4
PLANES = 8  # bits of an anchor's components in the popcounts
PART = 4096  # rows, and anchors, of a group
PAIRS = 1 << 19  # pairs looked at together
SCORED = 1 << 16


def coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, alignments, lengths of the rest) of turned rows: one of each per level."""
    rest, size = x.copy(), np.sqrt(x.shape[1])
    codes, align, left = [], [], []
    for _ in range(LEVELS):
        up = rest > 0
        codes.append(np.packbits(up, axis=1, bitorder="little").view("<u8"))
        align.append(np.abs(rest).sum(axis=1) / size)
        rest -= np.where(up, 1.0, -1.0) * (align[-1] / size)[:, None]
        left.append(np.linalg.norm(rest, axis=1))
    return np.stack(codes, axis=1), np.stack(align, axis=1), np.stack(left, axis=1)


class Planes:
    """Turned anchors as bit planes: component i is ``low + step * u[i]`` and a known error."""

    def __init__(self, x: np.ndarray):
        self.dims = x.shape[1]
        self.norm = np.linalg.norm(x, axis=1)
        self.low = x.min(axis=1)
        self.step = np.maximum((x.max(axis=1) - self.low) / ((1 << PLANES) - 1), 1e-300)
        u = np.clip(np.rint((x - self.low[:, None]) / self.step[:, None]), 0, (1 << PLANES) - 1)
        self.error = np.abs(x - self.low[:, None] - self.step[:, None] * u).sum(axis=1) / np.sqrt(self.dims)
        self.sum = u.sum(axis=1)
        bits = (u.astype(np.int64)[:, None, :] >> np.arange(PLANES)[:, None]) & 1
        self.bits = np.packbits(bits.astype(np.uint8), axis=2, bitorder="little").view("<u8")

    def along(self, anchor: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Inner products with the unit vectors of the codes, up to ``error``."""
        ones = np.bitwise_count(code).sum(axis=1, dtype=np.int64)
        total = np.zeros(len(anchor), np.int64)
        for plane in range(PLANES):
            total += np.bitwise_count(self.bits[anchor, plane] & code).sum(axis=1, dtype=np.int64) << plane
        value = self.low[anchor] * (2 * ones - self.dims) + self.step[anchor] * (2 * total - self.sum[anchor])
        return value / np.sqrt(self.dims)


def survivors(
    planes: Planes, block: np.ndarray, codes: np.ndarray, align: np.ndarray, left: np.ndarray, mask: np.ndarray,
    keep: Callable[[np.ndarray, np.ndarray], np.ndarray],
) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (anchor of the block, row) of ``mask`` whose intervals ``keep`` lets through at every
    level; it gets matrices of lower and upper bounds, minus infinity where a pair is out."""
    guess, error = np.zeros(mask.shape), np.zeros(mask.shape)
    for level in range(LEVELS):
        a, r = np.nonzero(mask)
        if not len(a):
            break
        near, off = planes.along(block[a], codes[r, level]), planes.error[block[a]]
        guess[a, r] += align[r, level] * near
        error[a, r] += align[r, level] * off
        norm = planes.norm[block[a]]
        across = np.sqrt(np.maximum(norm**2 - np.maximum(np.abs(near) - off, 0) ** 2, 0))
        # The margin covers rounding: of the doubles, and of bounds against integers.
        half = error[a, r] + across * left[r, level] + 1e-9 * norm * (align[r, 0] + left[r, 0]) + 0.25
        lower, upper = np.full(mask.shape, -np.inf), np.full(mask.shape, -np.inf)
        lower[a, r], upper[a, r] = guess[a, r] - half, guess[a, r] + half
        mask = mask & keep(lower, upper)
    return np.nonzero(mask)


def kth_largest(values: np.ndarray, k: int) -> np.ndarray:
    """Of each row, as a column; minus infinity where there are fewer."""
    n = values.shape[1]
    if n < k:
        return np.full((len(values), 1), -np.inf)
    return np.partition(values, n - k, axis=1)[:, n - k, None]


def scores(a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> np.ndarray:
    """Integer inner products of the named rows."""
    out = np.empty(len(at_a), np.int64)
    for lo in range(0, len(out), SCORED):
        part = slice(lo, lo + SCORED)
        out[part] = np.einsum("ij,ij->i", a[at_a[part]], b[at_b[part]])
    return out


def first_of_each(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best of each group, best first."""
    order = np.lexsort((ids, -score, group))
    of = group[order]
    return order[np.arange(len(order)) - np.searchsorted(of, of) < k]


def _blocks(anchors: np.ndarray, rows: int):
    step = max(1, PAIRS // max(rows, 1))
    for lo in range(0, len(anchors), step):
        yield anchors[lo : lo + step]


class _Side:
    """One side of a group as numpy arrays."""

    def __init__(self, table: pa.Table, dims: int):
        table = table.combine_chunks()
        self.table, self.rows = table, len(table)
        self.id, self.label = table.column("id").to_numpy(), table.column("label").to_numpy()
        ints = self._flat("ints", np.int64)
        self.ints = ints.reshape(self.rows, len(ints) // max(self.rows, 1))
        self.codes = self._flat("codes", np.int64).view(np.uint64).reshape(self.rows, LEVELS, dims // 64)
        self.align, self.left = (self._flat(c, np.float64).reshape(self.rows, LEVELS) for c in ("align", "rest"))

    def _flat(self, name: str, kind: type) -> np.ndarray:
        return self.table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind)

    def lists(self, name: str) -> list[list[int]]:
        return [x or [] for x in self.table.column(name).to_pylist()]


def _dims(size: int) -> int:
    return max(64, 1 << max(size - 1, 0).bit_length())


def _planes(side: _Side, dims: int) -> Planes:
    return Planes(turned(side.ints.astype(np.float64), 0, dims))


def prepared(table: DataFrame, id_col: str, label_col: str | Column, vector_col: str, scale: int) -> tuple[DataFrame, int]:
    """(id, label, ints, codes, align, rest), one row per id that takes part, and the padded size."""
    v = F.col(vector_col)
    label = F.col(label_col) if isinstance(label_col, str) else label_col
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall(
        "v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), v.cast("array<double>").alias("v")).where(usable)
    common = rows.groupBy(F.size("v").alias("s")).count().orderBy(F.desc("count"), "s").first()
    size = common.s if common else 1
    most = 1 << (62 - max(size - 1, 0).bit_length()) // 2
    ints = F.transform("v", lambda x: F.greatest(F.least(F.floor(x * scale).cast("double"), F.lit(most - 1.0)), F.lit(float(-most))).cast("int"))
    rows = rows.where(F.size("v") == size).select("id", F.struct("label", ints.alias("ints")).alias("row"))
    rows = rows.groupBy("id").agg(F.min("row").alias("row")).select("id", "row.label", "row.ints")
    dims = _dims(size)

    def scan(batches):
        for batch in batches:
            x = batch.column("ints").flatten().to_numpy(zero_copy_only=False)
            x = x.reshape(batch.num_rows, len(x) // max(batch.num_rows, 1))
            codes, align, left = coded(turned(x.astype(np.float64), 0, dims))
            new = [pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * (a.size // max(len(x), 1)), a.ravel())
                   for a in (codes.view(np.int64), align, left)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], ["id", "label", "ints", "codes", "align", "rest"])

    schema = "id long, label long, ints array<int>, codes array<long>, align array<double>, rest array<double>"
    return kept(rows.mapInArrow(scan, schema), "coded"), dims


def _groups(anchors: DataFrame, rows: DataFrame):
    """Both sides, each anchor part with each row part; the sizes of the parts are bounded."""
    spark = rows.sparkSession
    least = spark.sparkContext.defaultParallelism
    row_parts = max(-(-rows.count() // PART), least)
    anchor_parts = max(-(-anchors.count() // PART), 1)

    def deal(side: DataFrame, mine: int, others: int, own: str, other: str) -> DataFrame:
        return side.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(mine)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    extra = {c: F.lit(None).cast(anchors.schema[c].dataType) for c in anchors.columns if c not in rows.columns}
    both = deal(anchors, anchor_parts, row_parts, "part_a", "part_r").withColumn("anchor", F.lit(True)).unionByName(
        deal(rows.withColumns(extra), row_parts, anchor_parts, "part_r", "part_a").withColumn("anchor", F.lit(False)))
    return both.groupBy("part_a", "part_r")


def positives_of(anchors: DataFrame, rows: DataFrame, dims: int, k: int) -> DataFrame:
    """(anchor_id, id, score): the k best other rows of the anchor's label."""
    def pick(group: pa.Table) -> pa.Table:
        side = group.column("anchor")
        a, r = _Side(group.filter(side), dims), _Side(group.filter(pa.compute.invert(side)), dims)
        found = []
        planes = _planes(a, dims) if a.rows and r.rows else None
        for label in np.intersect1d(a.label, r.label):
            of = np.flatnonzero(r.label == label)
            for block in _blocks(np.flatnonzero(a.label == label), len(of)):
                mask = a.id[block][:, None] != r.id[of]
                x, y = survivors(planes, block, r.codes[of], r.align[of], r.left[of], mask, lambda lower, upper: upper >= kth_largest(lower, k))
                x, y = block[x], of[y]
                score = scores(a.ints, r.ints, x, y)
                best = first_of_each(x, score, r.id[y], k)
                found.append((a.id[x[best]], r.id[y[best]], score[best]))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(("anchor_id", "id", "score"), columns, strict=True)))

    near = _groups(anchors, rows).applyInArrow(pick, "anchor_id long, id long, score long")
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id"))
    return near.withColumn("place", place).where(F.col("place") <= k).drop("place")


def negatives_of(anchors: DataFrame, rows: DataFrame, dims: int, k: int, low: int, high: int) -> DataFrame:
    """(anchor_id, positive_id, positive_score, rank, id, score); ``anchors`` carry ``positives``, at
    most a few of (id, score)."""
    def pick(group: pa.Table) -> pa.Table:
        side = group.column("anchor")
        a, r = _Side(group.filter(side), dims), _Side(group.filter(pa.compute.invert(side)), dims)
        found = [[np.zeros(0, np.int64)] * 5]
        planes = _planes(a, dims) if a.rows and r.rows else None
        lists = a.lists("positives")
        most = max(map(len, lists), default=0)
        # Of anchors with fewer positives the last repeats.
        known = np.array([[[p["id"], p["score"]] for p in x + x[-1:] * (most - len(x))] for x in lists], np.int64).reshape(a.rows, most, 2)
        for block in _blocks(np.arange(a.rows), r.rows) if planes and most else ():
            ids, tops = known[block, :, 0], known[block, :, 1]

            def keep(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
                some = np.zeros(lower.shape, bool)
                for top in tops.T[:, :, None]:  # noqa: B023
                    least = top * low / high
                    inside = (lower >= least) & (upper <= top)
                    bar = kth_largest(np.where(inside, lower, -np.inf), k)
                    some |= (upper >= np.maximum(least, bar)) & (lower <= top)
                return some

            x, y = survivors(planes, block, r.codes, r.align, r.left, a.label[block][:, None] != r.label, keep)
            score = scores(a.ints, r.ints, block[x], y)
            for place in range(most):
                new = np.array([place < len(lists[b]) for b in block], bool)
                top = tops[x, place]
                fits = np.flatnonzero(new[x] & (in_window(score, top, low, high)))
                best = fits[first_of_each(x[fits], score[fits], r.id[y[fits]], k)]
                found.append([a.id[block[x[best]]], ids[x[best], place], top[best], r.id[y[best]], score[best]])
        columns = [np.concatenate(c) for c in zip(*found, strict=True)]
        return pa.table(dict(zip(("anchor_id", "positive_id", "positive_score", "id", "score"), columns, strict=True)))

    near = _groups(anchors, rows).applyInArrow(pick, "anchor_id long, positive_id long, positive_score long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def in_window(score: np.ndarray, top: np.ndarray, low: int, high: int) -> np.ndarray:
    """low * top <= high * score <= high * top, without products beyond 64 bits."""
    whole, part = np.divmod(top, high)
    least = whole * low + -(-part * low // high)
    return (score >= least) & (score <= top)


def mine(
    table: DataFrame, id_col: str = "vec_id", label_col: str | Column = "label", vector_col: str = "embedding",
    every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are rows whose id ``every`` divides; their positives are the best other rows of the same
    label.  The negatives of both are the best rows of other labels that score no more than the
    positive and at least ``low / high`` of it.
    """
    rows, dims = prepared(table, id_col, label_col, vector_col, scale)
    anchors = rows.where(F.col("id") % every == 0)
    near = positives_of(anchors, rows, dims, positives)
    lists = near.groupBy(F.col("anchor_id").alias("id")).agg(
        F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), F.col("id").alias("near")))).alias("near"))
    lists = lists.select("id", F.transform("near", lambda n: F.struct(n["near"].alias("id"), (-n["minus"]).alias("score"))).alias("positives"))
    asked = kept(anchors.join(lists, "id"), "asked")
    return negatives_of(asked, rows, dims, negatives, low, high).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))


def oracle_sql() -> str:
    return """
    WITH usable AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
    most AS (SELECT len(v) AS s FROM usable GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
    vectors AS (SELECT id, arg_min(label, {'l': label, 'v': v}) AS label, arg_min(v, {'l': label, 'v': v}) AS v
        FROM usable WHERE len(v) = (SELECT s FROM most) GROUP BY id),
    pairs AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
        FROM vectors a JOIN vectors b ON a.id <> b.id WHERE a.id % 100 = 0),
    positive AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM pairs WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
    SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
        id AS negative_id, positive_score, score AS negative_score
    FROM positive JOIN pairs USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
    QUALIFY rank <= 5"""
