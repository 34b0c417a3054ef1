"""Exact matches between sequences: finding, filtering, verifying and chaining."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandmill.functions import bases
from strandmill.functions.batches import by_bytes
from strandmill.functions.kernels import common_ends, seed_rows
from strandmill.operators import blocked, intervals
from strandmill.operators.spread import spread_join
from strandmill.session import checkpoint_dir


PIECE = 4_096  # bytes of a sequence that travel together
DIAGONALS = 65_536  # diagonals of two runs in one row
SEED_ROWS = 50_000  # that a task hands on together
SEED_COLUMNS = ("h", "pos", "step", "n", "residue", "kind")


def _seeds(seqs: DataFrame, name: str, k: int, window: int) -> DataFrame:
    """Minimizers and tandem runs of every sequence, see ``seed_rows``."""
    key = seqs.schema[name]
    schema = T.StructType([key, *[T.StructField(c, T.LongType()) for c in SEED_COLUMNS], T.StructField("root", T.BinaryType())])

    def pick(batches):
        for batch in batches:
            for part in by_bytes(batch, 1):
                found, roots, of = [], [], []

                def flush():
                    rows = np.concatenate(found)  # noqa: B023
                    return pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(np.concatenate(of)))]  # noqa: B023
                        + [pa.array(rows[:, c]) for c in range(len(SEED_COLUMNS))] + [pa.array(roots, pa.binary())],  # noqa: B023
                        names=[name, *SEED_COLUMNS, "root"],
                    )

                for r, data in enumerate(part.column(1).to_pylist()):
                    rows, more = seed_rows(data, k, window) if data else (None, [])
                    if not more:
                        continue
                    found.append(rows)
                    roots += more
                    of.append(np.full(len(more), r))
                    if len(roots) > SEED_ROWS:
                        yield flush()
                        found, roots, of = [], [], []
                if roots:
                    yield flush()

    return seqs.select(name, F.col("seq").cast("binary").alias("seq")).mapInArrow(pick, schema)


def _hits(target: DataFrame, query: DataFrame, min_len: int, k: int, window: int) -> DataFrame:
    """(query, target, q_pos, t_pos, size): shared seeds, still to be checked, with a null size, and
    equal stretches of two runs of one root.

    Seeds at the same place of the period in two runs of one root are left out, since the runs'
    diagonals hold them; so repeats cost as much as their matches, not the product of their seeds.
    """
    t, q = (
        _seeds(seqs, name, k, window).select(name, F.col("h"), "kind", *[F.col(c).alias(f"{side}_{c}") for c in ("pos", "step", "n", "residue", "root")])
        for seqs, name, side in ((target, "target", "t"), (query, "query", "q"))
    )
    both = q.join(t, ["h", "kind"]).where(
        (F.col("kind") == 0) & ~F.coalesce((F.col("t_root") == F.col("q_root")) & (F.col("t_residue") == F.col("q_residue")), F.lit(False))
        | (F.col("kind") == 1) & (F.col("t_root") == F.col("q_root")))
    # Of two runs: the first diagonal (target place - query place) long enough whose places agree.
    period, low = F.col("t_step"), F.col("t_pos") - F.col("q_n") + min_len
    first = low + F.pmod(F.col("t_residue") - F.col("q_residue") - low, period)
    count = F.greatest(F.lit(0), (F.col("t_n") - min_len - F.col("q_pos") - first + period) / period).cast("long")
    whole = F.ceil(F.col("count") / DIAGONALS).cast("long")
    run = F.col("kind") == 1
    both = both.withColumns({"first": first, "count": F.when(run, count)})
    # Outer index: places of the query's seed, or blocks of diagonals and then the runs' two corners.
    outer = F.when(run, whole + 1).otherwise(F.col("q_n"))
    both = both.withColumn("a", F.explode(F.sequence(F.lit(0).cast("long"), outer - 1)))
    corner = run & (F.col("a") == whole)
    inner = F.when(corner, 2).when(run, F.least(F.lit(DIAGONALS), F.col("count") - F.col("a") * DIAGONALS)).otherwise(F.col("t_n"))
    both = both.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), inner.cast("long") - 1)))
    diagonal = F.col("first") + (F.col("a") * DIAGONALS + F.col("b")) * period
    t_from = F.greatest("t_pos", F.col("q_pos") + diagonal)
    size = F.least("t_n", F.col("q_n") + diagonal) - t_from
    at_end = F.col("b") == 1
    t_corner = F.when(at_end, F.col("t_n") - k).otherwise(F.col("t_pos"))
    q_corner = F.when(at_end, F.col("q_n") - k).otherwise(F.col("q_pos"))
    agree = F.pmod(t_corner - q_corner - F.col("t_residue") + F.col("q_residue"), period) == 0
    return both.where(~corner | agree).select(
        "query", "target",
        F.when(corner, q_corner).when(run, t_from - diagonal).otherwise(F.col("q_pos") + F.col("a") * F.col("q_step")).alias("q_pos"),
        F.when(corner, t_corner).when(run, t_from).otherwise(F.col("t_pos") + F.col("b") * F.col("t_step")).alias("t_pos"),
        F.when(run & ~corner, size).alias("size"),
    )


def _around(hits: DataFrame, seqs: DataFrame, name: str, pos: str, k: int, reach: int) -> DataFrame:
    """(name, pos, before, ahead): up to ``reach`` bytes before each asked place, and the
    seed with as many after it.  A sequence travels once, in pieces, and only those asked for."""
    # Different places of one piece: as many as it has bytes at most.
    asked = hits.groupBy(name, F.expr(f"{pos} div {PIECE}").alias("piece")).agg(F.collect_set(pos).alias("asked"))
    data = F.col("seq").cast("binary")
    start = F.greatest(F.lit(0), F.col("piece") * PIECE - reach)
    pieces = seqs.select(name, data.alias("seq")).where(F.octet_length("seq") > 0).select(name, F.posexplode(F.transform(
        F.sequence(F.lit(0), F.expr(f"cast((octet_length(seq) - 1) div {PIECE} as int)")),
        lambda i: F.substring("seq", F.greatest(F.lit(1), i * PIECE - reach + 1), F.lit(PIECE + k + 2 * reach)))).alias("piece", "bytes"))
    found = asked.join(pieces, [name, "piece"]).select(name, start.alias("start"), "bytes", F.explode("asked").alias(pos)).select(
        name, pos, "bytes", (F.col(pos) - F.col("start")).cast("int").alias("at"))
    low = F.greatest(F.lit(0), F.col("at") - reach)
    return found.select(name, pos, F.substring("bytes", low + 1, F.col("at") - low).alias("before"),
                        F.substring("bytes", F.col("at") + 1, F.lit(k + reach)).alias("ahead"))


def _equal_around(k: int, reach: int):
    """A function of what lies around two places: how far they agree, as (left, right)."""
    def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        flat = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8)
        return flat, np.diff(offsets) if len(column) else np.zeros(0, np.int64)

    @F.arrow_udf("struct<left:long,right:long>")
    def equal(t_before: pa.Array, q_before: pa.Array, t_ahead: pa.Array, q_ahead: pa.Array) -> pa.Array:
        left = common_ends(strings(t_before), strings(q_before), reach, ahead=False)
        right = common_ends(strings(t_ahead), strings(q_ahead), k + reach, ahead=True)
        return pa.StructArray.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["left", "right"])

    return equal


def find(target: DataFrame, query: DataFrame, min_len: int) -> DataFrame:
    """All maximal exact matches of at least ``min_len`` bytes, forward strand.

    ``target`` has (target, seq) and ``query`` (query, seq).  Minimizers are shuffled, about two of
    every ``min_len / 2`` positions, and tandem repeats as intervals with a period.  Each shared
    seed is compared with its surroundings, which reach to the next shared seed or the end of the match, and
    what overlaps on one diagonal is one match.  Only those surroundings travel, never texts per
    pair.  Hits are written to the checkpoint folder, as several steps read them.  Sequences without a name or
    bytes have no matches.
    """
    k = (min_len + 1) // 2
    window = min_len - k + 1
    reach = window - 1
    checkpoint_dir(target.sparkSession)
    hits = _hits(target, query, min_len, k, window).checkpoint()
    seeds = hits.where("size IS NULL").drop("size")
    ts = _around(seeds, target, "target", "t_pos", k, reach).withColumnsRenamed({"before": "t_before", "ahead": "t_ahead"})
    qs = _around(seeds, query, "query", "q_pos", k, reach).withColumnsRenamed({"before": "q_before", "ahead": "q_ahead"})
    # A place that many seeds name is a hot key; adaptive skew handling splits the seeds.
    seen = seeds.join(ts, ["target", "t_pos"]).join(qs, ["query", "q_pos"]).withColumn("same", _equal_around(k, reach)("t_before", "q_before", "t_ahead", "q_ahead")).where(F.col("same.right") >= k)
    diagonal = F.struct("query", "target", (F.col("t_pos") - F.col("q_pos")).alias("d")).alias("of")
    parts = seen.select(diagonal, (F.col("q_pos") - F.col("same.left")).alias("start"), (F.col("q_pos") + F.col("same.right")).alias("end")).unionByName(
        hits.where("size IS NOT NULL").select(diagonal, F.col("q_pos").alias("start"), (F.col("q_pos") + F.col("size")).alias("end")))
    whole = intervals.merge(parts, "of").where(F.col("end") - F.col("start") >= min_len)
    return whole.select(
        "of.query", "of.target", (F.col("start") + F.col("of.d")).alias("t_start"), (F.col("end") + F.col("of.d")).alias("t_end"),
        F.col("start").alias("q_start"), F.col("end").alias("q_end")).checkpoint()


def longest(mems: DataFrame, width: int = intervals.BIN) -> DataFrame:
    """The matches kept when only the longest extension from each query start counts.

    A match stays if no match starting at or before it ends later in the query, and if
    none with the same query end contains it on the target side.  Groups are the matches
    of one sequence pair; both rules are prefix maxima along it, taken block by block.
    """
    pair = ["query", "target"]
    starts = mems.groupBy(*pair, "q_start").agg(F.max("q_end").alias("end"), F.count(F.lit(1)).alias("copies"))
    far = blocked.running(starts, pair, ["q_start"], blocked.block_of("q_start", width), {"far": ("max", F.col("end"))}, inclusive=True)
    kept = spread_join(mems, far.select(*pair, "q_start", "far", "copies"), [*pair, "q_start"], "copies", ["t_start", "q_end"]).where("q_end = far")
    # Equal query ends: a longer match starts earlier, so it contains this one if it ends at or after it.
    swept = blocked.running(
        kept.select(mems.columns), [*pair, "q_end"], ["t_start", F.desc("t_end")], blocked.block_of("t_start", width), {"reach": ("max", F.col("t_end"))})
    return swept.where(F.col("reach").isNull() | (F.col("reach") < F.col("t_end"))).select(mems.columns)


def verify(claims: DataFrame, target: DataFrame, query: DataFrame) -> DataFrame:
    """Check claimed matches byte by byte at their coordinates.

    Claims have (query, target, t_start, q_start, length, strand).  Out of bounds, empty
    or unknown sequences fail; on the reverse strand the query is complemented first.
    """
    t = target.select("target", bases.byte_string(F.col("seq")).alias("t_seq"))
    q = query.select("query", bases.byte_string(F.col("seq")).alias("q_seq"))
    n = F.col("length").cast("int")
    tg = F.substring("t_seq", (F.col("t_start") + 1).cast("int"), n)
    qg = F.substring("q_seq", (F.col("q_start") + 1).cast("int"), n)
    qg = F.when(F.col("strand") == "-", bases.reverse_complement(qg)).otherwise(qg)
    # The slice replaces the sequence before the next join, so texts do not travel twice.
    sliced = (
        claims.join(t, "target", "left")
        .withColumn("t_len", F.length("t_seq").cast("long"))
        .withColumn("tg", tg).drop("t_seq")
    )
    inside = (
        (n > 0) & (F.col("t_start") >= 0) & (F.col("q_start") >= 0)
        & (F.col("t_start") + n <= F.col("t_len")) & (F.col("q_start") + n <= F.length("q_seq"))
    )
    return sliced.join(q, "query", "left").select(
        *claims.columns, F.coalesce(inside & (F.col("tg") == qg), F.lit(False)).alias("valid")
    )


def chain(mems: DataFrame, max_gap: int) -> DataFrame:
    """Join matches on one diagonal across short mismatches into blocks with a CIGAR."""
    mems = mems.withColumn("d", F.col("t_start") - F.col("q_start"))
    along = Window.partitionBy("query", "target", "d").orderBy("q_start")
    gap = F.col("q_start") - F.lag("q_end").over(along)
    parted = mems.withColumn("gap", gap).withColumn(
        "block", F.sum(F.when(F.col("gap") <= max_gap, 0).otherwise(1)).over(along)
    )
    size = F.col("q_end") - F.col("q_start")
    piece = F.struct(
        F.col("q_start").alias("at"),
        F.concat(
            F.when(F.col("gap") <= max_gap, F.concat(F.col("gap").cast("string"), F.lit("X")))
            .otherwise(F.lit("")), size.cast("string"), F.lit("="),
        ).alias("c"),
    )
    blocks = parted.groupBy("query", "target", "d", "block").agg(
        F.min("q_start").alias("query_start"), F.max("q_end").alias("query_end"),
        F.min("t_start").alias("target_start"), F.max("t_end").alias("target_end"),
        F.sum(size).alias("matches"),
        F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["c"]), "").alias("cigar"),
    )
    length = F.col("query_end") - F.col("query_start")
    return blocks.select(
        F.col("query").alias("query_name"), "query_start", "query_end", F.lit("+").alias("strand"),
        F.col("target").alias("target_name"), "target_start", "target_end", "matches",
        length.alias("block_len"), (F.col("matches") / length).alias("identity"), "cigar",
    )
