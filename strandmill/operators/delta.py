"""Delta encoding of sequences against a reference, and its exact inverse.

Operations have (chrom, op_idx, type, ref_chrom, ref_start, ref_end, bytes): a copy takes
a range of a reference chromosome, a literal carries its own bytes.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandmill.functions import cigar
from strandmill.functions.hashing import address
from strandmill.operators import blocked, reconstruct
from strandmill.operators.intervals import BIN
from strandmill.operators.spread import spread_join
from strandmill.session import checkpoint_dir

COPY, LITERAL = "copy", "literal"


def _followers(first: DataFrame, width: int) -> DataFrame:
    """Adds ``next_start``: of the same sequence, the first start at or after a block's end."""
    asked = first.select("query_name", F.greatest("query_end", F.col("query_start") + 1).alias("at"), F.lit(1).alias("kind"), "query_start")
    starts = first.select("query_name", F.col("query_start").alias("at"), F.lit(0).alias("kind"), "query_start")
    # From the far end back, the smallest start met so far is the nearest one ahead.
    line = blocked.running(
        asked.unionByName(starts), ["query_name"], [F.desc("at"), F.asc("kind")], -blocked.block_of("at", width),
        {"next_start": ("min", F.when(F.col("kind") == 0, F.col("query_start")))}, inclusive=True)
    return line.where("kind = 1").select("query_name", "query_start", "next_start")


def select_blocks(blocks: DataFrame, width: int = BIN) -> DataFrame:
    """Per query sequence, forward blocks in query order that do not overlap, one row each.

    A block is taken when it starts at or after the end of the last one taken; of equal starts the
    smallest target counts.  Each block points at the first one that can follow it, and those taken
    are what the first block reaches: pointers double their length each round, so n blocks of one
    sequence take log2(n) rounds of joins and never meet in one cell.
    """
    block = F.struct("query_end", "target_name", "target_start", "cigar")
    usable = blocks.where((F.col("strand") == "+") & (F.col("cigar") != ""))
    first = usable.groupBy("query_name", "query_start").agg(
        F.min_by(block, F.struct("target_name", "target_start", "query_end", "cigar")).alias("b")
    ).select("query_name", "query_start", "b.*")
    checkpoint_dir(blocks.sparkSession)
    first = first.checkpoint()
    jumps = _followers(first.select("query_name", "query_start", "query_end"), width).checkpoint()
    reached = first.groupBy("query_name").agg(F.min("query_start").alias("query_start"))
    key = ["query_name", "query_start"]
    while True:
        onward = reached.join(jumps, key).where(F.col("next_start").isNotNull()).select("query_name", F.col("next_start").alias("query_start"))
        reached = reached.unionByName(onward).checkpoint()
        jumps = jumps.where(F.col("next_start").isNotNull())
        twice = jumps.select("query_name", F.col("query_start").alias("next_start"), F.col("next_start").alias("far"))
        jumps = jumps.join(twice, ["query_name", "next_start"]).select(*key, F.col("far").alias("next_start")).checkpoint()
        if jumps.isEmpty():
            return first.join(reached, key, "left_semi")


def _copies(taken: DataFrame) -> DataFrame:
    """The steps of taken blocks that both sequences share, in both coordinate systems."""
    schema = T.StructType([
        T.StructField("chrom", taken.schema["query_name"].dataType), T.StructField("q_start", T.LongType()), T.StructField("q_end", T.LongType()),
        T.StructField("ref_chrom", taken.schema["target_name"].dataType), T.StructField("ref_start", T.LongType()), T.StructField("ref_end", T.LongType())])

    def walk(batches):
        for batch in batches:
            row, t, q, n = cigar.copied_runs(batch.column("cigar"))
            at = pa.array(row)
            q = batch.column("query_start").to_numpy()[row] + q
            t = batch.column("target_start").to_numpy()[row] + t
            values = [q, q + n, t, t + n]
            values = [pa.array(v, pa.int64()) for v in values]
            yield pa.RecordBatch.from_arrays(
                [batch.column("query_name").take(at), *values[:2], batch.column("target_name").take(at), *values[2:]], names=schema.names)

    return taken.select("query_name", "query_start", "target_name", "target_start", "cigar").mapInArrow(walk, schema)


def coalesce_ops(copies: DataFrame, lengths: DataFrame, width: int = BIN) -> DataFrame:
    """Operations of sequences of given (chrom, length): copies that continue one another on the same reference
    are one, and what no copy covers is a literal.  The copy before comes from a scan by blocks."""
    none = {c: F.lit(None).cast(copies.schema[c].dataType) for c in ("ref_chrom", "ref_start", "ref_end")}
    # The end of a sequence is a mark of its own, so the last gap is found like the others.
    marks = copies.withColumn("mark", F.lit(0)).unionByName(
        lengths.select("chrom", F.col("length").alias("q_start"), F.col("length").alias("q_end")).withColumns(none).withColumn("mark", F.lit(1)))
    before = F.struct("q_start", "mark", "q_end", "ref_chrom", "ref_end")
    # Two scans, first for the row before and then for the runs that it continues.
    marks = blocked.running(marks, ["chrom"], ["q_start", "mark"], blocked.block_of("q_start", width), {"before": ("max", before)})
    goes_on = (F.col("before.q_end") == F.col("q_start")) & (F.col("before.ref_chrom") == F.col("ref_chrom")) & (F.col("before.ref_end") == F.col("ref_start"))
    marks = marks.withColumns({
        "used": F.coalesce("before.q_end", F.lit(0).cast("long")), "opens": F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)})
    marks = blocked.running(
        marks.drop("before"), ["chrom"], ["q_start", "mark"], blocked.block_of("q_start", width), {"run": ("sum", F.col("opens"))}, inclusive=True)
    whole = marks.where("mark = 0").groupBy("chrom", "run").agg(
        F.lit(COPY).alias("type"), F.min("ref_chrom").alias("ref_chrom"), F.min("ref_start").alias("ref_start"),
        F.max("ref_end").alias("ref_end"), F.min("q_start").alias("q_start"), F.max("q_end").alias("q_end")).drop("run")
    gaps = marks.where("q_start > used").select(
        "chrom", F.lit(LITERAL).alias("type"), F.col("used").alias("q_start"), F.col("q_start").alias("q_end")).withColumns(none)
    return blocked.position(whole.unionByName(gaps), ["chrom"], ["q_start"], blocked.block_of("q_start", width), "op_idx")


def build(blocks: DataFrame, query: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """Operations for every query sequence (query, seq), literals with their bytes; an empty sequence has none.

    With a reference (target, seq), blocks on targets it does not have are left out, and a match
    that runs past the end of its target becomes a literal.  Operations are rows throughout; a
    text moves once, to its literals.
    """
    sizes = None
    if reference is not None:
        sizes = reference.select(F.col("target").alias("ref_chrom"), F.octet_length(F.col("seq").cast("binary")).cast("long").alias("ref_size"))
        blocks = blocks.join(sizes.select(F.col("ref_chrom").alias("target_name")), "target_name", "left_semi")
    copies = _copies(select_blocks(blocks))
    if sizes is not None:
        held = copies.groupBy("ref_chrom").agg(F.count(F.lit(1)).alias("copies")).join(sizes, "ref_chrom")
        copies = spread_join(copies, held, ["ref_chrom"], "copies", ["chrom", "q_start"]).where("ref_end <= ref_size").drop("copies", "ref_size")
    data = query.select(F.col("query").alias("chrom"), F.col("seq").cast("binary").alias("seq"))
    lengths = data.select("chrom", F.coalesce(F.octet_length("seq"), F.lit(0)).cast("long").alias("length"))
    ops = coalesce_ops(copies, lengths).checkpoint()
    out = ["chrom", "op_idx", "type", "ref_chrom", "ref_start", "ref_end"]
    literals = ops.where(F.col("type") == LITERAL)
    texts = literals.groupBy("chrom").agg(F.count(F.lit(1)).alias("copies")).join(data, "chrom")
    own = F.substring("seq", (F.col("q_start") + 1).cast("int"), (F.col("q_end") - F.col("q_start")).cast("int"))
    literals = spread_join(literals, texts, ["chrom"], "copies", ["q_start"]).select(*out, own.alias("bytes"))
    return ops.where(F.col("type") == COPY).select(*out, F.lit(None).cast("binary").alias("bytes")).unionByName(literals)


class ReferenceMismatch(ValueError):
    """The delta was made against another reference."""


def reference_digest(reference: DataFrame) -> str | None:
    """The hash of a reference (target, seq), which a delta records; None for one without sequences."""
    chroms = reference.select(F.lit("").alias("of"), F.col("target").alias("chrom"), F.col("seq").alias("text"))
    row = reconstruct.reference_hash(chroms, "of").first()
    return row.reference_hash if row else None


def apply(ops: DataFrame, reference: DataFrame, recorded: str | None = None) -> DataFrame:
    """Sequences rebuilt from operations and a reference (target, seq).

    A copy that leaves its reference, or names an unknown one, makes ``bad`` positive.  With a
    ``recorded`` reference hash, another reference is refused.
    """
    if recorded is not None and (got := reference_digest(reference)) != recorded:
        raise ReferenceMismatch(f"made against {recorded}, got {got}")
    copies, none = ops.where(F.col("type") == COPY), F.lit(None).cast("binary")
    ref = reference.select(F.col("target").alias("ref_chrom"), F.col("seq").cast("binary").alias("ref"))
    held = copies.groupBy("ref_chrom").agg(F.count(F.lit(1)).alias("copies")).join(ref, "ref_chrom")
    n = F.col("ref_end") - F.col("ref_start")
    inside = (F.col("ref_start") >= 0) & (n >= 0) & (F.col("ref_end") <= F.octet_length("ref"))
    copied = F.when(inside, F.substring("ref", (F.col("ref_start") + 1).cast("int"), n.cast("int")))
    taken = spread_join(copies, held, ["ref_chrom"], "copies", ["chrom", "op_idx"]).select("chrom", "op_idx", copied.alias("piece"))
    unknown = copies.join(ref.select("ref_chrom"), "ref_chrom", "left_anti").select("chrom", "op_idx", none.alias("piece"))
    pieces = ops.where(F.col("type") != COPY).select("chrom", "op_idx", F.col("bytes").alias("piece")).unionByName(taken).unionByName(unknown)
    return pieces.groupBy("chrom").agg(
        F.count_if(F.col("piece").isNull()).alias("bad"),
        F.expr("listagg(piece) WITHIN GROUP (ORDER BY op_idx)").alias("data"),
    )


def summarise(ops: DataFrame, chroms: DataFrame | None = None) -> DataFrame:
    """Per sequence: bases in total, as literals and as copies, and the operation count.

    Sequences (chrom) that are empty have no operations; with ``chroms`` they get a row of zeros."""
    literal = F.coalesce(F.octet_length("bytes"), F.lit(0)).cast("long")
    copied = F.coalesce(F.col("ref_end") - F.col("ref_start"), F.lit(0))
    per = ops.groupBy("chrom").agg(
        F.sum(literal).alias("literal"), F.sum(copied).alias("copied"),
        F.count(F.lit(1)).alias("ops"),
    )
    if chroms is not None:
        per = chroms.select("chrom").distinct().join(per, "chrom", "left").na.fill(0, ["literal", "copied", "ops"])
    per = per.withColumn("total", F.col("literal") + F.col("copied"))
    return per.withColumn("literal_pct", F.when(F.col("total") == 0, 0.0).otherwise(F.round(100.0 * F.col("literal") / F.greatest("total", F.lit(1)), 6)))


def reference_gaps(ops: DataFrame, width: int = BIN) -> DataFrame:
    """Start of each copy relative to the end of the copy before it in its sequence."""
    copies = ops.where(F.col("type") == COPY).select("chrom", "op_idx", "ref_start", "ref_end")
    seen = blocked.running(copies, ["chrom"], ["op_idx"], blocked.block_of("op_idx", width), {"before": ("max", F.struct("op_idx", "ref_end"))})
    return seen.select("chrom", "op_idx", (F.col("ref_start") - F.coalesce("before.ref_end", F.lit(0))).alias("ref_gap"))


def verified(rebuilt: DataFrame, query: DataFrame) -> DataFrame:
    recorded = query.select(F.col("query").alias("chrom"), address(F.col("seq")).alias("recorded"))
    # An empty sequence has no operations, so nothing rebuilt stands for no bytes.
    found = recorded.join(rebuilt, "chrom", "left")
    data = F.when(F.col("bad").isNull(), F.lit(b"")).otherwise(F.col("data"))
    same = (F.coalesce("bad", F.lit(0)) == 0) & (address(data) == F.col("recorded"))
    return found.select("chrom", "recorded", address(data).alias("rebuilt"), F.coalesce(same, F.lit(False)).alias("verified"))
