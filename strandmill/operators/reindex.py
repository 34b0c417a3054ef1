"""Re-segmentation at propagated cuts, so shared stretches get the same segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.operators import blocked, chunking
from strandmill.operators.intervals import BIN
from strandmill.operators.spread import spread_join


def rechunk(
    chroms: DataFrame, regions: DataFrame, sizes: tuple[int, int], keys: Sequence[str] = ("chrom",),
    piece: int = chunking.BLOCK, width: int = BIN,
) -> DataFrame:
    """Chunk every region of every chromosome on its own.

    ``chroms`` has (assembly, *keys, seq) and ``regions`` (*keys, start, end, shared), of any number of
    genomes.  Texts travel in pieces and regions as rows to the pieces they touch; a region that
    touches several is put together again.  Segments are numbered along each chromosome.
    """
    keys = list(keys)
    texts = chunking.pieces(chroms, ["assembly", *keys], "seq", piece).withColumn("piece", F.expr(f"at div {piece}"))
    touched = regions.where("end > start").withColumn(
        "piece", F.explode(F.sequence(F.expr(f"start div {piece}"), F.expr(f"(end - 1) div {piece}"))))
    counts = touched.groupBy(*keys, "piece").agg(F.count(F.lit(1)).alias("copies"))
    low, high = F.greatest("start", "at"), F.least("end", F.col("at") + piece)
    met = spread_join(touched, texts.join(counts, [*keys, "piece"]), [*keys, "piece"], "copies", ["start"]).select(
        "assembly", *keys, F.col("start").alias("region_start"), "shared", "piece",
        F.substring("data", (low - F.col("at") + 1).cast("int"), (high - low).cast("int")).alias("slice"))
    whole = met.groupBy("assembly", *keys, "region_start", "shared").agg(F.expr("listagg(slice) WITHIN GROUP (ORDER BY piece)").alias("data"))
    parts = chunking.chunks(whole, ["assembly", *keys, "region_start", "shared"], "data", [sizes])
    parts = parts.withColumn("start", F.col("region_start") + F.col("start")).select("assembly", *keys, "start", "length", "hash", "shared")
    return blocked.position(parts, ["assembly", *keys], ["start"], blocked.block_of("start", width), "seg_idx")
