"""Cut points carried through pairwise matches until nothing new appears."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.operators import blocked
from strandmill.operators.intervals import BIN
from strandmill.operators.spread import spread_join
from strandmill.session import checkpoint_dir

COMPACT_EVERY = 5


def cut_propagation(
    cuts: DataFrame, pairs: DataFrame, strand_aware: bool = False, width: int = BIN
) -> DataFrame:
    """Close cuts (genome, chrom, pos) under the matches in ``pairs``.

    A pair has (i_genome, i_chrom, i_start, i_end, j_genome, j_chrom, j_start, j_end) and,
    if ``strand_aware``, strand.  A cut strictly inside one side appears at the mirrored
    place of the other.  Each round joins only the cuts found in the round before.  State
    is cut off by reliable checkpoints, so a lost executor never replays earlier rounds.
    """
    checkpoint_dir(cuts.sparkSession)
    forward = F.lit(True)
    if strand_aware:
        forward = F.col("strand") == "+"

    def side(a: str, b: str) -> DataFrame:
        return pairs.select(
            *[F.col(f"{a}_{c}").alias(c) for c in ("genome", "chrom", "start", "end")],
            *[F.col(f"{b}_{c}").alias(f"to_{c}") for c in ("genome", "chrom", "start", "end")],
            forward.alias("forward"),
        )

    key = ["genome", "chrom", "bin"]
    first, last = blocked.block_of("start", width), F.expr(f"(`end` - 1) div {width}")
    sides = (
        side("i", "j").unionByName(side("j", "i")).distinct()
        .withColumn("bin", F.explode(F.sequence(first, F.greatest(first, last))))
        .checkpoint()
    )
    copies = sides.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).checkpoint()
    known = cuts.select("genome", "chrom", "pos").distinct().checkpoint()
    fresh, rounds = known, 0
    inside = (F.col("pos") > F.col("start")) & (F.col("pos") < F.col("end"))
    step = F.col("pos") - F.col("start")
    mirrored = F.when(F.col("forward"), F.col("to_start") + step).otherwise(F.col("to_end") - step)
    while not fresh.isEmpty():
        asking = fresh.withColumn("bin", blocked.block_of("pos", width)).join(copies, key)
        met = spread_join(sides, asking, key, "copies", ["to_genome", "to_chrom", "to_start", "start"])
        landed = met.where(inside).select(
            F.col("to_genome").alias("genome"), F.col("to_chrom").alias("chrom"), mirrored.alias("pos")
        ).distinct()
        fresh = landed.join(known, ["genome", "chrom", "pos"], "left_anti").checkpoint()
        known = known.unionByName(fresh)
        rounds += 1
        if rounds % COMPACT_EVERY == 0:
            known = known.checkpoint()
    return known
