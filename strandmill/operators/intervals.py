"""Half-open intervals per key: merging, coverage and regions between cuts.

Positions are cut into bins of fixed width, so a key with most of the intervals is
worked on by many tasks; only one row per occupied bin is carried along the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandmill.operators import blocked

BIN = 65_536


def merge(
    ivs: DataFrame, key: str, start: str = "start", end: str = "end", width: int = BIN, tasks: int | None = None,
) -> DataFrame:
    """Union of intervals per key; touching intervals merge.  ``tasks`` as of ``blocked.tasks_of`` bounds what one task holds.

    Intervals are merged inside the bin they start in.  What then crosses bins is known
    from three numbers per bin: how far earlier bins reach, and the start of the last
    island that no earlier bin reaches.
    """
    # Equal starts collapse first, on the map side unless the rows are dealt.
    given = ivs.select(F.col(key), F.col(start).alias("s"), F.col(end).alias("e"))
    given = blocked.dealt(given, tasks, key, "s") if tasks else given
    longest = given.groupBy(key, "s").agg(F.max("e").alias("e"))
    here = Window.partitionBy(key, "bin").orderBy("s")
    earlier = here.rowsBetween(Window.unboundedPreceding, -1)
    so_far = here.rowsBetween(Window.unboundedPreceding, 0)
    binned = (
        longest.withColumn("bin", blocked.block_of("s", width))
        .where(F.col(key).isNotNull() & F.col("bin").isNotNull())
    )
    binned = (blocked.dealt(binned, tasks, key, "bin") if tasks else binned).withColumn("reach", F.max("e").over(earlier))
    opened = F.when(F.col("reach").isNull() | (F.col("s") > F.col("reach")), F.col("s"))
    islands = (
        binned.withColumn("opened", opened)
        .withColumn("first", F.max("opened").over(so_far))
        .groupBy(key, "bin", "first")
        .agg(F.max("e").alias("e"))
    )
    along = Window.partitionBy(key).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = (
        islands.groupBy(key, "bin")
        .agg(F.max("e").alias("far"), F.max("first").alias("last"))
        .withColumn("reach", F.max("far").over(along))
        .withColumn("opened", F.when(
            F.col("reach").isNull() | (F.col("last") > F.col("reach")), F.col("last")))
        .withColumn("entering", F.max("opened").over(along))
        .select(key, "bin", "reach", "entering")
    )
    alone = F.col("reach").isNull() | (F.col("first") > F.col("reach"))
    island = F.when(alone, F.col("first")).otherwise(F.col("entering"))
    found = islands.join(bins, [key, "bin"]).select(key, island.alias("start"), "e")
    found = blocked.dealt(found, tasks, key, "start") if tasks else found
    return found.groupBy(key, "start").agg(F.max("e").alias("end"))


def covered(merged: DataFrame, key: str) -> DataFrame:
    return merged.groupBy(key).agg(F.sum(F.col("end") - F.col("start")).alias("covered"))


def regions(
    cuts: DataFrame, lengths: DataFrame, merged: DataFrame, key: str, width: int = BIN, tasks: int | None = None,
) -> DataFrame:
    """Pieces between consecutive cuts of [0, length), marked when a merged interval
    contains them.

    ``cuts`` has (key, pos), ``lengths`` (key, length) and ``merged`` disjoint intervals.
    """
    ends = lengths.select(key, F.explode(F.array(F.lit(0).cast("long"), F.col("length"))).alias("pos"))
    points = cuts.where("pos > 0").select(key, "pos").unionByName(ends)
    points = (blocked.dealt(points, tasks, key, "pos") if tasks else points).distinct()
    pieces = blocked.following(
        points, [key], "pos", blocked.block_of("pos", width), "end", tasks
    ).where(F.col("end").isNotNull())
    # One walk along the line answers both questions about a piece.  The last merged
    # interval starting at or before it has the largest end so far, disjoint intervals
    # being ordered by end as well; and beyond the length marker nothing is a region.
    none = F.lit(None).cast("long")
    line = (
        pieces.select(key, F.col("pos").alias("at"), F.lit(1).alias("kind"), "end",
                      none.alias("reach"), none.alias("stop"))
        .unionByName(merged.select(
            key, F.col("start").alias("at"), F.lit(0).alias("kind"), none.alias("end"),
            F.col("end").alias("reach"), none.alias("stop")))
        .unionByName(lengths.select(
            key, F.col("length").alias("at"), F.lit(0).alias("kind"), none.alias("end"),
            none.alias("reach"), F.col("length").alias("stop")))
    )
    seen = blocked.running(
        line, [key], ["at", "kind"], blocked.block_of("at", width),
        {"limit": ("max", F.col("reach")), "past": ("max", F.col("stop"))}, inclusive=True, tasks=tasks,
    )
    return seen.where("kind = 1 AND past IS NULL").select(
        key, F.col("at").alias("start"), "end",
        F.coalesce(F.col("end") <= F.col("limit"), F.lit(False)).alias("shared"),
    )
