"""Following pointers from row to row by doubling them.

A pointer table has one row per node (node, next), next null at an end.  n steps take log2(n) rounds
of joins.  What many nodes point at is a hot key: each round counts how many do and splits it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.operators.spread import spread_join
from strandmill.session import checkpoint_dir


def _jump(rows: DataFrame, state: DataFrame, *carried: str) -> DataFrame:
    """``rows`` (node, next, ...) joined with the state of the node that ``next`` names."""
    asked = rows.groupBy(F.col("next").alias("node")).agg(F.count(F.lit(1)).alias("copies"))
    there = asked.join(state.select("node", *[F.col(c).alias(f"there_{c}") for c in carried]), "node").withColumnRenamed("node", "next")
    return spread_join(rows, there, ["next"], "copies", ["node"]).drop("copies")


def resolve(pointers: DataFrame) -> DataFrame:
    """(node, end, steps): where each node's pointers end and after how many steps.

    A pointer to a node that has no row ends there.  Nodes whose pointers never end, because they are
    on a cycle or lead to one, get a null end; ``on_cycle`` tells which are on it.
    """
    checkpoint_dir(pointers.sparkSession)
    start = pointers.groupBy("node").agg(F.min("next").alias("next"))
    outside = start.where(F.col("next").isNotNull()).select(F.col("next").alias("node")).distinct().join(start, "node", "left_anti")
    start = start.unionByName(outside.withColumn("next", F.lit(None).cast(start.schema["next"].dataType))).checkpoint()
    none = F.lit(None).cast(start.schema["node"].dataType)
    ended = start.where(F.col("next").isNull()).select("node", F.col("node").alias("end"), F.lit(0).cast("long").alias("steps"))
    going = start.where(F.col("next").isNotNull()).select("node", "next", F.lit(1).cast("long").alias("steps")).checkpoint()
    reach, left, before = 1, going.count(), None
    # While a walk that ends is left, each round ends one; then tails shrink until all pointers lie on cycles.
    while left and not (left == before and reach >= left):
        state = going.select("node", "next", none.alias("end"), "steps").unionByName(ended.select("node", none.alias("next"), "end", "steps"))
        there = _jump(going, state, "next", "end", "steps")
        there = there.select("node", F.col("there_next").alias("next"), F.col("there_end").alias("end"), (F.col("steps") + F.col("there_steps")).alias("steps")).checkpoint()
        ended = ended.unionByName(there.where(F.col("end").isNotNull()).select("node", "end", "steps"))
        going = there.where(F.col("end").isNull()).drop("end")
        reach, left, before = reach * 2, going.count(), left
    # After so many steps every pointer left lands on its cycle, and all of the cycle are landed on.
    landed = going.select(F.col("next").alias("node")).distinct().withColumn("on_cycle", F.lit(True))
    stuck = going.join(landed, "node", "left").select(
        "node", none.alias("end"), F.lit(None).cast("long").alias("steps"), F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"))
    return ended.withColumn("on_cycle", F.lit(False)).unionByName(stuck)


def reached(start: DataFrame, pointers: DataFrame) -> DataFrame:
    """Distinct nodes that ``start`` (node) reaches, itself included; cycles are walked once."""
    checkpoint_dir(pointers.sparkSession)
    known = start.select("node").distinct().checkpoint()
    jumps = pointers.where(F.col("next").isNotNull()).groupBy("node").agg(F.min("next").alias("next")).checkpoint()
    while True:
        onward = known.join(jumps, "node").select(F.col("next").alias("node")).distinct()
        fresh = onward.join(known, "node", "left_anti").checkpoint()
        if fresh.isEmpty():
            return known
        known = known.unionByName(fresh).checkpoint()
        jumps = _jump(jumps, jumps, "next").select("node", F.col("there_next").alias("next")).checkpoint()
