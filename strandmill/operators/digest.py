"""Digests over ordered collections too large for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAN = 65_536


def _digest(index: Column, token: Column) -> Column:
    """SHA-256 of the tokens of one group, joined in index order (at most FAN of them)."""
    items = F.array_sort(F.collect_list(F.struct(index.alias("i"), token.alias("t"))))
    return F.sha2(F.array_join(F.transform(items, lambda x: x["t"]), ""), 256)


SCHEME = "sha256-tree:"


def levels_for(fan: int) -> int:
    """Levels that any 63-bit number of tokens fits into."""
    levels, reach = 1, fan
    while reach < 1 << 63:
        levels, reach = levels + 1, reach * fan
    return levels


def ordered_root(rows: DataFrame, group: str, position: str, token: Column,
                 name: str = "root", fan: int = FAN) -> DataFrame:
    """One digest per group over its tokens in position order.

    Runs of ``fan`` tokens are hashed, then runs of ``fan`` of those digests, and so on
    through the same number of levels for every group, whatever its size.  So no task ever
    holds more than ``fan`` tokens of a group, and a root means the same for short and long
    groups.  ``position`` is 0-based and dense.
    """
    at = F.col(position)
    level = rows.groupBy(group, F.floor(at / fan).cast("long").alias("run")).agg(
        _digest(at, token).alias("d")
    )
    for _ in range(levels_for(fan) - 1):
        level = level.groupBy(group, F.floor(F.col("run") / fan).cast("long").alias("up")).agg(
            _digest(F.col("run"), F.col("d")).alias("d")
        ).withColumnRenamed("up", "run")
    return level.select(group, F.concat(F.lit(SCHEME), F.col("d")).alias(name))
