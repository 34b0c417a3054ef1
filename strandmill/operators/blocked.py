"""Ordered operators that never bring a whole key into one task.

A plain ``Window.partitionBy(key).orderBy(pos)`` sorts all rows of a key in a single
task, which fails when one key holds a third of the table.  Every ordered operator
here works in two levels instead: rows are cut into blocks that follow the order, each
block is scanned on its own, and only one summary row per block is carried along the
key.  Keys must not be null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "__block"
TASK_ROWS = 500_000


def tasks_of(rows: DataFrame) -> int:
    """Into how many tasks ``rows`` are to be dealt, so that one task sorts no more rows of a larger table.

    The rows are counted, so this is for plain tables or ones that lie in files already.
    """
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(usual, -(-rows.count() // TASK_ROWS))


def dealt(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """Rows laid out by ``keys`` over ``tasks`` tasks, without a number as Spark has it."""
    return df.repartition(tasks, *keys) if tasks else df.repartition(*keys)


def block_of(position: str, width: int) -> Column:
    """Number of the block of ``width`` positions a non-negative position falls into."""
    return F.expr(f"`{position}` div {width}")


def _in_blocks(df: DataFrame, keys: Sequence[str], block: Column, tasks: int | None = None) -> DataFrame:
    """Rows laid out by (key, block), the one exchange both levels work from.

    Nulls are dropped here once; otherwise the optimizer adds that filter to only one of
    the branches, and they can no longer share the exchange.
    """
    rows = df.withColumn(BLOCK, block)
    for name in (*keys, BLOCK):
        rows = rows.where(F.col(name).isNotNull())
    return dealt(rows, tasks, *keys, BLOCK)


def _per_block(rows: DataFrame, grain: Sequence[str], *folds: Column) -> DataFrame:
    """One summary row per block, reading the same columns as the row-level branch.

    With fewer columns the summary would get an exchange of its own and everything before
    it would be computed a second time.
    """
    rest = [c for c in rows.columns if c not in grain]
    touched = F.max(F.xxhash64(*rest)).alias("__touched")
    return rows.groupBy(*grain).agg(*folds, touched).where(F.col("__touched").isNotNull())


_FOLD = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count, "xor": F.bit_xor}
_MERGE = {
    "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    "count": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    "max": F.greatest,
    "min": F.least,
    "xor": lambda a, b: F.coalesce(a, F.lit(0)).bitwiseXOR(F.coalesce(b, F.lit(0))),
}
_OUTER = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min, "xor": F.bit_xor}


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    block: Column,
    aggs: dict[str, tuple[str, Column]],
    inclusive: bool = False,
    tasks: int | None = None,
) -> DataFrame:
    """Add prefix aggregates along ``order`` inside each key.

    ``block`` must not decrease along ``order`` (negate it for a descending order).
    ``aggs`` maps an output name to (``sum``/``count``/``max``/``min``/``xor``, column);
    ``inclusive`` decides whether a row sees itself.
    """
    rows = _in_blocks(df, keys, block, tasks)
    grain = [*keys, BLOCK]
    here = (
        Window.partitionBy(*grain)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    before = (
        Window.partitionBy(*keys)
        .orderBy(BLOCK)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    totals = _per_block(
        rows, grain, *[_FOLD[kind](col).alias(name) for name, (kind, col) in aggs.items()]
    )
    carry = totals.select(
        *grain,
        *[_OUTER[kind](name).over(before).alias(f"__carry_{name}")
          for name, (kind, _) in aggs.items()],
    )
    local = rows.select(
        "*",
        *[_FOLD[kind](col).over(here).alias(f"__local_{name}")
          for name, (kind, col) in aggs.items()],
    )
    joined = local.join(carry, grain)
    merged = [
        _MERGE[kind](F.col(f"__carry_{name}"), F.col(f"__local_{name}")).alias(name)
        for name, (kind, _) in aggs.items()
    ]
    return joined.select(*df.columns, *merged)


def position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    block: Column,
    name: str = "position",
) -> DataFrame:
    """0-based rank of each row inside its key; ``order`` must be unique per key."""
    return running(df, keys, order, block, {name: ("count", F.lit(1))})


def following(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    block: Column,
    name: str = "next_value",
    tasks: int | None = None,
) -> DataFrame:
    """The next larger ``value`` inside the key (null at the end); values are unique."""
    rows = _in_blocks(df, keys, block, tasks)
    grain = [*keys, BLOCK]
    here = Window.partitionBy(*grain).orderBy(value)
    firsts = rows.groupBy(*grain).agg(F.min(value).alias("__first"))
    along = Window.partitionBy(*keys).orderBy(BLOCK)
    carry = firsts.select(*grain, F.lead("__first").over(along).alias("__upcoming"))
    local = rows.withColumn("__lead", F.lead(value).over(here))
    return local.join(carry, grain).select(
        *df.columns, F.coalesce("__lead", "__upcoming").alias(name)
    )
