"""Equi-join of a table with skewed keys to a table with few rows per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 4_000_000


def spread_join(
    many: DataFrame,
    one: DataFrame,
    key: Sequence[str],
    copies: str,
    spread_by: Sequence[str],
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join where a single key may own a large share of ``many``.

    ``one`` carries, in ``copies``, how many rows of ``many`` have its key.  A key with
    more than ``hot_rows`` rows is split over ``ceil(copies / hot_rows)`` salts on both
    sides.  The broadcast list of such keys has at most ``rows(many) / hot_rows``
    entries, whatever the distribution.  The salt is a hash of row columns, so a
    recomputed task produces the same split.
    """
    key = list(key)
    fan = F.ceil(F.col(copies) / F.lit(hot_rows)).cast("int")
    # Reading every column keeps this branch on the same exchange as the join side below,
    # so ``one`` is computed once.  A key whose hash is 0 would merely not be split.
    whole = F.hash(*one.columns) != 0
    hot = one.where((F.col(copies) > hot_rows) & whole).select(*key, fan.alias("__fan")).distinct()
    salted = (
        many.join(F.broadcast(hot), key, "left")
        .withColumn(
            "__salt",
            F.coalesce(
                F.pmod(F.xxhash64(*spread_by), F.col("__fan").cast("long")).cast("int"),
                F.lit(0),
            ),
        )
        .drop("__fan")
    )
    fanned = one.withColumn(
        "__salt", F.explode(F.sequence(F.lit(0), F.greatest(fan, F.lit(1)) - 1))
    )
    return salted.join(fanned, [*key, "__salt"], how).drop("__salt")
