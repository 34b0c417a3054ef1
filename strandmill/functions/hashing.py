"""Content addresses and the 64-bit mixer used for sketches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALGORITHM = "sha256:"


def address(data: Column) -> Column:
    """Self-describing content address of a string or binary column.

    An absent value has the empty address.  The column is never null, so joins on it need
    no null filter, which would hash everything a second time.
    """
    return F.coalesce(F.concat(F.lit(ALGORITHM), F.sha2(data, 256)), F.lit(""))


def bare(hash_: Column) -> Column:
    """An address without its algorithm prefix."""
    return F.regexp_replace(hash_, r"^[a-z0-9]+:", "")


def canonical_message(*fields: Column) -> Column:
    """The newline-joined text an announcement signature covers."""
    return F.concat_ws("\n", *[f.cast("string") for f in fields])
