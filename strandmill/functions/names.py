"""Names taken from arguments, headers and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def name_and_path(text: Column) -> Column:
    """``name:path`` split at the first colon; null unless both parts are there."""
    parts = F.split(text, ":", 2)
    whole = (F.size(parts) == 2) & (parts[0] != "") & (F.get(parts, F.lit(1)) != "")
    return F.when(whole, F.struct(parts[0].alias("name"), F.get(parts, F.lit(1)).alias("path")))


def first_token(text: Column) -> Column:
    return F.split(F.trim(text), r"\s+")[0]


def assembly_of(path: Column) -> Column:
    """Base name of a file without its extension."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)
