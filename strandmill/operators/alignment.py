"""Alignment records: PAF lines, CIGAR strings and the exact runs inside them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandmill.functions import cigar

MIN_BLOCK_LEN = 1_000
MIN_IDENTITY = 0.90


def _lenient_int(text: Column) -> Column:
    """An integer field; anything else reads as 0."""
    return F.when(
        text.rlike(r"^[+-]?[0-9]+$"), F.coalesce(text.try_cast("long"), F.lit(0))
    ).otherwise(0).cast("long")


_FLOAT = r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"


def _tag(prefix: str, body: str) -> Column:
    """Value of the last readable tag after the twelve fixed fields; empty if none.

    Fields are looked at one by one; only a line with a line break inside goes through one pattern.
    """
    rest = lambda t: t.substr(F.lit(len(prefix) + 1), F.lit(2**31 - 1))
    tags = F.filter(F.slice("f", F.lit(13), F.greatest(F.size("f"), F.lit(0))), lambda t: t.startswith(prefix) & rest(t).rlike(f"^{body}$"))
    whole = F.regexp_extract(
        "line", rf"^(?:[^\t]*\t){{12}}(?:.*\t)?{prefix}({body})(?:\t.*)?$", 1
    )
    return F.when(F.col("broken"), whole).otherwise(F.coalesce(rest(F.try_element_at(tags, F.lit(-1))), F.lit("")))


def parse_paf(lines: DataFrame, value: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Alignment blocks from PAF text; lines with fewer than 12 fields are dropped.

    Identity is matches / block_len unless a readable ``dv:f:`` tag gives the divergence.
    """
    rows = lines.select(*keep, F.col(value).alias("line"), F.split(F.col(value), "\t", -1).alias("f"),
                        F.col(value).rlike("[\n\r\u0085\u2028\u2029]").alias("broken"))
    # Exploding one struct per line keeps later filters from reading the line again for each field they name.
    cells = F.struct(
        F.size("f").alias("fields"),
        F.get("f", F.lit(0)).alias("query_name"),
        _lenient_int(F.get("f", F.lit(2))).alias("query_start"),
        _lenient_int(F.get("f", F.lit(3))).alias("query_end"),
        F.get("f", F.lit(4)).alias("strand"),
        F.get("f", F.lit(5)).alias("target_name"),
        _lenient_int(F.get("f", F.lit(7))).alias("target_start"),
        _lenient_int(F.get("f", F.lit(8))).alias("target_end"),
        _lenient_int(F.get("f", F.lit(9))).alias("matches"),
        _lenient_int(F.get("f", F.lit(10))).alias("block_len"),
        _tag("dv:f:", _FLOAT).try_cast("double").alias("divergence"),
        _tag("cg:Z:", r"[^\t]*").alias("cigar"),
    )
    read = rows.select(*keep, F.inline(F.array(cells))).where(F.col("fields") >= 12)
    plain = F.when(F.col("block_len") > 0, F.col("matches") / F.col("block_len")).otherwise(0.0)
    return read.select(
        *keep, "query_name", "query_start", "query_end", "strand", "target_name", "target_start", "target_end", "matches", "block_len",
        F.coalesce(1.0 - F.col("divergence"), plain).alias("identity"), "cigar",
    )


def cigar_ops(text: Column) -> Column:
    """Array of (len, op); digits at the end without an operation are ignored."""
    pattern = F.lit(r"([0-9]*)([^0-9])")
    pairs = F.arrays_zip(
        F.regexp_extract_all(text, pattern, F.lit(1)).alias("n"),
        F.regexp_extract_all(text, pattern, F.lit(2)).alias("op"),
    )
    return F.transform(pairs, lambda p: F.struct(
        F.coalesce(p["n"].try_cast("long"), F.lit(0)).alias("len"), p["op"].alias("op")
    ))


def exact_runs(blocks: DataFrame, min_len: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """Maximal runs of ``=`` with at least ``min_len`` bases, in both coordinate systems.

    On the reverse strand the query is walked from its end.  A block is worked on where
    it lies, so no shuffle is needed; one without a CIGAR has no runs.
    """
    names = [*keep, "query_name", "target_name", "strand"]
    coords = ["target_start", "target_end", "query_start", "query_end"]

    def runs(batches):
        for batch in batches:
            row, t, q, n = cigar.exact_runs(batch.column("cigar"), min_len)
            at = {c: batch.column(c).to_numpy()[row] for c in ("target_start", "query_start", "query_end")}
            back = np.asarray(batch.column("strand").to_pylist(), dtype=object)[row] == "-"
            target = at["target_start"] + t
            query = np.where(back, at["query_end"] - q - n, at["query_start"] + q)
            values = [target, target + n, query, query + n]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(pa.array(row)) for c in names]
                + [pa.array(v, pa.int64()) for v in values],
                names=names + coords,
            )

    given = blocks.select(
        *names, "target_start", "query_start", "query_end", "cigar"
    )
    kept = [given.schema[c] for c in names]
    schema = T.StructType(kept + [T.StructField(c, T.LongType()) for c in coords])
    return given.mapInArrow(runs, schema)


def passes(min_len: int = MIN_BLOCK_LEN, min_identity: float = MIN_IDENTITY) -> Column:
    return (F.col("block_len") >= min_len) & (F.col("identity") >= min_identity)


def filter_counts(blocks: DataFrame, min_len: int, min_identity: float) -> DataFrame:
    """How many blocks fall to each rule; length is tested first."""
    short = F.col("block_len") < min_len
    low = ~short & (F.col("identity") < min_identity)
    return blocks.agg(
        F.count(F.lit(1)).alias("raw"),
        F.count_if(short).alias("too_short"),
        F.count_if(low).alias("low_identity"),
        F.count_if(~short & ~low).alias("kept"),
    )


def summarise(blocks: DataFrame) -> DataFrame:
    return blocks.agg(
        F.count(F.lit(1)).alias("blocks"),
        F.coalesce(F.sum(F.col("target_end") - F.col("target_start")), F.lit(0)).alias("target_span"),
        F.round(F.coalesce(F.avg("identity"), F.lit(0.0)), 6).alias("avg_identity"),
    )
