"""How the provided tables stand in for sequence data.

assembly = documents.source, organism = documents.lang, chromosome = doc_id,
sequence = UTF-8 bytes of the text, segment = line of the text.  The local store holds
the lines of documents labelled with good quality.  A null source or language is the
empty name and a null id is -1, so that no row is lost to a missing key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.functions.hashing import address
from strandmill.session import fill_cores


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table on which rows are expensive to work on."""
    return fill_cores(table(spark, sf_dir, name))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_table(spark, sf_dir, "documents").select(
        F.coalesce("source", F.lit("")).alias("assembly"),
        F.coalesce("lang", F.lit("")).alias("organism"),
        F.coalesce("doc_id", F.lit(-1)).alias("chrom"),
        "text",
    )


def genomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("source").alias("assembly"))


def lines(docs: DataFrame) -> DataFrame:
    """Segment occurrences with their text; exploding keeps rows where they are."""
    return docs.select(
        "assembly", "organism", "chrom",
        F.posexplode(F.split("text", "\n", -1)).alias("seg_idx", "data"),
    ).select(
        "assembly", "organism", "chrom", F.col("seg_idx").cast("long").alias("seg_idx"),
        address(F.col("data")).alias("hash"),
        F.octet_length("data").cast("long").alias("length"),
        "data",
    )


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(documents(spark, sf_dir)).drop("data")


def held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct hashes of the local store."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select(
        F.col("doc_id").alias("chrom")
    )
    kept = documents(spark, sf_dir).join(good, "chrom", "left_semi")
    return lines(kept).select("hash").distinct()


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session zone."""
    day = F.unix_date(ts.cast("date")).cast("long")
    second = F.hour(ts).cast("long") * 3600 + F.minute(ts).cast("long") * 60
    micros = (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    return (day * 86_400 + second) * 1_000_000 + micros


def as_log(events: DataFrame) -> DataFrame:
    """The node log: node, operation, content id and transferred bytes."""
    return events.select(
        F.col("event_id").alias("seq"),
        epoch_micros(F.col("ts")).alias("us"),
        F.col("user_id").alias("node"),
        F.col("event_type").alias("op"),
        F.col("value").alias("bytes"),
        F.get_json_object("props", "$.k").cast("long").alias("content"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_log(table(spark, sf_dir, "events"))
