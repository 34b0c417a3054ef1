"""The training-data pipeline over the documents table.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept.  All but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.llm import decontaminate, language, near_dup, packing, similar, substrings
from strandmill.llm.store import kept

ORACLE_SQL = None  # networks, fingerprints and tokenizers have no SQL form


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter, which are in no language."""
    net = language.fit(docs)
    if net is None:  # without a label nothing tells languages apart, letters still show
        return docs.where(F.col("text").rlike(r"\p{L}"))
    judged = language.predict(docs, net, name="__language")
    return judged.where(F.col("__language.lang_pred") != language.UNKNOWN).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of linked fingerprints, as op8 finds them, and
    then of each group of texts that share 0.8 of their five-word runs.

    What the first step keeps is told by id and hash, so that no text is stored between the two."""
    return similar.keep_one(docs, among=kept(near_dup.firsts(docs), "firsts"))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes runs of 20 words out of all documents but the first that has them."""
    return substrings.remove_repeats(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark windows in a twentieth of their words or more."""
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = found.where("contaminated").select(F.col("id").alias("__id"), F.col("same").alias("__same")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__same")), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4,096 tokens, with their token ids."""
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language", keep_languages),
    ("near_duplicates", drop_near_duplicates),
    ("substrings", cut_repeated_passages),
    ("decontaminate", drop_contaminated),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), name)
    return docs
