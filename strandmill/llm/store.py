"""Intermediate tables in the folder all executors share, and lasting worker state."""

from __future__ import annotations

import sys
import types
import uuid

from pyspark.sql import DataFrame, SparkSession

from strandmill.session import checkpoint_dir


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/strandmill-llm/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: computed once, and no
    lost executor makes Spark compute it anew.  ``codec`` "zstd" suits texts and token ids."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def worker_state() -> dict:
    """A dictionary that lives as long as the Python worker, whatever function asks for it."""
    name = "_strandmill_worker_state"
    return sys.modules.setdefault(name, types.ModuleType(name)).__dict__


def bucketed(df: DataFrame, name: str, keys: list[str], codec: str | None = None) -> DataFrame:
    """Like ``kept``, as a bucketed external table: joins on ``keys`` only move the other side."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    table = f"strandmill_{name}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, *keys).saveAsTable(table, "parquet", path=path, **({"compression": codec} if codec else {}))
    return spark.table(table)
