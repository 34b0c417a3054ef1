"""Structured Streaming twins of the node-log queries.

Results go through files in the shared checkpoint folder, never through the driver, and
each micro-batch writes its own directory, so a repeated batch replaces what it wrote.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.operators import network
from strandmill.session import checkpoint_dir


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


def read_log(spark: SparkSession, path: str, schema) -> DataFrame:
    """Files of a log table, one or many, a bounded number of them per micro-batch.

    The source takes a plain path for a folder; as a pattern it may also name a single file.
    """
    pattern = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1_000).parquet(pattern)


def _latest(updates: DataFrame, key: str) -> DataFrame:
    """Run an updating aggregate over all available input; the last row of each key."""
    spark, folder = updates.sparkSession, _folder(updates.sparkSession)
    schema = updates.schema

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{folder}/rows/step={batch_id}")

    query = (
        updates.writeStream.outputMode("update").foreachBatch(store)
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    # Without any input there is no batch: an empty one keeps the folder readable.
    store(spark.createDataFrame([], schema), -1)
    rest = [c for c in updates.columns if c != key]
    rows = spark.read.schema(schema.add("batch", "long")).parquet(f"{folder}/rows")
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("f")).select(key, "f.*")


def latest_facts(log: DataFrame) -> DataFrame:
    """The node facts over all available input."""
    return _latest(network.node_facts(log), "node")


def rates(served: DataFrame, event_time: str, size: Column, window_s: int, slide_s: int) -> DataFrame:
    """Requests and bytes per second in sliding windows over all available input.

    Every window is kept, open ones included, and no event is too late: the state is one row per
    slide of the log's time span.
    """
    spans = F.window(event_time, f"{window_s} seconds", f"{slide_s} seconds")
    counts = served.groupBy(spans).agg(F.count(F.lit(1)).alias("hits"), F.sum(size).alias("bytes")).select(
        F.col("window.end").alias("window_end"), "hits", "bytes")
    return _latest(counts, "window_end").select(
        "window_end",
        (F.col("hits") / window_s).alias("requests_per_s"),
        (F.col("bytes") / window_s).alias("bytes_per_s"),
    )
