"""Streaming versions of the node-log queries, run over all available input."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandmill.operators import network
from strandmill.plans import corpus
from strandmill.plans.swarm import DAY, LOG, ORACLES as BATCH
from strandmill.streaming import node_log

WINDOW, SLIDE = 600, 60


def _stream(spark, sf):
    schema = corpus.table(spark, sf, "events").schema
    return node_log.read_log(spark, f"{sf}/events.parquet", schema)


def stream_liveness(spark, sf):
    facts = node_log.latest_facts(corpus.as_log(_stream(spark, sf)))
    now = corpus.events(spark, sf).agg(F.max("us")).scalar()
    return network.members(facts, now, timeout_us=DAY)


def stream_rate(spark, sf):
    served = _stream(spark, sf).where(F.col("event_type") == network.SERVED).select(
        F.col("ts").cast("timestamp").alias("ts"), network.cents(F.col("value")).alias("cents")
    )
    out = node_log.rates(served, "ts", F.col("cents"), WINDOW, SLIDE)
    return out.select(
        corpus.epoch_micros(F.col("window_end").cast("timestamp_ntz")).alias("window_end"),
        F.round("requests_per_s", 6).alias("requests_per_s"),
        F.round(F.col("bytes_per_s") / 100, 6).alias("bytes_per_s"),
    )


QUERIES = {f.__name__: f for f in (stream_liveness, stream_rate)}

ORACLES = {
    "stream_liveness": BATCH["tracker_nodes"],
    "stream_rate": f"""WITH {LOG},
        hits AS (SELECT (us // 60000000 + t.i) * 60000000 AS window_end, us,
                   CAST(CAST(bytes * 100 AS DECIMAL(38,0)) AS BIGINT) AS cents
                 FROM log, unnest(range(1, 11)) AS t(i) WHERE op = 'click')
        SELECT window_end, round(count(*) / 600, 6) AS requests_per_s,
               round(sum(cents) / 60000, 6) AS bytes_per_s
        FROM hits GROUP BY window_end""",
}
