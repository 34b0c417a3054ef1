"""The job table: claiming, leases, tiles and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.operators import blocked

LEASE_SECONDS = 120


def claim(jobs: DataFrame, workers: int) -> DataFrame:
    """The oldest pending jobs, one for each asking worker (a top-k, not a global sort)."""
    oldest = jobs.where("state = 'pending'").orderBy("queued_at", "job").limit(workers)
    turn = F.row_number().over(Window.orderBy("queued_at", "job"))  # at most `workers` rows
    return oldest.select("job", F.concat(F.lit("worker-"), turn.cast("string")).alias("worker"))


def reclaim(jobs: DataFrame, now: Column, lease: Column) -> DataFrame:
    """Claims older than the lease return to pending without an owner."""
    lapsed = (F.col("state") == "claimed") & (now - F.col("claimed_at") > lease)
    return jobs.withColumns({
        "state": F.when(lapsed, "pending").otherwise(F.col("state")),
        "worker": F.when(~lapsed, F.col("worker")),
    })


def report(jobs: DataFrame, reports: DataFrame) -> DataFrame:
    """Apply workers' reports (job, worker, kind, at, found, valid) to the job table.

    Only the worker holding a claim is heard, and only from the claim on.  A heartbeat renews the
    lease.  The first completion ends the job with its counts (ties: the smaller counts); whatever
    comes later is refused.
    """
    claims = jobs.where("state = 'claimed'").select("job", "worker", F.col("claimed_at").alias("since"))
    heard = reports.join(claims, ["job", "worker"]).where(F.col("at") >= F.col("since"))
    done = F.col("kind") == "complete"
    ends = heard.where(done).groupBy("job").agg(F.min(F.struct("at", "found", "valid")).alias("end"))
    beats = heard.where(~done).join(ends, "job", "left").where(
        F.col("end").isNull() | (F.col("at") <= F.col("end.at"))).groupBy("job").agg(F.max("at").alias("beat"))
    ended = F.col("end").isNotNull()
    return jobs.join(ends, "job", "left").join(beats, "job", "left").select(
        *[c for c in jobs.columns if c not in ("state", "claimed_at")],
        F.when(ended, "done").otherwise(F.col("state")).alias("state"),
        F.coalesce("beat", "claimed_at").alias("claimed_at"),
        F.col("end.found").alias("found"),
        F.col("end.valid").alias("valid"),
    )


def rollup(jobs: DataFrame) -> DataFrame:
    def n(state: str) -> Column:
        return F.count_if(F.col("state") == state).alias(state)

    return jobs.agg(
        F.count(F.lit(1)).alias("jobs"), n("pending"), n("claimed"), n("done"),
        F.coalesce(F.sum("found"), F.lit(0)).cast("long").alias("found"),
        F.coalesce(F.sum("valid"), F.lit(0)).cast("long").alias("valid"),
    )


def tiles(chroms: DataFrame, per_block: int = 65_536) -> DataFrame:
    """One job per query chromosome, numbered in chromosome order."""
    placed = blocked.position(
        chroms, [], ["chrom"], blocked.block_of("chrom", per_block), "n"
    )
    return placed.select(
        F.concat(F.lit("job-"), (F.col("n") + 1).cast("string")).alias("job"), "assembly", "chrom"
    )
