"""Node-log and job-table queries.

events is the node log (announce = signup, heartbeat = view, leave = error, served
request = click, bytes = value, content id = props.k); orders is the job table, oldest
first by order date, with O, P and F read as pending, claimed and done.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandmill.operators import blocked, jobs, network, segments
from strandmill.plans import corpus
from strandmill.plans.dedup import HELD, SEG

SECOND = 1_000_000
DAY = 86_400 * SECOND


def _nodes(spark, sf):
    log = corpus.events(spark, sf)
    now = log.agg(F.max("us")).scalar()
    return network.members(network.node_facts(log), now, timeout_us=DAY)


def tracker_nodes(spark, sf):
    return _nodes(spark, sf)


def tracker_peers(spark, sf):
    """Online nodes for each content id."""
    return _nodes(spark, sf).where("online").select("content", "node")


def node_held_counts(spark, sf):
    """Every node with the number of segments it announced: those of the document its announcement names."""
    nodes = _nodes(spark, sf)
    content = corpus.manifest(spark, sf).select(F.col("chrom").alias("content"), "hash").distinct()
    announced = nodes.select("node", "content").join(content, "content")
    return network.node_views(nodes, announced).select("node", "age_s", "online", "held")


def node_rollup(spark, sf):
    return _nodes(spark, sf).agg(
        F.count(F.lit(1)).alias("nodes"), F.count_if("online").alias("online")
    )


def announce_latest(spark, sf):
    """An announcement replaces what the node announced before."""
    log = corpus.events(spark, sf).where(F.col("op") == network.ANNOUNCE)
    return log.groupBy("node").agg(
        F.max_by("content", F.struct("us", "seq")).alias("content"), F.max("us").alias("us")
    )


def announce_fresh(spark, sf):
    return network.announce_fresh(
        corpus.events(spark, sf), 300 * SECOND, blocked.block_of("seq", 65_536)
    )


def announce_spot_check(spark, sf):
    """Three announced hashes per node, picked by salted hash, looked up in the store."""
    announced = corpus.manifest(spark, sf).select(
        F.col("organism").alias("node"), "hash"
    ).distinct()
    pick = Window.partitionBy("node").orderBy(F.sha2(F.concat(F.col("hash"), F.lit("salt")), 256))
    # Spark cuts each partition to three rows per node before the shuffle.
    sample = announced.withColumn("r", F.row_number().over(pick)).where("r <= 3").drop("r")
    return segments.with_held(sample, corpus.held(spark, sf))


def rate_window(spark, sf):
    return network.request_rate(corpus.events(spark, sf), 600 * SECOND)


def served_feed_lastn(spark, sf):
    log = corpus.events(spark, sf).where(F.col("op") == network.SERVED)
    return log.orderBy(F.desc("us"), F.desc("seq")).limit(16).select("seq", "node", "us", "bytes")


def events_tail(spark, sf):
    return corpus.events(spark, sf).orderBy(F.desc("us"), F.desc("seq")).limit(20)


def activity_summary(spark, sf):
    return corpus.events(spark, sf).groupBy("op").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(network.cents(F.col("bytes"))).alias("cents"),
        F.max("us").alias("latest"),
    )


def _jobs(spark, sf):
    us = corpus.epoch_micros(F.col("o_orderdate"))
    state = (F.when(F.col("o_orderstatus") == "O", "pending")
             .when(F.col("o_orderstatus") == "P", "claimed").otherwise("done"))
    return corpus.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("job"), us.alias("queued_at"), us.alias("claimed_at"),
        state.alias("state"),
        F.when(state != "pending", F.concat(F.lit("worker-"), F.col("o_custkey").cast("string")))
        .alias("worker"),
    )


def job_list(spark, sf):
    return _jobs(spark, sf).select("job", "queued_at", "state", "worker")


def job_claim_fifo(spark, sf):
    return jobs.claim(_jobs(spark, sf), workers=25)


def job_reclaim(spark, sf):
    """Lease of 90 days, measured from the newest claim in the table."""
    table = _jobs(spark, sf)
    now = table.agg(F.max("claimed_at")).scalar()
    done = jobs.reclaim(table.withColumn("now", now), F.col("now"), F.lit(90 * DAY))
    return done.select("job", "state", "worker")


def job_reports(spark, sf):
    """Line items report on jobs: finished ones complete them, others are heartbeats."""
    reports = corpus.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("job"),
        F.concat(F.lit("worker-"), F.col("l_suppkey").cast("string")).alias("worker"),
        F.when(F.col("l_linestatus") == "F", "complete").otherwise("heartbeat").alias("kind"),
        corpus.epoch_micros(F.col("l_shipdate")).alias("at"),
        F.lit(1).cast("long").alias("found"),
        F.when(F.col("l_returnflag") == "N", 1).otherwise(0).cast("long").alias("valid"),
    )
    done = jobs.report(_jobs(spark, sf), reports)
    return done.select("job", "state", "worker", "claimed_at", "found", "valid")


def job_rollup(spark, sf):
    """Matches found and verified per job come from its line items."""
    found = corpus.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("job")).agg(
        F.count(F.lit(1)).alias("found"), F.count_if(F.col("l_linestatus") == "F").alias("valid")
    )
    return jobs.rollup(_jobs(spark, sf).join(found, "job", "left"))


def tile_jobs(spark, sf):
    return jobs.tiles(corpus.documents(spark, sf).select("assembly", "chrom"))


QUERIES = {
    f.__name__: f
    for f in (
        tracker_nodes, tracker_peers, node_held_counts, node_rollup, announce_latest, announce_fresh,
        announce_spot_check, rate_window, served_feed_lastn, events_tail, activity_summary,
        job_list, job_claim_fifo, job_reclaim, job_reports, job_rollup, tile_jobs,
    )
}

LOG = """
log AS (
  SELECT event_id AS seq, epoch_us(ts) AS us, user_id AS node, event_type AS op, value AS bytes,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS content
  FROM events
)"""
NODES = LOG + """,
clock AS (SELECT max(us) AS now FROM log),
ann AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY us DESC, seq DESC) AS r
        FROM log WHERE op = 'signup'),
nodes AS (
  SELECT a.node, a.content, s.last_seen, (now - s.last_seen) // 1000000 AS age_s,
         now - s.last_seen <= 86400000000 AS online
  FROM ann a
  JOIN (SELECT node, max(us) AS last_seen FROM log WHERE op IN ('signup', 'view') GROUP BY node) s
    ON s.node = a.node, clock
  WHERE a.r = 1 AND NOT EXISTS (
    SELECT 1 FROM log l WHERE l.node = a.node AND l.op = 'error'
      AND (l.us > a.us OR (l.us = a.us AND l.seq > a.seq)))
)"""
JOBS = """
jobs AS (
  SELECT o_orderkey AS job, epoch_us(o_orderdate) AS queued_at,
    CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'claimed' ELSE 'done' END AS state,
    CASE WHEN o_orderstatus <> 'O' THEN 'worker-' || o_custkey END AS worker
  FROM orders
)"""

ORACLES = {
    "tracker_nodes": f"WITH {NODES} SELECT * FROM nodes",
    "node_held_counts": f"""WITH {NODES}, held AS (SELECT doc_id AS content, count(DISTINCT line) AS n FROM
        (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL) GROUP BY 1)
        SELECT node, age_s, online, coalesce(n, 0) AS held FROM nodes LEFT JOIN held USING (content)""",
    "tracker_peers": f"WITH {NODES} SELECT content, node FROM nodes WHERE online",
    "node_rollup": f"""WITH {NODES}
        SELECT count(*) AS nodes, count(*) FILTER (online) AS online FROM nodes""",
    "announce_latest": f"""WITH {NODES} SELECT node, content, us FROM ann WHERE r = 1""",
    "announce_fresh": f"""WITH {LOG}
        SELECT seq, node, max(us) OVER (ORDER BY seq) - us <= 300000000 AS fresh
        FROM log WHERE op = 'signup'""",
    "announce_spot_check": f"""WITH {SEG}{HELD},
        a AS (SELECT DISTINCT organism AS node, hash FROM seg),
        s AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY sha256(hash || 'salt')) AS r FROM a)
        SELECT node, hash, hash IN (SELECT hash FROM held) AS held FROM s WHERE r <= 3""",
    "rate_window": f"""WITH {LOG},
        t AS (SELECT us, count(*) AS h, sum(CAST(CAST(bytes * 100 AS DECIMAL(38,0)) AS BIGINT)) AS c
              FROM log WHERE op = 'click' GROUP BY us)
        SELECT us, round(sum(h) OVER w / 600, 6) AS requests_per_s,
               round(sum(c) OVER w / 60000, 6) AS bytes_per_s
        FROM t WINDOW w AS (ORDER BY us RANGE BETWEEN 600000000 PRECEDING AND CURRENT ROW)""",
    "served_feed_lastn": f"""WITH {LOG} SELECT seq, node, us, bytes FROM log WHERE op = 'click'
        ORDER BY us DESC, seq DESC LIMIT 16""",
    "events_tail": f"WITH {LOG} SELECT * FROM log ORDER BY us DESC, seq DESC LIMIT 20",
    "activity_summary": f"""WITH {LOG}
        SELECT op, count(*) AS n, CAST(sum(CAST(bytes * 100 AS DECIMAL(38,0))) AS BIGINT) AS cents,
               max(us) AS latest FROM log GROUP BY op""",
    "job_list": f"WITH {JOBS} SELECT * FROM jobs",
    "job_claim_fifo": f"""WITH {JOBS}
        SELECT job, 'worker-' || row_number() OVER (ORDER BY queued_at, job) AS worker
        FROM jobs WHERE state = 'pending' ORDER BY queued_at, job LIMIT 25""",
    "job_reclaim": f"""WITH {JOBS}, c AS (SELECT max(queued_at) - 7776000000000 AS cut FROM jobs)
        SELECT job, CASE WHEN state = 'claimed' AND queued_at < cut THEN 'pending' ELSE state END AS state,
               CASE WHEN state = 'claimed' AND queued_at < cut THEN NULL ELSE worker END AS worker
        FROM jobs, c""",
    "job_reports": f"""WITH {JOBS},
        said AS (SELECT job, state, queued_at, epoch_us(l_shipdate) AS moment, l_linestatus = 'F' AS complete,
                CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS valid
              FROM jobs JOIN lineitem ON l_orderkey = job AND worker = 'worker-' || l_suppkey
              WHERE state = 'claimed' AND epoch_us(l_shipdate) >= queued_at),
        ends AS (SELECT job, moment AS ended, valid FROM (
              SELECT *, row_number() OVER (PARTITION BY job ORDER BY moment, valid) AS r FROM said WHERE complete) WHERE r = 1),
        beats AS (SELECT s.job, max(s.moment) AS moment FROM said s LEFT JOIN ends e USING (job)
              WHERE NOT complete AND (e.ended IS NULL OR s.moment <= e.ended) GROUP BY s.job)
        SELECT j.job, CASE WHEN e.job IS NOT NULL THEN 'done' ELSE state END AS state, j.worker,
          coalesce(b.moment, j.queued_at) AS claimed_at,
          CASE WHEN e.job IS NOT NULL THEN CAST(1 AS BIGINT) END AS found, CAST(e.valid AS BIGINT) AS valid
        FROM jobs j LEFT JOIN ends e USING (job) LEFT JOIN beats b USING (job)""",
    "job_rollup": f"""WITH {JOBS},
        f AS (SELECT l_orderkey AS job, count(*) AS found, count(*) FILTER (l_linestatus = 'F') AS valid
              FROM lineitem GROUP BY l_orderkey)
        SELECT count(*) AS jobs, count(*) FILTER (state = 'pending') AS pending,
          count(*) FILTER (state = 'claimed') AS claimed, count(*) FILTER (state = 'done') AS done,
          CAST(sum(found) AS BIGINT) AS found, CAST(sum(valid) AS BIGINT) AS valid
        FROM jobs LEFT JOIN f USING (job)""",
    "tile_jobs": """SELECT 'job-' || row_number() OVER (ORDER BY doc_id) AS job,
        source AS assembly, doc_id AS chrom FROM documents""",
}
