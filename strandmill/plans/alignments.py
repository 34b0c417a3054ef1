"""Alignment and interval queries.

Every lineitem row stands for one alignment block of a part against a supplier, written
as a PAF line whose CIGAR is built from the row's quantity and line number.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from strandmill.operators import alignment, blocked, intervals
from strandmill.plans import corpus

MIN_LEN, MIN_IDENTITY, MIN_RUN = 60, 0.93, 20


def paf_lines(spark, sf):
    q, n = F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long")
    ops = [(q, "="), (n, "X"), (q + n, "="), (n, "I"), (q, "="), (n, "D"), (q, "=")]
    cigar = F.concat(*[p for size, op in ops for p in (size.cast("string"), F.lit(op))])
    part, order = F.col("l_partkey"), F.col("l_orderkey")
    span = 4 * q + 3 * n
    fields = [
        F.concat(F.lit("P"), part.cast("string")), order + 100_000, order, order + span,
        F.when(F.col("l_returnflag") == "R", "-").otherwise("+"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")), F.lit(1_000_000), part,
        part + span, 4 * q + n, 4 * (q + n), F.lit(60), F.lit("tp:A:P"),
        F.when(F.col("l_linestatus") == "F", F.concat(
            F.lit("dv:f:"), F.col("l_discount").cast("decimal(6,4)").cast("string"))),
        F.concat(F.lit("cg:Z:"), cigar),
    ]
    return corpus.spread_table(spark, sf, "lineitem").select(
        F.concat_ws("\t", *[f.cast("string") for f in fields]).alias("value")
    )


def _blocks(spark, sf):
    return alignment.parse_paf(paf_lines(spark, sf))


def paf_parse(spark, sf):
    return _blocks(spark, sf).withColumn("identity", F.round("identity", 6))


def block_filter_counts(spark, sf):
    return alignment.filter_counts(_blocks(spark, sf), MIN_LEN, MIN_IDENTITY)


def block_stats(spark, sf):
    kept = _blocks(spark, sf).where(alignment.passes(MIN_LEN, MIN_IDENTITY))
    return alignment.summarise(kept)


def align_tsv(spark, sf):
    """Tab-separated report of the kept blocks, identity in percent."""
    kept = _blocks(spark, sf).where(alignment.passes(MIN_LEN, MIN_IDENTITY))
    # Exact hundredths of a percent: halves cannot occur after rounding at nine digits.
    pct = F.round(F.round(F.col("identity") * 100, 9), 2).cast("decimal(6,2)").cast("string")
    cols = ["query_name", "query_start", "query_end", "target_name", "target_start", "target_end"]
    return kept.select(F.concat_ws(
        "\t", *[F.col(c).cast("string") for c in cols], F.concat(pct, F.lit("%")),
        F.col("block_len").cast("string"),
    ).alias("line"))


def cigar_ops(spark, sf):
    ops = _blocks(spark, sf).select(
        F.posexplode(alignment.cigar_ops(F.col("cigar"))).alias("op_idx", "o")
    )
    return ops.groupBy(F.col("op_idx").cast("long").alias("op_idx"), F.col("o.op").alias("op")).agg(
        F.count(F.lit(1)).alias("ops"), F.sum("o.len").alias("bases")
    )


def cigar_exact_runs(spark, sf):
    return alignment.exact_runs(_blocks(spark, sf), MIN_RUN)


def _merged_exact(spark, sf):
    return intervals.merge(
        cigar_exact_runs(spark, sf), "target_name", "target_start", "target_end"
    )


def exact_coverage(spark, sf):
    """Bases of every target inside at least one exact run."""
    return intervals.covered(_merged_exact(spark, sf), "target_name")


def _line_intervals(spark, sf):
    return corpus.spread_table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("key"), F.col("l_partkey").alias("start"),
        (F.col("l_partkey") + F.floor(F.col("l_quantity") / 8).cast("long") + 1).alias("end"),
    )


def _line_tasks(spark, sf):
    return blocked.tasks_of(corpus.table(spark, sf, "lineitem"))


def interval_merge(spark, sf):
    return intervals.merge(_line_intervals(spark, sf), "key", tasks=_line_tasks(spark, sf))


def covered_bases(spark, sf):
    return intervals.covered(interval_merge(spark, sf), "key")


def regions_from_cuts(spark, sf):
    """Regions of each supplier's line, cut at every interval boundary."""
    ivs = _line_intervals(spark, sf)
    cuts = ivs.select("key", F.explode(F.array("start", "end")).alias("pos"))
    lengths = ivs.groupBy("key").agg((F.max("end") + 10).alias("length"))
    tasks = _line_tasks(spark, sf)
    return intervals.regions(cuts, lengths, intervals.merge(ivs, "key", tasks=tasks), "key", tasks=tasks)


def shared_regions(spark, sf):
    return regions_from_cuts(spark, sf).groupBy("key").agg(
        F.count(F.lit(1)).alias("regions"), F.count_if("shared").alias("shared")
    )


QUERIES = {
    f.__name__: f
    for f in (
        paf_parse, block_filter_counts, block_stats, align_tsv, cigar_ops, cigar_exact_runs,
        exact_coverage, interval_merge, covered_bases, regions_from_cuts, shared_regions,
    )
}

BLOCKS = """
raw AS (
  SELECT row_number() OVER () AS id, CAST(l_quantity AS BIGINT) AS q, CAST(l_linenumber AS BIGINT) AS n, *
  FROM lineitem
),
blocks AS (
  SELECT id, 'P' || l_partkey AS query_name, l_orderkey AS query_start,
    l_orderkey + 4 * q + 3 * n AS query_end,
    CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS strand,
    'S' || l_suppkey AS target_name, l_partkey AS target_start,
    l_partkey + 4 * q + 3 * n AS target_end, 4 * q + n AS matches, 4 * (q + n) AS block_len,
    CASE WHEN l_linestatus = 'F' THEN 1.0::DOUBLE - round(l_discount, 4)
         ELSE (4 * q + n)::DOUBLE / (4 * (q + n)) END AS identity,
    q || '=' || n || 'X' || (q + n) || '=' || n || 'I' || q || '=' || n || 'D' || q || '=' AS cigar
  FROM raw
),
kept AS (SELECT * FROM blocks WHERE block_len >= 60 AND identity >= 0.93),
ops AS (
  SELECT b.*, t.i - 1 AS op_idx,
    CAST(regexp_extract_all(cigar, '([0-9]*)([^0-9])', 1)[t.i] AS BIGINT) AS len,
    regexp_extract_all(cigar, '([0-9]*)([^0-9])', 2)[t.i] AS op
  FROM blocks b, unnest(range(1, 8)) AS t(i)
)"""
RUNS = BLOCKS + """,
walk AS (
  SELECT *,
    coalesce(sum(CASE WHEN op IN ('=', 'X', 'D') THEN len ELSE 0 END) OVER w, 0) AS t_off,
    coalesce(sum(CASE WHEN op IN ('=', 'X', 'I') THEN len ELSE 0 END) OVER w, 0) AS q_off,
    coalesce(sum(CASE WHEN op <> '=' THEN 1 ELSE 0 END) OVER w, 0) AS grp
  FROM ops
  WINDOW w AS (PARTITION BY id ORDER BY op_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
runs AS (
  SELECT id, query_name, target_name, strand, CAST(min(target_start + t_off) AS BIGINT) AS target_start,
    CAST(sum(len) AS BIGINT) AS n,
    CAST(CASE WHEN strand = '+' THEN min(query_start + q_off)
         ELSE min(query_end - q_off) - sum(len) END AS BIGINT) AS query_start
  FROM walk WHERE op = '=' GROUP BY id, query_name, target_name, strand, grp
  HAVING sum(len) >= 20
)"""
_MERGE = """,
flagged AS (
  SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY key ORDER BY s, e
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS f
  FROM (SELECT DISTINCT key, s, e FROM iv)
),
numbered AS (
  SELECT *, sum(f) OVER (PARTITION BY key ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM flagged
),
merged AS (SELECT key, min(s) AS "start", max(e) AS "end" FROM numbered GROUP BY key, g)"""
LINES = """
iv AS (SELECT l_suppkey AS key, l_partkey AS s,
       l_partkey + CAST(floor(l_quantity / 8) AS BIGINT) + 1 AS e FROM lineitem)""" + _MERGE
_REGIONS = LINES + """,
len AS (SELECT key, max(e) + 10 AS length FROM iv GROUP BY key),
pts AS (
  SELECT key, s AS pos FROM iv UNION SELECT key, e FROM iv
  UNION SELECT key, 0 FROM len UNION SELECT key, length FROM len
),
pieces AS (
  SELECT * FROM (SELECT key, pos AS "start", lead(pos) OVER (PARTITION BY key ORDER BY pos) AS "end"
                 FROM pts WHERE pos >= 0) WHERE "end" IS NOT NULL
),
regions AS (
  SELECT p.key, p."start", p."end", EXISTS (
    SELECT 1 FROM merged m WHERE m.key = p.key AND m."start" <= p."start" AND p."end" <= m."end"
  ) AS shared
  FROM pieces p
)"""

ORACLES = {
    "paf_parse": f"""WITH {BLOCKS}
        SELECT query_name, query_start, query_end, strand, target_name, target_start, target_end,
               matches, block_len, round(identity, 6) AS identity, cigar FROM blocks""",
    "block_filter_counts": f"""WITH {BLOCKS}
        SELECT count(*) AS raw, count(*) FILTER (block_len < 60) AS too_short,
          count(*) FILTER (block_len >= 60 AND identity < 0.93) AS low_identity,
          count(*) FILTER (block_len >= 60 AND identity >= 0.93) AS kept FROM blocks""",
    "block_stats": f"""WITH {BLOCKS}
        SELECT count(*) AS blocks, CAST(sum(target_end - target_start) AS BIGINT) AS target_span,
               round(avg(identity), 6) AS avg_identity FROM kept""",
    "align_tsv": f"""WITH {BLOCKS}
        SELECT concat_ws(chr(9), query_name, query_start, query_end, target_name, target_start,
          target_end, CAST(CAST(round(round(identity * 100, 9), 2) AS DECIMAL(6,2)) AS VARCHAR)
          || '%', block_len) AS line FROM kept""",
    "cigar_ops": f"""WITH {BLOCKS}
        SELECT op_idx, op, count(*) AS ops, CAST(sum(len) AS BIGINT) AS bases
        FROM ops GROUP BY op_idx, op""",
    "cigar_exact_runs": f"""WITH {RUNS}
        SELECT query_name, target_name, strand, target_start, target_start + n AS target_end,
               query_start, query_start + n AS query_end FROM runs""",
    "exact_coverage": f"""WITH {RUNS},
        iv AS (SELECT target_name AS key, target_start AS s, target_start + n AS e FROM runs)
        {_MERGE}
        SELECT key AS target_name, CAST(sum("end" - "start") AS BIGINT) AS covered
        FROM merged GROUP BY key""",
    "interval_merge": f'WITH {LINES} SELECT key, "start", "end" FROM merged',
    "covered_bases": f"""WITH {LINES}
        SELECT key, CAST(sum("end" - "start") AS BIGINT) AS covered FROM merged GROUP BY key""",
    "regions_from_cuts": f"WITH {_REGIONS} SELECT * FROM regions",
    "shared_regions": f"""WITH {_REGIONS}
        SELECT key, count(*) AS regions, count(*) FILTER (shared) AS shared
        FROM regions GROUP BY key""",
}
