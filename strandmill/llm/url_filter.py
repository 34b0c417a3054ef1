"""URL verdicts from rules and, where none fits, from a path-template tree per host.

DataFrame functions only.  Pages with a rule are the labelled ones.

1. Runs of digits and long hexadecimal segments become ``#``, which leaves few different
   (host, path) rows; all statistics work on those rows with their page and label counts.
2. Level by level, a node whose children mostly occur once gets one wildcard child ``*`` in their
   place.  What follows the first ``DEPTH`` segments is one last segment, as it is.
3. Branches of a host that differ in their first segment only and whose smoothed share of blocked
   labels falls into the same quarter are merged: their labels count together.  A branch without
   labels merges with all its labelled siblings.
4. A template is rejected if its share of blocked labels, smoothed by the share over all labels
   with weight ``PRIOR``, reaches one half; for a branch without labels its siblings must agree
   more, at ``AGREED``.  A template without any label among its siblings is allowed.

Pages with equal urls get equal verdicts, and nothing depends on an order, so there are no ties.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The rules of the contract.
RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]
DEPTH = 3
MANY = 10  # children from which a node may get a wildcard
PRIOR = 2.0
AGREED = 0.75
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_HEX = r"(^|/)[0-9a-fA-F-]{16,}(?=/|\z|\.)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, ties to the smaller text; nulls if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1]), reverse=True)[::-1]:
        own, below = re.fullmatch(r"([^/]*)(.*)", rule, re.S).groups()
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(below))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _shape(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, _HEX, "$1#"), "[0-9]+", "#")


def _templates(shapes: DataFrame) -> DataFrame:
    """``shapes`` with ``first`` and ``rest`` of each template."""
    rows = shapes.withColumn("__s", F.split("shape", "/")).withColumn("__prefix", F.lit(""))
    for level in range(1, DEPTH + 1):
        part = F.coalesce(F.get("__s", F.lit(level)), F.lit(""))
        rows = rows.withColumn("__seg", part)
        children = rows.where(F.size("__s") > level).groupBy("host", "__prefix", "__seg").agg(F.sum("pages").alias("n"))
        wild = children.groupBy("host", "__prefix").agg(F.count("*").alias("k"), F.count_if(F.col("n") == 1).alias("once"))
        wild = wild.where((F.col("k") >= MANY) & (2 * F.col("once") >= F.col("k"))).select("host", "__prefix", F.lit("*").alias("__wild"))
        rows = rows.join(wild, ["host", "__prefix"], "left")
        step = F.when(F.size("__s") <= level, F.lit("")).otherwise(F.concat(F.lit("/"), F.coalesce("__wild", "__seg")))
        rows = rows.withColumn("__step", step)
        rows = rows.withColumn("__prefix", F.concat("__prefix", "__step"))
        rows = rows.withColumn("first", F.col("__step")) if level == 1 else rows.withColumn("rest", F.concat("rest", "__step"))
        rows = rows.withColumn("rest", F.lit("")) if level == 1 else rows
        rows = rows.drop("__seg", "__wild", "__step")
    deeper = F.concat(F.lit("/"), F.array_join(F.slice("__s", DEPTH + 2, F.greatest(F.size("__s"), F.lit(1))), "/"))
    deeper = F.when(F.size("__s") > DEPTH + 1, deeper).otherwise(F.lit(""))
    return rows.withColumn("rest", F.concat("rest", deeper)).drop("__s", "__prefix")


def judge(pages: DataFrame, url_col: str = "url", rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """All columns of ``pages`` and a struct ``url_verdict`` of (host, path, rule, verdict, template).

    A null url or one without ``://`` has an empty host and path, which form a template like any
    other.  Repeated rows count once each.  ``template`` is null where a rule decides.
    """
    rules = RULES if rules is None else rules
    url = F.col(url_col)
    host, path = host_of(url), path_of(url)
    seen = pages.select(host.alias("host"), path.alias("path"), url.alias("url"))
    seen = seen.withColumn("found", rule_of(F.col("host"), F.col("path"), rules)).withColumn("shape", _shape(F.col("path")))
    blocked = F.count_if(F.col("found.verdict") == "block")
    shapes = seen.groupBy("host", "shape").agg(
        F.count("*").alias("pages"), blocked.alias("blocks"), F.count("found.verdict").alias("labels"))
    rows = _templates(shapes)
    total = shapes.agg((F.sum("blocks") / F.greatest(F.sum("labels"), F.lit(1))).alias("share"))
    smooth = (F.col("blocks") + PRIOR * F.coalesce("share", F.lit(0.0))) / (F.col("labels") + PRIOR)
    branches = rows.groupBy("host", "first", "rest").agg(F.sum("blocks").alias("blocks"), F.sum("labels").alias("labels"))
    branches = branches.join(F.broadcast(total), F.lit(True), "left")  # one row
    kind = F.when(F.col("labels") == 0, F.lit(-1)).otherwise(F.floor(4 * smooth).cast("int"))
    branches = branches.withColumn("kind", kind)
    groups = branches.where("labels > 0").groupBy("host", "rest", "kind").agg(
        F.sum("blocks").alias("blocks"), F.sum("labels").alias("labels"), F.max("share").alias("share"))
    siblings = groups.groupBy("host", "rest").agg(F.sum("blocks").alias("blocks"), F.sum("labels").alias("labels"), F.max("share").alias("share"))
    rejected = groups.where(smooth >= 0.5).select("host", "rest", "kind").unionByName(
        siblings.where(smooth >= AGREED).select("host", "rest", F.lit(-1).alias("kind"))).withColumn("verdict", F.lit("block"))
    judged = branches.join(rejected, ["host", "rest", "kind"], "left").select(
        "host", "first", "rest", F.coalesce("verdict", F.lit("allow")).alias("verdict"))
    by_shape = rows.select("host", "shape", "first", "rest").join(judged, ["host", "first", "rest"]).select(
        F.col("host").alias("__host"), F.col("shape").alias("__shape"), F.concat("first", "rest").alias("__template"), F.col("verdict").alias("__verdict"))
    named = pages.withColumn("__h", host).withColumn("__p", path)
    named = named.withColumn("__found", rule_of(F.col("__h"), F.col("__p"), rules)).withColumn("__s", _shape(F.col("__p")))
    joined = named.join(by_shape, (F.col("__h") == F.col("__host")) & (F.col("__s") == F.col("__shape")), "left")
    return joined.select(*pages.columns, F.struct(
        F.col("__h").alias("host"), F.col("__p").alias("path"), F.col("__found.rule").alias("rule"),
        F.coalesce("__found.verdict", "__verdict").alias("verdict"),
        F.when(F.col("__found").isNull(), F.col("__template")).alias("template")).alias("url_verdict"))


def oracle_sql() -> str:
    """The same for DuckDB over ``pages``: page_id, host, path, rule, verdict."""
    cases = "".join(
        f" WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{'rule': '{h}{p}', 'verdict': '{v}'}}"
        for v, h, p in sorted(((v, *r.partition("/")[::2]) for v, r in RULES), key=lambda x: (-len(x[1] + x[2]), x[1] + x[2]))
        for p in ["/" + p]
    )
    levels = ""
    for k in range(1, DEPTH + 1):
        before = f"t{k - 1}"
        levels += f""",
        w{k} AS (SELECT host, prefix FROM (SELECT host, prefix, s[{k + 1}] AS seg, sum(pages) AS n FROM {before}
            WHERE len(s) > {k} GROUP BY ALL) GROUP BY ALL HAVING count(*) >= {MANY} AND 2 * count(*) FILTER (n = 1) >= count(*)),
        t{k} AS (SELECT t.* EXCLUDE (prefix, first, rest, step), prefix || step AS prefix,
            {"step AS first, rest" if k == 1 else "first, rest || step AS rest"}
            FROM (SELECT t.*, CASE WHEN len(t.s) <= {k} THEN '' WHEN w.host IS NOT NULL THEN '/*' ELSE '/' || t.s[{k + 1}] END AS step
                FROM {before} t LEFT JOIN w{k} w ON w.host = t.host AND w.prefix = t.prefix) t)"""
    smooth = "(sum(blocks) + {p} * share) / (sum(labels) + {p})".format(p=PRIOR)
    hexes = r"(^|/)[0-9a-fA-F-]{16,}(/|\z|\.)"  # no look-ahead here: the second pass takes neighbours
    return rf"""
        WITH parts AS (SELECT page_id,
                translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
                regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
        ruled AS (SELECT *, CASE{cases} END AS found, regexp_replace(h, '[0-9]+', '#', 'g') AS shape FROM
            (SELECT page_id, host, path, regexp_replace(regexp_replace(path, '{hexes}', '\1#\2', 'g'), '{hexes}', '\1#\2', 'g') AS h FROM parts)),
        t0 AS (SELECT host, shape, string_split(shape, '/') AS s, '' AS prefix, '' AS first, '' AS rest, count(*) AS pages,
            count(*) FILTER (found.verdict = 'block') AS blocks, count(found.verdict) AS labels FROM ruled GROUP BY host, shape){levels},
        rows AS (SELECT host, shape, first, rest || CASE WHEN len(s) > {DEPTH + 1} THEN '/' || array_to_string(s[{DEPTH + 2}:], '/') ELSE '' END AS rest, blocks, labels FROM t{DEPTH}),
        share AS (SELECT coalesce(sum(blocks) / greatest(sum(labels), 1), 0) AS share FROM rows),
        branches AS (SELECT host, first, rest, sum(blocks) AS blocks, sum(labels) AS labels, any_value(share) AS share,
            CASE WHEN sum(labels) = 0 THEN -1 ELSE floor(4 * {smooth.replace("share", "any_value(share)")}) END AS kind FROM rows, share GROUP BY ALL),
        rejected AS (SELECT host, rest, kind FROM branches WHERE labels > 0 GROUP BY ALL HAVING {smooth.replace("share", "any_value(share)")} >= 0.5
            UNION ALL SELECT host, rest, -1 FROM branches WHERE labels > 0 GROUP BY ALL HAVING {smooth.replace("share", "any_value(share)")} >= {AGREED}),
        judged AS (SELECT b.host, b.first, b.rest, CASE WHEN r.host IS NULL THEN 'allow' ELSE 'block' END AS verdict
            FROM branches b LEFT JOIN rejected r ON r.host = b.host AND r.rest = b.rest AND r.kind = b.kind)
        SELECT p.page_id, p.host, p.path, p.found.rule AS rule, coalesce(p.found.verdict, j.verdict) AS verdict
        FROM ruled p JOIN rows t ON t.host = p.host AND t.shape = p.shape
        JOIN judged j ON j.host = t.host AND j.first = t.first AND j.rest = t.rest"""
