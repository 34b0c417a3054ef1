"""Catalogs, registries and the node log of the distribution network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.operators import blocked
from strandmill.operators.spread import spread_join


def overlay(own: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """Own entries plus cached entries for keys the node does not have itself."""
    return own.unionByName(cached.join(own.select(key), key, "left_anti"))


def registry(docs: DataFrame, refs: DataFrame) -> DataFrame:
    """Browsable index: distinct segments, bases, version and organism per genome."""
    sized = refs.groupBy("assembly").agg(
        F.count(F.lit(1)).alias("segments"),
        F.sum(F.col("length") * F.col("occurrences")).alias("bases"),
    )
    described = docs.groupBy("assembly").agg(
        F.count(F.lit(1)).alias("version"), F.min_by("organism", "chrom").alias("organism")
    )
    return sized.join(described, "assembly")


def discover(
    docs: DataFrame, manifest: DataFrame, held: DataFrame, local_node: str
) -> DataFrame:
    """Union of all nodes' registries: newest version per genome, with our coverage.

    Each organism publishes its own manifest of an assembly; the version is its number
    of chromosomes and ties go to the node listed first.
    """
    owned = manifest.groupBy("organism", "assembly", "hash").agg(F.lit(1).alias("x"))
    sizes = owned.groupBy("organism", "assembly").agg(F.count(F.lit(1)).alias("segments"))
    versions = docs.groupBy("organism", "assembly").agg(F.count(F.lit(1)).alias("version"))
    entry = versions.join(sizes, ["organism", "assembly"])
    best = entry.groupBy("assembly").agg(
        F.min_by(
            F.struct("organism", "version", "segments"), F.struct(-F.col("version"), "organism")
        ).alias("e"),
        F.count(F.lit(1)).alias("sources"),
        F.bool_or(F.col("organism") == local_node).alias("local"),
    ).select("assembly", "e.organism", "e.version", "e.segments", "sources", "local")
    # Coverage of every published manifest first: hashes are spread evenly there, whereas
    # joining the winners first would gather a big genome under one key.
    have = (
        owned.join(held.select("hash").distinct(), "hash", "left_semi")
        .groupBy("assembly", "organism")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return best.join(have, ["assembly", "organism"], "left").select(
        "assembly", F.col("organism").alias("node"), "version", "segments", "sources", "local",
        F.coalesce("n", F.lit(0)).alias("have"),
    )


def attribute_path(path: Column) -> Column:
    """Assembly named directly in a request path; null for other paths."""
    return F.coalesce(
        F.nullif(F.regexp_extract(path, r"^/deltas/(.+)$", 1), F.lit("")),
        F.nullif(F.regexp_extract(path, r"^/genomes/([^/]+)", 1), F.lit("")),
    )


def attribute_requests(requests: DataFrame, refs: DataFrame) -> DataFrame:
    """Adds the assembly of each request ``path``: the one it names, or for a segment the first that
    holds it by the reverse index of ``refs`` (hash, assembly); null if there is none."""
    hash_ = F.nullif(F.regexp_extract("path", r"^/segments/(?:[^:/]*:)?(.+)$", 1), F.lit(""))
    rows = requests.withColumns({"__named": attribute_path(F.col("path")), "__hash": hash_})
    direct = rows.where(F.col("__hash").isNull()).select(*requests.columns, F.col("__named").alias("assembly"))
    asked = rows.where(F.col("__hash").isNotNull())
    plain = refs.select(F.regexp_replace("hash", "^[^:]*:", "").alias("__hash"), "assembly")
    owner = plain.groupBy("__hash").agg(F.min("assembly").alias("assembly"))
    counted = asked.groupBy("__hash").agg(F.count(F.lit(1)).alias("copies")).join(owner, "__hash", "left")
    found = spread_join(asked, counted, ["__hash"], "copies", ["path"])
    return direct.unionByName(found.select(*requests.columns, "assembly"))


def node_views(nodes: DataFrame, announced: DataFrame) -> DataFrame:
    """Nodes with ``held``, the number of different hashes (node, hash) each has announced."""
    held = announced.select("node", "hash").distinct().groupBy("node").agg(F.count(F.lit(1)).alias("held"))
    return nodes.join(held, "node", "left").withColumn("held", F.coalesce("held", F.lit(0).cast("long")))


def matches_search(query: str, *cols: str) -> Column:
    """Case-insensitive substring search over several columns; empty finds all."""
    needle = F.lower(F.trim(F.lit(query)))
    hit = F.lit(False)
    for col in cols:
        hit = hit | F.contains(F.lower(F.col(col)), needle)
    return hit


# --- node log -------------------------------------------------------------------------

ANNOUNCE, HEARTBEAT, LEAVE, SERVED = "signup", "view", "error", "click"


def node_facts(log: DataFrame) -> DataFrame:
    """Per node: latest announcement and its content, latest leave, last sign of life.

    Each fact is a partial aggregate, so a node that wrote a third of the log costs no
    more than any other, and the same aggregate runs on a stream.
    """
    at = F.struct("us", "seq")
    is_a, is_h, is_l = (F.col("op") == op for op in (ANNOUNCE, HEARTBEAT, LEAVE))
    return log.where(is_a | is_h | is_l).groupBy("node").agg(
        F.max(F.when(is_a, at)).alias("announced"),
        F.max(F.when(is_l, at)).alias("left_at"),
        F.max(F.when(is_a | is_h, F.col("us"))).alias("last_seen"),
        F.max_by(F.when(is_a, F.col("content")), F.when(is_a, at)).alias("content"),
    )


def members(facts: DataFrame, now: Column, timeout_us: int) -> DataFrame:
    """Nodes announced since their last leave, with age and liveness."""
    member = F.col("announced").isNotNull() & (
        F.col("left_at").isNull() | (F.col("announced") > F.col("left_at"))
    )
    age = now - F.col("last_seen")
    return facts.where(member).select(
        "node", "content", "last_seen",
        F.floor(age / 1_000_000).cast("long").alias("age_s"),
        (age <= timeout_us).alias("online"),
    )


def announce_fresh(log: DataFrame, skew_us: int, block: Column) -> DataFrame:
    """Announcements checked against the arrival clock, i.e. the latest time seen so far."""
    announced = log.where(F.col("op") == ANNOUNCE)
    clocked = blocked.running(
        announced, [], ["seq"], block, {"clock": ("max", F.col("us"))}, inclusive=True
    )
    return clocked.select("seq", "node", (F.col("clock") - F.col("us") <= skew_us).alias("fresh"))


def cents(amount: Column) -> Column:
    """Hundredths, rounded; a plain cast would turn 0.29 into 28."""
    return (amount * 100).cast("decimal(38,0)").cast("long")


def request_rate(log: DataFrame, window_us: int) -> DataFrame:
    """Requests and bytes per second over the window ending at each served request.

    A request is placed in its own time bucket and the next one; a bucket then holds
    everything its requests can look back on, and no global ordering is needed.
    """
    served = log.where(F.col("op") == SERVED).select(
        "us", cents(F.col("bytes")).alias("cents")
    )
    # Requests of the same microsecond see each other; one row stands for them all.
    ticks = served.groupBy("us").agg(
        F.count(F.lit(1)).alias("hits"), F.sum("cents").alias("cents")
    )
    bucket = F.floor(F.col("us") / window_us).cast("long")
    copies = ticks.select("*", bucket.alias("own")).withColumn(
        "bucket", F.explode(F.array(F.col("own"), F.col("own") + 1))
    )
    back = Window.partitionBy("bucket").orderBy("us").rangeBetween(-window_us, 0)
    seconds = window_us / 1_000_000
    return (
        copies.select(
            "us", "own", "bucket",
            F.sum("hits").over(back).alias("h"),
            F.sum("cents").over(back).alias("c"),
        )
        .where(F.col("own") == F.col("bucket"))
        .select(
            "us",
            F.round(F.col("h") / seconds, 6).alias("requests_per_s"),
            F.round(F.col("c") / (100 * seconds), 6).alias("bytes_per_s"),
        )
    )


def by_priority(candidates: DataFrame, key: str, rank: str) -> DataFrame:
    """The candidate with the lowest rank per key: local before remote, manifest before delta."""
    rest = [c for c in candidates.columns if c != key]
    best = candidates.groupBy(key).agg(F.min_by(F.struct(*rest), rank).alias("b"))
    return best.select(key, *[F.col(f"b.{c}").alias(c) for c in rest])


def merge_addresses(listed: DataFrame) -> DataFrame:
    """Addresses without trailing slashes, empty ones dropped, at their first place."""
    plain = listed.select(F.regexp_replace("address", "/+$", "").alias("address"), "place")
    return plain.where("address <> ''").groupBy("address").agg(F.min("place").alias("place"))


def last_by_name(chroms: DataFrame, name: str, order: str) -> DataFrame:
    """One row per chromosome name; a later duplicate replaces an earlier one."""
    rest = [c for c in chroms.columns if c != name]
    last = chroms.groupBy(name).agg(F.max_by(F.struct(*rest), order).alias("l"))
    return last.select(name, *[F.col(f"l.{c}").alias(c) for c in rest])
