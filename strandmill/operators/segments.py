"""Deduplication index: references, tiers, coverage and transfer plans.

A *manifest* has one row per segment occurrence:
``assembly, chrom, seg_idx, hash, length``.  A *reference* table is its distinct
``(hash, assembly)`` form and a *refcount* table has one row per hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.operators.spread import spread_join

BAR_WIDTH = 60


def references(manifest: DataFrame) -> DataFrame:
    """Distinct (hash, assembly) with occurrence counts and the first position."""
    return manifest.groupBy("hash", "assembly").agg(
        F.min("length").alias("length"),
        F.count(F.lit(1)).alias("occurrences"),
    )


def refcounts(refs: DataFrame) -> DataFrame:
    """One row per hash: genomes referencing it, one of them, and total occurrences."""
    return refs.groupBy("hash").agg(
        F.max("length").alias("length"),
        F.count(F.lit(1)).alias("rc"),
        F.min("assembly").alias("owner"),
        F.sum("occurrences").alias("occurrences"),
    )


def genome_count(genomes: DataFrame) -> Column:
    return genomes.agg(F.count_distinct("assembly")).scalar()


def tier(rc: Column, n: Column) -> Column:
    """Core wins over unique, so a single-genome index is all core."""
    return F.when(rc == n, "core").when(rc == 1, "unique").otherwise("partial")


def summary(counts: DataFrame, genomes: DataFrame) -> DataFrame:
    """One row of three-tier totals; naive counts a segment once per genome."""
    by_rc = counts.groupBy("rc").agg(
        F.count(F.lit(1)).alias("segments"), F.sum("length").alias("bytes")
    )
    tiered = by_rc.withColumn("n", genome_count(genomes)).withColumn(
        "tier", tier(F.col("rc"), F.col("n"))
    )

    def total(name: str) -> Column:
        picked = F.when(F.col("tier") == name, F.col("bytes")).otherwise(0)
        return F.coalesce(F.sum(picked), F.lit(0)).alias(f"{name}_bytes")

    return tiered.agg(
        F.max("n").cast("long").alias("genomes"),
        F.sum("segments").alias("segments"),
        total("core"),
        total("partial"),
        total("unique"),
        F.sum("bytes").alias("stored_bytes"),
        F.sum(F.col("bytes") * F.col("rc")).alias("naive_bytes"),
    )


def savings(summary_row: DataFrame) -> DataFrame:
    saved = F.col("naive_bytes") - F.col("stored_bytes")
    pct = F.when(F.col("naive_bytes") > 0, saved * 100.0 / F.col("naive_bytes"))
    return summary_row.select(
        "stored_bytes",
        "naive_bytes",
        saved.alias("saved_bytes"),
        F.round(F.coalesce(pct, F.lit(0.0)), 6).alias("saved_pct"),
    )


def unique_per_genome(counts: DataFrame, genomes: DataFrame) -> DataFrame:
    """Bytes only one genome references, zero-filled; nothing is unique when n = 1."""
    lone = (
        counts.where(F.col("rc") == 1)
        .groupBy(F.col("owner").alias("assembly"))
        .agg(F.sum("length").alias("bytes"))
    )
    several = genome_count(genomes) > 1
    return (
        genomes.select("assembly").distinct()
        .join(lone, "assembly", "left")
        .select(
            "assembly",
            F.when(several, F.coalesce("bytes", F.lit(0))).otherwise(0).cast("long")
            .alias("unique_bytes"),
        )
    )


def delete_plan(counts: DataFrame, refs: DataFrame) -> DataFrame:
    """Per genome: segments removed and kept if that genome alone were deleted."""
    lone = (
        counts.where(F.col("rc") == 1)
        .groupBy(F.col("owner").alias("assembly"))
        .agg(F.count(F.lit(1)).alias("deleted"))
    )
    mine = refs.groupBy("assembly").agg(F.count(F.lit(1)).alias("total"))
    deleted = F.coalesce("deleted", F.lit(0))
    return mine.join(lone, "assembly", "left").select(
        "assembly", deleted.alias("deleted"), (F.col("total") - deleted).alias("kept")
    )


def remove_genome(refs: DataFrame, assembly: str) -> DataFrame:
    """References left after a genome is dropped; orphaned segments go with it."""
    return refs.where(F.col("assembly") != assembly)


def drop_reference(refs: DataFrame, doomed: DataFrame) -> DataFrame:
    """References left after single (hash, assembly) pairs are dropped; a hash without any goes with them."""
    return refs.join(doomed.select("hash", "assembly").distinct(), ["hash", "assembly"], "left_anti")


def only_chromosome(chroms: DataFrame, name) -> DataFrame:
    """The rows of the one chromosome of that name, of any table with a chrom."""
    return chroms.where(F.col("chrom") == name)


def chromosome_hashes(manifest: DataFrame, chroms: DataFrame | None = None) -> DataFrame:
    """Distinct (assembly, hash) of the named chromosomes (assembly, chrom), of all without names."""
    rows = manifest if chroms is None else manifest.join(chroms.select("assembly", "chrom").distinct(), ["assembly", "chrom"], "left_semi")
    return rows.groupBy("assembly", "hash").agg(F.min("length").alias("length"))


def insert_new(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Idempotent content-addressed insert: the first copy of each absent hash."""
    fresh = batch.groupBy("hash").agg(F.min("length").alias("length"))
    return fresh.join(stored.select("hash"), "hash", "left_anti")


def delete_hashes(stored: DataFrame, doomed: DataFrame) -> DataFrame:
    return stored.join(doomed.select("hash").distinct(), "hash", "left_anti")


def with_held(refs: DataFrame, held: DataFrame) -> DataFrame:
    """Flag references whose segment is in the held set (distinct hashes)."""
    flagged = held.select("hash").distinct().withColumn("__held", F.lit(True))
    return refs.join(flagged, "hash", "left").withColumn(
        "held", F.coalesce("__held", F.lit(False))
    ).drop("__held")


def coverage(refs: DataFrame, held: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Held and total *distinct* segments per genome."""
    return with_held(refs, held).groupBy(*(by or ["assembly"])).agg(
        F.count_if("held").alias("have"), F.count(F.lit(1)).alias("total")
    )


def coverage_state(have: Column, total: Column) -> Column:
    return (
        F.when(total == 0, "empty").when(have >= total, "full")
        .when(have > 0, "partial").otherwise("empty")
    )


def chromosome_coverage(manifest: DataFrame, counts: DataFrame, held: DataFrame) -> DataFrame:
    """Held and total segment *occurrences* per chromosome."""
    per_chrom = manifest.groupBy("assembly", "chrom", "hash").agg(
        F.count(F.lit(1)).alias("n")
    )
    flagged = with_held(counts.select("hash", "occurrences"), held)
    return (
        spread_join(per_chrom, flagged, ["hash"], "occurrences", ["assembly", "chrom"])
        .groupBy("assembly", "chrom")
        .agg(
            F.sum(F.when(F.col("held"), F.col("n")).otherwise(0)).alias("have"),
            F.sum("n").alias("segments"),
        )
    )


def fetch_plan(refs: DataFrame, held: DataFrame) -> DataFrame:
    return with_held(refs, held).select(
        "assembly", "hash", F.when(F.col("held"), "have").otherwise("missing").alias("state")
    )


def publish_plan(manifest: DataFrame, origin: DataFrame) -> DataFrame:
    """Hashes the origin lacks, each at its first position in the genome."""
    first = manifest.groupBy("assembly", "hash").agg(
        F.min(F.struct("chrom", "seg_idx")).alias("p")
    )
    return first.join(origin.select("hash").distinct(), "hash", "left_anti").select(
        "assembly", "hash", F.col("p.chrom").alias("chrom"), F.col("p.seg_idx").alias("seg_idx")
    )


def admission(refs: DataFrame, held: DataFrame) -> DataFrame:
    """A manifest is admitted only when every segment occurrence is stored."""
    missing = F.sum(F.when(F.col("held"), 0).otherwise(F.col("occurrences")))
    return with_held(refs, held).groupBy("assembly").agg(
        missing.alias("missing"), (missing == 0).alias("admitted")
    )


def segment_table(manifest: DataFrame, refs: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` distinct hashes in manifest order with the genomes using them."""
    place = F.struct("assembly", "chrom", "seg_idx")
    top = (
        manifest.groupBy("hash")
        .agg(F.min(place).alias("p"), F.min("length").alias("length"))
        .orderBy("p")
        .limit(limit)
    )
    # `limit` rows, so the broadcast is bounded by the argument.
    return (
        refs.select("hash", "assembly")
        .join(F.broadcast(top), "hash")
        .groupBy("hash")
        .agg(
            F.min("p").alias("p"),
            F.min("length").alias("length"),
            F.array_join(F.array_sort(F.collect_set("assembly")), ", ").alias("referenced_by"),
        )
        .select(
            "hash", "length", "referenced_by",
            F.col("p.assembly").alias("assembly"),
            F.col("p.chrom").alias("chrom"),
            F.col("p.seg_idx").alias("seg_idx"),
        )
    )


def bar_cells(
    manifest: DataFrame, counts: DataFrame, genomes: DataFrame, width: int = BAR_WIDTH
) -> DataFrame:
    """Proportional cell width and COR/PAR/UNQ label of every segment occurrence."""
    widest = (
        manifest.groupBy("assembly").agg(F.sum("length").alias("t")).agg(F.max("t")).scalar()
    )
    n = genome_count(genomes)
    cells = spread_join(
        manifest.select("assembly", "chrom", "seg_idx", "hash"),
        counts.select("hash", "length", "rc", "occurrences"),
        ["hash"], "occurrences", ["assembly", "chrom", "seg_idx"],
    )
    scaled = F.floor(F.col("length") * width / F.nullif(widest, F.lit(0)))
    return cells.select(
        "assembly", "chrom", "seg_idx", "length",
        F.greatest(F.lit(1), F.coalesce(scaled, F.lit(0))).cast("long").alias("width"),
        F.when(F.col("rc") == n, "COR").when(F.col("rc") > 1, "PAR").otherwise("UNQ")
        .alias("label"),
    )


def neighbour_sharing(refs: DataFrame, genomes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Benchmark every genome B against the genome A listed before it.

    ``shared`` counts occurrences in B whose hash is in A, which is not symmetric.
    """
    by = by or []
    ordered = genomes.select("assembly").distinct()


    pairs = ordered.select(
        F.col("assembly").alias("b"), F.lag("assembly").over(Window.orderBy("assembly")).alias("a")
    ).where(F.col("a").isNotNull())
    b = refs.join(pairs, refs["assembly"] == pairs["b"]).select(
        *by, "hash", "a", "b", "occurrences"
    )
    # Reads the same columns as the other uses of ``refs``, so they share its exchange.
    a = refs.select(
        *by, "hash", F.col("assembly").alias("a"), (F.col("occurrences") > 0).alias("in_a")
    )
    shared = b.join(a, [*by, "hash", "a"], "left").groupBy(*by, "a", "b").agg(
        F.sum(F.when(F.col("in_a"), F.col("occurrences")).otherwise(0)).alias("shared")
    )
    sizes = refs.groupBy(*by, "assembly").agg(F.sum("occurrences").alias("n"))
    na = sizes.withColumnsRenamed({"assembly": "a", "n": "segments_a"})
    nb = sizes.withColumnsRenamed({"assembly": "b", "n": "segments_b"})
    total = F.col("segments_a") + F.col("segments_b")
    return (
        shared.join(na, [*by, "a"]).join(nb, [*by, "b"])
        .select(
            *by, "a", "b", "segments_a", "segments_b", "shared",
            (total - F.col("shared")).alias("unique_segments"),
            F.round(F.col("shared") / total, 6).alias("dedup_ratio"),
        )
    )
