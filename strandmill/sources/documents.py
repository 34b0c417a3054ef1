"""JSON documents: manifests, recipes, sketches, activity logs and the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill import schemas
from strandmill.functions.hashing import address, bare
from strandmill.operators.alignment import parse_paf
from strandmill.operators.sketch import unsigned


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Manifest documents as segment rows in genome order; missing lists read as empty."""
    doc = spark.read.schema(schemas.MANIFEST).option("multiLine", True).json(path)
    chroms = doc.select(
        F.coalesce("assembly", F.lit("")).alias("assembly"),
        F.coalesce("organism", F.lit("")).alias("organism"),
        F.coalesce("version", F.lit(0)).alias("version"),
        F.posexplode("chromosomes").alias("chrom_idx", "c"),
    )
    return chroms.select(
        "assembly", "organism", "version", F.col("chrom_idx").cast("long").alias("chrom_idx"),
        F.col("c.name").alias("chrom"), F.col("c.hash").alias("chrom_hash"),
        F.posexplode("c.segments").alias("seg_idx", "s"),
    ).select(
        "assembly", "organism", "version", "chrom_idx", "chrom", "chrom_hash",
        F.col("seg_idx").cast("long").alias("seg_idx"), "s.hash", "s.length",
    )


def write_manifests(manifest: DataFrame, path: str) -> None:
    """Manifests as JSON lines, one line per chromosome under its assembly's directory.

    A line has the shape of a manifest document with a single chromosome, so
    ``read_manifests`` reads it back (without ``multiLine`` the lines of a genome are read
    by many tasks); a genome of any size never becomes one value.
    """
    segs = F.array_sort(F.collect_list(F.struct("seg_idx", "hash", "length")))
    chroms = manifest.groupBy("assembly", "organism", "chrom_idx", "chrom").agg(
        F.sum("length").alias("length"), F.min("chrom_hash").alias("hash"),
        F.transform(segs, lambda s: F.struct(s["hash"].alias("hash"), s["length"].alias("length")))
        .alias("segments"),
    )
    lines = chroms.repartitionByRange("assembly", "chrom_idx").sortWithinPartitions("assembly", "chrom_idx")
    lines.select(
        F.col("assembly").alias("genome"), "assembly", "organism", F.lit(1).alias("version"),
        "chrom_idx",
        F.array(F.struct(F.col("chrom").cast("string").alias("name"), "length", "hash", "segments"))
        .alias("chromosomes"),
    ).write.partitionBy("genome").mode("errorifexists").json(path)


def read_manifest_lines(spark: SparkSession, path: str) -> DataFrame:
    """Segment rows of manifests written by ``write_manifests``."""
    doc = spark.read.schema(schemas.MANIFEST + ", chrom_idx bigint").json(path)
    return doc.select(
        "assembly", "organism", "chrom_idx", F.explode("chromosomes").alias("c")
    ).select(
        "assembly", "organism", "chrom_idx", F.col("c.name").alias("chrom"),
        F.col("c.hash").alias("chrom_hash"), F.posexplode("c.segments").alias("seg_idx", "s"),
    ).select(
        "assembly", "organism", "chrom_idx", "chrom", "chrom_hash",
        F.col("seg_idx").cast("long").alias("seg_idx"), "s.hash", "s.length",
    )


def read_recipes(spark: SparkSession, path: str) -> DataFrame:
    doc = spark.read.schema(schemas.RECIPE).option("multiLine", True).json(path)
    return doc.select(
        "assembly", "reference", "total_size", F.posexplode("chunks").alias("chunk_idx", "c")
    ).select("assembly", "reference", "total_size", "chunk_idx", bare(F.col("c.hash")).alias("hash"), "c.length")


def read_sketches(spark: SparkSession, path: str) -> DataFrame:
    """Sketches with hashes in the engine's order-keeping signed form."""
    doc = spark.read.schema(schemas.SKETCH).option("multiLine", True).json(path)
    offset = F.lit(str(2**63)).cast("decimal(20,0)")
    return doc.withColumn(
        "hashes", F.transform("hashes", lambda h: (h - offset).cast("bigint"))
    )


def write_sketches(sketches: DataFrame, path: str, kmer: int, size: int) -> None:
    sketches.select(
        "assembly", F.lit(kmer).alias("kmer"), F.lit(size).alias("size"),
        F.transform("hashes", unsigned).alias("hashes"),
    ).write.mode("errorifexists").json(path)


def read_activity(spark: SparkSession, path: str) -> DataFrame:
    """Activity log lines; blank and malformed ones are skipped."""
    return spark.read.schema(schemas.ACTIVITY).option("mode", "DROPMALFORMED").json(path)


def append_activity(events: DataFrame, path: str) -> None:
    """Append events, stamping those without a time."""
    events.withColumn("time", F.coalesce("time", F.current_timestamp())).write.mode("append").json(path)


def read_paf(spark: SparkSession, path: str) -> DataFrame:
    return parse_paf(spark.read.text(path))


def artifact_kind(path: Column) -> Column:
    """Kind of a catalog file by its name; null for anything else."""
    # File name endings of the catalog.
    return (
        F.when(F.endswith(path, F.lit(".deltarecipe.json")), "recipe")
        .when(F.endswith(path, F.lit(".manifest.json")), "manifest")
        .when(F.endswith(path, F.lit(".delta.ghd")) | F.endswith(path, F.lit(".delta.json")), "delta")
    )


def catalog(entries: DataFrame) -> DataFrame:
    """Latest file per (assembly, kind) of (path, assembly); names sort as they are listed."""
    kinds = entries.withColumn("kind", artifact_kind(F.col("path"))).where(
        F.col("kind").isNotNull() & (F.col("assembly") != "")
    )
    return kinds.groupBy("assembly", "kind").agg(F.max("path").alias("path"))


def scan_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """Catalog of a directory of artifacts, keyed by the assembly each declares: JSON documents in
    their ``assembly`` field, binary deltas in their header."""
    from strandmill.sources import deltas

    declared = (
        spark.read.schema("assembly string").option("multiLine", True)
        .option("pathGlobFilter", "*.json").json(folder)
        .select("assembly", F.col("_metadata.file_path").alias("path"))
    )
    return catalog(declared.unionByName(deltas.declared(spark, folder)))


def unseed(entries: DataFrame, assembly: str) -> DataFrame:
    """Drop one catalog entry of a genome: its manifest, else its recipe, else its delta."""
    rank = F.when(F.col("kind") == "manifest", 0).when(F.col("kind") == "recipe", 1).otherwise(2)
    chosen = entries.where(F.col("assembly") == assembly).agg(F.min(rank).alias("r"))
    mine = entries.withColumn("first", chosen.scalar())
    gone = (F.col("assembly") == assembly) & (rank == F.col("first"))
    return mine.where(~gone).drop("first")


def mirror(store: DataFrame, refs: DataFrame, path: str) -> None:
    """Static export of every referenced segment, filed under the first hash digits."""
    wanted = refs.select("hash").distinct()
    store.join(wanted, "hash", "left_semi").withColumn(
        "shelf", F.substring(bare(F.col("hash")), 1, 2)
    ).repartition("shelf", F.substring(bare(F.col("hash")), 3, 1)).write.partitionBy("shelf").mode(
        "errorifexists"
    ).parquet(path)


def write_matches(mems: DataFrame, path: str) -> None:
    """Verified matches as JSON, one directory per target and query genome."""
    mems.write.partitionBy("target_genome", "query_genome").mode("append").json(path)


def file_addresses(spark: SparkSession, path: str) -> DataFrame:
    """Content address of every file, the key under which its alignments are kept."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", address(F.col("content")).alias("hash"), "length")
