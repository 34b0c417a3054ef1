"""A store of genomes that changes by whole snapshots.

An import writes its new segments, manifests, sketches and log entries into a folder of its own and
then publishes it by one small commit file.  Commits are numbered and created only if their number is
still free, so of two imports that race one has to try again.  Readers see the folders of whole commits
only: an import that dies leaves files that nobody reads.  A genome's manifest in a later commit
replaces the one before; segments are kept once whatever number of imports brings them.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.functions.hashing import address
from strandmill.operators import chunking, segments, sketch

PARTS = {
    "store": "hash string, length long, data binary",
    "manifest": "assembly string, organism string, chrom_idx long, chrom string, chrom_hash string, seg_idx long, hash string, length long",
    "sketches": "assembly string, hashes array<long>",
    "log": "op string, assembly string, bytes long, segments long",
}


class Conflict(RuntimeError):
    """Another import has committed in the meantime."""


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


class Snapshot:
    """The tables of a store as of one commit; number 0 is the empty store."""

    def __init__(self, spark: SparkSession, root: str, number: int, folders: list[tuple[int, str]]):
        self.spark, self.root, self.number, self._folders = spark, root, number, folders

    def _part(self, name: str) -> DataFrame:
        schema = PARTS[name]
        out = self.spark.createDataFrame([], f"{schema}, snapshot long")
        if not self._folders:
            return out
        known = self.spark.createDataFrame([(f"data/{folder}/", n) for n, folder in self._folders], "folder string, snapshot long")
        rows = self.spark.read.schema(schema).parquet(*[f"{self.root}/data/{folder}/{name}" for _, folder in self._folders])
        # One row per commit, as many as there were imports.
        rows = rows.withColumn("folder", F.regexp_extract(F.col("_metadata.file_path"), r"(data/[^/]+/)[^/]+/[^/]+$", 1))
        return rows.join(F.broadcast(known) if len(self._folders) < 10_000 else known, "folder").drop("folder")

    def store(self) -> DataFrame:
        """(hash, length, data), each hash once."""
        return self._part("store").drop("snapshot")

    def _newest(self, name: str) -> DataFrame:
        rows = self._part(name)
        last = rows.groupBy("assembly").agg(F.max("snapshot").alias("snapshot"))
        return rows.join(last, ["assembly", "snapshot"], "left_semi")

    def manifest(self) -> DataFrame:
        """Segment rows of every genome as last imported, with the ``snapshot`` that did."""
        return self._newest("manifest")

    def sketches(self) -> DataFrame:
        return self._newest("sketches").drop("snapshot")

    def log(self) -> DataFrame:
        return self._part("log")

    def index(self) -> DataFrame:
        """References (hash, assembly) of the manifests."""
        return segments.references(self.manifest())


def _commits(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    files, folder = _file_system(spark, f"{root}/commits")
    if not files.exists(folder):
        return []
    rows = spark.read.schema("number long, folder string, _broken string").option("columnNameOfCorruptRecord", "_broken").json(f"{root}/commits")
    # As many rows as imports.  A commit file cut short is no commit.
    return sorted((r.number, r.folder) for r in rows.where("number IS NOT NULL AND folder IS NOT NULL").collect())


def read(spark: SparkSession, root: str, number: int | None = None) -> Snapshot:
    """The newest snapshot of a store, or that of a number."""
    commits = [c for c in _commits(spark, root) if number is None or c[0] <= number]
    if number and (not commits or commits[-1][0] != number):
        raise ValueError(f"{root} has no snapshot {number}")
    return Snapshot(spark, root, commits[-1][0] if commits else 0, commits)


def publish(spark: SparkSession, root: str, number: int, folder: str) -> None:
    """Make a folder part of the store as commit ``number``, unless there is one already."""
    files, place = _file_system(spark, f"{root}/commits/{number:020d}.json")
    try:
        out = files.create(place, False)
    except Exception as taken:
        raise Conflict(f"snapshot {number} of {root} exists") from taken
    out.write(bytearray(json.dumps({"number": number, "folder": folder}).encode()))
    out.close()


def _same(one: DataFrame, other: DataFrame) -> DataFrame:
    """Assemblies with the same manifest rows in both."""
    row = F.xxhash64("chrom_idx", "chrom", "organism", "chrom_hash", "seg_idx", "hash")
    digest = lambda rows: rows.groupBy("assembly").agg(F.bit_xor(row).alias("d"), F.count(F.lit(1)).alias("n"))
    return digest(one).join(digest(other), ["assembly", "d", "n"]).select("assembly")


def import_genomes(
    spark: SparkSession, root: str, chroms: DataFrame, sizes: tuple[int, int] = (chunking.MIN_SIZE, chunking.MAX_SIZE),
    kmer: int = sketch.KMER, sketch_size: int = sketch.SIZE,
) -> Snapshot:
    """Import genomes (assembly, organism, chrom_idx, chrom, seq) and return the snapshot that holds them.

    Only segments the store lacks are written, and only manifests that differ.  If nothing is new
    there is no commit.  An empty sequence has no segments.  On a conflict the import can be repeated.
    """
    before = read(spark, root)
    folder = uuid.uuid4().hex
    path = f"{root}/data/{folder}"
    files, place = _file_system(spark, path)
    given = chroms.select("assembly", "organism", F.col("chrom_idx").cast("long").alias("chrom_idx"), F.col("chrom").cast("string").alias("chrom"),
                          F.col("seq").cast("binary").alias("seq"))
    keep = ["assembly", "organism", "chrom_idx", "chrom", "chrom_hash"]
    cut = chunking.chunks(given.withColumn("chrom_hash", address(F.col("seq"))), keep, "seq", [sizes])
    # Bytes travel only if the store lacks them, so they are cut out again once that is known.
    cut.select(*keep, "seg_idx", "hash", "length").write.parquet(f"{path}/_staged")
    rows = spark.read.parquet(f"{path}/_staged")
    lacking = rows.select("hash").distinct().join(before.store().select("hash"), "hash", "left_anti")
    lacking.write.parquet(f"{path}/_lacking")
    lacking = spark.read.parquet(f"{path}/_lacking")
    fresh = chunking.chunks(given.select("assembly", "seq"), ["assembly"], "seq", [sizes]).join(lacking, "hash", "left_semi")
    fresh = spark.createDataFrame([], PARTS["store"]) if lacking.isEmpty() else fresh.groupBy("hash").agg(F.min("length").alias("length"), F.first("data").alias("data"))
    fresh.write.parquet(f"{path}/store")
    changed = rows.join(_same(rows, before.manifest()), "assembly", "left_anti")
    changed.select([c.split()[0] for c in PARTS["manifest"].split(", ")]).write.parquet(f"{path}/manifest")
    changed = spark.read.parquet(f"{path}/manifest")
    new = changed.select("assembly").distinct()
    kept = given.join(new, "assembly", "left_semi").withColumn("seq", F.col("seq").cast("string"))
    sketch.sketches(sketch.bottom_hashes(kept, "assembly", "seq", kmer, sketch_size), "assembly").select("assembly", "hashes").write.parquet(f"{path}/sketches")
    changed.groupBy("assembly").agg(F.sum("length").alias("bytes"), F.count(F.lit(1)).alias("segments")).select(
        F.lit("import").alias("op"), "assembly", "bytes", "segments").write.parquet(f"{path}/log")
    for name in ("_staged", "_lacking"):
        _, staged = _file_system(spark, f"{path}/{name}")
        files.delete(staged, True)
    if changed.isEmpty() and spark.read.parquet(f"{path}/store").isEmpty():
        files.delete(place, True)
        return before
    publish(spark, root, before.number + 1, folder)
    return read(spark, root, before.number + 1)
