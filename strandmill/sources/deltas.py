"""Delta files: binary or JSON, one file per genome, as operation rows."""

from __future__ import annotations

import itertools

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill import schemas
from strandmill.functions import ghd
from strandmill.functions.hashing import bare
from strandmill.operators import blocked, chunking

ROWS = 20_000

_JSON = (
    "assembly string, reference string, reference_hash string, chromosomes array<struct<"
    "name:string,length:bigint,hash:string,ops:array<struct<type:string,ref_chrom:string,"
    "ref_start:bigint,ref_end:bigint,bytes:string>>>>"
)


def read_deltas(spark: SparkSession, path: str) -> DataFrame:
    """Operations of all delta files; the first four bytes tell binary from JSON."""
    files = spark.read.format("binaryFile").load(path).select("content")
    magic = F.substring("content", 1, 4) == F.lit(ghd.MAGIC)

    def decode(batches):
        for batch in batches:
            for content in batch["content"]:
                rows = ghd.operations(bytes(content))
                while chunk := list(itertools.islice(rows, ROWS)):
                    yield pd.DataFrame(chunk, columns=columns).astype(
                        {"ref_start": "Int64", "ref_end": "Int64"})

    columns = [c.split()[0] for c in schemas.DELTA_OPS.split(", ")]
    binary = files.where(magic).mapInPandas(decode, schemas.DELTA_OPS)
    text = files.where(~magic).select(F.from_json(F.decode("content", "UTF-8"), _JSON).alias("d"))
    chroms = text.select("d.*", F.posexplode("d.chromosomes").alias("chrom_idx", "c"))
    plain = chroms.select(
        "assembly", "reference", "reference_hash", F.col("chrom_idx").cast("long").alias("chrom_idx"),
        F.col("c.name").alias("chrom"), "c.length", "c.hash", F.posexplode("c.ops").alias("op_idx", "o"),
    ).select(
        "assembly", "reference", "reference_hash", "chrom_idx", "chrom", "length", "hash",
        F.col("op_idx").cast("long").alias("op_idx"), "o.type", "o.ref_chrom",
        F.when(F.col("o.type") == "copy", F.coalesce("o.ref_start", F.lit(0))).alias("ref_start"),
        F.col("o.ref_end").alias("ref_end"), F.unbase64("o.bytes").alias("bytes"),
    )
    return binary.unionByName(plain)


def declared(spark: SparkSession, folder: str) -> DataFrame:
    """(assembly, path) of the binary delta files in a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ghd").load(folder).select("path", "content")

    @F.pandas_udf("string")
    def assembly(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: ghd.declared_assembly(bytes(c)))

    return files.select(assembly("content").alias("assembly"), "path")


def encode_deltas(ops: DataFrame) -> DataFrame:
    """One binary file content per assembly.

    Chromosomes are encoded in parallel.  Only the finished file is put together in one
    place, because a file is one value; deltas beyond that size stay operation rows.
    """
    first = ops.where("type = 'copy'").groupBy("assembly", "ref_chrom").agg(
        F.min(F.struct("chrom_idx", "op_idx")).alias("at")
    )
    at = F.col("at.chrom_idx")
    names = blocked.position(first, ["assembly"], ["at"], at, "ref_index")
    indexed = ops.join(names.select("assembly", "ref_chrom", "ref_index"), ["assembly", "ref_chrom"], "left")
    # Zero where absent: a null would turn the whole list into floating point in Python.
    coords = [F.coalesce(c, F.lit(0)).alias(c) for c in ("ref_index", "ref_start", "ref_end")]
    fields = ["op_idx", "type", *coords, "bytes"]
    chroms = indexed.groupBy("assembly", "reference", "reference_hash", "chrom_idx", "chrom", "length", "hash").agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("ops"),
        F.sum(F.coalesce(F.octet_length("bytes"), F.lit(0))).alias("literal"),
    )

    @F.pandas_udf("binary")
    def body(chrom: pd.Series, length: pd.Series, hash_: pd.Series, op_list: pd.Series) -> pd.Series:
        return pd.Series([ghd.encode_chromosome(*v) for v in zip(chrom, length, hash_, op_list)])

    coded = chroms.withColumn("body", body("chrom", "length", "hash", "ops"))
    table = names.groupBy("assembly").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ref_index", "ref_chrom"))), lambda x: x["ref_chrom"])
        .alias("names")
    )
    parts = F.array_sort(F.collect_list(F.struct("chrom_idx", F.hex("body").alias("x"))))
    files = coded.groupBy("assembly", "reference", "reference_hash").agg(
        F.unhex(F.array_join(F.transform(parts, lambda p: p["x"]), "")).alias("bodies"),
        F.count(F.lit(1)).alias("chroms"), F.sum("length").alias("total_bases"),
        F.sum("literal").alias("literal_bases"), F.now().alias("created"),
    ).join(table, "assembly", "left")

    @F.pandas_udf("binary")
    def lead(header: pd.DataFrame, names_: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([
            ghd.preamble(h, list(x) if x is not None else [], c)
            for h, x, c in zip(header.to_dict("records"), names_, n)
        ])

    header = F.struct(
        F.lit(1).alias("version"), "assembly", "reference", "reference_hash", "total_bases",
        "literal_bases", F.date_format("created", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
    )
    return files.select("assembly", F.concat(lead(header, "names", "chroms"), "bodies").alias("content"))


def recipe_chunks(files: DataFrame, sizes: tuple[int, int] | None = None) -> DataFrame:
    """Pieces of delta files (assembly, content) as segments, so that they deduplicate too."""
    pieces = chunking.chunks(files, ["assembly"], "content", [sizes] if sizes else None)
    return pieces.select(
        "assembly", F.col("seg_idx").alias("chunk_idx"), bare(F.col("hash")).alias("hash"), "length", "data"
    )


def write_recipes(chunks: DataFrame, references: DataFrame, path: str) -> None:
    """Recipes as JSON lines: the chunk hashes of each delta file, in order."""
    listed = F.array_sort(F.collect_list(F.struct("chunk_idx", "hash", "length")))
    recipes = chunks.groupBy("assembly").agg(
        F.sum("length").alias("total_size"),
        F.transform(listed, lambda c: F.struct(c["hash"].alias("hash"), c["length"].alias("length")))
        .alias("chunks"),
    )
    recipes.join(references.select("assembly", "reference"), "assembly").write.mode(
        "errorifexists"
    ).json(path)


def join_chunks(chunks: DataFrame, store: DataFrame) -> DataFrame:
    """Delta files put back together from stored chunks (hash, data)."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_idx", F.hex("data").alias("x"))))
    return chunks.select("assembly", "chunk_idx", "hash").join(store, "hash", "left").groupBy("assembly").agg(
        F.count_if(F.col("data").isNull()).alias("missing"),
        F.unhex(F.array_join(F.transform(parts, lambda p: p["x"]), "")).alias("content"),
    )
