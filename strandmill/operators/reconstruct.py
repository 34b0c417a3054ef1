"""Rebuilding sequences from manifests and the segment store, and checking them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.functions.hashing import address, bare
from strandmill.operators import blocked
from strandmill.operators.digest import ordered_root
from strandmill.operators.spread import spread_join

CHROMS_PER_BLOCK = 4_096


def _chrom_block(rows: DataFrame, chrom: str = "chrom") -> Column:
    """Blocks along the chromosome order: of numbers, or of the first two letters of names."""
    if rows.schema[chrom].dataType.typeName() != "string":
        return blocked.block_of(chrom, CHROMS_PER_BLOCK)
    return F.ascii(chrom).cast("long") * (1 << 21) + F.ascii(F.substring(chrom, 2, 1))


def store_of(segments: DataFrame) -> DataFrame:
    """Content-addressed store: one copy of every segment and how often it is used."""
    return segments.groupBy("hash").agg(
        F.max("data").alias("data"), F.count(F.lit(1)).alias("occurrences")
    )


def assemble(manifest: DataFrame, store: DataFrame, glue: str = "") -> DataFrame:
    """Chromosomes put together from stored segments, in segment order.

    ``missing`` counts occurrences without a stored segment; such a chromosome cannot be
    rebuilt and its ``data`` is null.  The group is one chromosome, which is one value of
    the result, so it is bounded by the size of a cell.
    """
    placed = spread_join(
        manifest.select("assembly", "chrom", "seg_idx", "hash"), store, ["hash"],
        "occurrences", ["assembly", "chrom", "seg_idx"], how="left",
    )
    pieces = F.array_sort(F.collect_list(F.struct("seg_idx", "data")))
    missing = F.count_if(F.col("data").isNull())
    return placed.groupBy("assembly", "chrom").agg(
        missing.alias("missing"),
        F.when(missing == 0, F.array_join(F.transform(pieces, lambda p: p["data"]), glue))
        .alias("data"),
    )


def verified_segments(arrived: DataFrame) -> DataFrame:
    """The best valid copy of each segment: right hash first, then source priority."""
    return (
        arrived.where(address(F.col("data")) == F.col("hash"))
        .groupBy("hash")
        .agg(F.min_by(F.struct("data", "source_rank"), "source_rank").alias("s"))
        .select("hash", "s.data", "s.source_rank")
    )


def chrom_index(chroms: DataFrame, block: Column | None = None) -> DataFrame:
    """0-based place of each chromosome inside its assembly."""
    block = _chrom_block(chroms) if block is None else block
    return blocked.position(chroms, ["assembly"], ["chrom"], block, "chrom_idx")


def verify_positional(original: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Compare two genomes chromosome by chromosome, by place; reordering fails."""
    a = chrom_index(original).select(
        "assembly", "chrom_idx", F.col("chrom").alias("chrom_a"), F.col("hash").alias("hash_a")
    )
    b = chrom_index(rebuilt).select(
        "assembly", "chrom_idx", F.col("chrom").alias("chrom_b"), F.col("hash").alias("hash_b")
    )
    both = F.col("chrom_a").isNotNull() & F.col("chrom_b").isNotNull()
    renamed = both & (F.col("chrom_a") != F.col("chrom_b"))
    changed = both & ~renamed & (F.col("hash_a") != F.col("hash_b"))
    per = a.join(b, ["assembly", "chrom_idx"], "full").groupBy("assembly").agg(
        F.count("chrom_a").alias("original"),
        F.count("chrom_b").alias("reconstructed"),
        F.count_if(renamed).alias("renamed"),
        F.count_if(changed).alias("changed"),
    )
    same = F.col("original") == F.col("reconstructed")
    return per.withColumn(
        "verified", same & (F.col("renamed") == 0) & (F.col("changed") == 0)
    )


def segments_root(manifest: DataFrame) -> DataFrame:
    """Root hash of each assembly over its segment addresses in genome order."""
    placed = blocked.position(
        manifest.select("assembly", "chrom", "seg_idx", "hash"),
        ["assembly"], ["chrom", "seg_idx"], _chrom_block(manifest),
    )
    return ordered_root(placed, "assembly", "position", F.col("hash"), "segments_root")


def hashes_digest(refs: DataFrame, owner: str = "assembly") -> DataFrame:
    """Order-independent digest of a held set: sorted, newline-terminated."""
    plain = refs.select(owner, bare(F.col("hash")).alias("h"))
    # Hashes are uniform, so their leading digits cut the sorted order into even blocks.
    lead = F.conv(F.substring("h", 1, 4), 16, 10).cast("long")
    placed = blocked.position(plain, [owner], ["h"], lead)
    return ordered_root(placed, owner, "position", F.concat("h", F.lit("\n")), "digest")


def reference_hash(chroms: DataFrame, group: str) -> DataFrame:
    """Hash of a reference: every chromosome's name and bytes, then their order."""
    nul = F.lit(b"\x00")
    token = F.sha2(F.concat(
        F.encode(F.col("chrom").cast("string"), "UTF-8"), nul, F.encode("text", "UTF-8"), nul
    ), 256)
    tokens = chroms.select(group, "chrom", token.alias("token"))
    placed = blocked.position(
        tokens, [group], ["chrom"], _chrom_block(tokens)
    )
    return ordered_root(placed, group, "position", F.col("token"), "reference_hash")


def offsets(rows: DataFrame, key: str, index: str, length: Column, per_block: int = 65_536) -> DataFrame:
    """Start of every piece inside its sequence, as a prefix sum of lengths."""
    sized = rows.withColumn("length", length)
    return blocked.running(
        sized, [key], [index], blocked.block_of(index, per_block), {"start": ("sum", F.col("length"))}
    )
