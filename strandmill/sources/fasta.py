"""FASTA files as rows of chromosomes, and back."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.functions.bases import FASTA_WIDTH, wrap
from strandmill.functions.names import assembly_of


def _places(batches):
    """Number the records of each file split, dropping text before a file's first header."""
    now, n = None, 0
    for batch in batches:
        keep, place = [], []
        starts = pc.starts_with(batch.column("value"), ">").to_pylist()
        where = zip(batch.column("file").to_pylist(), batch.column("split").to_pylist())
        for row, (split, header) in enumerate(zip(where, starts)):
            n = 0 if split != now else n + 1
            now = split
            if header or n > 0 or split[1] > 0:
                keep.append(row)
                place.append(split[1] + n)
        kept = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("value").take(kept), batch.column("file").take(kept), pa.array(place, pa.int64())],
            names=["value", "file", "place"],
        )


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(assembly, chrom_idx, chrom, seq) for every record of every file.

    Records are separated by a line break and ``>``, which the text source can split on,
    so one big file is read by many tasks.  ``chrom_idx`` is the byte offset of the split
    plus the place inside it: it orders the records of a file without any shuffle, but
    has gaps.  The assembly is the file name without its extension.  Names end at the
    first blank, sequences are upper-cased with trailing blanks of each line removed, and
    anything before the first header is dropped.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
    )
    records = raw.mapInArrow(_places, "value string, file string, place bigint")
    # Splitting takes the mark off every record but the first of a file.
    head = F.regexp_extract(F.when(F.col("place") == 0, F.expr("substr(value, 2)")).otherwise(F.col("value")), r"^([^\n]*)", 1)
    body = F.regexp_replace("value", r"^[^\n]*\n?", "")
    return records.select(
        assembly_of(F.col("file")).alias("assembly"),
        F.col("place").alias("chrom_idx"),
        F.regexp_extract(F.regexp_replace(head, r"\r$", ""), r"^([^ \t]*)", 1).alias("chrom"),
        F.upper(F.regexp_replace(body, r"[ \r]*(\n|$)", "")).alias("seq"),
    )


def write_fasta(chroms: DataFrame, path: str, width: int = FASTA_WIDTH) -> None:
    """Write (assembly, chrom_idx, chrom, seq) as FASTA, one directory per assembly.

    Chromosomes are range-partitioned in genome order; the part files of a directory,
    read by name, are the genome.  No task writes more than its range.
    """
    data = F.col("seq").cast("binary")
    body = F.transform(wrap(data, width), lambda x: F.decode(x, "ISO-8859-1"))
    record = F.concat_ws("\n", F.concat(F.lit(">"), F.col("chrom").cast("string")), body)
    (
        chroms.repartitionByRange("assembly", "chrom_idx")
        .sortWithinPartitions("assembly", "chrom_idx")
        .select("assembly", record.alias("value"))
        .write.partitionBy("assembly").mode("errorifexists").text(path)
    )
