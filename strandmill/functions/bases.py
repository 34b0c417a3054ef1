"""Base-level string functions; they work on bytes, not characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FASTA_WIDTH = 60


def byte_string(text: Column) -> Column:
    """A string with one character per UTF-8 byte, so string functions count bytes."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def reverse_complement(seq: Column) -> Column:
    """Reverse complement of a one-character-per-byte string; other bytes become N."""
    known = F.upper(F.regexp_replace(seq, "[^ACGTacgt]", "N"))
    return F.reverse(F.translate(known, "ACGT", "TGCA"))


def wrap(data: Column, width: int = FASTA_WIDTH) -> Column:
    """FASTA body lines of a binary value: an array of at most ``width`` bytes each."""
    starts = F.sequence(F.lit(1), F.octet_length(data), F.lit(width))
    lines = F.transform(starts, lambda s: F.substring(data, s, F.lit(width)))
    return F.when(F.octet_length(data) > 0, lines).otherwise(F.array())


def bases_of(text: Column) -> Column:
    """A nucleotide reading of text: two bases per byte, N between lines.

    Each hexadecimal digit stands for the base of its low two bits.  Equal text gives
    equal bases, so overlap between documents carries over.
    """
    def read(line: Column) -> Column:
        return F.translate(F.hex(F.encode(line, "UTF-8")), "0123456789ABCDEF", "ACGTACGTACGTACGT")

    return F.array_join(F.transform(F.split(text, "\n", -1), read), "N")
