"""Bottom-k sketches and the similarity estimates built on them.

Unsigned 64-bit hashes are kept as ``bigint`` shifted by 2**63, which sorts the same way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandmill.functions.batches import by_bytes
from strandmill.functions.kernels import row_kmers, smallest

KMER, SIZE = 21, 1_000
HELD_HASHES = 500_000  # of all groups a task keeps before it hands them on
GROUP_COST = 32  # hashes that a group weighs by itself


def unsigned(h: Column) -> Column:
    """The hash as its unsigned decimal value."""
    return h.cast("decimal(20,0)") + F.lit(str(2**63)).cast("decimal(20,0)")


def bottom_hashes(seqs: DataFrame, group: str, seq: str, kmer: int = KMER, size: int = SIZE) -> DataFrame:
    """The ``size`` smallest distinct k-mer hashes per group, one row each with its rank.

    Every task sends at most ``size`` hashes per group, and the rank filter trims each
    partition to ``size`` rows per group again before its shuffle, so a group owning most
    sequences is no heavier to finish than a small one.
    """

    def partial(batches):
        held: dict = {}
        weight = 0

        def flush():
            sizes = [len(h) for h in held.values()]
            of = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            hashes = np.concatenate(list(held.values())) if held else np.empty(0, np.uint64)
            signed = (hashes ^ np.uint64(1 << 63)).view(np.int64)
            keys = pa.array(list(held), key_type).take(of)
            held.clear()
            return pa.RecordBatch.from_arrays([keys, pa.array(signed)], names=[group, "h"])

        for batch in batches:
            for part in by_bytes(batch, 1):
                groups = part.column(0).to_pylist()
                for r, hashes in row_kmers([s or b"" for s in part.column(1).to_pylist()], kmer):
                    g = groups[r]
                    best = held.get(g)
                    if best is None:
                        held[g] = smallest(hashes, size)
                        weight += GROUP_COST + len(held[g])
                        continue
                    if len(best) == size:
                        hashes = hashes[hashes < best[-1]]
                    if len(hashes):
                        held[g] = smallest(np.concatenate([best, smallest(hashes, size)]), size)
                        weight += len(held[g]) - len(best)
                if weight > HELD_HASHES:
                    yield flush()
                    weight = 0
        yield flush()

    given = seqs.select(group, F.encode(F.col(seq), "UTF-8").alias("s"))
    field = given.schema[group]
    key_type = pa.int64() if isinstance(field.dataType, T.LongType) else pa.string()
    schema = T.StructType([field, T.StructField("h", T.LongType())])
    rank = F.row_number().over(Window.partitionBy(group).orderBy("h"))
    return (
        given.mapInArrow(partial, schema).distinct()
        .withColumn("rank", rank).where(F.col("rank") <= size)
    )


def sketches(hashes: DataFrame, group: str) -> DataFrame:
    """One row per group with its ascending hashes; the arrays are bounded by the size."""
    return hashes.groupBy(group).agg(F.array_sort(F.collect_list("h")).alias("hashes"))


def jaccard(a: Column, b: Column, size: int = SIZE) -> Column:
    """Share of the k smallest united hashes that both sketches hold."""
    k = F.least(F.lit(size), F.size(a), F.size(b))
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, F.greatest(k, F.lit(1)))
    both = F.size(F.array_intersect(F.array_intersect(union, a), b))
    return F.when(k <= 0, 0.0).otherwise(both / F.size(union))


def similarity(j: Column, kmer: int = KMER) -> Column:
    """Identity estimated from a Jaccard index by the Mash transform, within [0, 1]."""
    raw = 1.0 + F.ln(2.0 * j / (1.0 + j)) / kmer
    return F.when(j <= 0, 0.0).when(j >= 1, 1.0).otherwise(F.greatest(F.lit(0.0), raw))


# Inclusive similarity thresholds of the routing decision.
DELTA_AT, REINDEX_AT = 0.95, 0.50


def strategy(sim: Column) -> Column:
    return F.when(sim >= DELTA_AT, "delta").when(sim >= REINDEX_AT, "reindex").otherwise("skip")


def against(sketch_table: DataFrame, group: str, query: DataFrame, kmer: int = KMER, size: int = SIZE) -> DataFrame:
    """Similarity of every sketch to the single sketch in ``query``.

    The query's hashes (at most ``size``) become a scalar; it is sketched on its own, so
    that its filter reaches the scan of its sequences.
    """
    others = sketch_table.withColumn("__mine", query.select("hashes").scalar())
    scored = others.select(group, jaccard(F.col("__mine"), F.col("hashes"), size).alias("jaccard"))
    return scored.withColumn("similarity", similarity(F.col("jaccard"), kmer))
