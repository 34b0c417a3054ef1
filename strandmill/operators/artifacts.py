"""Which form of a genome to use, and what it takes to rebuild or download it.

A genome is held as a manifest of segments, as a recipe of chunks of a delta, or as a delta file; a
delta needs its reference first, which may be a delta itself.  Entries have (assembly, kind).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.operators import pointers, segments

MANIFEST, RECIPE, DELTA = "manifest", "recipe", "delta"
_PLACE = {MANIFEST: 0, RECIPE: 1, DELTA: 2}


def _place(kind: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, place in _PLACE.items():
        out = F.when(kind == name, place).otherwise(out)
    return out


def dispatch(entries: DataFrame) -> DataFrame:
    """(assembly, kind) to rebuild from: a manifest before a recipe before a delta file."""
    known = entries.where(F.col("kind").isin(*_PLACE))
    return known.groupBy("assembly").agg(F.min_by("kind", _place(F.col("kind"))).alias("kind"))


def serves_delta(entries: DataFrame) -> DataFrame:
    """(assembly, delta): whether a download takes the delta path, which a recipe or delta file opens."""
    return entries.groupBy("assembly").agg(F.bool_or(F.col("kind").isin(RECIPE, DELTA)).alias("delta"))


def rebuild_plan(entries: DataFrame, needs: DataFrame) -> DataFrame:
    """(assembly, kind, base, level, state) for every assembly held.

    ``needs`` has (assembly, reference) for deltas.  Level 0 are manifests; a delta is rebuilt one
    level after its reference, so assemblies of one level can be rebuilt side by side.  ``base`` is
    where the chain of references ends.  The state is ``ready``, ``missing`` if the chain ends at something not
    held or a delta names no reference, ``cycle`` for deltas that need one another and ``behind_cycle`` for those that need such.
    """
    kinds = dispatch(entries)
    links = kinds.join(needs.groupBy("assembly").agg(F.min("reference").alias("reference")), "assembly", "left")
    links = links.select(F.col("assembly").alias("node"), F.when(F.col("kind") != MANIFEST, F.col("reference")).alias("next"))
    ends = pointers.resolve(links).withColumnRenamed("node", "assembly")
    bases = kinds.where(F.col("kind") == MANIFEST).select(F.col("assembly").alias("end"), F.lit(True).alias("whole"))
    found = kinds.join(ends, "assembly").join(bases, "end", "left")
    state = F.when(F.col("on_cycle"), "cycle").when(F.col("end").isNull(), "behind_cycle").when(F.col("whole"), "ready").otherwise("missing")
    return found.select("assembly", "kind", F.col("end").alias("base"), F.col("steps").alias("level"), state.alias("state"))


def download_closure(wanted: DataFrame, entries: DataFrame, needs: DataFrame, contents: DataFrame, held: DataFrame) -> DataFrame:
    """(hash, length, state) of all segments and chunks that the wanted assemblies take.

    Of a delta its own pieces and those of its chain of references count, each hash once; ``contents``
    has (assembly, hash, length) with the segments of manifests and the chunks of recipes.
    """
    kinds = dispatch(entries)
    links = kinds.where(F.col("kind") != MANIFEST).join(needs, "assembly").select(F.col("assembly").alias("node"), F.col("reference").alias("next"))
    taken = pointers.reached(wanted.select(F.col("assembly").alias("node")), links).withColumnRenamed("node", "assembly")
    hashes = contents.join(taken, "assembly", "left_semi").groupBy("hash").agg(F.min("length").alias("length"))
    return segments.with_held(hashes, held).select("hash", "length", F.when(F.col("held"), "have").otherwise("missing").alias("state"))
