"""SimHash near-duplicates linked through deletion-variant signatures.

A fingerprint is cut into two halves.  If two fingerprints differ in at most two bits, one of
the halves differs in at most one, so both fingerprints own a common variant: (half, position of
the ignored bit, half without that bit).  Variants are joined by equality and each pair is
verified on all bits.

A bucket with more than ``BUCKET`` different fingerprints is not paired, and none of its links is
lost: there every fingerprint goes to its 65 neighbours within one bit, and those that
meet at a neighbour are linked to the smallest of them.  Two fingerprints share a neighbour
exactly if they differ in at most two bits, so this needs no pairs.

Equal fingerprints are one node.  Components come from alternating large-star and small-star
steps (Kiveris et al., 2014) on tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.llm.bitmap import bitmap_of, passes
from strandmill.llm.store import kept
from strandmill.llm.words import BLANKS_LOWER, Words, mix, slices

SHINGLE = 3
SEED = 42
BITS = 2
BUCKET = 24
SLICE = 1 << 20  # bytes of text whose shingles are laid out at a time


def _fingerprints(texts: pa.Array, shingle: int) -> np.ndarray:
    """SimHash of each text over runs of ``shingle`` words, repeats counted."""
    words = Words(texts, BLANKS_LOWER)
    digest, out = xxhash.xxh64_intdigest, np.zeros(words.rows, np.uint64)
    hashes: list[int] = []
    ends = []
    for row in range(words.rows):
        lo, hi = int(words.first[row]), int(words.first[row + 1])
        if hi > lo:
            text = words.text(lo, hi)
            size = words.end[lo:hi] - words.start[lo:hi]
            stop = np.cumsum(size + 1) - 1
            start = (stop - size).tolist()
            width = min(shingle, hi - lo)
            hashes += [digest(text[a:b], SEED) for a, b in zip(start, stop[width - 1 :].tolist(), strict=False)]
        ends.append(len(hashes))
    bounds = np.array([0, *ends])
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        values = np.array(hashes, np.uint64)
        total = np.diff(bounds)[some]
        for bit in range(64):
            ones = np.add.reduceat((values >> np.uint64(bit)) & np.uint64(1), bounds[some])
            out[some] |= (2 * ones.astype(np.int64) > total).astype(np.uint64) << np.uint64(bit)
    return out


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, with_hash: bool = False
) -> DataFrame:
    """(id, fp long): one row per row of ``docs``; ``with_hash`` adds ``__hash``, the XXH64 of the whole text.

    A text with fewer words than a shingle has one shingle; null or wordless texts get 0.
    """
    more = ["__hash"] if with_hash else []

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, SLICE):
                fp = _fingerprints(part.column(text_col), shingle)
                yield pa.RecordBatch.from_arrays(
                    [part.column(id_col), pa.array(fp.view(np.int64)), *map(part.column, more)], [id_col, "fp", *more])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(id_col, text_col, *[F.xxhash64(text_col).alias(x) for x in more])
    return rows.mapInArrow(scan, f"`{id_col}` {kind}, fp long" + "".join(f", `{x}` long" for x in more))


def _variants(nodes: DataFrame) -> DataFrame:
    """(key, fp): 64 rows per node; the key packs half, ignored bit and the rest of the half."""
    rows = nodes.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("v"))
    half = F.when(F.col("v") < 32, F.col("fp").bitwiseAND(0xFFFFFFFF)).otherwise(F.shiftrightunsigned("fp", 32))
    return rows.select(
        (F.expr("shiftleft(cast(v as bigint), 32)") + half.bitwiseAND(F.expr("~shiftleft(1L, v % 32)"))).alias("key"),
        "fp",
    )


def _variants_of(nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``_variants`` whose key is in ``keys``, and few others."""
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(mix(batch.column("key").to_numpy().view(np.uint64)).view(np.int64))], ["h"])

    shared = nodes.sparkSession.sparkContext.broadcast(bitmap_of(keys.select("key").mapInArrow(hashed, "h long"), "h"))

    def variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = np.arange(64, dtype=np.uint64)
        rest = ~(np.uint64(1) << (v % np.uint64(32))) & np.uint64(0xFFFFFFFF)
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)[:, None]
            key = (v << np.uint64(32)) + ((fp >> (v // np.uint64(32) * np.uint64(32))) & rest)
            row, at = np.nonzero(passes(shared.value, mix(key)))
            yield pa.RecordBatch.from_arrays([pa.array(key[row, at].view(np.int64)), batch.column("fp").take(pa.array(row))], ["key", "fp"])

    return nodes.select("fp").mapInArrow(variants, "key long, fp long")


def _near(a: str, b: str, bits: int):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= bits


def links(nodes: DataFrame, bits: int = BITS, bucket: int = BUCKET) -> DataFrame:
    """(a, b) with a < b: verified links that connect all fingerprints within ``bits`` bits.

    ``nodes`` has different values in ``fp``.  Every link inside a bucket of up to ``bucket``
    fingerprints is returned, of larger ones a set of true links with the same components.
    """
    if bits not in (1, 2):
        raise ValueError("two halves with one ignored bit find one or two differing bits")
    buckets = (
        _variants(nodes).groupBy("key")
        .agg(F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.bit_xor("fp").alias("all"))
        .where("n > 1")
    )
    buckets = kept(buckets, "buckets")
    # Buckets of two or three are known from their aggregates; only larger ones need their members.
    mid = F.col("all").bitwiseXOR(F.col("lo")).bitwiseXOR(F.col("hi"))
    few = buckets.where("n <= 3").select("lo", "hi", F.when(F.col("n") == 3, mid).alias("mid"))
    two = few.select(F.inline(F.array(
        F.struct(F.col("lo").alias("a"), F.col("hi").alias("b")), F.struct(F.col("lo").alias("a"), F.col("mid").alias("b")),
        F.struct(F.col("mid").alias("a"), F.col("hi").alias("b")))))
    more = buckets.where("n > 3").select("key", "n")
    members = kept(_variants_of(nodes, more).join(more, "key"), "members")
    small = members.where(F.col("n") <= bucket)
    pairs = small.select("key", F.col("fp").alias("a")).join(
        small.select("key", F.col("fp").alias("b")),
        "key",
    ).where(F.col("a") < F.col("b"))
    found = two.unionByName(pairs.select("a", "b")).where(_near("a", "b", bits))
    crowded = members.where(F.col("n") > bucket).select("fp").distinct()
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("j"))
    # Two bits: a common neighbour within one bit.  One bit: the same value without that bit.
    hub = F.col("fp").bitwiseXOR(one) if bits == 2 else F.col("fp").bitwiseAND(F.bitwise_not(one))
    around = crowded.select("fp", F.explode(F.sequence(F.lit(-1), F.lit(63))).alias("j")).select(
        "fp", F.when(F.col("j") < 0, F.col("fp")).otherwise(hub).alias("hub")
    )
    first = around.groupBy("hub").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("hub", "a")
    stars = around.join(first, "hub").where(F.col("a") < F.col("fp")).select("a", F.col("fp").alias("b"))
    return found.unionByName(stars.where(_near("a", "b", bits))).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    return both.where("b > a").join(low, "a").select(F.col("low").alias("a"), "b").where("a < b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("b").agg(F.min("a").alias("low"))
    moved = edges.join(low, "b").where("a > low").select(F.col("low").alias("a"), F.col("a").alias("b"))
    return moved.unionByName(low.select(F.col("low").alias("a"), "b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(fp, root): the smallest node of each component, for nodes that have a link."""
    edges = kept(edges, "links")
    seen = None
    while True:
        edges = kept(_small_star(_large_star(edges)), "stars")
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if not state.n or tuple(state) == seen:
            return edges.select(F.col("b").alias("fp"), F.col("a").alias("root"))
        seen = tuple(state)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = BITS, bucket: int = BUCKET,
    with_hash: bool = False,
) -> DataFrame:
    """(id, fp, root, component): one row per row of ``docs``; ``with_hash`` as in ``fingerprints``.

    ``root`` is the smallest fingerprint that can be reached over fingerprints within ``bits`` bits,
    component the smallest id there.  Null ids never become a component's id (null only if the whole
    component has none).  Repeated rows keep their own result rows.  An empty table gives no rows.
    """
    prints = kept(fingerprints(docs, id_col, text_col, shingle, with_hash), "prints")
    nodes = kept(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "nodes")
    roots = components(links(nodes.select("fp"), bits, bucket))
    placed = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = placed.groupBy("root").agg(F.min("least").alias("component"))
    label = kept(placed.join(named, "root").select("fp", "root", "component"), "labels")
    return prints.join(label, "fp").select(id_col, "fp", "root", "component", *(["__hash"] if with_hash else []))


def _named(docs: DataFrame, id_col: str) -> list[Column]:
    return [F.col(id_col).isNull().alias("__none"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("__id")]


def first_of(found: DataFrame, id_col: str, node_col: str) -> DataFrame:
    """(__none, __id, __hash) of the row with the smallest id of each ``root`` in ``found``; without an id, or among
    equal ids, of one with the smallest node."""
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(node_col).alias("node"), F.col("__hash").alias("hash"))
    first = found.groupBy("root").agg(F.min(key).alias("k")).select("k.*")
    return first.select(*_named(first, "id"), F.col("hash").alias("__hash"))


def rows_of(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str | None = None) -> DataFrame:
    """One row of ``docs`` for each row of ``chosen``, found again by its id and the hash of its text, so no text is
    hashed word by word again; without ``text_col``, ``docs`` has that hash as ``__hash``."""
    # Join and removal of repeats use the same keys, so the rows are shuffled once.
    keys = ["__none", "__id", "__hash"]
    named = docs.select("*", *_named(docs, id_col), *([F.xxhash64(text_col).alias("__hash")] if text_col else []))
    return named.join(chosen, keys).dropDuplicates(keys).select(*docs.columns)


def firsts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """What ``rows_of`` needs to find one row of each group of near duplicates: that with the smallest id."""
    return first_of(near_duplicates(docs, id_col, text_col, shingle, bits, with_hash=True), id_col, "fp")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that with the smallest id.

    Without an id, or among equal ids, it is one with the smallest fingerprint.
    """
    return rows_of(docs, firsts(docs, id_col, text_col, shingle, bits), id_col, text_col)
