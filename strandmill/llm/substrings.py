"""Repeated passages through a compacted token de Bruijn graph.

Edges of the graph are runs of 20 words.  Only edges that may repeat are ever built:

1. Each run of 20 words owns the smallest of its six-word hashes.  These sparse seeds
   are counted over the corpus; a run whose seed occurs once cannot repeat.
2. Documents with equal texts are one node source, read once, so copies cost no edges.
3. The edges with repeated seeds are aggregated to one row per edge: occurrences, smallest
   source coordinate, and whether the edge before and the edge after are always the same.
4. An edge follows another in a nonbranching path if each is the other's only neighbour.  All
   edges of such a path share their first source, so paths are compacted by laying the repeated
   edges along their source coordinates.
5. Places in the corpus where a path begins are joined with the paths.  The words of each span
   are digested at their own coordinates, and only spans with the digest of an earlier span
   (smaller id, or earlier start in the same document) are removed.

Every join is an equality join of tables that Spark shuffles; hash collisions split paths or fail
the digest, and never remove anything.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.llm.bitmap import bitmap_of, passes
from strandmill.llm.store import bucketed, kept
from strandmill.llm.words import BLANKS, Words, roll, slices, slide

WIDTH = 20
SEED = 6
COUNT_BYTES = 16 << 20
BLOCK_BITS = 20
DIGEST_SEED = 11
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_LAST = (1 << 63) - 1
_FORK = -1


class _Runs:
    """Seeds and edges of some texts: one edge per place where a run of ``width`` words starts."""

    def __init__(self, texts: pa.Array, width: int, seed: int):
        self.words = words = Words(texts, BLANKS)
        own = words.hashes()
        n = len(own)
        last = np.repeat(words.first[1:], words.counts)
        # Seeds that leave their document never win; edges that leave it are not edges.
        self.seeds = np.full(n, _TOP)
        made = roll(own, seed)
        self.seeds[: len(made)] = np.where(np.arange(len(made)) + seed <= last[: len(made)], made, _TOP)
        self.edges = roll(own, width)
        self.valid = np.arange(len(self.edges)) + width <= last[: len(self.edges)]
        self.span = width - seed + 1
        self.least = slide(self.seeds, self.span, np.minimum)[: len(self.edges)] if len(self.edges) else self.edges

    def chosen(self) -> np.ndarray:
        """Places of seeds that are the smallest of some edge."""
        if not len(self.edges):
            return np.zeros(0, np.int64)
        least = np.where(self.valid, self.least, np.uint64(0))
        gap = np.zeros(self.span - 1, np.uint64)
        reach = slide(np.concatenate([gap, least, gap]), self.span, np.maximum)
        return np.flatnonzero((reach == self.seeds[: len(reach)]) & (self.seeds[: len(reach)] != _TOP))

    def place(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.searchsorted(self.words.first, at, "right") - 1
        return row, at - self.words.first[row]


def _counts(docs: DataFrame, width: int, seed: int) -> DataFrame:
    """(seed): hashes of seeds that occur at two places of different texts, or of one text.

    A slice of rows sends at most two places per seed, so a common seed is small in the shuffle.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", COUNT_BYTES):
                runs = _Runs(part.column("text"), width, seed)
                at = runs.chosen()
                row, place = runs.place(at)
                value = part.column("c1").to_numpy()[row] ^ place * 0x2545F4914F6CDD1D
                key = runs.seeds[at].view(np.int64)
                order = np.lexsort((value, key))
                key, value = key[order], value[order]
                change = key[1:] != key[:-1]
                first = np.flatnonzero(np.concatenate([[True], change])) if len(key) else order
                last = np.flatnonzero(np.concatenate([change, [True]])) if len(key) else order
                ends = np.concatenate([first, last[value[last] != value[first]]])
                yield pa.RecordBatch.from_arrays([pa.array(key[ends]), pa.array(value[ends])], ["seed", "place"])

    rows = docs.select("text", "c1").mapInArrow(scan, "seed long, place long").repartition("seed")
    return rows.groupBy("seed").agg(F.min("place").alias("lo"), F.max("place").alias("hi")).where("lo <> hi").select("seed")


def _seed_places(docs: DataFrame, shared, width: int, seed: int) -> DataFrame:
    """(seed, c1, at): places of seeds that pass the bitmap."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                runs = _Runs(part.column("text"), width, seed)
                at = runs.chosen()
                at = at[passes(shared.value, runs.seeds[at])]
                row, place = runs.place(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(runs.seeds[at].view(np.int64)), part.column("c1").take(pa.array(row)), pa.array(place.astype(np.int32))],
                    ["seed", "c1", "at"])

    return docs.select("text", "c1").mapInArrow(scan, "seed long, c1 long, at int")


def _edges(sources: DataFrame, width: int, seed: int) -> DataFrame:
    """(edge, n, coord, prev, next) of edges whose seed is at one of the row's ``places``.

    A slice of rows sends an edge once: n occurrences, the smallest coordinate, and the edges
    before and after, each 0 if there is none and ``_FORK`` if they differ.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", COUNT_BYTES):
                runs = _Runs(part.column("text"), width, seed)
                if not len(runs.edges):
                    continue
                spots = part.column("places")
                row = np.repeat(np.arange(part.num_rows), spots.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                at = spots.flatten().to_numpy(zero_copy_only=False) + runs.words.first[row]
                flagged = np.full(len(runs.seeds), _TOP)
                flagged[at] = runs.seeds[at]
                least = slide(flagged, runs.span, np.minimum)[: len(runs.edges)]
                at = np.flatnonzero(runs.valid & (least == runs.least))
                row, place = runs.place(at)
                ended = at + 1 >= len(runs.edges)
                after = np.minimum(at + 1, len(runs.edges) - 1)
                none = np.uint64(0)
                prev = np.where(place > 0, runs.edges[at - 1], none).view(np.int64)
                following = np.where(ended | ~runs.valid[after], none, runs.edges[after]).view(np.int64)
                coord = part.column("base").to_numpy()[row] + place
                edge = runs.edges[at].view(np.int64)
                order = np.lexsort((coord, edge))
                edge, coord, prev, following = edge[order], coord[order], prev[order], following[order]
                first = np.flatnonzero(np.concatenate([[True], edge[1:] != edge[:-1]])) if len(edge) else order
                n = np.diff(np.concatenate([first, [len(edge)]]))
                columns = [edge[first], n, coord[first], *(_same(x, first, n) for x in (prev, following))]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["edge", "n", "coord", "prev", "next"])

    return sources.select("text", "base", "places").mapInArrow(scan, "edge long, n long, coord long, prev long, next long")


def _same(values: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The value of each group, ``_FORK`` where it has several."""
    if not len(first):
        return values
    low, high = np.minimum.reduceat(values, first), np.maximum.reduceat(values, first)
    return np.where(low == high, low, _FORK)


def _paths(edges: DataFrame) -> DataFrame:
    """(edge, size): first edge and number of edges of each repeated nonbranching path.

    Paths also end where a block of source coordinates ends, so no task sees more than a block.
    """
    nodes = edges.repartition("edge").groupBy("edge").agg(
        F.sum("n").alias("n"), F.min("coord").alias("coord"),
        F.min("prev").alias("p0"), F.max("prev").alias("p1"), F.min("next").alias("n0"), F.max("next").alias("n1"),
    ).where("n > 1")
    rows = nodes.select(
        "edge", "coord", F.shiftright("coord", BLOCK_BITS).alias("block"),
        F.when(F.expr("p0 = p1"), F.col("p0")).otherwise(0).alias("prev"),
        F.when(F.expr("n0 = n1"), F.col("n0")).otherwise(0).alias("next"),
    )
    along = Window.partitionBy("block").orderBy("coord")
    joins = (
        (F.lag("coord").over(along) == F.col("coord") - 1)
        & (F.lag("next").over(along) == F.col("edge"))
        & (F.lag("edge").over(along) == F.col("prev"))
    )
    marked = rows.withColumn("head", F.when(joins, 0).otherwise(1))
    path = F.sum("head").over(along.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("path", path).groupBy("block", "path").agg(
        F.min_by("edge", "coord").alias("edge"), F.count("*").cast("int").alias("size")).select("edge", "size")


def _starts(sources: DataFrame, shared, width: int, seed: int) -> DataFrame:
    """(edge, c1, c2, at): places of edges that pass the bitmap of path heads."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                runs = _Runs(part.column("text"), width, seed)
                at = np.flatnonzero(runs.valid & passes(shared.value, runs.edges))
                row, place = runs.place(at)
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(runs.edges[at].view(np.int64)), part.column("c1").take(rows), part.column("c2").take(rows),
                     pa.array(place.astype(np.int32))], ["edge", "c1", "c2", "at"])

    return sources.select("text", "c1", "c2").mapInArrow(scan, "edge long, c1 long, c2 long, at int")


def _digests(sources: DataFrame, width: int) -> DataFrame:
    """(edge, digest, base, c1, c2, at, size) of the row's ``spans``."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"), BLANKS)
                rows, out = [], {"edge": [], "digest": [], "at": [], "size": []}
                for r, spans in enumerate(part.column("spans").to_pylist()):
                    lo = int(words.first[r])
                    for s in spans:
                        text = words.text(lo + s["at"], lo + s["at"] + s["size"] + width - 1)
                        rows.append(r)
                        out["edge"].append(s["edge"])
                        out["digest"].append(xxhash.xxh3_64_intdigest(text, DIGEST_SEED) - (1 << 63))
                        out["at"].append(s["at"])
                        out["size"].append(s["size"])
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out["edge"], pa.int64()), pa.array(out["digest"], pa.int64()), part.column("base").take(take),
                     part.column("c1").take(take), part.column("c2").take(take),
                     pa.array(out["at"], pa.int32()), pa.array(out["size"], pa.int32())],
                    ["edge", "digest", "base", "c1", "c2", "at", "size"])

    kinds = "edge long, digest long, base long, c1 long, c2 long, at int, size int"
    return sources.mapInArrow(scan, kinds)


def _cut_texts(sources: DataFrame, removals: DataFrame) -> DataFrame:
    """(c1, c2, n_removed, kept_text, kept_sha256) of texts that lose words."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"), BLANKS)
                lost, texts = [], []
                for r, spans in enumerate(part.column("spans").to_pylist()):
                    lo, hi = int(words.first[r]), int(words.first[r + 1])
                    gone = np.zeros(hi - lo, bool)
                    for s in spans:
                        gone[s["lo"] : s["hi"]] = True
                    own = words.text(lo, hi).split(b" ")
                    texts.append(b" ".join([own[i] for i in np.flatnonzero(~gone).tolist()]))
                    lost.append(int(gone.sum()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("c1"), part.column("c2"), pa.array(lost, pa.int64()), pa.array(texts).cast(pa.string()),
                     pa.array([hashlib.sha256(t).hexdigest() for t in texts])],
                    ["c1", "c2", "n_removed", "kept_text", "kept_sha256"])

    joined = sources.select("c1", "c2", "text").join(removals, ["c1", "c2"])
    return joined.mapInArrow(cut, "c1 long, c2 long, n_removed long, kept_text string, kept_sha256 string")


def _text_keys(text_col: str) -> tuple[Column, Column]:
    return F.xxhash64(text_col), F.xxhash64(F.lit(7), F.col(text_col))


def _order(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST))


def _laid_out(classes: DataFrame) -> DataFrame:
    """(c1, c2, uid, base): texts in the order of (uid, c2), each at the sum of the sizes before it,
    so that base + place orders all words of all texts."""
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = kept(classes.repartitionByRange(parts, "uid", "c2").withColumn("part", F.spark_partition_id()), "classes")
    inner = F.coalesce(F.sum(F.col("size") + 1).over(Window.partitionBy("part").orderBy("uid", "c2", "c1").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = rows.groupBy("part").agg(F.sum(F.col("size") + 1).alias("total"))  # one row per range
    starts = totals.select("part", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    laid = rows.withColumn("inner", inner).join(F.broadcast(starts), "part")
    return kept(laid.select("c1", "c2", "uid", (F.col("start") + F.col("inner")).alias("base")), "laid_out")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """(c1, c2, uid, n_removed, kept_text, kept_sha256): one row per different text.

    c1 and c2 are hashes of the text, uid its smallest id (null ids: the largest long).  The last
    three are null where nothing in the text repeats.  Different texts of one id are ordered by a
    hash of the text.  Rows with a larger id than uid are copies.
    """
    c1, c2 = _text_keys(text_col)
    texts = docs.select(_order(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), c1.alias("c1"), c2.alias("c2"))
    classes = _laid_out(texts.groupBy("c1", "c2").agg(F.min("id").alias("uid"), F.max(F.length("text")).alias("size")))
    context = docs.sparkSession.sparkContext
    repeated = kept(_counts(texts, width, seed), "seeds")
    places = _seed_places(texts, context.broadcast(bitmap_of(repeated, "seed")), width, seed).join(repeated, "seed")
    spots = kept(places.groupBy("c1").agg(F.collect_set("at").alias("places")).join(classes, "c1"), "spots")
    # Texts without repeated seeds need not travel to the join that would drop them.
    wanted = context.broadcast(bitmap_of(spots, "c1"))

    @F.pandas_udf("boolean")
    def may_repeat(keys: pd.Series) -> pd.Series:
        return pd.Series(passes(wanted.value, keys.to_numpy().view(np.uint64)))

    # Bucketed by text, so that what belongs to a text later meets it without moving it again.
    sources = bucketed(texts.where(may_repeat("c1")).join(spots, ["c1", "c2"]).where("id = uid").select("c1", "c2", "base", "text", "places"), "sources", ["c1", "c2"], "zstd")
    paths = kept(_paths(_edges(sources, width, seed)), "paths")
    spans = _starts(sources, context.broadcast(bitmap_of(paths, "edge")), width, seed).join(paths, "edge")
    spans = spans.groupBy("c1", "c2").agg(F.collect_set(F.struct("edge", "at", "size")).alias("spans"))
    digests = kept(_digests(sources.select("c1", "c2", "base", "text").join(spans, ["c1", "c2"]), width), "digests")
    digests = digests.withColumn("coord", F.col("base") + F.col("at"))
    least = digests.groupBy("edge", "digest").agg(F.min("coord").alias("first"))
    later = digests.join(least, ["edge", "digest"]).where("coord > first")
    removals = later.groupBy("c1", "c2").agg(
        F.collect_set(F.struct(F.col("at").alias("lo"), (F.col("at") + F.col("size") + (width - 1)).alias("hi"))).alias("spans"))
    return classes.drop("base").join(_cut_texts(sources, removals), ["c1", "c2"], "left")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256), one row per row of ``docs``.

    Rows that repeat both id and text get the same result; a text that equals that of a smaller
    id loses all words, if it has at least ``width``.  Null texts have no words, a null id comes
    after all others.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"), BLANKS)
                sha = [hashlib.sha256(words.text(int(a), int(b))).hexdigest() for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("c1"), part.column("c2"), pa.array(words.counts, pa.int64()), pa.array(sha, pa.string())],
                    ["id", "c1", "c2", "n_words", "sha"])

    c1, c2 = _text_keys(text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), c1.alias("c1"), c2.alias("c2"))
    rows = named.mapInArrow(scan, f"id {kind}, c1 long, c2 long, n_words long, sha string")
    found = rows.join(repeats(docs, id_col, text_col, width, seed).drop("kept_text"), ["c1", "c2"])
    copy = (F.col("uid") < _order("id")) & (F.col("n_words") >= width)
    return found.select(
        "id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """``docs`` with what repeats taken out of ``text_col``: kept words joined by one blank.

    Texts that lose nothing stay as they are, nulls too; a text may end up empty.
    """
    c1, c2 = _text_keys(text_col)
    plan = repeats(docs, id_col, text_col, width, seed)
    plan = plan.select(*[F.col(c).alias(f"__{c}") for c in ("c1", "c2", "uid", "kept_text")])
    joined = docs.withColumn("__c1", c1).withColumn("__c2", c2).join(plan, ["__c1", "__c2"])
    words = F.size(F.filter(F.split(F.col(text_col), "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
    copy = (F.col("__uid") < _order(id_col)) & (words >= width)
    text = F.when(copy, F.lit("")).otherwise(F.coalesce("__kept_text", F.col(text_col)))
    return joined.withColumn(text_col, text).select(*docs.columns)
