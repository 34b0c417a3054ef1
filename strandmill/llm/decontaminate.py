"""Benchmark decontamination as a prefix-filtered set join.

A benchmark item is seen as windows of 13 consecutive words, each a set of shingles of up to
three words.  A text that contains a window contains all its shingles, so one of them, the rarest
in the corpus, is a sufficient prefix:

1. The item shingles are counted in the corpus and each window keeps its rarest as its anchor.
   Neighbouring windows with the same anchor stay together as one row.
2. The text scan emits the places where an anchor may occur, with the words around.  A
   bitmap of bounded size of anchor hashes decides that; false
   hits cost time only.
3. Places join anchors on the shingle's hash, under the length and position bounds.
4. Each joined row is verified word by word to both sides of the anchor, which gives the range of
   windows that truly occur, and so one interval of hit words.

No side is broadcast by hand except the bitmap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandmill.llm.bitmap import bitmap_of, passes
from strandmill.llm.store import kept
from strandmill.llm.words import ALNUM_LOWER, Words, roll, slices

WINDOW = 13
SHINGLE = 3
SHARE = 20  # contaminated from one hit word in 20


def _shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words inside one row, and the places where they start."""
    hashes = roll(words.hashes(), width) ^ np.uint64(width)
    last = np.repeat(words.first[1:], words.counts)[: len(hashes)]
    at = np.flatnonzero(np.arange(len(hashes)) + width <= last)
    return hashes[at], at


def _items(benchmark: DataFrame, id_col: str, text_col: str, window: int, shingle: int) -> DataFrame:
    """(item, words, width, size, hashes): size is the length of the item's windows."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                words = Words(part.column(text_col), ALNUM_LOWER)
                own = words.hashes()
                lists: dict[str, list] = {"words": [], "width": [], "size": [], "hashes": []}
                for r in range(words.rows):
                    lo, hi = int(words.first[r]), int(words.first[r + 1])
                    width = min(shingle, hi - lo)
                    lists["words"].append([words.word(i).decode() for i in range(lo, hi)])
                    lists["width"].append(width)
                    lists["size"].append(min(window, hi - lo))
                    run = roll(own[lo:hi], width) ^ np.uint64(width) if width else own[:0]
                    lists["hashes"].append(run.view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column("item"), pa.array(lists["words"], pa.list_(pa.string())), pa.array(lists["width"], pa.int32()),
                     pa.array(lists["size"], pa.int32()), pa.array(lists["hashes"], pa.list_(pa.int64()))],
                    ["item", *lists],
                )

    named = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col))
    return named.mapInArrow(scan, "item string, words array<string>, width int, size int, hashes array<long>").where("width > 0")


def _count_in_corpus(docs: DataFrame, text_col: str, widths: list[int], shared) -> DataFrame:
    """(hash, n): how often shingles that the bitmap lets pass occur in the corpus."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                words = Words(part.column(text_col), ALNUM_LOWER)
                for width in widths:
                    hashes, _ = _shingles(words, width)
                    value, n = np.unique(hashes[passes(shared.value, hashes)], return_counts=True)
                    if len(value):
                        yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n)], ["hash", "n"])

    return docs.select(text_col).mapInArrow(scan, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def _anchors(items: DataFrame, counts: DataFrame) -> DataFrame:
    """(hash, item, width, size, at, low, words): windows ``low`` .. of an item whose rarest
    shingle starts at word ``at``; ``words`` are those of all these windows."""
    single = items.select("item", "width", "size", "words", F.posexplode("hashes").alias("at", "hash"),
                          F.xxhash64("words").alias("same"))
    rated = single.join(counts, "hash", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    # A window starts at each place with size words left; it spans size - width + 1 shingles.
    key = Window.partitionBy("item", "same", "size").orderBy("at")
    rank = F.struct("n", "hash", "at")
    sizes = [r.span for r in items.select((F.col("size") - F.col("width")).alias("span")).distinct().collect()]
    best = None
    for span in sizes:  # few: items of at least a window's length share one, shorter ones have others
        column = F.when(F.col("size") - F.col("width") == span, F.min(rank).over(key.rowsBetween(0, span)))
        best = column if best is None else F.coalesce(best, column)
    if best is None:
        best = F.lit(None).cast("struct<n:bigint,hash:bigint,at:int>")
    windows = rated.select("*", best.alias("best")).where(F.col("at") + F.col("size") <= F.size("words"))
    ranges = windows.groupBy("item", "same", "size", "width", F.col("best.at").alias("anchor"), F.col("best.hash").alias("hash")).agg(
        F.min("at").alias("low"), F.max("at").alias("high"))
    texts = items.select("item", F.xxhash64("words").alias("same"), "words").distinct()
    return ranges.join(texts, ["item", "same"]).select(
        "hash", "item", "width", "size", F.col("anchor").alias("at"), "low", "high",
        F.expr("slice(words, low + 1, high - low + size)").alias("words"),
    )


def _places(docs: DataFrame, id_col: str, text_col: str, widths: list[int], window: int, shared) -> DataFrame:
    """One row per document: n_words and the places where an anchor may start."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                words = Words(part.column(text_col), ALNUM_LOWER)
                rows, hits = [], [[] for _ in range(words.rows)]
                for width in widths:
                    hashes, at = _shingles(words, width)
                    ok = passes(shared.value, hashes)
                    rows.append((at[ok], hashes[ok].view(np.int64)))
                for at, hashes in rows:
                    row = np.searchsorted(words.first, at, "right") - 1
                    lo, hi = words.first[row], words.first[row + 1]
                    left, right = np.maximum(at - window, lo), np.minimum(at + window, hi)
                    for r, h, a, b, x, y in zip(row.tolist(), hashes.tolist(), (at - lo).tolist(), (at - left).tolist(),
                                                left.tolist(), right.tolist(), strict=True):
                        hits[r].append({"hash": h, "at": a, "before": b, "context": words.text(x, y).decode()})
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("same"), pa.array(words.counts, pa.int64()), pa.array(hits, hit_type)],
                    ["id", "same", "n_words", "places"],
                )

    hit_type = pa.list_(pa.struct([("hash", pa.int64()), ("at", pa.int64()), ("before", pa.int32()), ("context", pa.string())]))
    kind = docs.schema[id_col].dataType.simpleString()
    named = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("same"), F.col(text_col))
    place = "hash:bigint,at:bigint,before:int,context:string"
    return named.mapInArrow(scan, f"id {kind}, same long, n_words long, places array<struct<{place}>>")


def _verify(joined: DataFrame, kind: str) -> DataFrame:
    """(id, same, item, lo, hi): words lo .. hi - 1 of the document are hit by windows of the item."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, los, his = [], [], []
            columns = [batch.column(c).to_pylist() for c in ("at", "before", "context", "anchor", "low", "high", "size", "words")]
            for i, (at, before, context, anchor, low, high, size, words) in enumerate(zip(*columns, strict=True)):
                own, mid, offset = context.split(" "), anchor - low, at - anchor
                left = 0
                while left < min(mid, before) and own[before - left - 1] == words[mid - left - 1]:
                    left += 1
                right, most = 0, min(len(words) - mid, len(own) - before)
                while right < most and own[before + right] == words[mid + right]:
                    right += 1
                first, last = max(low, anchor - left), min(high, anchor + right - size)
                if first <= last:
                    keep.append(i)
                    los.append(first + offset)
                    his.append(last + size + offset)
            rows = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [rows.column("id"), rows.column("same"), rows.column("item"), pa.array(los, pa.int64()), pa.array(his, pa.int64())],
                ["id", "same", "item", "lo", "hi"],
            )

    return joined.mapInArrow(check, f"id {kind}, same long, item string, lo long, hi long")


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE,
) -> DataFrame:
    """(id, same, n_words, n_hit, items array<string>, contaminated): one row per row of ``docs``.

    ``same`` is the hash of the text; rows that repeat id and text get equal results.  Null ids are
    kept, null texts have no words, null item ids count as the empty string.  Without items nothing
    is hit.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    context = docs.sparkSession.sparkContext
    items = kept(_items(benchmark, item_col, item_text, window, shingle), "items")
    widths = [r.width for r in items.select("width").distinct().collect()]
    hashes = items.select(F.explode("hashes").alias("hash")).distinct()
    counts = _count_in_corpus(docs, text_col, widths, context.broadcast(bitmap_of(hashes, "hash", 64)))
    anchors = kept(_anchors(items, counts), "anchors")
    near_anchor = context.broadcast(bitmap_of(anchors.select("hash").distinct(), "hash", 64))
    found = kept(_places(docs, id_col, text_col, widths, window, near_anchor), "places", "zstd")
    hits = found.where(F.size("places") > 0).distinct().select("id", "same", "n_words", F.explode("places").alias("p"))
    hits = hits.select("id", "same", "n_words", "p.*")
    near = hits.join(anchors.withColumnRenamed("at", "anchor"), "hash").where(
        (F.col("at") >= F.col("anchor") - F.col("high"))
        & (F.col("n_words") - F.col("at") >= F.col("low") + F.col("size") - F.col("anchor"))
    )
    spans = _verify(near, kind)
    reach = Window.partitionBy("id", "same").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("before", F.max("hi").over(reach))
    fresh = F.greatest(F.lit(0), F.col("hi") - F.greatest("lo", F.coalesce("before", F.lit(0))))
    hit = spans.groupBy("id", "same").agg(F.sum(fresh).alias("n_hit"), F.sort_array(F.collect_set("item")).alias("items"))
    joined = found.select(F.col("id").alias("l_id"), F.col("same").alias("l_same"), "n_words").join(
        hit, (F.col("l_same") == F.col("same")) & F.col("l_id").eqNullSafe(F.col("id")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return joined.select(
        F.col("l_id").alias("id"), F.col("l_same").alias("same"), "n_words", n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (SHARE * n_hit >= F.col("n_words"))).alias("contaminated"),
    )
