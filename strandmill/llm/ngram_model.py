"""Language-model scores from a log-frequency Bloom filter (Talbot and Osborne, 2007).

Counts of word pairs are rounded down to steps of a geometric scale, and a pair at step ``s`` is
put into the filter together with each of 1 .. s.  A reader probes 1, 2, ... until one is missing,
which gives the step.  The probability of a word after another is

    (pair + MU * p(word)) / (count(context) + MU),  p(word) = (count + 0.1) / (N + 0.1 * (V + 1)),

with the step's lower edge for the pair, so that the probabilities of all words after a context add
up to one at most, but for the filter's false hits (about one in a hundred).

Texts are read once, in blocks of bounded size that hold each different word once.  Exact counts of
words come to a block by an equality join over (word, block), never over single occurrences.  The
filter is built region by region in tasks.  It grows with the number of different pairs, those
that occur once included; a broadcast holds ``SHARD_BYTES`` of it at most, and a larger filter is
scored shard by shard, each pair in the one shard that owns it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.llm.store import bucketed, kept
from strandmill.llm.words import BLANKS_LOWER, Words, mix, slices

BLOCK_BYTES = 12 << 20
BASE = 1.5
MU = 8.0
BITS_PER_KEY = 10
PROBES = 5
REGION_BITS = 1 << 19
SHARD_BYTES = 96 << 20
RUN_TOKENS = 1 << 19  # tokens of a block that are scored at once
_END = np.uint64(0x5851F42D4C957F2D)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def edges(most: int) -> np.ndarray:
    """Lower edges of the steps: step s stands for counts from ``edges[s]``; step 0 for none."""
    out, at = [0], 1.0
    while at <= max(most, 1):
        out.append(max(int(np.ceil(at)), out[-1] + 1))
        at *= BASE
    return np.array(out, np.int64)


def _pairs(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each token with the one before, end of its text): texts with their end tokens."""
    sizes = np.diff(first) + 1
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    full = np.full(int(bounds[-1]), _END)
    inner = np.ones(len(full), bool)
    inner[bounds[1:] - 1] = False
    full[inner] = words
    before = np.empty_like(full)
    before[1:] = full[:-1]
    before[bounds[:-1]] = _END
    with np.errstate(over="ignore"):
        return mix(before * _STEP + full) >> np.uint64(16), bounds


def _places(pair: np.ndarray, step: int, regions: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(region, bits inside it) of pairs at a step."""
    region = mix(pair) % np.uint64(regions)
    with np.errstate(over="ignore"):
        spread = mix(pair * _STEP + np.uint64(step))
    low, high = spread & np.uint64(0xFFFFFFFF), (spread >> np.uint64(32)) | np.uint64(1)
    return region, [(low + np.uint64(i) * high) & np.uint64(REGION_BITS - 1) for i in range(PROBES)]


class Filter:
    """Regions ``first .. first + len - 1`` of a log-frequency Bloom filter."""

    def __init__(self, regions: int, first: int, bits: np.ndarray, steps: np.ndarray):
        self.regions, self.first, self.bits, self.steps = regions, first, bits, steps

    def owns(self, pair: np.ndarray) -> np.ndarray:
        region = mix(pair) % np.uint64(self.regions)
        return (region >= self.first) & (region < self.first + len(self.bits) * 8 // REGION_BITS)

    def counts(self, pair: np.ndarray) -> np.ndarray:
        """Lower edge of the count of each owned pair, 0 if it is not held."""
        out = np.zeros(len(pair), np.int64)
        todo = np.arange(len(pair))
        for step in range(1, len(self.steps)):
            region, spots = _places(pair[todo], step, self.regions)
            base = (region - np.uint64(self.first)) * np.uint64(REGION_BITS)
            held = np.ones(len(todo), bool)
            for spot in spots:
                at = base + spot
                held &= (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
            todo = todo[held]
            if not len(todo):
                break
            out[todo] = self.steps[step]
        return out


def _blocks(docs: DataFrame, id_col: str, text_col: str, learn: Column) -> DataFrame:
    """One row per block of documents: its different words with their counts in learning texts, and
    the texts as indices of those words."""
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            for part in slices(batch, "text", BLOCK_BYTES):
                words = Words(part.column("text"), BLANKS_LOWER)
                coded = words.array().dictionary_encode()
                index = coded.indices.to_numpy(zero_copy_only=False).astype(np.uint32)
                learning = part.column("learn").to_numpy(zero_copy_only=False)
                counts = np.bincount(index[np.repeat(learning, words.counts)], minlength=len(coded.dictionary))
                block = (part.column("part")[0].as_py() << 32) + number
                number += 1
                one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int64()), one(part.column("id")), one(part.column("learn")), one(pa.array(words.counts, pa.int64())),
                     pa.array([zstandard.compress(index.tobytes(), 1)], pa.binary()), one(coded.dictionary.cast(pa.binary())), one(pa.array(counts, pa.int64()))],
                    ["block", "ids", "learns", "sizes", "index", "words", "counts"])

    named = docs.select(
        F.col(id_col).alias("id"), F.coalesce(learn, F.lit(False)).alias("learn"), F.col(text_col).alias("text"), F.spark_partition_id().alias("part"))
    kinds = f"block long, ids array<{kind}>, learns array<boolean>, sizes array<long>, index binary, words array<binary>, counts array<long>"
    return named.mapInArrow(scan, kinds)


def _read(batch: pa.RecordBatch, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of each word, bounds of texts, hashes of the different words) of a block."""
    index = np.frombuffer(zstandard.decompress(batch.column("index")[r].as_py()), np.uint32)
    first = np.concatenate([[0], np.cumsum(batch.column("sizes")[r].values.to_numpy())])
    own = batch.column("words")[r].values
    hashes = Words(own.cast(pa.string()), BLANKS_LOWER).hashes() if len(own) else np.zeros(0, np.uint64)
    return index, first, hashes


def _runs(first: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``most`` words each, one text at least."""
    low = 0
    while low < len(first) - 1:
        high = max(low + 1, int(np.searchsorted(first, first[low] + most, "right")) - 1)
        yield low, high
        low = high


def _pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, n) of all pairs in learning texts."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                index, first, hashes = _read(batch, r)
                pair, bounds = _pairs(hashes[index], first)
                learns = batch.column("learns")[r].values.to_numpy(zero_copy_only=False)
                value, n = np.unique(pair[np.repeat(learns, np.diff(bounds))], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n)], ["pair", "n"])

    rows = blocks.select("learns", "sizes", "index", "words").mapInArrow(scan, "pair long, n long")
    # A block sends a pair once, so there is little left to combine before the shuffle.
    return rows.repartition("pair").groupBy("pair").agg(F.sum("n").alias("n"))


def _regions(pairs: DataFrame, regions: int, steps: np.ndarray) -> DataFrame:
    """(region, bits binary): the filter's regions, each built by one task."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair = batch.column("pair").to_numpy().view(np.uint64)
            step = np.searchsorted(steps, batch.column("n").to_numpy(), "right") - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array((mix(pair) % np.uint64(regions)).astype(np.int32)), batch.column("pair"), pa.array(step.astype(np.int32))], ["region", "pair", "step"])

    def build(group: pa.Table) -> pa.Table:
        pair, step = group.column("pair").to_numpy().view(np.uint64), group.column("step").to_numpy()
        bits = np.zeros(REGION_BITS, np.uint8)
        for s in range(1, int(step.max()) + 1):
            for spot in _places(pair[step >= s], s, regions)[1]:
                bits[spot] = 1
        return pa.table({"region": pa.array([group.column("region")[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    return pairs.mapInArrow(deal, "region int, pair long, step int").groupBy("region").applyInArrow(build, "region int, bits binary")


def score(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(id, learn, n_tokens, n_known, train_tokens, base_score, score), one row per row of ``docs``.

    Rows where ``learn`` is true teach the model; null counts as false.  Null texts count as empty
    and have the end token only.  Repeated rows are counted and scored each; with nothing to learn
    from, all tokens are unknown.
    """
    spark = docs.sparkSession
    blocks = bucketed(_blocks(docs, id_col, text_col, learn), "blocks", ["block"])
    kind = docs.schema[id_col].dataType.simpleString()
    rows = blocks.select("block", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "w")).select("block", "at", "w.words", "w.counts")
    # One row per block that has the word, whatever its number of occurrences.
    total = F.sum("counts").over(Window.partitionBy("words"))
    nth = F.row_number().over(Window.partitionBy("words").orderBy("block"))
    counted = rows.select("block", "at", total.alias("c"), (nth == 1).alias("first"))
    known = kept(counted.groupBy("block").agg(
        F.sort_array(F.collect_list(F.struct("at", "c"))).alias("known"),
        F.sum(F.when(F.col("first"), F.col("c"))).alias("n"), F.count_if(F.col("first") & (F.col("c") > 0)).alias("v")), "known")
    ends = blocks.select(F.explode("learns").alias("learn")).agg(F.count_if("learn")).first()[0]
    sums = known.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    n_all, v_all = sums.n + ends, sums.v + (ends > 0)
    pairs = kept(_pair_counts(blocks), "pairs")
    most = pairs.agg(F.max("n")).first()[0] or 0
    steps = edges(most)
    step_of = sum([(F.col("n") >= int(e)).cast("long") for e in steps[1:]], F.lit(0))
    keys = pairs.agg(F.sum(step_of)).first()[0] or 0
    regions = max(1, -(-keys * BITS_PER_KEY // REGION_BITS))
    built = kept(_regions(pairs, regions, steps), "filter")
    joined = blocks.select("block", "ids", "learns", "sizes", "index", "words").join(known.select("block", "known"), "block", "left")
    per = max(1, shard_bytes * 8 // REGION_BITS)
    parts = []
    for low in range(0, regions, per):
        size = min(per, regions - low)
        bits = np.zeros(size * REGION_BITS // 8, np.uint8)
        for r in built.where((F.col("region") >= low) & (F.col("region") < low + size)).toLocalIterator():
            at = (r.region - low) * (REGION_BITS // 8)
            bits[at : at + REGION_BITS // 8] = np.frombuffer(r.bits, np.uint8)
        shared = spark.sparkContext.broadcast((regions, low, bits, steps))
        parts.append(_scored(joined, shared, n_all, v_all, ends, kind))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    if len(parts) > 1:
        out = out.groupBy("block", "nth", "id", "learn").agg(
            *[F.max(c).alias(c) for c in ("n_tokens", "n_known", "base_score")], F.sum("score").alias("score"))
    return out.select("id", "learn", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score")


def _scored(joined: DataFrame, shared, n_all: int, v_all: int, ends: int, kind: str) -> DataFrame:
    """Scores of the pairs that the shard owns, by document."""
    floor = n_all + 0.1 * (v_all + 1)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Filter(*shared.value)
        for batch in batches:
            for r in range(batch.num_rows):
                index, first, hashes = _read(batch, r)
                known = batch.column("known")[r]
                count = known.values.field("c").to_numpy(zero_copy_only=False) if known.is_valid else np.zeros(0, np.int64)
                block, ids, learns = batch.column("block")[r].as_py(), batch.column("ids")[r].values, batch.column("learns")[r].values
                for low, high in _runs(first, RUN_TOKENS):
                    columns = scored(model, index[first[low] : first[high]], first[low : high + 1] - first[low], hashes, count)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([block] * (high - low), pa.int64()), pa.array(np.arange(low, high)), ids.slice(low, high - low), learns.slice(low, high - low),
                         *map(pa.array, columns)],
                        ["block", "nth", "id", "learn", "n_tokens", "n_known", "base_score", "score"])

    def scored(model: Filter, index: np.ndarray, first: np.ndarray, hashes: np.ndarray, count: np.ndarray) -> list[np.ndarray]:
        pair, bounds = _pairs(hashes[index], first)
        inner = np.ones(len(pair), bool)
        inner[bounds[1:] - 1] = False
        c = np.full(len(pair), ends, np.int64)
        c[inner] = count[index]
        context = np.empty_like(c)
        context[1:] = c[:-1]
        context[bounds[:-1]] = ends
        single = (c + 0.1) / floor
        mine = np.flatnonzero(model.owns(pair))
        # The filter is far larger than any cache, so each different pair is probed once.
        asked, back = np.unique(pair[mine], return_inverse=True)
        held = np.minimum(model.counts(asked)[back], np.minimum(c[mine], context[mine]))
        part = np.zeros(len(pair))
        part[mine] = np.log10((held + MU * single[mine]) / (context[mine] + MU))
        starts = bounds[:-1]
        return [np.diff(bounds), np.add.reduceat((c > 0).astype(np.int64), starts), np.add.reduceat(np.log10(single), starts), np.add.reduceat(part, starts)]

    return joined.mapInArrow(scan, f"block long, nth long, id {kind}, learn boolean, n_tokens long, n_known long, base_score double, score double")
