"""Token shards as wavelet matrices.

A shard is one compressed value: the ids of consecutive documents as succinct bit planes from the
highest bit to the lowest.  Each plane is kept in the order in which the plane above has put the
ids (zeros first, both sides stable).  Rank samples make access, counting and finding an
occurrence take one step per plane; zstd compresses the whole.

Layout of a shard, little-endian, before compression: magic ``WVM1``, planes (int32), documents
(int64), ids (int64); doc lengths (int64 each); then for each plane the number of zeros (int64)
and its bits, padded to 64.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandmill.llm import tokens
from strandmill.llm.store import shared_path

MAGIC = b"WVM1"
SHARD_IDS = 2_000_000
_HEAD = "<4siqq"
_BLOCK = 512


def pack(ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """The shard of documents with ``lengths`` ids each, concatenated in ``ids``."""
    top = int(ids.max()) if len(ids) else 0
    planes = max(1, top.bit_length())
    parts = [struct.pack(_HEAD, MAGIC, planes, len(lengths), len(ids)), lengths.astype("<i8").tobytes()]
    left = ids.astype(np.uint16 if planes <= 16 else np.uint32)
    for level in range(planes - 1, -1, -1):
        ones = (left >> level) & 1 == 1
        bits = np.packbits(ones, bitorder="little").tobytes()
        zeros = left[~ones]
        parts += [struct.pack("<q", len(zeros)), bits, bytes(-len(bits) % 8)]
        left = np.concatenate([zeros, left[ones]])
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


class Shard:
    """Reads a packed shard: single ids, counts and places without decoding the rest."""

    def __init__(self, blob: bytes):
        data = zstandard.ZstdDecompressor().decompress(blob)
        magic, self.planes, docs, self.size = struct.unpack_from(_HEAD, data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = struct.calcsize(_HEAD)
        self.lengths = np.frombuffer(data, "<i8", docs, at)
        at += 8 * docs
        span = -(-(-(-self.size // 8)) // 8) * 8
        self.zeros, self.bits = [], []
        for _ in range(self.planes):
            self.zeros.append(struct.unpack_from("<q", data, at)[0])
            self.bits.append(np.frombuffer(data, np.uint8, span, at + 8))
            at += 8 + span
        self._samples: list[np.ndarray] | None = None

    def ids(self) -> np.ndarray:
        """All ids, from the lowest plane upwards."""
        out = np.zeros(self.size, np.uint16 if self.planes <= 16 else np.uint32)
        for depth in range(self.planes - 1, -1, -1):
            ones = np.unpackbits(self.bits[depth], count=self.size, bitorder="little").view(bool)
            above = np.empty_like(out)
            above[~ones] = out[: self.zeros[depth]]
            above[ones] = out[self.zeros[depth] :] | out.dtype.type(1 << (self.planes - 1 - depth))
            out = above
        return out

    def _rank(self, depth: int, at: int) -> int:
        """Ones of a plane before ``at``."""
        if self._samples is None:
            self._samples = []
            for bits in self.bits:
                ones = np.bitwise_count(bits).astype(np.int64)
                step = _BLOCK // 8
                padded = np.concatenate([ones, np.zeros(-len(ones) % step, np.int64)]).reshape(-1, step)
                self._samples.append(np.concatenate([[0], np.cumsum(padded.sum(axis=1))]))
        block = at // _BLOCK
        whole, bits = at // 8, self.bits[depth]
        inside = int(np.bitwise_count(bits[block * (_BLOCK // 8) : whole]).sum())
        if at % 8:
            inside += (int(bits[whole]) & ((1 << at % 8) - 1)).bit_count()
        return int(self._samples[depth][block]) + inside

    def _bit(self, depth: int, at: int) -> int:
        return int(self.bits[depth][at // 8]) >> (at % 8) & 1

    def access(self, at: int) -> int:
        """The id at place ``at``."""
        value = 0
        for depth in range(self.planes):
            bit = self._bit(depth, at)
            ones = self._rank(depth, at)
            at = self.zeros[depth] + ones if bit else at - ones
            value = value << 1 | bit
        return value

    def _range(self, value: int, lo: int, hi: int) -> tuple[int, int]:
        if value >> self.planes:
            return 0, 0
        for depth in range(self.planes):
            one = value >> (self.planes - 1 - depth) & 1
            a, b = self._rank(depth, lo), self._rank(depth, hi)
            lo, hi = (self.zeros[depth] + a, self.zeros[depth] + b) if one else (lo - a, hi - b)
        return lo, hi

    def count(self, value: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of an id at places ``lo .. hi - 1``."""
        hi = self.size if hi is None else hi
        if hi <= lo:
            return 0
        lo, hi = self._range(value, lo, hi)
        return hi - lo

    def _select(self, depth: int, bit: int, nth: int) -> int:
        """Place of the ``nth`` (from 0) bit of a kind, by halving over ranks."""
        lo, hi = 0, self.size
        while lo + 1 < hi:
            mid = (lo + hi) // 2
            ones = self._rank(depth, mid)
            if (ones if bit else mid - ones) <= nth:
                lo = mid
            else:
                hi = mid
        return lo

    def find(self, value: int, nth: int = 0) -> int:
        """Place of the ``nth`` occurrence of an id, -1 if there are not so many."""
        lo, hi = self._range(value, 0, self.size)
        if nth < 0 or lo + nth >= hi:
            return -1
        at = lo + nth
        for depth in range(self.planes - 1, -1, -1):
            one = value >> (self.planes - 1 - depth) & 1
            at = self._select(depth, one, at - self.zeros[depth] if one else at)
        return at


def write_shards(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, path: str | None = None,
    shard_ids: int = SHARD_IDS,
) -> str:
    """Writes all texts' ids in ascending id order as packed shards and returns the folder.

    The folder holds rows (part, shard, start, ids, n_ids, blob) in Parquet files: a blob per shard
    of about ``shard_ids`` ids, where ``start`` counts the ids of the part before it.  Documents
    are never split.  Null texts count as empty, null ids come first, texts of one id follow the
    order of their hash.
    """
    spark = docs.sparkSession
    file = vocabulary or tokens.vocabulary()
    target = path or shared_path(spark, "shards")
    kind = docs.schema[id_col].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, start, size, part = 0, 0, 0, 0
        held: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        names: list[pa.Array] = []

        def out() -> pa.RecordBatch:
            ids = pa.concat_arrays(names)
            blob = pack(np.concatenate(held), np.concatenate(lengths))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([start], pa.int64()),
                 pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([size], pa.int64()), pa.array([blob], pa.binary())],
                ["part", "shard", "start", "ids", "n_ids", "blob"])

        for rows, ids, bounds in tokens.encoded(batches, "text", file):
            part = rows.column("part")[0].as_py()
            held.append(ids)
            lengths.append(np.diff(bounds))
            names.append(rows.column("id"))
            size += len(ids)
            if size >= shard_ids:
                yield out()
                shard, start, size, held, lengths, names = shard + 1, start + size, 0, [], [], []
        if held:
            yield out()

    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    spread = named.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    kinds = f"part int, shard int, start long, ids array<{kind}>, n_ids long, blob binary"
    spread.mapInArrow(build, kinds).write.parquet(target)
    return target


def _decoded(spark, path: str, column: str, kind: str, make) -> DataFrame:
    """(id, start, n_tokens, column): ``make(ids, bounds)`` gives the column of a shard's documents."""
    shards = spark.read.parquet(path)
    id_kind = shards.schema["ids"].dataType.elementType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                shard = Shard(batch.column("blob")[r].as_py())
                bounds = np.concatenate([[0], np.cumsum(shard.lengths)])
                n = len(shard.lengths)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column("part")[r].as_py()] * n, pa.int32()), batch.column("ids")[r].values,
                     pa.array(bounds[:-1] + batch.column("start")[r].as_py()), pa.array(shard.lengths), make(shard.ids(), bounds)],
                    ["part", "id", "start", "n_tokens", column])

    rows = shards.mapInArrow(decode, f"part int, id {id_kind}, start long, n_tokens long, `{column}` {kind}")
    # One row per shuffle partition of the writer, so small enough to hold anywhere.
    along = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(before), "part").select("id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", column)


def read_shards(spark, path: str) -> DataFrame:
    """(id, start, n_tokens, tokens array<int>) of all documents in a folder of shards; ``start``
    counts the ids of all documents before."""
    def lists(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))

    return _decoded(spark, path, "tokens", "array<int>", lists)


def crc_of(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Unsigned CRC-32 of each document's ids as little-endian unsigned 32-bit integers."""
    raw = memoryview(ids.astype("<u4").tobytes())
    return pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.int64())


def shard_digests(spark, path: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of all documents in a folder of shards."""
    return _decoded(spark, path, "ids_crc32", "long", crc_of)
