"""Content-defined chunking of sequences into segments."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandmill.functions.batches import by_bytes
from strandmill.functions.hashing import address
from strandmill.functions.kernels import candidate_ends, cut_ends, exit_table, mask_bits, next_ends
from strandmill.operators import blocked

MIN_SIZE, MAX_SIZE = 262_144, 1_048_576
BLOCK = 4_194_304  # bytes of a long sequence that one task walks


def chunks(
    seqs: DataFrame, keep: list[str], seq: str, sizes: list[tuple[int, int]] | None = None
) -> DataFrame:
    """Segments of every sequence for each (min, max) chunk size asked for.

    One pass reads each sequence once for all sizes.  Rows stay in their partition and a
    sequence is a cell, so no task holds more than a batch of them and the segments of a slice.
    """
    sizes = sizes or [(MIN_SIZE, MAX_SIZE)]

    def split(batches):
        for batch in batches:
            for part in by_bytes(batch, len(keep)):
                row, top, idx, start, data = [], [], [], [], []
                for r, value in enumerate(part.column(len(keep)).to_pylist()):
                    for low, high in sizes if value else ():
                        begin = 0
                        for i, end in enumerate(cut_ends(value, low, high)):
                            row.append(r)
                            top.append(high)
                            idx.append(i)
                            start.append(begin)
                            data.append(value[begin:end])
                            begin = end
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(i).take(at) for i in range(len(keep))]
                    + [pa.array(v, pa.int64()) for v in (top, idx, start)]
                    + [pa.array(data, pa.binary())],
                    names=[*keep, "max_chunk", "seg_idx", "start", "data"],
                )

    given = seqs.select(*keep, F.col(seq).cast("binary").alias("s"))
    longs = [T.StructField(c, T.LongType()) for c in ("max_chunk", "seg_idx", "start")]
    schema = T.StructType(
        [given.schema[c] for c in keep] + longs + [T.StructField("data", T.BinaryType())]
    )
    return given.mapInArrow(split, schema).withColumns({
        "length": F.octet_length("data").cast("long"), "hash": address(F.col("data"))
    })


def pieces(seqs: DataFrame, keep: list[str], seq: str, size: int = BLOCK) -> DataFrame:
    """Sequences as ordered pieces (at, data) of ``size`` bytes, as a reader by ranges gives them."""
    data = F.col(seq).cast("binary")
    given = seqs.select(*keep, data.alias("s")).where(F.octet_length("s") > 0)
    cut = F.transform(F.sequence(F.lit(0), F.expr(f"cast((octet_length(s) - 1) div {size} as int)")),
                      lambda i: F.substring("s", i * size + 1, F.lit(size)))
    return given.select(*keep, F.posexplode(cut).alias("piece", "data")).select(
        *keep, (F.col("piece").cast("long") * size).alias("at"), "data")


def placed(parts: DataFrame, keep: list[str], order: str, width: int = 4_096) -> DataFrame:
    """Pieces (data) numbered by ``order`` with the place ``at`` of their first byte in the sequence."""
    sizes = parts.select(*keep, order, F.octet_length("data").cast("long").alias("size"))
    at = blocked.running(sizes, keep, [order], blocked.block_of(order, width), {"at": ("sum", F.col("size"))})
    return parts.join(at.select(*keep, order, F.coalesce("at", F.lit(0)).alias("at")), [*keep, order]).select(*keep, "at", "data")


def long_chunks(parts: DataFrame, keep: list[str], sizes: tuple[int, int] = (MIN_SIZE, MAX_SIZE), block: int = BLOCK) -> DataFrame:
    """Segments of sequences that are too long for one cell: the same ends as ``chunks`` gives.

    ``parts`` has the columns ``keep`` naming a sequence, ``at`` and ``data``: pieces of any length without
    gaps.  They are dealt into blocks that overlap by the longest chunk.  Where a chunk may end depends on few
    bytes, so each block tells for all offsets at which the first chunk may enter it where the first
    chunk leaves it; these tables, a few numbers each, are passed through in order, and then every
    block cuts its own chunks.  So a single sequence uses all cores.  Needs a least size of at least
    the hash's reach, as ``mask_bits`` tells.
    """
    low, high = sizes
    bits, longest = mask_bits(low, high), max(low, high)
    if low < bits:
        raise ValueError(f"chunks of {low} bytes are shorter than the {bits} bytes of the hash")
    lengths = parts.groupBy(*keep).agg(F.max(F.col("at") + F.octet_length("data")).cast("long").alias("total"))
    stop = F.col("at") + F.octet_length("data")
    touched = F.sequence(F.greatest(F.lit(0), F.floor((F.col("at") - longest) / block)), F.floor((stop + bits - 1) / block))
    start = F.col("block") * block - bits  # the bytes before let the first ends be found
    from_ = F.greatest("at", start)
    to = F.least(stop, F.col("block") * block + block + longest)
    dealt = parts.withColumn("block", F.explode(touched)).withColumns({"from_": from_, "to": to}).where("to > from_").select(
        *keep, "block", "from_", F.substring("data", (F.col("from_") - F.col("at") + 1).cast("int"), (F.col("to") - F.col("from_")).cast("int")).alias("data"))
    blocks = dealt.groupBy(*keep, "block").agg(F.expr("listagg(data) WITHIN GROUP (ORDER BY from_)").alias("data"), F.min("from_").alias("from_"))
    blocks = blocks.join(lengths, keep).where(F.col("block") * block < F.col("total"))
    names = [blocks.schema[c] for c in keep]
    n = len(keep)

    def ends_of(data: bytes, skip: int):
        """Candidate ends from the block's first byte, of the bytes after ``skip``."""
        ends = candidate_ends(data, bits) - skip
        return ends[ends > 0]

    def tables(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                index, start = batch.column("block")[r].as_py(), batch.column("from_")[r].as_py()
                data, skip = batch.column("data")[r].as_py(), index * block - start
                entries, exits, slopes = exit_table(ends_of(data, skip), min(block, len(data) - skip), low, high)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(r, 1) for c in (*keep, "block")] + [pa.array([v.tolist()], pa.list_(pa.int64())) for v in (entries, exits, slopes)],
                    names=[*keep, "block", "entries", "exits", "slopes"])

    lists = [T.StructField(c, T.ArrayType(T.LongType())) for c in ("entries", "exits", "slopes")]
    walks = blocks.mapInArrow(tables, T.StructType([*names, T.StructField("block", T.LongType()), *lists]))

    def compose(batches):
        """Walks of one sequence in order: where the first chunk enters each block."""
        key, entry = None, 0
        for batch in batches:
            out = []
            keys = list(zip(*[batch.column(c).to_pylist() for c in keep], strict=True))
            for r, one in enumerate(keys):
                if one != key:
                    key, entry = one, 0
                out.append(entry)
                entries, exits, slopes = (batch.column(c)[r].values.to_numpy() for c in ("entries", "exits", "slopes"))
                at = int(entries.searchsorted(entry, "right")) - 1
                entry = int(exits[at] + slopes[at] * (entry - entries[at]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in (*keep, "block")] + [pa.array(out, pa.int64())], names=[*keep, "block", "entry"])

    schema = T.StructType([*names, T.StructField("block", T.LongType()), T.StructField("entry", T.LongType())])
    entered = walks.repartition(*keep).sortWithinPartitions(*keep, "block").mapInArrow(compose, schema)

    def cut(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                index, start, total, at = (batch.column(c)[r].as_py() for c in ("block", "from_", "total", "entry"))
                data, skip = batch.column("data")[r].as_py(), index * block - start
                ends, rest = ends_of(data, skip), total - index * block
                begins, found = [], []
                while at < min(block, rest):
                    end = min(int(next_ends(np.array([at]), ends, low, high)[0]), rest)
                    begins.append(at + index * block)
                    found.append(data[skip + at : skip + end])
                    at = end
                row = pa.array(np.full(len(begins), r))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).take(row) for c in keep] + [pa.array(begins, pa.int64()), pa.array(found, pa.binary())], names=[*keep, "start", "data"])

    schema = T.StructType([*names, T.StructField("start", T.LongType()), T.StructField("data", T.BinaryType())])
    found = blocks.join(entered, [*keep, "block"]).mapInArrow(cut, schema)
    return found.withColumns({"length": F.octet_length("data").cast("long"), "hash": address(F.col("data"))})
