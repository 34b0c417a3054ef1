"""Chunks of long sequences against the sequential walk."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmill.functions import kernels
from strandmill.operators import chunking


def sequences():
    rng = random.Random(4)
    text = lambda n, letters: bytes(rng.choice(letters) for _ in range(n))
    return {
        "random": text(40_000, range(256)), "bases": text(30_000, b"ACGT"), "equal": b"N" * 20_011,
        "mixed": text(5_000, b"ACGT") + b"N" * 9_000 + text(3_000, b"ACGT"), "short": b"ACGT", "one": b"A", "edge": text(4_000, b"AC"), "empty": b"",
    }


@pytest.mark.parametrize("sizes,block", [((64, 256), 1_000), ((64, 1_024), 700), ((100, 100), 4_000), ((300, 200), 1_000)])
def test_same_ends_as_the_walk(spark, sizes, block):
    given = sequences()
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in given.items()], "name string, seq binary")
    got = {}
    for r in chunking.long_chunks(chunking.pieces(df, ["name"], "seq", 900), ["name"], sizes, block).collect():
        got.setdefault(r["name"], []).append((r.start, r.length, bytes(r.data)))
    for name, data in given.items():
        found, start = [], 0
        for end in kernels.cut_ends(data, *sizes):
            found.append((start, end - start, data[start:end]))
            start = end
        assert sorted(got.get(name, [])) == found, name


def test_pieces_of_any_length(spark):
    rng = random.Random(5)
    data = bytes(rng.choice(b"ACGT") for _ in range(9_000))
    cuts = sorted({0, 9_000, *(rng.randrange(9_000) for _ in range(40))})
    rows = [("x", i, bytearray(data[a:b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    parts = chunking.placed(spark.createDataFrame(rows, "name string, idx long, data binary"), ["name"], "idx")
    got = chunking.long_chunks(parts, ["name"], (64, 512), 2_000).orderBy("start")
    assert [r.start + r.length for r in got.collect()] == kernels.cut_ends(data, 64, 512)


def test_exit_table():
    rng = np.random.default_rng(6)
    ends = np.unique(rng.integers(1, 3_000, 40))
    entries, exits, slopes = kernels.exit_table(ends, 2_000, 30, 200)
    for e in range(200):
        at = e
        while at < 2_000:
            at = int(kernels.next_ends(np.array([at]), ends, 30, 200)[0])
        k = np.searchsorted(entries, e, "right") - 1
        assert exits[k] + slopes[k] * (e - entries[k]) == at - 2_000


def test_short_minimum_is_refused(spark):
    with pytest.raises(ValueError):
        chunking.long_chunks(spark.createDataFrame([], "name string, at long, data binary"), ["name"], (2, 1_000))
    assert chunking.long_chunks(spark.createDataFrame([], "name string, at long, data binary"), ["name"], (64, 100)).where(F.lit(True)).count() == 0
