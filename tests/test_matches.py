"""Exact matches on repeats, and maximality, against plain models."""

import random
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strandmill.functions import kernels
from strandmill.operators import delta, matches


def plain(t, q, least):
    out = set()
    for i in range(len(t)):
        for j in range(len(q)):
            if t[i] == q[j] and (i == 0 or j == 0 or t[i - 1] != q[j - 1]):
                n = 0
                while i + n < len(t) and j + n < len(q) and t[i + n] == q[j + n]:
                    n += 1
                if n >= least:
                    out.add((i, i + n, j, j + n))
    return out


def kept(found):
    """Longest extension from each query start, nothing contained with the same query end."""
    far = {m for m in found if m[3] == max(o[3] for o in found if o[2] <= m[2])}
    return {m for m in far if not any(o[3] == m[3] and o[2] < m[2] and o[0] <= m[0] and o[1] >= m[1] for o in far)}


def texts(seed):
    rng = random.Random(seed)
    some = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    line, twin = some(27, "abcd"), some(9, "abcd")
    unit = some(rng.randint(1, 4), "ab")
    return [
        some(90, "ab"), "b" + "a" * 50 + some(4, "abc") + "a" * 33, some(4, "ab") + unit * 17 + some(3, "abc") + unit * 9,
        line * 4 + "x" + line[5:] * 2 + line, line[:3] + line * 3 + some(9, "abcd") + line, (twin + "xyz" + twin + "w") * 4 + "q" + twin * 3,
        "", None, "a" * 5, line[:12] * 6 + "b" * 30,
    ]


@pytest.mark.parametrize("least", [5, 16])
def test_repeats(spark, least):
    t, q = list(enumerate(texts(1))), list(enumerate(texts(1)[::-1] + texts(2)))
    found = matches.find(spark.createDataFrame(t, "target int, seq string"), spark.createDataFrame(q, "query int, seq string"), least).persist()
    longest = matches.longest(found, width=16)
    got, best = defaultdict(list), defaultdict(list)
    for into, rows in ((got, found), (best, longest)):
        for r in rows.collect():
            into[r.target, r["query"]].append((r.t_start, r.t_end, r.q_start, r.q_end))
    for a, one in t:
        for b, other in q:
            want = plain(one or "", other or "", least)
            assert sorted(got[a, b]) == sorted(want) and sorted(best[a, b]) == sorted(kept(want)), (one, other)


def test_work_follows_the_matches_and_not_the_seeds(spark):
    n = 100_000
    one = lambda name: spark.createDataFrame([(1, "a" * n)], f"{name} int, seq string")
    start = time.time()
    assert matches.find(one("target"), one("query"), 32).count() == 2 * n - 1 - 2 * 31
    assert time.time() - start < 120
    # A line a thousand times: one row per minimizer of the period, whatever the number of times.
    line = bytes(random.Random(3).choice(b"abcdefgh") for _ in range(60))
    few, many = (len(kernels.seed_rows(line * m, 16, 17)[0]) for m in (10, 1_000))
    assert few == many < 20


def test_runs_of_one_root_are_equal_where_their_shifts_say():
    rng = random.Random(4)
    for _ in range(200):
        p = rng.randint(1, 30)
        unit = bytes(rng.choice(b"ab") for _ in range(p))
        data = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9))) + unit * (60 // p + 3) + bytes(rng.choice(b"abc") for _ in range(9))
        at, hashes = kernels.minimizers(data, 8, 9)
        for start, end, period, shift, _ in kernels.tandem_runs(data, at, hashes, 8):
            assert all(data[i] == data[i + period] for i in range(start, end - period))
            assert start == 0 or data[start - 1] != data[start - 1 + period]
            assert end == len(data) or data[end] != data[end - period]
            turned = (data[start : start + period] * 2)[(shift - start) % period :][:period]
            assert turned == min((data[start : start + period] * 2)[i : i + period] for i in range(period))


def greedy(blocks):
    out, by = set(), defaultdict(list)
    for b in blocks:
        by[b[0]].append(b)
    for name, rows in by.items():
        used, seen = 0, set()
        for b in sorted(rows, key=lambda b: (b[1], b[4], b[5], b[2], b[6])):
            if b[1] not in seen and b[1] >= used:
                out.add((name, b[1], b[2]))
                used = max(b[2], b[1] + 1)
            seen.add(b[1])
    return out


def test_blocks_are_taken_as_by_a_walk(spark):
    rng = random.Random(5)
    blocks = [("hot", s, s + rng.randint(1, 60), "+", rng.choice("rs"), 0, "1=") for s in (rng.randrange(20_000) for _ in range(6_000))]
    blocks += [(f"q{i % 40}", s, s + rng.randint(0, 9), "+", "r", 0, "1=") for i, s in enumerate(rng.randrange(50) for _ in range(400))]
    blocks += [("hot", 1, 30_000, "-", "r", 0, "1="), ("none", 1, 5, "+", "r", 0, "")]
    df = spark.createDataFrame(blocks, "query_name string, query_start long, query_end long, strand string, target_name string, target_start long, cigar string")
    got = delta.select_blocks(df, width=500).collect()
    assert {(r.query_name, r.query_start, r.query_end) for r in got} == greedy([b for b in blocks if b[3] == "+" and b[6]])
    assert len(got) == len({(r.query_name, r.query_start) for r in got})


@pytest.mark.parametrize("width", [7, 10_000])
def test_copies_and_gaps(spark, width):
    """Copies that go on become one; the rest of each sequence is literal."""
    copies = spark.createDataFrame(
        [("a", 3, 6, "r", 10, 13), ("a", 6, 9, "r", 13, 16), ("a", 9, 12, "r", 20, 23), ("a", 12, 14, "s", 23, 25), ("a", 40, 50, "s", 25, 35), ("b", 0, 5, "r", 0, 5)],
        "chrom string, q_start long, q_end long, ref_chrom string, ref_start long, ref_end long")
    lengths = spark.createDataFrame([("a", 60), ("b", 5), ("c", 4), ("d", 0)], "chrom string, length long")
    got = delta.coalesce_ops(copies, lengths, width).orderBy("chrom", "op_idx").collect()
    assert [(r.chrom, r.op_idx, r.type, r.ref_chrom, r.ref_start, r.ref_end, r.q_start, r.q_end) for r in got] == [
        ("a", 0, "literal", None, None, None, 0, 3), ("a", 1, "copy", "r", 10, 16, 3, 9), ("a", 2, "copy", "r", 20, 23, 9, 12),
        ("a", 3, "copy", "s", 23, 25, 12, 14), ("a", 4, "literal", None, None, None, 14, 40), ("a", 5, "copy", "s", 25, 35, 40, 50),
        ("a", 6, "literal", None, None, None, 50, 60), ("b", 0, "copy", "r", 0, 5, 0, 5), ("c", 0, "literal", None, None, None, 0, 4)]
    ops = delta.coalesce_ops(copies, lengths, width).withColumn("bytes", F.when(F.col("type") == "literal", F.lit(b"x")))
    gaps = {(r.chrom, r.op_idx): r.ref_gap for r in delta.reference_gaps(ops, width).collect()}
    assert gaps == {("a", 1): 10, ("a", 2): 4, ("a", 3): 0, ("a", 5): 0, ("b", 0): 0}
    assert delta.summarise(ops, lengths).where("chrom = 'd'").first()[1:] == (0, 0, 0, 0, 0.0)
