"""Packing: the fill against brute force, and whole documents back from their pieces."""

import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from strandmill.llm import packing, tokens


def test_best_fill():
    rng = random.Random(4)
    for _ in range(60):
        counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(5)}
        window = rng.randrange(30, 60)
        used = packing.best_fill(counts, window)
        sums = {sum(k * n for k, n in zip(counts, uses, strict=True)) for uses in itertools.product(*[range(c + 1) for c in counts.values()])}
        assert sum(k * n for k, n in used.items()) == max(s for s in sums if s <= window)
        assert all(n <= counts[k] for k, n in used.items())


def test_plan_of_many_lengths():
    rng = random.Random(1)
    counts = {rng.randrange(1, 4096): rng.randrange(1, 40) for _ in range(1500)}
    patterns, left = packing.plan(counts)
    placed = defaultdict(int, left)
    for times, used in patterns:
        assert 4092 <= sum(k * n for k, n in used.items()) <= 4096
        for k, n in used.items():
            placed[k] += times * n
    assert dict(placed) == counts
    total = sum(k * n for k, n in counts.items())
    assert sum(k * n for k, n in left.items()) < 0.4 * total
    many = {k: 1000 for k in range(1, 1500)}  # short lengths fill every gap
    assert sum(k * n for k, n in packing.plan(many)[1].items()) < 4096


def check(rows, pieces, window, slack):
    whole = tokens.whole_tokenizer(tokens.vocabulary())
    pool = defaultdict(int)
    for i, t in rows:
        pool[i, tuple(whole.encode(t or "", add_special_tokens=False).ids + [2])] += 1
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
        assert p.length == len(p.ids)
    padding = 0
    for parts in sequences.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
        assert at & (at - 1) == 0 or window - at <= slack
    by_id = defaultdict(list)
    for p in pieces:
        by_id[p.id].append(p)
    for i, parts in by_id.items():  # equal ids may hold several documents: match them up by content
        todo = sorted((k[1] for k, n in pool.items() if k[0] == i for _ in range(n)), key=len)
        left = list(parts)
        for ids in todo:
            at = 0
            while at < len(ids):
                p = next(p for p in left if p.start == at and p.doc_tokens == len(ids) and tuple(p.ids) == ids[at : at + p.length])
                left.remove(p)
                at += p.length
        assert not left
    assert sum(p.length for p in pieces) == sum(len(k[1]) * n for k, n in pool.items())


@pytest.mark.parametrize(("window", "slack"), [(64, 4), (64, 0), (4096, 4)])
def test_documents(spark, window, slack):
    rng = random.Random(window)
    rows = [(i, " ".join(rng.choice(["the", "x", "Éa", "thing."]) for _ in range(rng.randrange(150)))) for i in range(200)]
    rows += [(300 + i, "a " * 40) for i in range(90)] + [(500, None), (501, ""), (7, "seven"), (7, "b " * 70), (None, "none"), (502, "w " * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "2 as block").repartition(5)
    check(rows, packing.pack(df, window=window, slack=slack).collect(), window, slack)


def test_digests(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    ids = {(r.id, r.start): zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in packing.pack(df).collect()}
    assert {(r.id, r.start): r.ids_crc32 for r in packing.pack_digests(df).collect()} == ids


def test_no_documents(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []
