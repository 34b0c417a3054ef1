"""Hard negatives against plain integer scores of all pairs."""

import numpy as np
import pytest

from strandmill.llm import hard_negatives as hn
from strandmill.llm.neighbours import turned


def plain(rows, every=10, k=5, low=80, high=100, scale=256):
    best = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        key = (label, [int(np.floor(scale * float(x))) for x in v])
        best[i] = min(best.get(i, key), key)
    sizes = [len(v) for _, v in best.values()]
    size = max(sorted(set(sizes)), key=sizes.count) if sizes else 0
    best = {i: x for i, x in best.items() if len(x[1]) == size}
    out = set()
    for a, (label, v) in best.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, (other, w) in best.items() if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:k]:
            fits = [x for x in scored if x[2] != label and low * -s <= high * -x[0] <= high * -s][:k]
            out |= {(a, p, n + 1, i, -s, -x) for n, (x, i, _) in enumerate(fits)}
    return out


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as id", "'x' as ints", "2 as codes")
    got = hn.mine(df, every=10, **options).collect()
    assert len(got) == len({tuple(r) for r in got})
    return {(r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got}


def vectors(kind, n=160, dims=64):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, dims)) / 8
    if kind == "clusters":
        x = (rng.normal(size=(6, dims))[rng.integers(0, 6, n)] + x * 2) / 8
    if kind == "ties":
        x = rng.integers(0, 2, size=(n, dims)) / 4
    if kind == "copies":
        x[: n // 2] = x[0]
    if kind == "norms":
        x *= rng.lognormal(0, 2, (n, 1))
    return x.astype(np.float32).tolist()


@pytest.mark.parametrize("kind", ["plain", "clusters", "ties", "copies", "norms"])
def test_all_kinds(spark, monkeypatch, kind):
    monkeypatch.setattr(hn, "PART", 60)
    labels = np.random.default_rng(2).choice(4, 160, p=[0.6, 0.2, 0.1, 0.1]).tolist()
    rows = [(i, v, l) for i, (v, l) in enumerate(zip(vectors(kind), labels, strict=True))]
    want = plain(rows)
    assert found(spark, rows) == want and (want or kind == "plain")


def test_odd_rows(spark):
    v = vectors("clusters", 40, 3)
    rows = [(i, x, i % 2) for i, x in enumerate(v)]
    rows += [(None, v[0], 1), (50, None, 1), (60, v[1], None), (70, [1.0, None, 2.0], 1), (80, [float("nan")] * 3, 1), (90, [float("inf")] * 3, 0),
             (100, [1.0], 1), (110, [], 1), (20, v[20], 0), (20, v[3], 0), (120, [0.0, 0.0, 0.0], 1), (-10, v[4], 1)]
    assert found(spark, rows) == plain(rows)
    assert found(spark, []) == set()
    assert found(spark, [(0, [1.0], 1)]) == set()


def test_huge_components_saturate(spark):
    rows = [(i, [1e30 * (-1) ** i, float(i)], i % 2) for i in range(20)]
    assert all(abs(r[4]) < 1 << 62 for r in found(spark, rows))


def test_intervals_hold_and_filter():
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(8, 64))[rng.integers(0, 8, 500)] * 30 + rng.normal(size=(500, 64)) * 9).astype(np.int64)
    spun = turned(x.astype(float), 0, 64)
    codes, align, left = hn.coded(spun)
    planes = hn.Planes(spun[:50])
    exact, seen = x[:50] @ x.T, []

    def keep(lower, upper):
        inside = np.isfinite(lower)
        assert (lower <= exact)[inside].all() and (exact <= upper)[inside].all()
        bar = hn.kth_largest(lower, 5)
        seen.append((upper - lower)[inside].mean())
        return upper >= bar

    a, r = hn.survivors(planes, np.arange(50), codes, align, left, np.ones(exact.shape, bool), keep)
    assert seen == sorted(seen, reverse=True)  # each level narrows the intervals
    assert len(a) < exact.size / 4
    for q in range(50):
        assert set(np.argsort(-exact[q], kind="stable")[:5]) <= set(r[a == q])
