"""Hashed neighbours against all inner products."""

import numpy as np
import pandas as pd
import pytest

from strandmill.llm import neighbours


def exact(rows, every, k):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i, tuple(map(float, v))] = 1
    out = {}
    for q, x in good:
        if q % every == 0:
            best = {}
            for i, y in good:
                if i != q:
                    best[i] = max(best.get(i, -np.inf), float(np.dot(x, y)))
            out.setdefault(q, sorted(((-s, i) for i, s in best.items()))[:k])
    return out


def run(spark, rows, kind="float", **options):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").selectExpr("*", "1 as code", "2 as least", "3 as id")
    out = neighbours.search(df, **options).collect()
    found = {}
    for r in sorted(out, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    return found


def odd_rows():
    return [(None, [1.0] * 8), (1000, None), (1020, [0.0] * 8), (1040, [float("nan")] + [1.0] * 7), (1060, [None] + [1.0] * 7),
            (1080, [float("inf")] * 8), (1100, [1.0, 2.0]), (1120, [])]


def test_all_probes_are_exact(spark):
    rng = np.random.default_rng(0)
    rows = [(i, (rng.normal(size=8) * rng.uniform(0.5, 3)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(400 + i, rows[40][1]) for i in range(60)] + odd_rows() + [rows[20], rows[20]]
    got = run(spark, rows, probes=32, chunk=40, whole_band=0)
    want = exact([r for r in rows if not r[1] or len(r[1]) == 8], 20, 20)
    assert got.keys() == want.keys()
    for q, near in want.items():
        assert [i for _, i, _ in got[q]] == [i for _, i in near] and [n for n, _, _ in got[q]] == list(range(1, 21))
        assert np.allclose([s for _, _, s in got[q]], [-s for s, _ in near], atol=1e-12)


@pytest.mark.parametrize("whole_band", [0, 512])
def test_ties_go_to_smaller_ids(spark, whole_band):
    """Vectors with three ones of 16: scores are 0 to 3, so most of the border ties; doubles stay doubles."""
    rng = np.random.default_rng(8)
    rows = [(i, np.isin(np.arange(16), rng.choice(16, 3, False)).astype(float).tolist()) for i in rng.permutation(400).tolist()]
    rows += [(i, [x * (1 + 2.0**-40) for x in v]) for i, v in ((500, rows[3][1]), (501, rows[4][1]), (520, rows[5][1]))]
    got, want = run(spark, rows, "double", probes=32, chunk=64, whole_band=whole_band), exact(rows, 20, 20)
    assert {q: [(i, s) for _, i, s in near] for q, near in got.items()} == {q: [(i, -s) for s, i in near] for q, near in want.items()}


def test_few_rows(spark):
    assert run(spark, []) == {}
    assert run(spark, [(0, [1.0, 0.0])]) == {}
    assert run(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 0.0])]) == {0: [(1, 2, 1.0), (2, 1, 0.5)]}


def test_recall(spark):
    data = pd.read_parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = list(zip(data.vec_id.tolist(), data.embedding.map(list).tolist(), strict=True))
    rows = [(i, [float(x) for x in v]) for i, v in rows]
    got, want = run(spark, rows, whole_band=0), exact(rows, 20, 20)
    hits = sum(len({i for _, i, _ in got[q]} & {i for _, i in near}) for q, near in want.items())
    assert hits >= 0.9 * sum(len(n) for n in want.values())


@pytest.mark.parametrize("kind", ["lognormal", "outlier"])
def test_recall_on_mixed_norms(spark, kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "lognormal":
        x *= rng.lognormal(0, 1, (2000, 1))
    else:
        x[7] *= 20
    rows = [(i, v) for i, v in enumerate(x.astype(np.float32).tolist())]
    got, want = run(spark, rows), exact(rows, 100, 20)
    hits = sum(len({i for _, i, _ in got[q]} & {i for _, i in near}) for q, near in want.items())
    assert hits >= 0.9 * sum(len(n) for n in want.values())
    print("recall", kind, hits / sum(len(n) for n in want.values()))
