"""Groups of similar texts against exact Jaccard similarities of five-word runs."""

import random

import pytest

from strandmill.llm import similar


def runs(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def model(rows):
    """The row kept of each component, all pairs compared."""
    sets = [runs(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                root[find(a)] = find(b)
    least = {}
    for v, (i, _) in enumerate(rows):
        least[find(v)] = min(i, least.get(find(v), i))
    return sorted(least.values())


def edited(rng, text, edits):
    words = text.split()
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("bucket", [similar.BUCKET, 1])
def test_planted_copies(spark, bucket):
    rng = random.Random(4)
    fresh = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    rows = []
    for group, (size, edits) in enumerate([(200, 1), (200, 2), (200, 4), (200, 14), (1000, 5), (1000, 20)] * 8):
        base = fresh(size)
        rows += [(1000 * group, base), (1000 * group + 1, edited(rng, base, edits))]
    large = fresh(150)
    rows += [(900_000 + i, edited(rng, large, rng.randrange(3))) for i in range(80)]
    rows += [(950_000, "One two"), (950_001, "one  TWO"), (950_002, "one three"), (950_003, "w " * 20_000), (950_004, None), (950_005, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "2 as root", "3 as key").repartition(3)
    got = similar.keep_one(docs, bucket=bucket)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == model(rows)


def test_pipeline_stage_drops_similar_texts(spark, docs_schema):
    import corpus_pipeline

    rng = random.Random(8)
    base = [" ".join(f"w{rng.randrange(3000)}" for _ in range(200)) for _ in range(20)]
    rows = [(i, t, "a", "s", 1) for i, t in enumerate(base)] + [(100 + i, edited(rng, t, 4), "a", "s", 1) for i, t in enumerate(base)]
    want = model([r[:2] for r in rows])
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, docs_schema), "")
    assert sorted(r.doc_id for r in got.collect()) == want and len(want) < 26


def test_empty(spark):
    assert similar.keep_one(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_no_link_is_lost_in_a_crowded_bucket(spark, monkeypatch):
    """One bucket of many texts apart and a few similar pairs that no leader of three rounds need be part of."""
    rng = random.Random(12)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for group in range(60):
        words = base[:40] + [f"g{group}x{i}" for i in range(60)]
        rows += [(2 * group, " ".join(words)), (2 * group + 1, " ".join([*words[:95], "z", *words[96:]]))]
    rng.shuffle(rows)
    monkeypatch.setattr(similar, "_bands", lambda runs, bounds: similar.np.ones((int((similar.np.diff(bounds) > 0).sum()), similar.BANDS), similar.np.uint64))
    monkeypatch.setattr(similar, "LEAST_ROUNDS", 1)
    got = similar.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == model(rows) == list(range(0, 120, 2))


def test_pipeline_stage_links_fingerprints(spark, docs_schema):
    """Texts whose fingerprints link in op8 are one group, whatever share of their runs is equal."""
    import corpus_pipeline
    from test_near_dup import groups
    from test_near_dup import model as prints

    rng = random.Random(13)
    base = [" ".join(f"w{rng.randrange(3000)}" for _ in range(40)) for _ in range(5)]
    # Texts many times in a row, and short ones over two letters, whose fingerprints are close.
    rows = [(i, t) for i, t in enumerate(base)] + [(10 + i, " ".join([t] * 30)) for i, t in enumerate(base)] + [(20 + i, " ".join([t] * 31)) for i, t in enumerate(base)]
    rows += [(100 + i, " ".join(rng.choice("ab") for _ in range(9))) for i in range(60)]
    of = {}
    for i, _, c in groups(prints(rows)):
        of.setdefault(c, []).append(i)
    linked = {i for c, v in of.items() for i in v if i != c}
    got = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame([(i, t, "a", "s", 1) for i, t in rows], docs_schema), "").collect()}
    assert linked and not got & linked
    left = {r.doc_id for r in corpus_pipeline.similar.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left & linked  # the runs alone would keep them


def test_meeting_pairs_few_of_many_texts_apart(spark, tmp_path):
    """Texts that share two thirds of their runs are no candidates, and no similar pair is lost."""
    rng = random.Random(21)
    base = list(range(200))
    rows = []
    for group in range(150):
        own = base[:160] + rng.sample(range(10_000, 900_000), 40)
        for other in (own, own[:190] + rng.sample(range(10_000, 900_000), 10)) if group < 10 else (own,):
            rows.append((len(rows), len(rows), sorted(other)))
    rows += [(1000 + i, 1000, sorted(base[: 9 + i])) for i in range(30)] + [(2000, 2000, base[:1]), (2001, 2001, base[:1])]
    spark.createDataFrame([(n, s) for n, _, s in rows], "node long, `set` array<int>").write.parquet(f"{tmp_path}/sets")
    rest = spark.createDataFrame([r[:2] for r in rows], "node long, root long")
    met = similar._meeting(rest, spark.read.parquet(f"{tmp_path}/sets"), similar.SIMILAR).collect()
    both = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] != b[1] and both(a[2], b[2]) >= similar.SIMILAR - 1e-9}
    assert want and want <= {(min(r), max(r)) for r in met}
    assert len(met) < 2000  # of 13,000 pairs that share 160 of 200 runs


def test_no_text_is_stored_between_the_steps(spark, docs_schema, tmp_path):
    """What the near-duplicate stage leaves in the shared folder is far smaller than its texts."""
    from pathlib import Path

    import corpus_pipeline
    from strandmill.session import checkpoint_dir

    rng = random.Random(22)
    rows = [(i, " ".join(f"w{rng.randrange(10**9)}" for _ in range(3000)), "a", "s", 1) for i in range(60)]
    spark.createDataFrame(rows, docs_schema).write.parquet(f"{tmp_path}/docs")
    size = lambda files: sum(p.stat().st_size for p in files)
    folder = Path(checkpoint_dir(spark).removeprefix("file:"))
    before = set(folder.rglob("*.parquet"))
    got = corpus_pipeline.drop_near_duplicates(spark, spark.read.parquet(f"{tmp_path}/docs"), "")
    assert got.count() == 60
    assert size(set(folder.rglob("*.parquet")) - before) < 0.2 * size((tmp_path / "docs").rglob("*.parquet"))
