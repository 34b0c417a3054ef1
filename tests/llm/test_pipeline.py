"""The pipeline on a small corpus, stage by stage against the brute-force models."""

import hashlib
import importlib
import random

from test_decontaminate import model as contaminated_by
from test_near_dup import groups
from test_near_dup import model as prints
from test_substrings import model as cut_by

from strandmill.llm import tokens

pipeline = importlib.import_module("corpus_pipeline")
KINDS = {"aa": ["the", "and", "of", "thing", "with"], "bb": ["der", "und", "für", "nicht", "ein"]}


def corpus():
    rng = random.Random(11)
    def text(kind, n):
        return " ".join(rng.choice(KINDS[kind]) + rng.choice(["", "", rng.choice("xyzw")]) + str(rng.randrange(50) or "") for _ in range(n))

    rows = [(i, text(k, rng.randrange(30, 120)), k, "s", 7) for i, k in enumerate(rng.choice("ab") * 2 for _ in range(120))]
    shared, items = text("aa", 60), [(1, text("aa", 40)), (2, text("bb", 9)), (3, None)]
    rows += [(200, rows[3][1], "aa", "s", 7), (201, rows[5][1] + " extra", None, "s", 7), rows[7], (207, text("aa", 50), "aa", None, None)]
    rows += [(210 + i, text("aa", 50) + " " + shared + " " + text("aa", 30), "aa", "s", 7) for i in range(4)]
    rows += [(220, text("aa", 30) + " " + items[0][1], "aa", "s", 7), (221, text("bb", 400) + " " + items[1][1], "bb", "s", 7)]
    rows += [(230, None, "aa", "s", 7), (231, "", "bb", "s", 7), (232, "1 2 3 !", None, None, None), (None, text("bb", 60), "bb", "s", 7)]
    return rows, items


def test_stages(spark, docs_schema, tmp_path):
    rows, items = corpus()
    spark.createDataFrame(rows, docs_schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["language", "near_duplicates", "substrings", "decontaminate", "packing"]
    outs = []
    for _, stage in pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), docs_schema) if len(outs) < 4 else stage(spark, docs, str(tmp_path))
        outs.append(docs.collect())
        if len(outs) < 5:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    first, second, third, fourth, pieces = outs
    key = lambda r: (str(r[0]), r[1] or "")
    letters = [r for r in rows if r[1] and any(map(str.isalpha, r[1]))]
    assert sorted(map(tuple, first), key=key) == sorted(letters, key=key)
    pairs = [(r.doc_id, r.text) for r in first]
    parts = {c for _, _, c in groups(prints(pairs))}
    print_of = dict(zip(pairs, (f for _, f in prints(pairs)), strict=True))
    of = {(i, f): c for i, f, c in groups(prints(pairs))}
    kept_by = {}
    for r in second:
        kept_by.setdefault(of[r.doc_id, print_of[r.doc_id, r.text]], []).append(r.doc_id)
    assert kept_by.keys() == parts and all(set(v) == {c} for c, v in kept_by.items())
    want = {(i, sha) for i, _, _, sha in cut_by([(r.doc_id, r.text) for r in second], 20)}
    assert {(r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in third} == want and len(third) == len(second)
    assert all(r.n_chars == len(r.text) for r in third)
    bad = {i for i, *_, c in contaminated_by([(r.doc_id, r.text) for r in third], items) if c}
    assert bad and {r.doc_id for r in fourth} == {r.doc_id for r in third} - bad
    whole = tokens.whole_tokenizer(tokens.vocabulary())
    for r in fourth:
        ids = [t for p in sorted((p for p in pieces if p.doc_id == r.doc_id), key=lambda p: p.start) for t in p.ids]
        assert ids == whole.encode(r.text, add_special_tokens=False).ids + [2]
    assert len(pipeline.run(spark, str(tmp_path)).collect()) == len(pieces)


def test_languages_without_labels(spark, docs_schema):
    """Where nothing can be learned, all texts with a letter stay; a column of the struct's name stays too."""
    rows = [(1, "a", None, "s", 1), (2, "1 2", None, "s", 3), (3, None, None, None, None), (4, "\u00e9\u6f22", None, "s", 2)]
    docs = spark.createDataFrame(rows, docs_schema).selectExpr("*", "source as language")
    out = pipeline.keep_languages(spark, docs, "")
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {1, 4}
    labelled = spark.createDataFrame([(i, t, k, "s", 1) for i, (t, k) in enumerate([("the cat", "aa"), ("der hund", "bb"), ("7", "aa"), ("x", None)])], docs_schema)
    out = pipeline.keep_languages(spark, labelled.selectExpr("*", "source as language"), "")
    assert {(r.doc_id, r.language) for r in out.collect()} == {(0, "s"), (1, "s"), (3, "s")}


def test_empty(spark, docs_schema, tmp_path):
    spark.createDataFrame([], docs_schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).collect() == []
