"""Byte network: held-out accuracy, gradients, windows and odd rows."""

import random

import numpy as np

from strandmill.llm import language


def test_windows_cover_texts():
    raw = [b"", b"abc", bytes(range(1, 193)), bytes(range(1, 200))]
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    rows, count = language.windows_of(np.frombuffer(b"".join(raw), np.uint8), bounds, 192)
    assert count.tolist() == [0, 1, 1, 2]
    assert bytes(rows[0]) == b"abc" + bytes(189) and bytes(rows[1]) == raw[2]
    assert bytes(rows[2]) == raw[3][:192] and bytes(rows[3]) == raw[3][-192:]


def test_responses_equal_products():
    net = language.ByteNet(["a", "b"], window=30)
    net.prepare()
    rows = np.random.default_rng(0).integers(0, 256, (5, 30)).astype(np.uint8)
    for width, taps, got in zip(net.widths, net.taps, net._responses(rows), strict=True):
        for place in range(30 - width + 1):
            want = sum(taps[i][rows[:, place + i]] for i in range(width))
            assert np.allclose(got[:, place], want, atol=1e-5)


def text(rng, words):
    return " ".join(rng.choice(words) for _ in range(40))


def test_held_out(spark):
    rng = random.Random(1)
    kinds = {"aa": ["the", "and", "of", "thing"], "bb": ["der", "und", "für", "nicht"], "cc": ["el", "año", "que", "los"]}
    rows = [(i, text(rng, kinds[k]), k) for i, k in enumerate(rng.choice(list(kinds)) for _ in range(240))]
    odd = [(900, None, "aa"), (901, "", "bb"), (902, "12 34 ...", None), (903, "the and of", None), (None, text(rng, kinds["bb"]), None),
           (904, "el que " * 9000, "cc"), rows[4], rows[4]]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").selectExpr("*", "1 as language", "2 as label", "3 as h")
    net = language.fit(df.drop("language"))
    assert net.labels == ["aa", "bb", "cc"]
    out = language.predict(df.drop("language").withColumn("held", ~language.learns()), net).collect()
    held = [r for r in out if r.held and r.lang and r.text]
    assert len(held) > 30 and all(r.language.lang_pred == r.lang for r in held)
    by = {r.doc_id: r.language for r in out}
    assert by[900] == by[901] == by[902] == ("und", 0.0)
    assert by[903].lang_pred == "aa" and by[None].lang_pred == "bb" and by[904].lang_pred == "cc"
    assert all(0 <= r.language.score <= 1 for r in out)


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert language.fit(df) is None
    assert language.predict(df, None).first().language == ("und", 0.0)
    assert language.fit(df.limit(0)) is None and language.predict(df.limit(0), None).collect() == []


def test_texts_reach_the_model_in_small_slices(spark, monkeypatch):
    """A batch of many texts is laid out a slice at a time, and the answer does not depend on the slices."""
    rows = [(i, t * 30, k) for i, (t, k) in enumerate([("the cat and the dog ", "aa"), ("der hund und die katze ", "bb")] * 40)]
    docs = spark.createDataFrame([*rows, (900, None, None), (901, "12 3", None)], "doc_id long, text string, lang string").coalesce(1)
    net = language.fit(docs)
    whole = language.predict(docs, net)
    assert "ArrowEvalPython" in whole._jdf.queryExecution().executedPlan().toString()
    want = {r.doc_id: r.language for r in whole.collect()}
    monkeypatch.setattr(language, "SLICE", 700)
    got = {r.doc_id: r.language for r in language.predict(docs, net).collect()}
    assert {i: x.lang_pred for i, x in got.items()} == {i: x.lang_pred for i, x in want.items()}
    assert all(abs(got[i].score - want[i].score) < 1e-6 for i in got) and got[900].lang_pred == got[901].lang_pred == "und"
    assert language.SLICE < 1 << 20 and not hasattr(language, "pd")
