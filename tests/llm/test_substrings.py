"""Repeated passages against a brute-force model."""

import hashlib
import random
import re

import pytest

from strandmill.llm import substrings


def model(rows, width):
    texts = {(2**63 - 1 if i is None else i, t or "") for i, t in rows}
    split = {k: re.findall("[^\x20\x09-\x0d]+", k[1]) for k in texts}
    first = {}
    for key, words in split.items():
        for a in range(len(words) - width + 1):
            run = tuple(words[a : a + width])
            first[run] = min(first.get(run, (key[0], a)), (key[0], a))
    out = []
    for i, t in rows:
        key = (2**63 - 1 if i is None else i, t or "")
        words, gone = split[key], set()
        for a in range(len(words) - width + 1):
            if first[tuple(words[a : a + width])] < (key[0], a):
                gone |= set(range(a, a + width))
        left = " ".join(w for n, w in enumerate(words) if n not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return sorted(out, key=str)


def rows(width):
    rng = random.Random(width)
    text = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    shared = [text(n) for n in (width - 1, width, width + 1, 3 * width, 70)]
    out = []
    for i in range(60):
        parts = [text(rng.randrange(30))]
        for _ in range(rng.randrange(4)):
            own = rng.choice(shared).split()
            lo = rng.randrange(len(own))
            parts += [rng.choice([" ", "\t", "\n"]).join(own[lo:]), text(rng.randrange(12))]
        out.append((i, " ".join(parts)))
    out += [(70, None), (71, ""), (72, "a " * 90), (73, "x y " * 40), (74, "a " * 25), (75, text(width)), (76, out[3][1])]
    out += [out[5], out[5], (77, out[5][1]), (None, out[6][1]), (None, "z " * 50), (78, "é " + shared[4] + " \x1c" + shared[4])]
    return out


@pytest.mark.parametrize(("width", "seed"), [(20, 6), (4, 2)])
def test_documents(spark, width, seed):
    data = rows(width)
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 as c1", "2 as uid", "3 as spans")
    found = sorted(((r.id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.report(df, width=width, seed=seed).collect()), key=str)
    assert found == model(data, width)


def test_texts(spark):
    data = rows(20)
    df = spark.createDataFrame([(i, t, 5) for i, t in data], "doc_id long, text string, c1 int")
    out = substrings.remove_repeats(df)
    assert out.columns == df.columns
    digests = {(i, n, s) for i, n, _, s in model(data, 20)}
    got = [(r.doc_id, hashlib.sha256(" ".join(re.findall("[^\x20\x09-\x0d]+", r.text or "")).encode()).hexdigest()) for r in out.collect()]
    assert sorted(map(str, got)) == sorted(str((i, s)) for i, n, _, s in model(data, 20))
    assert digests


def test_copies_in_one_slice(spark):
    """Copies of a text must not hide that its passages also occur elsewhere."""
    rng = random.Random(8)
    text = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    data = []
    for i in range(40):
        shared = text(40)
        whole = text(10) + " " + shared + " " + text(10)
        data += [(100 + 3 * i, whole), (101 + 3 * i, whole), (102 + 3 * i, shared + " " + text(5))]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "doc_id long, text string").coalesce(1)
    found = sorted(((r.id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.report(df).collect()), key=str)
    assert found == model(data, 20)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.report(df).collect() == [] and substrings.remove_repeats(df).collect() == []
