"""Contamination against a brute-force model."""

import random
import re

from strandmill.llm import decontaminate

PATTERN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return PATTERN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def model(docs, items):
    out = []
    for i, text in docs:
        words, hit, found = words_of(text), set(), set()
        for item, t in items:
            own = words_of(t)
            size = min(13, len(own))
            wins = {tuple(own[a : a + size]) for a in range(len(own) - size + 1)} if own else set()
            for a in range(len(words) - size + 1):
                if size and tuple(words[a : a + size]) in wins:
                    hit |= set(range(a, a + size))
                    found.add("" if item is None else str(item))
        out.append((i, len(words), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(words)))
    return sorted(out, key=str)


def run(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item", "text as words", "doc_id as hash")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as size")
    found = decontaminate.contamination(d, b).collect()
    return sorted(((r.id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in found), key=str)


def cases():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(30)] + ["é1", "Über", "THE", "x9"]
    text = lambda n: " ".join(rng.choice(vocab) + rng.choice(["", "", ",", "."]) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 3, 5, 12, 13, 14, 30, 60]))) for i in range(25)]
    items += [(90, None), (91, ""), (92, "a " * 40), (93, "a b " * 20), (94, items[8][1]), (None, items[9][1]), (8, text(20)), (10, "?!")]
    docs = []
    for i in range(60):
        parts = [text(rng.randrange(0, 50))]
        for _ in range(rng.randrange(3)):
            own = words_of(rng.choice(items)[1])
            lo = rng.randrange(len(own) + 1)
            parts += ["; ".join(own[lo : lo + rng.randrange(8, 40)]).upper(), text(rng.randrange(30))]
        docs.append((i, " ".join(parts)))
    docs += [(70, None), (71, ""), (72, "a " * 3000), (73, "b a " * 30), docs[3], docs[3], (3, text(9)), (None, docs[5][1]), (None, None)]
    return docs, items


def test_documents(spark):
    docs, items = cases()
    assert run(spark, docs, items) == model(docs, items)


def test_empty_tables(spark):
    docs, items = cases()
    assert run(spark, [], items) == []
    assert run(spark, docs[:5], []) == model(docs[:5], [])
