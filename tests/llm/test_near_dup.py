"""SimHash groups against a brute-force model."""

import random
import re

import pytest
import xxhash

from strandmill.llm import near_dup, similar


def model(rows):
    def fp(text):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = [w for w in re.split("[\x20\x09-\x0d]+", low) if w]
        if not words:
            return 0
        runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
        hs = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
        return sum((2 * sum(h >> b & 1 for h in hs) > len(hs)) << b for b in range(64))

    return [(i, fp(t)) for i, t in rows]


def groups(prints, bits=2):
    values = sorted({f for _, f in prints})
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in values:
        for b in values:
            if a < b and bin(a ^ b).count("1") <= bits:
                root[find(a)] = find(b)
    least = {}
    for i, f in prints:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return sorted(((i, f, least.get(find(f))) for i, f in prints), key=str)


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, key int")
    return sorted(((r.doc_id, r.fp % 2**64, r.component) for r in near_dup.near_duplicates(df).collect()), key=str)


def test_documents(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choice(["The", "of", "thing", "x", "é"]) + str(rng.randrange(40)) for _ in range(60)) for _ in range(12)]
    rows = [(n, t) for n, t in enumerate(base)]
    for n in range(60):
        words = base[n % 5].split()
        words[rng.randrange(60)] = "new"
        rows.append((100 + n, " \t ".join(words)))
    rows += [(7, None), (900, ""), (901, " \n "), (902, "One"), (903, "one"), (None, "one"), (3, base[3]), (3, base[3])]
    rows += [(905, "w " * 30000)]
    assert run(spark, [(i, t, "x", 1) for i, t in rows]) == groups(model(rows))


def test_empty(spark):
    assert run(spark, []) == []


def linked(spark, values, bucket):
    nodes = spark.createDataFrame([(v - 2**64 if v >= 2**63 else v,) for v in values], "fp long")
    found = near_dup.components(near_dup.links(nodes, bucket=bucket))
    root = {r.fp: r.root for r in found.collect()}
    parts = {}
    for v in values:
        s = v - 2**64 if v >= 2**63 else v
        parts.setdefault(root.get(s, s), set()).add(v)
    return sorted(map(sorted, parts.values()))


def test_links_of_full_and_small_buckets(spark):
    rng = random.Random(9)
    values = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        values |= {centre} | {centre ^ (1 << a) ^ (1 << b) ^ (1 << c) for a, b, c in
                              ([rng.randrange(64) for _ in range(3)] for _ in range(40))}
    values |= {rng.getrandbits(64) for _ in range(50)} | {0, 2**64 - 1, 2**63, 1}
    parts = {}
    for i, _, c in groups(list(zip(range(len(values)), sorted(values), strict=True))):
        parts.setdefault(c, []).append(sorted(values)[i])
    expected = sorted(map(sorted, parts.values()))
    assert linked(spark, sorted(values), 24) == expected
    assert linked(spark, sorted(values), 2) == expected


@pytest.mark.parametrize("keep", [near_dup.keep_one, similar.keep_one])
def test_kept_rows_are_found_without_reading_texts_again(spark, keep):
    """Rows come back by id and text hash: no Python over the texts after the groups are known."""
    far = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcdef"]
    rows = [(5, far[0]), (4, far[0]), (4, far[0]), (4, far[1]), (None, far[2]), (None, far[3]), (None, far[3]), (6, None), (7, ""), (None, far[4]), (0, far[4]), (None, far[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as fp", "1 as node").repartition(3)
    got = keep(docs)
    assert got.columns == docs.columns
    want = {(4, far[0]), (4, far[1]), (None, far[2]), (None, far[3]), (0, far[4]), (None, far[5])}
    found = [(r.doc_id, r.text) for r in got.collect()]
    assert {r for r in found if r[1]} == want
    empty = [r for r in found if not r[1]]  # null and empty are one fingerprint, and one text without words
    assert empty == [(6, None)] and len(found) == len(want) + 1
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in plan and "MapInArrow" not in plan
