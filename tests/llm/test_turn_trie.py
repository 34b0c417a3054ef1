"""The z-fast trie against a dictionary of all prefixes."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from strandmill.llm import turn_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns[c].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in turns.items()}
    full = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(c / 20) * 20
        full[c] = tuple(own.get(c - base, [])[:h] + own[c][h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, seq in full.items():
        ends[seq].append(c)
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for key in members:
        if key:
            children[key[:-1]] += 1
    for key in members:
        words = len(re.findall(r"[^\x20\x09-\x0D]+", key[-1][1])) if key else 0
        for d in range(len(key) + 1):
            leaves[key[:d]] += not children[key]
            saved[key[:d]] += (len(members[key]) - 1) * words
    return sorted(
        ((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k],
          hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()) for k, m in members.items()), key=str)


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"name": F.lit(1), "depth": F.lit("x"), "a": F.lit(None).cast("int")})
    got = [(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)
           for r in turn_trie.prefix_nodes(df).collect()]
    assert sorted(got, key=str) == plain(rows)


def shapes():
    rng = random.Random(3)
    say = lambda: (rng.choice(["user", "system", None]), rng.choice(["a b", "c", "", None, "d e  f", "g h i"]))
    random_ = [(c, t, *say()) for c in range(-30, 60) for t in range(rng.randrange(1, 7)) if rng.random() < 0.8]
    chain = [(20 * c, t, "u", f"w{t} x") for c in range(12) for t in range(3 * c + 1)]
    caterpillar = [(20 * c, t, "u", f"w{t}" if t < c else f"off {c}") for c in range(25) for t in range(c + 1)]
    copies = [(20 * c, t, "u", "same words") for c in range(40) for t in range(5)] + [(20 * c, 0, "v", "other") for c in range(50, 60)]
    odd = [(1, None, None, None), (1, None, None, None), (1, 2, "a", "b"), (1, 2, "a", "b"), (1, 2, "", "ab"), (None, 1, "a", "b"),
           (7, 5, "x", "y"), (45, 1, "z", "q"), (41, 0, "z", "q"), (2, 9, "long", "word " * 3000)]
    long_ = [(0, t, "u", str(t)) for t in range(700)] + [(20, t, "u", str(t)) for t in range(650)] + [(40, t, "u", str(t if t < 300 else -t)) for t in range(600)]
    return {"random": random_, "chain": chain, "caterpillar": caterpillar, "copies": copies, "odd": odd, "long": long_}


def test_shapes(spark, monkeypatch):
    """All shapes at once, each in its own range of ids."""
    monkeypatch.setattr(turn_trie, "RUN", 64)
    rows = [(None if c is None else c + 100_000 * n, *rest) for n, shape in enumerate(shapes().values()) for c, *rest in shape]
    # Conversation ``lone`` loses its own first turns and has no base, so it has none at all.
    lone = next(c for c in range(900_001, 900_020) if zlib.crc32(str(c).encode()) % 4 == 3)
    check(spark, [*rows, (lone, 0, "a", "b"), (lone, 1, "a", "b"), *((c - 50, *rest) for c, *rest in shapes()["random"])])


def test_empty(spark):
    check(spark, [])


def test_fattest(spark):
    for low in range(0, 40):
        pairs = [(low, high) for high in range(low + 1, 70)]
        got = spark.createDataFrame(pairs, "lo long, hi long").select("lo", "hi", turn_trie.fattest(F.col("lo"), F.col("hi")).alias("f")).collect() if low % 13 == 0 else []
        for r in got:
            assert r.f == max(range(r.lo + 1, r.hi + 1), key=lambda n: n & -n)
