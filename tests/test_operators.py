"""Operators on small fixtures, against stated results or brute force."""

import random

import pytest
from pyspark.sql import functions as F

from strandmill.functions import bases, formatting, names
from strandmill.operators import (
    alignment, blocked, chunking, delta, digest, intervals, jobs, matches, network, propagate,
    reconstruct, segments, sketch,
)
from strandmill.operators.spread import spread_join


def rows(df):
    return sorted(map(tuple, df.collect()))


# --- ordered operators ----------------------------------------------------------------


def test_running_matches_a_plain_scan(spark):
    rng = random.Random(1)
    data = [(rng.randrange(3), p, rng.randrange(9)) for p in rng.sample(range(500), 200)]
    df = spark.createDataFrame(data, "k long, p long, v long")
    got = blocked.running(df, ["k"], ["p"], blocked.block_of("p", 16),
                          {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "n": ("count", F.lit(1))})
    want = []
    for k, p, v in data:
        before = [w for kk, pp, w in data if kk == k and pp < p]
        want.append((k, p, v, sum(before), max(before, default=None), len(before)))
    key = lambda r: r[:2]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_following(spark):
    df = spark.createDataFrame([(1, p) for p in (0, 3, 90, 91)] + [(2, 5)], "k long, p long")
    got = blocked.following(df, ["k"], "p", blocked.block_of("p", 10), "n")
    assert {(r.k, r.p): r.n for r in got.collect()} == {
        (1, 0): 3, (1, 3): 90, (1, 90): 91, (1, 91): None, (2, 5): None}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_splits_hot_keys(spark, how):
    many = spark.createDataFrame([("hot", i) for i in range(50)] + [("b", 1), ("none", 2)], "k string, i long")
    one = spark.createDataFrame([("hot", 50, "x"), ("b", 1, "y")], "k string, n long, v string")
    got = spread_join(many, one, ["k"], "n", ["i"], how=how, hot_rows=7)
    want = many.join(one, "k", how)
    assert rows(got.select("k", "i", F.coalesce("v", F.lit("-")))) == rows(
        want.select("k", "i", F.coalesce("v", F.lit("-"))))


@pytest.mark.parametrize("size", [1, 2, 255, 256, 257, 65_537])
def test_ordered_root_is_one_definition(spark, size):
    import hashlib

    def up(parts):
        return [hashlib.sha256("".join(parts[i:i + 256]).encode()).hexdigest() for i in range(0, len(parts), 256)]

    df = spark.range(size).select(F.lit("g").alias("g"), F.col("id").alias("p"), F.concat(F.lit("t"), "id").alias("t"))
    nodes = [f"t{i}" for i in range(size)]
    for _ in range(digest.levels_for(256)):
        nodes = up(nodes)
    assert rows(digest.ordered_root(df, "g", "p", F.col("t"), fan=256)) == [("g", "sha256-tree:" + nodes[0])]


# --- index ------------------------------------------------------------------------------


def refs(spark, *items):
    m = spark.createDataFrame([(a, 0, i, h, n) for i, (h, n, a) in enumerate(items)],
                              "assembly string, chrom long, seg_idx long, hash string, length long")
    return m, segments.references(m)


def summarise(m, r):
    s = segments.summary(segments.refcounts(r), m).first()
    return (s.genomes, s.segments, s.core_bytes, s.partial_bytes, s.unique_bytes, s.stored_bytes, s.naive_bytes)


@pytest.mark.parametrize("genomes", [2, 3, 5])
def test_summary_of_random_genomes(spark, genomes):
    rng = random.Random(genomes)
    size = {f"h{i}": rng.randrange(1, 2000) for i in range(25)}
    own = {f"G{g}": [rng.choice(list(size)) for _ in range(12)] for g in range(genomes)}
    m, r = refs(spark, *[(h, size[h], g) for g, hs in own.items() for h in hs])
    count = {h: sum(h in hs for hs in own.values()) for h in size}
    total = lambda keep: sum(n for h, n in size.items() if keep(count[h]))
    assert summarise(m, r) == (
        genomes, sum(c > 0 for c in count.values()), total(lambda c: c == genomes), total(lambda c: 1 < c < genomes),
        total(lambda c: c == 1), total(lambda c: c > 0), sum(size[h] for hs in own.values() for h in set(hs)))
    alone = {g: {h for h in hs if count[h] == 1} for g, hs in own.items()}
    assert rows(segments.unique_per_genome(segments.refcounts(r), m)) == sorted((g, sum(size[h] for h in hs)) for g, hs in alone.items())
    assert rows(segments.delete_plan(segments.refcounts(r), r)) == sorted((g, len(alone[g]), len(set(hs) - alone[g])) for g, hs in own.items())


def test_single_genome_is_all_core(spark):
    m, r = refs(spark, ("x", 10, "A"), ("y", 5, "A"))
    assert summarise(m, r) == (1, 2, 15, 0, 0, 15, 15)
    assert rows(segments.unique_per_genome(segments.refcounts(r), m)) == [("A", 0)]


def test_remove_genome_and_insert(spark):
    _, r = refs(spark, ("s", 10, "A"), ("s", 10, "B"), ("a", 5, "A"))
    left = segments.refcounts(segments.remove_genome(r, "A"))
    assert rows(left.select("hash", "rc")) == [("s", 1)]
    batch = spark.createDataFrame([("n", 3), ("n", 3), ("s", 10)], "hash string, length long")
    assert rows(segments.insert_new(batch, r)) == [("n", 3)]


def test_coverage_counts(spark):
    m, r = refs(spark, ("h1", 5, "G"), ("h1", 5, "G"), ("h2", 5, "G"), ("h3", 5, "G"))
    held = spark.createDataFrame([("h1",), ("h1",)], "hash string")
    assert rows(segments.coverage(r, held)) == [("G", 1, 3)]
    assert rows(segments.chromosome_coverage(m, segments.refcounts(r), held)) == [("G", 0, 2, 4)]
    assert rows(segments.admission(r, held)) == [("G", 2, False)]


# --- reconstruction -----------------------------------------------------------------------


def test_assemble_and_missing(spark):
    m = spark.createDataFrame([("g", 1, 0, "a"), ("g", 1, 1, "b"), ("g", 1, 2, "a"), ("g", 2, 0, "zz")],
                              "assembly string, chrom long, seg_idx long, hash string")
    store = spark.createDataFrame([("a", "AC", 2), ("b", "GT", 1)], "hash string, data string, occurrences long")
    assert rows(reconstruct.assemble(m, store).select("chrom", "missing", F.coalesce("data", F.lit("?")))) == [
        (1, 0, "ACGTAC"), (2, 1, "?")]


def test_verify_is_positional(spark):
    schema = "assembly string, chrom long, hash string"
    a = spark.createDataFrame([("g", 1, "x"), ("g", 2, "y"), ("h", 5, "z")], schema)
    b = spark.createDataFrame([("g", 2, "y"), ("g", 3, "q"), ("h", 5, "z")], schema)
    assert rows(reconstruct.verify_positional(a, b)) == [("g", 2, 2, 2, 0, False), ("h", 1, 1, 0, 0, True)]


# --- alignments and intervals -------------------------------------------------------------

def walked_runs(ops, strand, t0, q0, q1, least):
    """Base by base: mark the matching pairs, then read off the unbroken diagonals."""
    t, q, pairs = t0, 0, []
    for n, c in ops:
        for _ in range(n):
            if c == "=":
                pairs.append((t, q))
            t += c in "=XD"
            q += c in "=XI"
    out, start = [], 0
    for i in range(1, len(pairs) + 1):
        if i == len(pairs) or (pairs[i][0] - pairs[i - 1][0], pairs[i][1] - pairs[i - 1][1]) != (1, 1):
            (a, x), (b, y) = pairs[start], pairs[i - 1]
            if b + 1 - a >= least:
                out.append((a, b + 1, q0 + x, q0 + y + 1) if strand == "+" else (a, b + 1, q1 - y - 1, q1 - x))
            start = i
    return sorted(out)


@pytest.mark.parametrize("strand", ["+", "-"])
@pytest.mark.parametrize("least", [1, 7, 30])
def test_exact_runs(spark, strand, least):
    rng = random.Random(f"{strand}{least}")
    table, want = [("q", "t", strand, 3, 90, 5, 60, "")], []
    for name in range(25):
        ops = [(rng.randrange(1, 40), rng.choice("===XID")) for _ in range(rng.randrange(1, 9))]
        t0, q0 = rng.randrange(500), rng.randrange(500)
        q1 = q0 + sum(n for n, c in ops if c in "=XI")
        t1 = t0 + sum(n for n, c in ops if c in "=XD")
        table.append((f"q{name}", "t", strand, t0, t1, q0, q1, "".join(f"{n}{c}" for n, c in ops)))
        want += [(f"q{name}", *r) for r in walked_runs(ops, strand, t0, q0, q1, least)]
    b = spark.createDataFrame(table, "query_name string, target_name string, strand string, target_start long,"
                                     "target_end long, query_start long, query_end long, cigar string")
    got = alignment.exact_runs(b, least).select("query_name", "target_start", "target_end", "query_start", "query_end")
    assert rows(got) == sorted(want)


@pytest.mark.parametrize("width", [4, 64, 65_536])
def test_merge_and_regions(spark, width):
    rng = random.Random(width)
    ivs = [(k, s, s + 1 + rng.randrange(12)) for k in (1, 2) for s in rng.sample(range(300), 30)]
    df = spark.createDataFrame(ivs, "key long, start long, end long")
    want = []
    for k in (1, 2):
        for _, s, e in sorted(i for i in ivs if i[0] == k):
            if want and want[-1][0] == k and s <= want[-1][2]:
                want[-1] = (k, want[-1][1], max(want[-1][2], e))
            else:
                want.append((k, s, e))
    merged = intervals.merge(df, "key", width=width)
    assert rows(merged) == sorted(want)
    cuts = [(k, rng.randrange(330)) for k in (1, 2) for _ in range(40)]
    cut_df = spark.createDataFrame(cuts + [(1, 0), (2, 320)], "key long, pos long")
    lengths = spark.createDataFrame([(1, 320), (2, 320)], "key long, length long")
    expect = []
    for k in (1, 2):
        pts = sorted({0, 320} | {p for kk, p in cuts if kk == k and 0 < p < 320})
        expect += [(k, a, b, any(m[0] == k and m[1] <= a and b <= m[2] for m in want))
                   for a, b in zip(pts, pts[1:])]
    assert rows(intervals.regions(cut_df, lengths, merged, "key", width)) == sorted(expect)


# --- sketches and chunks ------------------------------------------------------------------


def sim(spark, a, b):
    df = spark.createDataFrame([("a", a), ("b", b)], "g string, s string")
    sk = sketch.sketches(sketch.bottom_hashes(df, "g", "s"), "g")
    return sketch.against(sk.where("g = 'b'"), "g", sk.where("g = 'a'")).first()


def test_sketch_similarity(spark):
    rng = random.Random(7)
    a = "".join(rng.choice("ACGT") for _ in range(50_000))
    mutate = lambda s, p: "".join(rng.choice("ACGT") if rng.random() < p else c for c in s)
    flip = a[::-1].translate(str.maketrans("ACGT", "TGCA"))
    other = "".join(rng.choice("ACGT") for _ in range(50_000))
    near, far = sim(spark, a, mutate(a, 0.01)), sim(spark, a, mutate(a, 0.15))
    assert sim(spark, a, a).jaccard == 1.0 and sim(spark, a, flip).jaccard >= 0.99
    assert sim(spark, a, other).jaccard <= 0.01
    assert near.similarity >= 0.95 > far.similarity


def test_jaccard_model(spark):
    rng = random.Random(3)
    for size in (3, 8):
        a, b = (sorted(rng.sample(range(20), rng.randrange(0, size + 1))) for _ in range(2))
        k = min(size, len(a), len(b))
        low = sorted(set(a) | set(b))[:k]
        want = sum(x in a and x in b for x in low) / k if k else 0.0
        df = spark.createDataFrame([(a, b)], "a array<bigint>, b array<bigint>")
        assert df.select(sketch.jaccard(F.col("a"), F.col("b"), size)).first()[0] == want


@pytest.mark.parametrize("s,want", [(0.95, "delta"), (0.9499, "reindex"), (0.5, "reindex"), (0.4999, "skip")])
def test_strategy_thresholds(spark, s, want):
    assert spark.range(1).select(sketch.strategy(F.lit(s))).first()[0] == want


def test_chunks_rejoin(spark):
    text = "".join(random.Random(2).choice("ACGT") for _ in range(5000))
    df = spark.createDataFrame([("g", 1, text), ("g", 2, "")], "assembly string, chrom long, s string")
    got = chunking.chunks(df, ["assembly", "chrom"], "s", [(16, 64), (64, 256)]).orderBy("max_chunk", "seg_idx")
    for top in (64, 256):
        assert b"".join(bytes(r.data) for r in got.where(F.col("max_chunk") == top).collect()).decode() == text


# --- exact matches ------------------------------------------------------------------------


def all_matches(t, q, least):
    out = []
    for i in range(len(t)):
        for j in range(len(q)):
            if i and j and t[i - 1] == q[j - 1]:
                continue
            n = 0
            while i + n < len(t) and j + n < len(q) and t[i + n] == q[j + n]:
                n += 1
            if n >= least:
                out.append((i, i + n, j, j + n))
    return sorted(out)


def longest_matches(t, q, least):
    """Longest extension per query start, left-maximal, then none inside a longer one."""
    found = []
    for j in range(len(q)):
        n = 0
        while j + n < len(q) and q[j:j + n + 1] in t:
            n += 1
        if n >= least:
            for i in range(len(t) - n + 1):
                if t[i:i + n] == q[j:j + n] and not (i and j and t[i - 1] == q[j - 1]):
                    found.append((i, i + n, j, j + n))
    inside = lambda m, o: (o[0] <= m[0] and o[1] >= m[1] and o[2] <= m[2] and o[3] >= m[3]
                           and o[3] - o[2] > m[3] - m[2])
    return sorted(m for m in found if not any(inside(m, o) for o in found))


def test_matches_against_brute_force(spark):
    rng = random.Random(11)
    make = lambda n, abc: "".join(rng.choice(abc) for _ in range(n))
    ts = {i: make(60, "AB" if i % 2 else "ABCD") for i in range(6)}
    ts[6] = "ACGTTA" * 3 + "GG"
    qs = {i: make(40, "AB" if i % 2 else "ABCD") + ts[i % 7][10:40] for i in range(6)}
    qs[6] = "ACGTTA" * 2
    t = spark.createDataFrame(list(ts.items()), "target long, seq string")
    q = spark.createDataFrame(list(qs.items()), "query long, seq string")
    got = matches.find(t, q, 6)
    assert rows(got) == sorted((j, i, *m) for i in ts for j in qs for m in all_matches(ts[i], qs[j], 6))
    assert rows(matches.longest(got)) == sorted(
        (j, i, *m) for i in ts for j in qs for m in longest_matches(ts[i], qs[j], 6))


def test_verify_claims(spark):
    t = spark.createDataFrame([(1, "AACCGGTT")], "target long, seq string")
    q = spark.createDataFrame([(2, "CCGGnACCGG")], "query long, seq string")
    claims = [(2, 1, 2, 0, 4, "+"), (2, 1, 1, 0, 4, "+"), (2, 1, 2, 0, 4, "-"), (2, 1, 6, 0, 4, "+"),
              (2, 1, 2, 0, 0, "+"), (2, 9, 2, 0, 4, "+"), (2, 1, -1, 0, 2, "+")]
    c = spark.createDataFrame(claims, "query long, target long, t_start long, q_start long, length long, strand string")
    got = {tuple(r)[:6]: r.valid for r in matches.verify(c, t, q).collect()}
    assert [got[x] for x in claims] == [True, False, True, False, False, False, False]


# --- cuts ---------------------------------------------------------------------------------

PAIR = ("i_genome string, i_chrom string, i_start long, i_end long, j_genome string, j_chrom string,"
        "j_start long, j_end long, strand string")


def test_cuts_travel_through_three_genomes(spark):
    pairs = spark.createDataFrame(
        [("A", "1", 0, 100, "B", "1", 1000, 1100, "+"), ("B", "1", 1050, 1200, "C", "1", 0, 150, "+")], PAIR)
    cuts = spark.createDataFrame([("A", "1", 70), ("C", "1", 10), ("A", "1", 100)], "genome string, chrom string, pos long")
    got = rows(propagate.cut_propagation(cuts, pairs, width=64))
    assert got == [("A", "1", 60), ("A", "1", 70), ("A", "1", 100), ("B", "1", 1060), ("B", "1", 1070),
                   ("C", "1", 10), ("C", "1", 20)]


def test_cuts_mirror_on_the_reverse_strand(spark):
    pairs = spark.createDataFrame([("A", "1", 0, 100, "B", "1", 200, 300, "-")], PAIR)
    cuts = spark.createDataFrame([("A", "1", 30)], "genome string, chrom string, pos long")
    assert ("B", "1", 230) in rows(propagate.cut_propagation(cuts, pairs))
    assert ("B", "1", 270) in rows(propagate.cut_propagation(cuts, pairs, strand_aware=True))


# --- delta --------------------------------------------------------------------------------

def edited(rng, ref):
    """A query made from stretches of ``ref``, with its CIGAR over the aligned part and the bases in no stretch."""
    at, query, ops, extra = rng.randrange(5), "", [], 0
    first = at
    for _ in range(rng.randrange(1, 5)):
        n = rng.randrange(3, 9)
        query += ref[at:at + n]
        ops.append((n, "="))
        at += n
        kind, m = rng.choice("XID"), rng.randrange(1, 4)
        ops.append((m, kind))
        if kind in "XI":
            # never the reference's own base, so the walk finds no longer stretch
            query += "".join(rng.choice([b for b in "ACGT" if b != ref[at + i]]) for i in range(m))
            extra += m
        at += m if kind in "XD" else 0
    query += ref[at:at + 4]
    ops.append((4, "="))
    return first, query, "".join(f"{n}{c}" for n, c in ops), extra


@pytest.mark.parametrize("seed", range(6))
def test_delta(spark, seed):
    rng = random.Random(seed)
    ref = "".join(rng.choice("ACGT") for _ in range(80))
    first, middle, cigar, extra = edited(rng, ref)
    head, tail = ("".join(rng.choice("ACGT") for _ in range(rng.randrange(4))) for _ in range(2))
    query = head + middle + tail
    b = spark.createDataFrame([("q", len(head), len(head) + len(middle), "+", "r", first, cigar)] if seed else [],
                              "query_name string, query_start long, query_end long, strand string,"
                              "target_name string, target_start long, cigar string")
    r = spark.createDataFrame([("r", ref)], "target string, seq string")
    q = spark.createDataFrame([("q", query)], "query string, seq string")
    ops = delta.build(b, q)
    s = delta.summarise(ops).first()
    assert (s.total, s.literal) == (len(query), extra + len(head) + len(tail) if seed else len(query))
    assert delta.verified(delta.apply(ops, r), q).first().verified
    assert delta.apply(ops.where("type = 'copy'").withColumn("ref_chrom", F.lit("zz")), r).where("bad = 0").isEmpty()


BLOCKS = ("query_name string, query_start long, query_end long, strand string, target_name string,"
          "target_start long, cigar string")


def test_delta_takes_only_what_the_reference_has(spark):
    r = spark.createDataFrame([("r", "GATTACAGATTACA")], "target string, seq string")
    q = spark.createDataFrame([("q", "TTACAGATTACAGG"), ("none", "")], "query string, seq string")
    b = spark.createDataFrame([("q", 0, 14, "+", "r", 2, "10=2I2="), ("q", 0, 14, "+", "gone", 0, "14=")], BLOCKS)
    ops = delta.build(b, q, r)
    kinds = rows(ops.select("op_idx", "type", F.coalesce("ref_start", F.lit(-1)), F.coalesce("ref_end", F.lit(-1))))
    assert kinds == [(0, "copy", 2, 12), (1, "literal", -1, -1), (2, "copy", 12, 14)]
    late = delta.build(b.withColumn("target_start", F.lit(6).cast("long")), q, r)
    assert rows(late.select("type", F.col("bytes").cast("string"))) == [("literal", "TTACAGATTACAGG")]
    for made in (ops, late):
        got = {x.chrom: x.verified for x in delta.verified(delta.apply(made, r), q).collect()}
        assert got == {"q": made is late, "none": True}


def test_delta_refuses_another_reference(spark):
    r = spark.createDataFrame([("r", "GATTACA"), ("s", "CCC")], "target string, seq string")
    ops = delta.build(spark.createDataFrame([], BLOCKS), spark.createDataFrame([("q", "AC")], "query string, seq string"), r)
    digest_of = delta.reference_digest(r)
    assert delta.apply(ops, r, digest_of).first().bad == 0
    with pytest.raises(delta.ReferenceMismatch):
        delta.apply(ops, r.where("target = 'r'"), digest_of)


def test_roots_of_named_chromosomes(spark):
    names_ = ["chr1", "chr10", "chr2", "chrM", "Z", "z", "é", ""]
    df = spark.createDataFrame([("g", n, 0, f"h{i}") for i, n in enumerate(names_)], "assembly string, chrom string, seg_idx long, hash string")
    one = reconstruct.segments_root(df).first().segments_root
    assert one == reconstruct.segments_root(df.repartition(5)).first().segments_root
    place = {r.chrom: r.chrom_idx for r in reconstruct.chrom_index(df.select("assembly", "chrom")).collect()}
    assert sorted(names_, key=place.get) == sorted(names_)


# --- network ------------------------------------------------------------------------------


def test_members(spark):
    log = [("n1", "signup", 0), ("n2", "signup", 5), ("n1", "error", 10), ("n3", "view", 11),
           ("n2", "view", 20), ("n4", "signup", 1), ("n4", "error", 2), ("n4", "signup", 3)]
    df = spark.createDataFrame([(n, op, t * 10**6, i, 7) for i, (n, op, t) in enumerate(log)],
                               "node string, op string, us long, seq long, content long")
    got = network.members(network.node_facts(df), F.lit(100 * 10**6), 90 * 10**6)
    assert rows(got.select("node", "age_s", "online")) == [("n2", 80, True), ("n4", 97, False)]


def test_first_completion_after_the_claim_counts(spark):
    j = spark.createDataFrame([(1, 0, 50, "claimed", "w")], "job long, queued_at long, claimed_at long, state string, worker string")
    said = [(1, "w", "complete", 40, 1, 1), (1, "w", "heartbeat", 60, 0, 0), (1, "w", "complete", 70, 5, 4),
            (1, "w", "heartbeat", 75, 0, 0), (1, "w", "complete", 80, 7, 7), (1, "v", "complete", 55, 9, 9)]
    rep = spark.createDataFrame(said, "job long, worker string, kind string, at long, found long, valid long")
    got = jobs.report(j, rep).select("state", "claimed_at", "found", "valid")
    assert rows(got) == [("done", 60, 5, 4)]
    early = jobs.report(j, rep.where("at < 50")).select("state", "claimed_at", F.coalesce("found", F.lit(-1)))
    assert rows(early) == [("claimed", 50, -1)]


def test_rates_keep_every_cent(spark):
    log = spark.createDataFrame([("click", 0, 0.29), ("click", 1_000_000, 0.58)], "op string, us long, bytes double")
    got = rows(network.request_rate(log, 10_000_000).select("us", "bytes_per_s"))
    assert got == [(0, 0.029), (1_000_000, 0.087)]


def test_job_lifecycle(spark):
    j = spark.createDataFrame([(1, 10, None, "pending", None), (2, 5, None, "pending", None),
                               (3, 1, 100, "claimed", "w1"), (4, 1, 10, "claimed", "w2")],
                              "job long, queued_at long, claimed_at long, state string, worker string")
    assert rows(jobs.claim(j, 1)) == [(2, "worker-1")]
    back = jobs.reclaim(j, F.lit(150), F.lit(60))
    assert rows(back.where("job > 2").select("job", "state", F.coalesce("worker", F.lit("-")))) == [
        (3, "claimed", "w1"), (4, "pending", "-")]
    rep = spark.createDataFrame([(3, "w9", "complete", 120, 10, 9), (4, "w2", "complete", 120, 10, 9)],
                                "job long, worker string, kind string, at long, found long, valid long")
    done = jobs.report(j, rep)
    assert rows(done.where("job > 2").select("job", "state", F.coalesce("valid", F.lit(-1)))) == [
        (3, "claimed", -1), (4, "done", 9)]


# --- functions ----------------------------------------------------------------------------


def test_sizes_print_like_printf(spark):
    rng = random.Random(4)
    ns = [0, 1, 999, 1000, 1023, 1024, 1050, 1150, 3450, 1_050_000, 1_550_000, 2**20, 2**40] + [
        rng.randrange(10**k) for k in range(1, 13) for _ in range(20)]
    df = spark.createDataFrame([(n,) for n in ns], "n long")
    n = F.col("n")
    for r in df.select(n, formatting.bytes_short(n).alias("b"), formatting.base_pairs(n).alias("p")).collect():
        want = f"{r.n/2**20:.1f} MB" if r.n >= 2**20 else f"{r.n/1024:.1f} KB" if r.n >= 1024 else f"{r.n} B"
        pair = (f"{r.n/1e6:.1f} Mbp" if r.n >= 10**6 else f"{r.n/1e3:.1f} Kbp" if r.n >= 1000 else f"{r.n} bp")
        assert (r.b, r.p) == (want, pair)


def test_small_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(bases.reverse_complement(bases.byte_string(F.lit("acGTné")))) == "NNNACGT"
    assert get(formatting.parse_bytes(F.lit("50GB"))) == 50 * 10**9
    assert get(formatting.parse_bytes(F.lit("4 KiB"))) == 4096
    assert get(formatting.age(F.lit(3605))) == "1h0m5s"
    assert get(formatting.progress_bar(F.lit(3), F.lit(6), 4)) == "▓▓░░"
    assert get(network.attribute_path(F.lit("/genomes/A1/manifest"))) == "A1"
    assert get(network.attribute_path(F.lit("/deltas/B"))) == "B"


def test_names_and_priorities(spark):
    df = spark.createDataFrame([("a:/x:y",), (":p",), ("n:",), ("plain",)], "s string")
    got = df.select(names.name_and_path(F.col("s")).alias("n")).collect()
    assert [tuple(r.n) if r.n else None for r in got] == [("a", "/x:y"), None, None, None]
    c = spark.createDataFrame([("k", 2, "remote"), ("k", 1, "local"), ("j", 3, "x")], "k string, r long, v string")
    assert rows(network.by_priority(c, "k", "r")) == [("j", 3, "x"), ("k", 1, "local")]
    assert rows(network.last_by_name(c, "k", "r")) == [("j", 3, "x"), ("k", 2, "remote")]
    a = spark.createDataFrame([("http://a/", 0), ("", 1), ("http://b", 2), ("http://a", 3)], "address string, place long")
    assert rows(network.merge_addresses(a)) == [("http://a", 0), ("http://b", 2)]


def test_top_k_is_cut_before_the_shuffle(spark):
    df = spark.createDataFrame([("g", "ACGTACGT" * 10)], "g string, s string")
    plan = sketch.bottom_hashes(df, "g", "s")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan.split("WindowGroupLimit", 1)[1]
