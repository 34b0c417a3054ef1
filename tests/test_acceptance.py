"""End to end: genomes that share some chromosomes, coverage, re-cutting and deltas."""

import random

from pyspark.sql import functions as F

from strandmill.operators import chunking, delta, intervals, matches, propagate, reindex, segments
from strandmill.sources import fasta


def test_coverage_of_each_holder(spark, tmp_path):
    rng = random.Random(31)
    pool = ["".join(rng.choices("ACGT", k=rng.randrange(70_000, 90_000))) for _ in range(7)]
    plan = {"plum": [0, 1, 2], "fig": [2, 3], "pear": [1, 2, 4, 5], "kiwi": [6]}
    for name, chroms in plan.items():
        text = "".join(f">{name}.{c} made up\n" + "\n".join(pool[c][j:j + 77] for j in range(0, len(pool[c]), 77)) + "\n" for c in chroms)
        (tmp_path / f"{name}.fa").write_text(text)
    parts = chunking.chunks(fasta.read_fasta(spark, str(tmp_path)), ["assembly", "chrom"], "seq")
    refs = segments.references(parts)
    for holder, own in plan.items():
        seen = segments.coverage(refs, parts.where(F.col("assembly") == holder).select("hash")).collect()
        assert {r.assembly: r.have == r.total for r in seen} == {g: set(cs) <= set(own) for g, cs in plan.items()}
        assert {r.assembly for r in seen if r.have} == {g for g, cs in plan.items() if set(cs) & set(own)}


def test_reindex_makes_shared_stretches_equal(spark):
    rng = random.Random(1)
    shared = "".join(rng.choices("ACGT", k=3_000))
    a = "".join(rng.choices("ACGT", k=1_111)) + shared
    b = "".join(rng.choices("ACGT", k=777)) + shared + "".join(rng.choices("ACGT", k=50))
    t = spark.createDataFrame([("a", a)], "target string, seq string")
    q = spark.createDataFrame([("b", b)], "query string, seq string")
    mems = matches.find(t, q, 200)
    pairs = mems.select(
        F.lit("A").alias("i_genome"), F.col("target").alias("i_chrom"), F.col("t_start").alias("i_start"),
        F.col("t_end").alias("i_end"), F.lit("B").alias("j_genome"), F.col("query").alias("j_chrom"),
        F.col("q_start").alias("j_start"), F.col("q_end").alias("j_end"))
    sides = [pairs.select(F.col(f"{s}_genome").alias("genome"), F.col(f"{s}_chrom").alias("chrom"),
                          F.col(f"{s}_start").alias("start"), F.col(f"{s}_end").alias("end")) for s in "ij"]
    cover = sides[0].unionByName(sides[1])
    cuts = propagate.cut_propagation(
        cover.select("genome", "chrom", F.explode(F.array("start", "end")).alias("pos")), pairs)
    lengths = spark.createDataFrame([("a", len(a)), ("b", len(b))], "chrom string, length long")
    regions = intervals.regions(cuts, lengths, intervals.merge(cover, "chrom"), "chrom")
    chroms = spark.createDataFrame([("A", "a", a), ("B", "b", b)], "assembly string, chrom string, seq string")
    segs = reindex.rechunk(chroms, regions, (64, 256))
    both = [{r.hash for r in segs.where(F.col("chrom") == c).where("shared").collect()} for c in "ab"]
    assert both[0] == both[1] and len(both[0]) > 5
    assert segs.groupBy("chrom").agg(F.sum("length").alias("n")).orderBy("chrom").collect()[0].n == len(a)


def test_a_mutated_genome_is_a_small_delta(spark):
    rng = random.Random(8)
    ref = "".join(rng.choices("ACGT", k=5_000))
    near = list(ref)
    for i in range(100, 5_000, 400):
        near[i] = "ACGT"[("ACGT".index(near[i]) + 1) % 4]
    q = spark.createDataFrame([("q", "".join(near))], "query string, seq string")
    t = spark.createDataFrame([("r", ref)], "target string, seq string")
    ops = delta.build(matches.chain(matches.find(t, q, 64), 8), q)
    s = delta.summarise(ops).first()
    assert s.literal == 13 and s.total == 5_000
    assert delta.verified(delta.apply(ops, t), q).first().verified
