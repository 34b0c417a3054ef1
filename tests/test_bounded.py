"""Work that is handed on in small parts, read once, or read by few tasks."""

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from strandmill.functions import bases, batches, kernels
from strandmill.operators import alignment, blocked, chunking, intervals, matches, sketch
from strandmill.sources import fasta_parts, snapshots


def letters(rng, n):
    return "".join(rng.choices("ACGTN", [24, 24, 24, 24, 1], k=n))


def test_kmers_of_rows_walked_together():
    rng = random.Random(5)
    rows = [letters(rng, n).encode() for n in (0, 20, 21, 22, 400, 3000, 90, 0, 5000)]
    for piece in (16, 300, 1 << 17):
        got = [[] for _ in rows]
        for row, hashes in kernels.row_kmers(rows, 21, piece):
            assert len(hashes) <= piece + 21
            got[row] += hashes.tolist()
        assert got == [kernels.canonical_kmers(s, 21).tolist() for s in rows]


def test_smallest_of_many_and_of_repeats():
    rng = np.random.default_rng(2)
    for high in (3, 40, 10**6):
        values = rng.integers(0, high, 5000).astype(np.uint64)
        for size in (1, 2, 30, 1000):
            assert kernels.smallest(values, size).tolist() == sorted(set(values.tolist()))[:size]


def test_groups_are_handed_on_early(spark, monkeypatch):
    """Tasks that hand groups on after every slice still give each group's smallest hashes."""
    rng = random.Random(6)
    rows = [(i % 7, letters(rng, 300)) for i in range(60)] + [(None, letters(rng, 100)), (3, None)]
    monkeypatch.setattr(sketch, "HELD_HASHES", 0)
    got = {}
    for r in sketch.bottom_hashes(spark.createDataFrame(rows, "g long, s string").coalesce(2), "g", "s", 11, 40).collect():
        got.setdefault(r.g, []).append((r["rank"], (r.h + 2**63) % 2**64))
    want = {}
    for g, s in rows:
        want.setdefault(g, set()).update(kernels.canonical_kmers((s or "").encode(), 11).tolist())
    assert {g: [h for _, h in sorted(v)] for g, v in got.items()} == {g: sorted(v)[:40] for g, v in want.items()}


def test_bases_of_text(spark):
    texts = ["a\nb", "", "\n", None, "é漢\n\nx"]
    want = [None if t is None else "N".join("".join("ACGT"[int(d, 16) % 4] for d in line.encode().hex()) for line in t.split("\n")) for t in texts]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", bases.bases_of("t").alias("b")).collect()
    assert [r.b for r in sorted(rows)] == want


def test_slices_hold_few_bytes():
    batch = pa.record_batch([pa.array(range(7)), pa.array([b"x" * 10, None, b"", b"y" * 50, b"z", b"z" * 9, b"w" * 10])], ["i", "s"])
    parts = list(batches.by_bytes(batch, 1, 20))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch])) and len(parts) == 2
    assert list(batches.by_bytes(batch.slice(0, 0), 1)) == []


def run_here(monkeypatch, frame, call):
    """The batches that the function handed to ``mapInArrow`` gives for one batch of rows."""
    taken = []
    monkeypatch.setattr(type(frame), "mapInArrow", lambda self, f, schema: taken.append(f) or self.limit(0))
    try:
        call()
    except Exception:  # noqa: BLE001  what follows the function has no rows of its schema
        assert taken
    return taken[0]


def test_chunks_of_a_batch_leave_in_slices(spark, monkeypatch):
    rng = random.Random(3)
    texts = [letters(rng, 400_000).encode() for _ in range(6)]
    frame = spark.createDataFrame([(1, "a")], "k long, s string")
    split = run_here(monkeypatch, frame, lambda: chunking.chunks(frame, ["k"], "s", [(64, 1024)]))
    out = list(split([pa.record_batch([pa.array(range(6)), pa.array(texts)], ["k", "s"])]))
    assert len(out) > 1 and max(b.nbytes for b in out) < 2 << 20
    joined = {}
    for b in out:
        for row in b.to_pylist():
            joined[row["k"]] = joined.get(row["k"], b"") + row["data"]
    assert [joined[k] for k in range(6)] == texts


def test_seeds_of_a_batch_leave_in_slices(spark, monkeypatch):
    rng = random.Random(4)
    texts = [letters(rng, 400_000).encode() for _ in range(6)]
    frame = spark.createDataFrame([(1, "a")], "query long, seq string")
    pick = run_here(monkeypatch, frame, lambda: matches._seeds(frame, "query", 16, 17))
    out = list(pick([pa.record_batch([pa.array(range(6)), pa.array(texts)], ["query", "seq"])]))
    whole = [kernels.seed_rows(t, 16, 17)[0] for t in texts]
    assert max(b.num_rows for b in out) <= 150_000
    assert [h for b in out for h in b.column("h").to_pylist()] == np.concatenate(whole)[:, 0].tolist()


def test_paf_lines_are_read_once(spark):
    """A filter on parsed fields reads the line once, not again for each field it names."""
    line = "q\t10\t1\t9\t+\tt\t20\t3\t4\t5\t8\t60\tdv:f:0.1\tcg:Z:3=\tdv:f:x"
    rows = [(line,), (line + "\r",), (line[:20],), (None,), (line + "\tcg:Z:\tdv:f:.5e1",), (line.replace("\t8\t", "\t99999999999999999999\t"),)]
    found = alignment.parse_paf(spark.createDataFrame(rows, "v string").selectExpr("concat(v, '') as value"))
    kept = found.where(alignment.passes(6, 0.1))
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"concat\(", plan)) <= 1 and plan.count("split(") == 1
    got = sorted((r.block_len, r.identity, r.cigar) for r in found.collect())
    assert got == [(0, 0.9, "3="), (8, -4.0, ""), (8, 0.9, "3="), (8, 0.9, "3=")]
    assert len(kept.collect()) == 2


def test_small_ranges_share_a_task(tmp_path):
    (tmp_path / "a.fa").write_bytes(b">x one\nACGT\n" + b"ACGTA\n" * 200)
    (tmp_path / "b.fa").write_bytes(b">y\n" + b"GG\n" * 100)
    reader = fasta_parts._Reader({"path": str(tmp_path), "range": "10", "tasks": "3"})
    tasks = reader.partitions()
    assert 3 <= len(tasks) <= 5
    ranges = [r for t in tasks for r in t.ranges]
    assert all(r.high - r.low <= 10 for r in ranges) and sum(r.high - r.low for r in ranges) == sum(f.stat().st_size for f in tmp_path.iterdir())


def test_intervals_over_more_tasks(spark):
    """Dealt over any number of tasks, intervals and regions are the same."""
    rng = random.Random(9)
    rows = [(rng.randrange(4), a, a + rng.randrange(1, 9)) for a in (rng.randrange(900) for _ in range(300))] + [(None, 1, 2), (1, 5, None)]
    ivs = spark.createDataFrame(rows, "key long, start long, end long")
    cuts = ivs.selectExpr("key", "explode(array(start, end)) as pos").where("key is not null and pos is not null")
    lengths = cuts.groupBy("key").agg(F.max("pos").alias("length"))
    plain, many = (intervals.merge(ivs, "key", width=50, tasks=t) for t in (None, 7))
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, many.collect()))
    first, second = (intervals.regions(cuts, lengths, m, "key", 50, tasks=t) for m, t in ((plain, None), (many, 7)))
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, second.collect()))


def test_tasks_follow_rows(spark, monkeypatch):
    monkeypatch.setattr(blocked, "TASK_ROWS", 10)
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert blocked.tasks_of(spark.range(5)) == usual and blocked.tasks_of(spark.range(995)) == 100


def test_known_bytes_do_not_travel(spark, tmp_path, monkeypatch):
    """An import of what the store has cuts sequences once: their bytes are not asked for again."""
    rng = random.Random(10)
    rows = [("a" if i % 2 else "b", "o", i, str(i), letters(rng, 3000)) for i in range(6)]
    docs = spark.createDataFrame(rows, "assembly string, organism string, chrom_idx long, chrom string, seq string")
    one = snapshots.import_genomes(spark, str(tmp_path), docs, (64, 1024))
    asked = []
    real = type(docs).groupBy
    monkeypatch.setattr(type(docs), "groupBy", lambda self, *c: asked.append(self.columns) or real(self, *c))
    two = snapshots.import_genomes(spark, str(tmp_path), docs, (64, 1024))
    assert two.number == one.number == 1 and not any("data" in c for c in asked)
    more = docs.unionByName(spark.createDataFrame([("c", "o", 9, "9", letters(rng, 3000) + rows[0][4])], docs.schema))
    three = snapshots.import_genomes(spark, str(tmp_path), more, (64, 1024))
    assert three.number == 2 and three.store().count() == three.store().select("hash").distinct().count()
    assert {r.hash for r in three.manifest().collect()} == {r.hash for r in three.store().collect()}
