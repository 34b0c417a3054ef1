import json
import random

import pytest
from pyspark.sql import functions as F

from strandmill.sources import deltas, documents, fasta


def test_fasta_parse(spark, tmp_path):
    p = tmp_path / "g1.fa"
    p.write_text("junk\nACGT\n>chr1 first one\nacgt  \r\nTTTT\n>chr2\tx\nGG GG\n\n>empty\n>chr3\nAC")
    rows = fasta.read_fasta(spark, str(p)).orderBy("chrom_idx").collect()
    assert [(r.assembly, r.chrom, r.seq) for r in rows] == [
        ("g1", "chr1", "ACGTTTTT"), ("g1", "chr2", "GG GG"), ("g1", "empty", ""), ("g1", "chr3", "AC"),
    ]


def test_fasta_splits_and_round_trip(spark, tmp_path):
    seqs = [(f"c{i}", "ACGT" * (i % 70)) for i in range(500)]
    df = spark.createDataFrame([("g", i, n, s) for i, (n, s) in enumerate(seqs)],
                               "assembly string, chrom_idx long, chrom string, seq string")
    fasta.write_fasta(df, str(tmp_path / "out"))
    parts = sorted((tmp_path / "out" / "assembly=g").glob("part-*.txt"))
    text = "".join(p.read_text() for p in parts)
    assert max(map(len, text.splitlines())) == 60
    one = tmp_path / "g.fa"
    one.write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = fasta.read_fasta(spark, str(one)).orderBy("chrom_idx").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r.chrom, r.seq) for r in got] == seqs


def _manifest(assembly):
    return {
        "version": 1, "assembly": assembly, "organism": "o", "unknown": 1,
        "chromosomes": [
            {"name": "chr1", "length": 100, "hash": "sha256:c1",
             "segments": [{"hash": "sha256:a", "length": 60}, {"hash": "sha256:b", "length": 40}]},
            {"name": "chr2", "length": 80, "hash": "sha256:c2",
             "segments": [{"hash": "sha256:d", "length": 80}]},
        ],
    }


def test_manifest_documents(spark, tmp_path):
    (tmp_path / "x.manifest.json").write_text(json.dumps(_manifest("X"), indent=2))
    m = documents.read_manifests(spark, str(tmp_path))
    rows = m.orderBy("chrom_idx", "seg_idx").collect()
    assert [(r.chrom, r.seg_idx, r.hash, r.length) for r in rows] == [
        ("chr1", 0, "sha256:a", 60), ("chr1", 1, "sha256:b", 40), ("chr2", 0, "sha256:d", 80)]
    documents.write_manifests(m, str(tmp_path / "lines"))
    back = documents.read_manifest_lines(spark, str(tmp_path / "lines"))
    cols = ["assembly", "organism", "chrom_idx", "chrom", "chrom_hash", "seg_idx", "hash", "length"]
    assert sorted(map(tuple, back.select(cols).collect())) == sorted(map(tuple, m.select(cols).collect()))


def test_catalog(spark, tmp_path):
    (tmp_path / "a.manifest.json").write_text(json.dumps(_manifest("X")))
    (tmp_path / "b.manifest.json").write_text(json.dumps(_manifest("X")))
    (tmp_path / "r.deltarecipe.json").write_text(json.dumps(
        {"assembly": "X", "reference": "R", "total_size": 3, "chunks": [{"hash": "sha256:z", "length": 3}]}))
    (tmp_path / "note.json").write_text(json.dumps({"assembly": "N"}))
    c = documents.scan_catalog(spark, str(tmp_path))
    got = {(r.assembly, r.kind): r.path.rsplit("/", 1)[1] for r in c.collect()}
    assert got == {("X", "manifest"): "b.manifest.json", ("X", "recipe"): "r.deltarecipe.json"}
    left = documents.unseed(c, "X").collect()
    assert [r.kind for r in left] == ["recipe"]
    rec = documents.read_recipes(spark, str(tmp_path / "r.deltarecipe.json")).collect()
    assert [(r.chunk_idx, r.hash, r.length) for r in rec] == [(0, "z", 3)]


def test_sketch_and_activity_files(spark, tmp_path):
    df = spark.createDataFrame([("A", [-(2**63), 5, 2**63 - 1])], "assembly string, hashes array<bigint>")
    documents.write_sketches(df, str(tmp_path / "sk"), 21, 1000)
    text = "".join(p.read_text() for p in (tmp_path / "sk").glob("part-*"))
    assert str(2**64 - 1) in text
    assert documents.read_sketches(spark, str(tmp_path / "sk")).first().hashes == [-(2**63), 5, 2**63 - 1]
    log = tmp_path / "log.jsonl"
    log.write_text('{"op":"import","assembly":"A","bytes":5}\n\nnot json\n{"op":"publish","assembly":"B"}\n')
    rows = documents.read_activity(spark, str(log))
    assert sorted(r.op for r in rows.collect()) == ["import", "publish"]
    documents.append_activity(rows, str(tmp_path / "log2"))
    assert documents.read_activity(spark, str(tmp_path / "log2")).where("time is null").count() == 0


def test_paf(spark, tmp_path):
    rng = random.Random(21)
    lines, want = [], []
    for i in range(12):
        span = rng.randrange(50, 900)
        same = rng.randrange(span)
        fields = [f"read{i}", "2000", "7", str(7 + span), rng.choice("+-"), "contig", "9000", "40", str(40 + span), str(same), str(span), "33"]
        tags, identity, cigar = [], same / span, ""
        if i % 3 == 0:
            off = rng.randrange(100) / 1000
            tags, identity = [f"dv:f:{off}"], 1 - off
        if i % 4 == 1:
            cigar = f"{same}={span - same}X"
            tags.append(f"cg:Z:{cigar}")
        lines.append(fields + tags)
        want.append((f"read{i}", round(identity, 6), cigar))
    broken = [lines[0][:7], lines[1][:3] + ["", "x"]]
    unread = lines[2][:9] + ["none", "80", "33", "dv:f:oops"]
    (tmp_path / "a.paf").write_text("\n".join("\t".join(x) for x in [*lines, *broken, unread]) + "\n\n")
    got = documents.read_paf(spark, str(tmp_path / "a.paf")).collect()
    assert sorted((r.query_name, round(r.identity, 6), r.cigar) for r in got) == sorted([*want, (unread[0], 0.0, "")])


def test_binary_delta_round_trip(spark, tmp_path):
    ops = [
        ("Q", "R", "sha256:r", 0, "chr1", 9, "h1", 0, "copy", "r1", 5, 9, None),
        ("Q", "R", "sha256:r", 0, "chr1", 9, "h1", 1, "literal", None, None, None, b"ACGTN"),
        ("Q", "R", "sha256:r", 1, "chr2", 5, "h2", 0, "literal", None, None, None, b"ACGTA"),
        ("Q", "R", "sha256:r", 1, "chr2", 5, "h2", 1, "copy", "r0", 300, 700, None),
        ("Q", "R", "sha256:r", 1, "chr2", 5, "h2", 2, "copy", "r1", 2, 4, None),
    ]
    from strandmill.schemas import DELTA_OPS

    df = spark.createDataFrame(ops, DELTA_OPS)
    content = deltas.encode_deltas(df).first().content
    assert bytes(content[:4]) == b"GHD1"
    (tmp_path / "q.delta.ghd").write_bytes(bytes(content))
    (tmp_path / "p.delta.json").write_text(json.dumps({
        "assembly": "P", "reference": "R", "reference_hash": "x", "chromosomes": [
            {"name": "c", "length": 3, "hash": "h", "ops": [{"type": "literal", "bytes": "QUNH"}]}]}))
    back = deltas.read_deltas(spark, str(tmp_path)).orderBy("assembly", "chrom_idx", "op_idx").collect()
    assert back[0].assembly == "P" and bytes(back[0].bytes) == b"ACG"
    plain = [tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in back[1:]]
    assert plain == ops


def test_truncated_delta_is_an_error(spark, tmp_path):
    from strandmill.functions import ghd

    with pytest.raises(ValueError):
        list(ghd.operations(ghd.MAGIC + b"\x01\x05{}"))


def test_delta_files_as_chunks(spark, tmp_path):
    blob = bytes((7 * i * i + i // 3) % 251 for i in range(3000))
    files = spark.createDataFrame([("Q", bytearray(blob))], "assembly string, content binary")
    chunks = deltas.recipe_chunks(files, (64, 256))
    refs = spark.createDataFrame([("Q", "R")], "assembly string, reference string")
    deltas.write_recipes(chunks, refs, str(tmp_path / "recipes"))
    part = next((tmp_path / "recipes").glob("part-*.json"))
    recipe = documents.read_recipes(spark, str(part))
    store = chunks.groupBy("hash").agg(F.first("data").alias("data"))
    assert recipe.first().total_size == 3000
    back = deltas.join_chunks(recipe, store).first()
    assert back.missing == 0 and bytes(back.content) == blob
