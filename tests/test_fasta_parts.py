"""FASTA by byte ranges against a reader and a writer of whole files."""

import pytest

from strandmill.operators import chunking
from strandmill.sources import fasta, fasta_parts

ODD = (b"junk\nACGT\n>chr1 first one\nacgt  \r\nTTTT\n>chr2\tx\nGG GG\n\n>empty\n>" + b"n" * 40 + b" long header\r\n"
       + b"ACGTN" * 30 + b" " * 25 + b"\n>>odd\nA>C\n>\nTT\r\n>chr3\n" + b"AC" * 20 + b"   \n" + b"g" * 61 + b"  ")


def joined(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.chrom_idx, r.at)):
        data = out.setdefault((r.assembly, r.chrom_idx, r.chrom), bytearray())
        assert len(data) == r.at
        data += r.data
    return {k: bytes(v).decode() for k, v in out.items()}


@pytest.mark.parametrize("size", [5, 16, 50, 1000])
def test_ranges_of_any_size(spark, tmp_path, size):
    (tmp_path / "g1.fa").write_bytes(ODD)
    want = [(r.assembly, r.chrom, r.seq) for r in fasta.read_fasta(spark, str(tmp_path / "g1.fa")).orderBy("chrom_idx").collect()]
    got = joined(fasta_parts.read_parts(spark, str(tmp_path), size=size, piece=11).collect())
    assert [(a, c, s) for (a, _, c), s in sorted(got.items())] == want
    assert all(ODD[i : i + 1] == b">" for _, i, _ in got)


def test_writer_equals_a_single_one(spark, tmp_path):
    seqs = [("a/b =%+", i, f"c{i}", "ACGTTGCAT" * n) for i, n in enumerate([0, 1, 7, 500, 20, 0, 40, 60])] + [("z", 3, "x", ""), ("", 1, "y", "A" * 120)]
    df = spark.createDataFrame(seqs, "assembly string, chrom_idx long, chrom string, seq string")
    key = ["assembly", "chrom_idx", "chrom"]
    empty = df.where("seq = ''").selectExpr(*key, "0L as at", "cast('' as binary) as data")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        fasta_parts.write_parts(chunking.pieces(df, key, "seq", 37).unionByName(empty), str(tmp_path / "out"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    folders = sorted(p for p in (tmp_path / "out").iterdir() if p.is_dir())
    assert len(folders) == 3
    texts = {"".join(p.read_text() for p in sorted(f.iterdir())) for f in folders}
    want = {}
    for a, _, c, s in seqs:
        want[a] = want.get(a, "") + f">{c}\n" + "".join(s[i : i + 60] + "\n" for i in range(0, len(s), 60))
    assert texts == set(want.values())
    assert max(len(list(f.iterdir())) for f in folders) > 1
    for size in (13, 1000):
        got = joined(fasta_parts.read_parts(spark, str(tmp_path / "out"), joined=True, size=size, piece=50).collect())
        assert sorted((a, c, s) for (a, _, c), s in got.items()) == sorted((a, c, s) for a, _, c, s in seqs)
    with pytest.raises(FileExistsError):
        fasta_parts.write_parts(chunking.pieces(df, key, "seq", 37), str(tmp_path / "out"))


def test_nothing_to_read(spark, tmp_path):
    (tmp_path / "a.fa").write_bytes(b"")
    (tmp_path / "b.fa").write_bytes(b"no header\n")
    assert fasta_parts.read_parts(spark, str(tmp_path)).collect() == []
