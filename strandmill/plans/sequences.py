"""Reconstruction, integrity and scalar-function queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strandmill.functions import bases, formatting, hashing
from strandmill.operators import chunking, network, reconstruct, segments
from strandmill.plans import corpus
from strandmill.plans.dedup import HELD, REFS, SEG
from strandmill.session import checkpoint_dir
from strandmill.sources import fasta_parts

FASTA_RANGE = 100_003


def _rebuilt(spark, sf):
    docs = corpus.documents(spark, sf)
    segs = corpus.lines(docs)
    return reconstruct.assemble(segs, reconstruct.store_of(segs), "\n")


def reconstruct_text(spark, sf):
    return _rebuilt(spark, sf).select(
        "assembly", "chrom", F.octet_length("data").cast("long").alias("bases"), "data"
    )


def chromosome_hash_check(spark, sf):
    """Hash of every rebuilt chromosome against the one recorded for the original."""
    recorded = corpus.documents(spark, sf).select(
        "assembly", "chrom", hashing.address(F.col("text")).alias("recorded")
    )
    return _rebuilt(spark, sf).join(recorded, ["assembly", "chrom"]).select(
        "assembly", "chrom", "recorded",
        (hashing.address(F.col("data")) == F.col("recorded")).alias("verified"),
    )


def verify_positional(spark, sf):
    """Originals against what the local store alone can rebuild."""
    docs = corpus.documents(spark, sf)
    segs = corpus.lines(docs)
    local = reconstruct.store_of(segs).join(corpus.held(spark, sf), "hash", "left_semi")
    rebuilt = reconstruct.assemble(segs, local, "\n").where("missing = 0").select(
        "assembly", "chrom", hashing.address(F.col("data")).alias("hash")
    )
    original = docs.select("assembly", "chrom", hashing.address(F.col("text")).alias("hash"))
    return reconstruct.verify_positional(original, rebuilt)


def segments_root(spark, sf):
    return reconstruct.segments_root(corpus.manifest(spark, sf))


def hashes_digest(spark, sf):
    return reconstruct.hashes_digest(segments.references(corpus.manifest(spark, sf)))


def reference_hash(spark, sf):
    return reconstruct.reference_hash(corpus.documents(spark, sf), "assembly")


def segment_starts(spark, sf):
    """Start offset of every turn in its conversation."""
    turns = corpus.table(spark, sf, "conversations").select("conv_id", "turn", "text")
    length = F.octet_length("text").cast("long")
    placed = reconstruct.offsets(turns.select("conv_id", "turn", length.alias("n")),
                                 "conv_id", "turn", F.col("n"))
    return placed.select("conv_id", "turn", "start", "length")


def segment_arrival_check(spark, sf):
    """Segments arriving from three sources, one of which corrupts what it sends.

    The first source delivers upper-cased text, which fails the hash for most lines; the
    second holds the labelled documents; the origin has everything.
    """
    segs = corpus.lines(corpus.documents(spark, sf)).select("hash", "data").distinct()
    damaged = segs.select("hash", F.upper("data").alias("data"), F.lit(0).alias("source_rank"))
    peer = segs.join(corpus.held(spark, sf), "hash", "left_semi").withColumn(
        "source_rank", F.lit(1)
    )
    origin = segs.withColumn("source_rank", F.lit(2))
    kept = reconstruct.verified_segments(damaged.unionByName(peer).unionByName(origin))
    return kept.select("hash", F.col("source_rank").cast("long").alias("source_rank"))


def fasta_wrap60(spark, sf):
    docs = corpus.documents(spark, sf)
    return docs.select(
        "chrom", F.posexplode(bases.wrap(F.encode("text", "UTF-8"))).alias("line_no", "line")
    ).select("chrom", F.col("line_no").cast("long").alias("line_no"), F.hex("line").alias("line"))


def fasta_parts_round_trip(spark, sf):
    """Texts in hexadecimal, written as FASTA in pieces and read back by ranges that cut lines and records."""
    docs = corpus.documents(spark, sf).select("assembly", F.col("chrom").alias("chrom_idx"), "chrom", F.hex(F.encode("text", "UTF-8")).alias("seq"))
    path = f"{checkpoint_dir(spark).rstrip('/')}/fasta-{uuid.uuid4().hex}"
    key = ["assembly", "chrom_idx", "chrom"]
    empty = docs.where("coalesce(seq, '') = ''").select(*key, F.lit(0).cast("long").alias("at"), F.lit(b"").alias("data"))
    fasta_parts.write_parts(chunking.pieces(docs, key, "seq", 5_000).unionByName(empty), path)
    read = fasta_parts.read_parts(spark, path, joined=True, size=FASTA_RANGE, piece=7_000)
    return read.groupBy("assembly", F.col("chrom").cast("long").alias("chrom")).agg(
        F.sum(F.octet_length("data")).alias("bases"), F.expr("sha2(listagg(data) WITHIN GROUP (ORDER BY at), 256)").alias("digest"))


def revcomp(spark, sf):
    return corpus.documents(spark, sf).select(
        "chrom", bases.reverse_complement(bases.byte_string(F.col("text"))).alias("revcomp")
    )


def fmt_bytes(spark, sf):
    size = F.octet_length("text").cast("long")
    big = size * F.lit(1_000)
    return corpus.documents(spark, sf).select(
        "chrom",
        formatting.bytes_short(size).alias("short"),
        formatting.bytes_short(big).alias("short_big"),
        formatting.base_pairs(size).alias("bp"),
        formatting.base_pairs(big).alias("bp_big"),
        formatting.bytes_iec(size).alias("iec"),
        formatting.bytes_iec(big, "").alias("iec_big"),
    )


def url_path_attribution(spark, sf):
    """Requests for page paths attributed to the genome they belong to.

    The path after the host is read as /genomes/{name}/..., and pages of one name are
    counted together.
    """
    path = F.concat(F.lit("/genomes"), F.regexp_extract("url", r"^https?://[^/]+(/.*)$", 1))
    return (
        corpus.table(spark, sf, "pages")
        .select(network.attribute_path(path).alias("assembly"))
        .groupBy("assembly").agg(F.count(F.lit(1)).alias("hits"))
    )


def segment_attribution(spark, sf):
    """Served bytes per genome: a shared segment counts for one owner only."""
    counts = segments.refcounts(segments.references(corpus.manifest(spark, sf)))
    return counts.groupBy(F.col("owner").alias("assembly")).agg(
        F.count(F.lit(1)).alias("segments"), F.sum("length").alias("bytes")
    )


def search_filter(spark, sf):
    docs = corpus.documents(spark, sf).select("assembly", "organism", "chrom")
    return docs.where(network.matches_search(" C1 ", "assembly", "organism"))


def canonical_message(spark, sf):
    """The text a node signs for each announcement."""
    e = corpus.events(spark, sf).where(F.col("op") == network.ANNOUNCE)
    node = F.concat(F.lit("node-"), F.col("node").cast("string"))
    msg = hashing.canonical_message(
        F.lit("announce"), node, F.concat(F.lit("http://"), node), F.col("us"),
        F.sha2(F.concat(F.col("content").cast("string"), F.lit("\n")), 256),
    )
    return e.select("seq", msg.alias("message"))


QUERIES = {
    f.__name__: f
    for f in (
        reconstruct_text, chromosome_hash_check, verify_positional, segments_root,
        hashes_digest, reference_hash, segment_starts, segment_arrival_check, fasta_wrap60, fasta_parts_round_trip,
        revcomp, fmt_bytes, url_path_attribution, segment_attribution, search_filter,
        canonical_message,
    )
}

# Digest of tokens in order: four levels of runs of 65,536 each.
_ROOT = """,
l0 AS (SELECT g, p // 65536 AS run, sha256(string_agg(token, '' ORDER BY p)) AS d FROM placed GROUP BY ALL),
l1 AS (SELECT g, run // 65536 AS run, sha256(string_agg(d, '' ORDER BY l0.run)) AS d FROM l0 GROUP BY g, l0.run // 65536),
l2 AS (SELECT g, run // 65536 AS run, sha256(string_agg(d, '' ORDER BY l1.run)) AS d FROM l1 GROUP BY g, l1.run // 65536),
root AS (SELECT g, 'sha256-tree:' || sha256(string_agg(d, '' ORDER BY l2.run)) AS d FROM l2 GROUP BY g)"""


def _short(x: str) -> str:
    return f"""CASE WHEN {x} >= 1048576 THEN format('{{:.1f}} MB', {x} / 1048576)
        WHEN {x} >= 1024 THEN format('{{:.1f}} KB', {x} / 1024) ELSE {x} || ' B' END"""


def _bp(x: str) -> str:
    return f"""CASE WHEN {x} >= 1000000 THEN format('{{:.1f}} Mbp', {x} / 1000000)
        WHEN {x} >= 1000 THEN format('{{:.1f}} Kbp', {x} / 1000) ELSE {x} || ' bp' END"""


def _iec(x: str, gap: str) -> str:
    steps = "".join(
        f"WHEN {x} >= {1 << (10 * (i + 1))} THEN format('{{:.1f}}{gap}{s}B', {x} / {1 << (10 * (i + 1))}) "
        for i, s in reversed(list(enumerate("KMGTPE")))
    )
    return f"CASE {steps} ELSE {x} || '{gap}B' END"


ORACLES = {
    "reconstruct_text": """SELECT source AS assembly, doc_id AS chrom,
        octet_length(encode(text)) AS bases, text AS data FROM documents""",
    "chromosome_hash_check": """SELECT source AS assembly, doc_id AS chrom,
        'sha256:' || sha256(text) AS recorded, true AS verified FROM documents""",
    "verify_positional": f"""WITH {SEG}{HELD},
        whole AS (SELECT s.chrom FROM seg s LEFT JOIN held h USING (hash)
                  GROUP BY s.chrom HAVING count(*) = count(h.hash)),
        a AS (SELECT source AS assembly, doc_id AS chrom, sha256(text) AS hash,
                row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
        b AS (SELECT source AS assembly, doc_id AS chrom, sha256(text) AS hash,
                row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i
              FROM documents WHERE doc_id IN (SELECT chrom FROM whole)),
        j AS (SELECT coalesce(a.assembly, b.assembly) AS assembly, a.chrom AS ca, b.chrom AS cb,
                     a.hash AS ha, b.hash AS hb
              FROM a FULL JOIN b ON a.assembly = b.assembly AND a.i = b.i),
        t AS (SELECT assembly, count(ca) AS original, count(cb) AS reconstructed,
                count(*) FILTER (ca <> cb) AS renamed,
                count(*) FILTER (ca = cb AND ha <> hb) AS changed
              FROM j GROUP BY assembly)
        SELECT *, original = reconstructed AND renamed = 0 AND changed = 0 AS verified FROM t""",
    "segments_root": f"""WITH {SEG},
        placed AS (SELECT assembly AS g, hash AS token,
          row_number() OVER (PARTITION BY assembly ORDER BY chrom, seg_idx) - 1 AS p FROM seg)
        {_ROOT} SELECT g AS assembly, d AS segments_root FROM root""",
    "hashes_digest": f"""WITH {REFS},
        placed AS (SELECT assembly AS g, substr(hash, 8) || chr(10) AS token,
          row_number() OVER (PARTITION BY assembly ORDER BY hash) - 1 AS p FROM refs)
        {_ROOT} SELECT g AS assembly, d AS digest FROM root""",
    "reference_hash": f"""WITH
        placed AS (SELECT source AS g,
          sha256(encode(CAST(doc_id AS VARCHAR)) || '\\x00'::BLOB || encode(text) || '\\x00'::BLOB)
            AS token,
          row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS p FROM documents)
        {_ROOT} SELECT g AS assembly, d AS reference_hash FROM root""",
    "segment_starts": """SELECT conv_id, turn, octet_length(encode(text)) AS length,
        CAST(coalesce(sum(octet_length(encode(text))) OVER (PARTITION BY conv_id ORDER BY turn
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
        FROM conversations""",
    "segment_arrival_check": f"""WITH {SEG}{HELD}
        SELECT DISTINCT hash,
          CAST(CASE WHEN upper(data) = data THEN 0
               WHEN hash IN (SELECT hash FROM held) THEN 1 ELSE 2 END AS BIGINT) AS source_rank
        FROM seg""",
    "fasta_wrap60": """SELECT doc_id AS chrom, i AS line_no, substr(h, 1 + 120 * i, 120) AS line
        FROM (SELECT doc_id, hex(encode(text)) AS h FROM documents) d,
             unnest(range(0, (len(d.h) + 119) // 120)) AS t(i)""",
    "fasta_parts_round_trip": """SELECT coalesce(source, '') AS assembly, coalesce(doc_id, -1) AS chrom, 2 * octet_length(encode(coalesce(text, ''))) AS bases,
        sha256(hex(encode(coalesce(text, '')))) AS digest FROM documents""",
    "revcomp": r"""SELECT doc_id AS chrom, reverse(translate(upper(
          regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
            '[\x{10000}-\x{10FFFF}]', 'NNNN', 'g'), '[\x{800}-\x{FFFF}]', 'NNN', 'g'),
            '[\x{80}-\x{7FF}]', 'NN', 'g'), '[^ACGTacgt]', 'N', 'g')), 'ACGT', 'TGCA')) AS revcomp
        FROM documents""",
    "fmt_bytes": f"""SELECT doc_id AS chrom, {_short('n')} AS short, {_short('b')} AS short_big,
          {_bp('n')} AS bp, {_bp('b')} AS bp_big, {_iec('n', ' ')} AS iec, {_iec('b', '')} AS iec_big
        FROM (SELECT doc_id, octet_length(encode(text)) AS n,
                     octet_length(encode(text)) * 1000 AS b FROM documents)""",
    "url_path_attribution": """SELECT split_part(regexp_extract(url, '^https?://[^/]+/(.*)$', 1), '/', 1)
          AS assembly, count(*) AS hits FROM pages GROUP BY 1""",
    "segment_attribution": f"""WITH {REFS} SELECT owner AS assembly, count(*) AS segments,
        CAST(sum(length) AS BIGINT) AS bytes FROM counts GROUP BY owner""",
    "search_filter": """SELECT source AS assembly, lang AS organism, doc_id AS chrom
        FROM documents WHERE contains(lower(source), 'c1') OR contains(lower(lang), 'c1')""",
    "canonical_message": """SELECT event_id AS seq,
          'announce' || chr(10) || 'node-' || user_id || chr(10) || 'http://node-' || user_id
          || chr(10) || epoch_us(ts) || chr(10)
          || sha256(CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) AS VARCHAR) || chr(10))
          AS message
        FROM events WHERE event_type = 'signup'""",
}
