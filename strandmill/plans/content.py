"""Content-defined chunking and sketch queries over the document corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandmill.functions import bases
from strandmill.operators import chunking, segments, sketch
from strandmill.plans import corpus

CHUNK = (64, 1_024)
SWEEP = [(64, 256), (256, 1_024), (1_024, 4_096)]


def _chunks(spark, sf, sizes):
    return chunking.chunks(corpus.documents(spark, sf), ["assembly", "chrom"], "text", sizes)


def cdc_chunks(spark, sf):
    return _chunks(spark, sf, [CHUNK]).select("chrom", "seg_idx", "start", "length", "hash")


def cdc_long_chunks(spark, sf):
    """Chunks of each assembly as one long sequence, its documents one after the other."""
    docs = corpus.documents(spark, sf).where("text <> ''")
    parts = chunking.placed(docs.select("assembly", "chrom", F.col("text").cast("binary").alias("data")), ["assembly"], "chrom")
    return chunking.long_chunks(parts, ["assembly"], CHUNK, 65_536).select("assembly", "start", "length", "hash")


def cdc_chunk_stats(spark, sf):
    refs = segments.references(_chunks(spark, sf, [CHUNK]))
    return segments.summary(segments.refcounts(refs), corpus.genomes(spark, sf))


def cdc_benchmark_sweep(spark, sf):
    """Sharing with the genome listed before, for several chunk sizes."""
    per = _chunks(spark, sf, SWEEP).groupBy("max_chunk", "hash", "assembly").agg(
        F.count(F.lit(1)).alias("occurrences")
    )
    return segments.neighbour_sharing(per, corpus.genomes(spark, sf), by=["max_chunk"])


def _bases(spark, sf):
    return corpus.documents(spark, sf).select(
        "assembly", "chrom", bases.bases_of(F.col("text")).alias("seq")
    )


def _sketches(spark, sf, which):
    chroms = _bases(spark, sf).where(which)
    return sketch.sketches(sketch.bottom_hashes(chroms, "assembly", "seq"), "assembly")


def sketch_bottomk(spark, sf):
    h = sketch.bottom_hashes(_bases(spark, sf), "assembly", "seq")
    return h.select(
        "assembly", F.col("rank").cast("long").alias("rank"),
        sketch.unsigned(F.col("h")).cast("string").alias("hash"),
    )


def kmer_canonical(spark, sf):
    """Smallest canonical k-mer hash of every chromosome."""
    h = sketch.bottom_hashes(_bases(spark, sf), "chrom", "seq", size=1)
    return h.select("chrom", sketch.unsigned(F.col("h")).cast("string").alias("hash"))


def _scores(spark, sf):
    """Candidates scored against one query genome."""
    name = F.col("assembly")
    return sketch.against(
        _sketches(spark, sf, name != "src0"), "assembly", _sketches(spark, sf, name == "src0")
    )


def sketch_jaccard(spark, sf):
    return _scores(spark, sf).select("assembly", F.round("jaccard", 6).alias("jaccard"))


def sketch_similarity(spark, sf):
    return _scores(spark, sf).select("assembly", F.round("similarity", 6).alias("similarity"))


def similar_topn(spark, sf):
    return sketch_similarity(spark, sf).orderBy(F.desc("similarity"), "assembly").limit(5)


def route_decision(spark, sf):
    """Storage strategy of the query genome, from its most similar candidate."""
    best = sketch_similarity(spark, sf).agg(
        F.min_by(F.struct("assembly", "similarity"), F.struct(-F.col("similarity"), "assembly"))
        .alias("b")
    ).select(F.col("b.assembly").alias("assembly"), F.col("b.similarity").alias("similarity"))
    return best.withColumn("strategy", sketch.strategy(F.col("similarity")))


QUERIES = {
    f.__name__: f
    for f in (
        cdc_chunks, cdc_long_chunks, cdc_chunk_stats, cdc_benchmark_sweep, sketch_bottomk, kmer_canonical,
        sketch_jaccard, sketch_similarity, similar_topn, route_decision,
    )
}


_TEXTS = """SELECT doc_id AS doc, source AS assembly, encode(text) AS raw, hex(encode(text)) AS h,
             octet_length(encode(text)) AS n FROM documents"""
_ASSEMBLIES = """SELECT doc, doc AS assembly, encode(t) AS raw, hex(encode(t)) AS h, octet_length(encode(t)) AS n FROM
             (SELECT coalesce(source, '') AS doc, string_agg(text, '' ORDER BY doc_id) AS t FROM documents GROUP BY 1)"""


def chunk_sql(sizes: list[tuple[int, int]], texts: str = _TEXTS) -> str:
    """Chunks by recursion: from each start, the first candidate end that is long enough."""
    parts = []
    for low, high in sizes:
        bits = ((low + high) // 2).bit_length() - 1
        terms = " + ".join(
            f"(lag(g, {j}, 0) OVER w % {1 << bits}) * {1 << j}" for j in range(bits)
        )
        parts.append(f"""SELECT {low} AS lo, {high} AS hi, doc, i,
          ({terms}) % {1 << bits} = 0 AS cand FROM gb WINDOW w AS (PARTITION BY doc ORDER BY i)""")
    return f"""gear(b, v) AS (
      SELECT 0, (6364136223846793005::UHUGEINT + 1442695040888963407) & 18446744073709551615::UHUGEINT
      UNION ALL
      SELECT b + 1, (v * 6364136223846793005 + 1442695040888963407) & 18446744073709551615::UHUGEINT
      FROM gear WHERE b < 255
    ),
    hx AS ({texts}),
    bytes AS (SELECT doc, unnest(regexp_extract_all(h, '..')) AS x,
                generate_subscripts(regexp_extract_all(h, '..'), 1) - 1 AS i FROM hx WHERE n > 0),
    gb AS (SELECT doc, i, CAST(v & 1048575::UHUGEINT AS BIGINT) AS g
           FROM bytes JOIN (SELECT printf('%02X', b) AS x, v FROM gear) USING (x)),
    cands AS ({" UNION ALL ".join(parts)}),
    ends AS (SELECT lo, hi, doc, list(i + 1 ORDER BY i) AS ends FROM cands WHERE cand
             GROUP BY lo, hi, doc),
    size(lo, hi) AS (VALUES {", ".join(str(s) for s in sizes)}),
    cuts(lo, hi, doc, n, ends, seg_idx, s, e) AS (
      SELECT size.lo, size.hi, hx.doc, n, ends, -1, CAST(0 AS BIGINT), CAST(0 AS BIGINT)
      FROM hx JOIN size ON n > 0
      LEFT JOIN ends ON ends.doc = hx.doc AND ends.hi = size.hi
      UNION ALL
      SELECT lo, hi, doc, n, ends, seg_idx + 1, e,
        least(coalesce(list_min(list_filter(ends, lambda x: x >= e + lo)), n), e + hi, n)
      FROM cuts WHERE e < n
    ),
    pieces AS (SELECT h.assembly, c.hi AS max_chunk, c.doc AS chrom, c.seg_idx, c.s AS start,
                 c.e - c.s AS length,
                 'sha256:' || sha256(unhex(substr(h.h, 2 * c.s + 1, 2 * (c.e - c.s)))) AS hash
               FROM cuts c JOIN hx h ON h.doc = c.doc WHERE c.seg_idx >= 0)"""


_KMERS = """dna AS (
  SELECT source AS assembly, doc_id AS chrom, array_to_string(list_transform(
    string_split(text, chr(10)), lambda l: translate(lower(hex(encode(l))), '0123456789abcdef',
    'ACGTACGTACGTACGT')), 'N') AS s FROM documents
),
ch AS (
  SELECT assembly, chrom, unnest(string_split(s, '')) AS c,
         generate_subscripts(string_split(s, ''), 1) AS i FROM dna
),
num AS (SELECT assembly, chrom, i, CASE c WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'G' THEN 2
          WHEN 'T' THEN 3 END::BIGINT AS c FROM ch),
k1 AS (
  SELECT assembly, chrom, {fwd} AS f, {rev} AS r FROM num
  WINDOW w AS (PARTITION BY chrom ORDER BY i)
),
code AS (SELECT assembly, chrom, least(f, r)::UHUGEINT AS x FROM k1 WHERE f IS NOT NULL),
m0 AS (SELECT *, (x + 11400714819323198485) & {m} AS y FROM code),
m1 AS (SELECT *, (xor(y, y >> 30) * 13787848793156543929) & {m} AS z FROM m0),
m2 AS (SELECT *, (xor(z, z >> 27) * 10723151780598845931) & {m} AS u FROM m1),
hashed AS (SELECT assembly, chrom, xor(u, u >> 31) AS h FROM m2)""".replace(
    "{m}", "18446744073709551615::UHUGEINT"
).replace(
    "{fwd}", " + ".join(f"lag(c, {j}) OVER w * {4**j}" for j in range(21))
).replace(
    "{rev}", " + ".join(f"(3 - lag(c, {j}) OVER w) * {4**(20 - j)}" for j in range(21))
)
SKETCH = _KMERS + """,
sk AS (
  SELECT * FROM (SELECT assembly, h, row_number() OVER (PARTITION BY assembly ORDER BY h) AS rank
                 FROM (SELECT DISTINCT assembly, h FROM hashed)) WHERE rank <= 1000
)"""
SCORES = SKETCH + """,
mine AS (SELECT h FROM sk WHERE assembly = 'src0'),
others AS (SELECT DISTINCT assembly FROM sk WHERE assembly <> 'src0'),
kk AS (SELECT o.assembly, least(1000, (SELECT count(*) FROM mine),
         (SELECT count(*) FROM sk WHERE sk.assembly = o.assembly)) AS k FROM others o),
u AS (SELECT assembly, h, count(*) AS c FROM (
        SELECT assembly, h FROM sk WHERE assembly <> 'src0'
        UNION ALL SELECT o.assembly, m.h FROM others o, mine m) GROUP BY assembly, h),
r AS (SELECT *, row_number() OVER (PARTITION BY assembly ORDER BY h) AS i FROM u),
scores AS (
  SELECT r.assembly, avg(CASE WHEN c = 2 THEN 1.0 ELSE 0.0 END) AS j
  FROM r JOIN kk ON kk.assembly = r.assembly WHERE r.i <= kk.k GROUP BY r.assembly
),
sims AS (
  SELECT assembly, j, round(CASE WHEN j <= 0 THEN 0.0 WHEN j >= 1 THEN 1.0
    ELSE greatest(0.0, 1.0 + ln(2 * j / (1 + j)) / 21) END, 6) AS similarity FROM scores
)"""

ORACLES = {
    "cdc_chunks": f"""WITH RECURSIVE {chunk_sql([CHUNK])}
        SELECT chrom, seg_idx, start, length, hash FROM pieces""",
    "cdc_long_chunks": f"""WITH RECURSIVE {chunk_sql([CHUNK], _ASSEMBLIES)}
        SELECT assembly, start, length, hash FROM pieces""",
    "cdc_chunk_stats": f"""WITH RECURSIVE {chunk_sql([CHUNK])},
        c AS (SELECT hash, min(length) AS length, count(DISTINCT assembly) AS rc
              FROM pieces GROUP BY hash),
        ng AS (SELECT count(DISTINCT source) AS n FROM documents)
        SELECT CAST(max(n) AS BIGINT) AS genomes, count(*) AS segments,
          CAST(sum(CASE WHEN rc = n THEN length ELSE 0 END) AS BIGINT) AS core_bytes,
          CAST(sum(CASE WHEN rc <> n AND rc <> 1 THEN length ELSE 0 END) AS BIGINT) AS partial_bytes,
          CAST(sum(CASE WHEN rc <> n AND rc = 1 THEN length ELSE 0 END) AS BIGINT) AS unique_bytes,
          CAST(sum(length) AS BIGINT) AS stored_bytes,
          CAST(sum(length * rc) AS BIGINT) AS naive_bytes FROM c, ng""",
    "cdc_benchmark_sweep": f"""WITH RECURSIVE {chunk_sql(SWEEP)},
        p AS (SELECT * FROM (SELECT assembly AS b, lag(assembly) OVER (ORDER BY assembly) AS a
              FROM (SELECT DISTINCT source AS assembly FROM documents)) WHERE a IS NOT NULL),
        sz AS (SELECT max_chunk, assembly, count(*) AS n FROM pieces GROUP BY max_chunk, assembly),
        d AS (SELECT DISTINCT max_chunk, assembly, hash FROM pieces),
        sh AS (SELECT s.max_chunk, p.a, p.b, count(d.hash) AS shared
               FROM p JOIN pieces s ON s.assembly = p.b
               LEFT JOIN d ON d.max_chunk = s.max_chunk AND d.assembly = p.a AND d.hash = s.hash
               GROUP BY s.max_chunk, p.a, p.b)
        SELECT CAST(sh.max_chunk AS BIGINT) AS max_chunk, sh.a, sh.b, x.n AS segments_a, y.n AS segments_b,
               sh.shared, x.n + y.n - sh.shared AS unique_segments,
               round(sh.shared / (x.n + y.n), 6) AS dedup_ratio
        FROM sh JOIN sz x ON x.assembly = sh.a AND x.max_chunk = sh.max_chunk
                JOIN sz y ON y.assembly = sh.b AND y.max_chunk = sh.max_chunk""",
    "sketch_bottomk": f"""WITH {SKETCH}
        SELECT assembly, rank, CAST(h AS VARCHAR) AS hash FROM sk""",
    "kmer_canonical": f"""WITH {_KMERS}
        SELECT chrom, CAST(min(h) AS VARCHAR) AS hash FROM hashed GROUP BY chrom""",
    "sketch_jaccard": f"WITH {SCORES} SELECT assembly, round(j, 6) AS jaccard FROM sims",
    "sketch_similarity": f"WITH {SCORES} SELECT assembly, similarity FROM sims",
    "similar_topn": f"""WITH {SCORES} SELECT assembly, similarity FROM sims
        ORDER BY similarity DESC, assembly LIMIT 5""",
    "route_decision": f"""WITH {SCORES} SELECT assembly, similarity,
          CASE WHEN similarity >= 0.95 THEN 'delta' WHEN similarity >= 0.5 THEN 'reindex'
          ELSE 'skip' END AS strategy
        FROM sims ORDER BY similarity DESC, assembly LIMIT 1""",
}
