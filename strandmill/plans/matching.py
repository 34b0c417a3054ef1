"""Exact-match, delta and reindex queries: documents against the benchmark passages.

Passages are the target (reference) chromosomes and documents the query chromosomes; both
are read as UTF-8 bytes.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from strandmill.operators import alignment, delta, intervals, matches, propagate, reindex
from strandmill.operators import segments as seg_ops
from strandmill.plans import corpus
from strandmill.plans.content import chunk_sql

MIN_LEN, MAX_GAP = 32, 8
CHUNK = (64, 1_024)


def _target(spark, sf):
    return corpus.table(spark, sf, "benchmark").select(F.col("item_id").alias("target"), F.col("text").alias("seq"))


def _query(spark, sf):
    return corpus.documents(spark, sf).select(F.col("chrom").alias("query"), F.col("text").alias("seq"))


def _mems(spark, sf):
    return matches.find(_target(spark, sf), _query(spark, sf), MIN_LEN)


def mem_all(spark, sf):
    return _mems(spark, sf)


def mem_maximal(spark, sf):
    return matches.longest(_mems(spark, sf))


def mem_repeats(spark, sf):
    """Matches between tandem repeats: each passage three times in a row against it five times,
    apart from its first bytes."""
    items = corpus.table(spark, sf, "benchmark").select(F.col("item_id").alias("target"), F.expr("substr(text, 1, 60)").alias("unit"))
    target = items.select("target", F.repeat("unit", F.lit(3)).alias("seq"))
    query = items.select(F.col("target").alias("query"), F.concat(F.expr("substr(unit, 4)"), F.repeat("unit", F.lit(4))).alias("seq"))
    return matches.find(target, query, MIN_LEN)


def mem_verify(spark, sf):
    """True matches, the same shifted by one base, and reverse-strand claims."""
    m = _mems(spark, sf).select(
        "query", "target", "t_start", "q_start", (F.col("t_end") - F.col("t_start")).alias("length"),
        F.explode(F.array(F.lit("+"), F.lit("shift"), F.lit("-"))).alias("strand"),
    )
    shifted = F.col("strand") == "shift"
    claims = m.withColumns({
        "t_start": F.when(shifted, F.col("t_start") + 1).otherwise(F.col("t_start")),
        "strand": F.when(shifted, "+").otherwise(F.col("strand")),
    })
    return matches.verify(claims, _target(spark, sf), _query(spark, sf))


def _blocks(spark, sf):
    return matches.chain(_mems(spark, sf), MAX_GAP)


def match_blocks(spark, sf):
    return _blocks(spark, sf).withColumn("identity", F.round("identity", 6))


def match_block_runs(spark, sf):
    """Exact runs read back from the blocks' CIGARs: the matches they were made of."""
    return alignment.exact_runs(_blocks(spark, sf), MIN_LEN)


def _delta(spark, sf):
    return delta.build(_blocks(spark, sf), _query(spark, sf), _target(spark, sf))


def delta_ops(spark, sf):
    return _delta(spark, sf).withColumn("bytes", F.hex("bytes"))


def delta_apply(spark, sf):
    return delta.verified(delta.apply(_delta(spark, sf), _target(spark, sf)), _query(spark, sf))


def delta_summary(spark, sf):
    return delta.summarise(_delta(spark, sf), _query(spark, sf).withColumnRenamed("query", "chrom"))


def delta_ref_gap(spark, sf):
    return delta.reference_gaps(_delta(spark, sf))


def _pairs(mems):
    return mems.select(
        F.lit("benchmark").alias("i_genome"), F.col("target").alias("i_chrom"),
        F.col("t_start").alias("i_start"), F.col("t_end").alias("i_end"),
        F.lit("documents").alias("j_genome"), F.col("query").alias("j_chrom"),
        F.col("q_start").alias("j_start"), F.col("q_end").alias("j_end"),
    )


def _closed_cuts(mems):
    pairs = _pairs(mems)
    ends = [
        pairs.select(F.col(f"{s}_genome").alias("genome"), F.col(f"{s}_chrom").alias("chrom"),
                     F.explode(F.array(f"{s}_start", f"{s}_end")).alias("pos"))
        for s in "ij"
    ]
    return propagate.cut_propagation(ends[0].unionByName(ends[1]), pairs)


def cut_propagation(spark, sf):
    return _closed_cuts(_mems(spark, sf))


def _genomes(spark, sf):
    """Both genomes of the match graph: documents under their sources, passages as one."""
    docs = corpus.documents(spark, sf).select(F.lit("documents").alias("genome"), "assembly", "chrom", F.col("text").alias("seq"))
    return docs.unionByName(_target(spark, sf).select(
        F.lit("benchmark").alias("genome"), F.lit("benchmark").alias("assembly"), F.col("target").alias("chrom"), "seq"))


def _reindex_regions(spark, sf):
    mems = _mems(spark, sf)
    of = F.struct("genome", "chrom").alias("of")
    cuts = _closed_cuts(mems).select(of, "pos")
    lengths = _genomes(spark, sf).select(of, F.coalesce(F.octet_length("seq"), F.lit(0)).cast("long").alias("length"))
    pairs = _pairs(mems)
    cover = [pairs.select(F.struct(F.col(f"{s}_genome").alias("genome"), F.col(f"{s}_chrom").alias("chrom")).alias("of"),
                          F.col(f"{s}_start").alias("start"), F.col(f"{s}_end").alias("end")) for s in "ij"]
    found = intervals.regions(cuts, lengths, intervals.merge(cover[0].unionByName(cover[1]), "of"), "of")
    return found.select("of.genome", "of.chrom", "start", "end", "shared")


def reindex_regions(spark, sf):
    return _reindex_regions(spark, sf)


def reindex_segments(spark, sf):
    return reindex.rechunk(_genomes(spark, sf), _reindex_regions(spark, sf), CHUNK, ["genome", "chrom"])


def reindex_summary(spark, sf):
    refs = seg_ops.references(reindex_segments(spark, sf))
    return seg_ops.summary(seg_ops.refcounts(refs), _genomes(spark, sf))


QUERIES = {
    f.__name__: f
    for f in (
        mem_all, mem_maximal, mem_repeats, mem_verify, match_blocks, match_block_runs, delta_ops, delta_apply,
        delta_summary, delta_ref_gap, cut_propagation, reindex_regions, reindex_segments,
        reindex_summary,
    )
}

# Windows of 32 bytes as four 8-byte numbers, joined for equality and grouped by diagonal.
_WORD = " + ".join(f"lead(b, {j}) OVER w::UBIGINT * {256**j}" for j in range(8))


def _windows(name: str, id_: str, source: str) -> str:
    return f"""
{name}_b AS (SELECT {id_} AS id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS x,
    generate_subscripts(regexp_extract_all(hex(encode(text)), '..'), 1) - 1 AS i
  FROM {source} WHERE text <> ''),
{name}_n AS (SELECT id, i, v AS b FROM {name}_b JOIN byte USING (x)),
{name}_e AS (SELECT id, i, {_WORD.replace('OVER w::UBIGINT', 'OVER w')} AS e
  FROM {name}_n WINDOW w AS (PARTITION BY id ORDER BY i)),
{name}_w AS (SELECT id, i, e AS e0, lead(e, 8) OVER w AS e1, lead(e, 16) OVER w AS e2,
    lead(e, 24) OVER w AS e3
  FROM {name}_e WINDOW w AS (PARTITION BY id ORDER BY i))"""


def _mems_of(targets: str, queries: str) -> str:
    return f"""
byte AS (SELECT printf('%02X', v) AS x, v::UBIGINT AS v FROM range(256) t(v)),
{_windows('t', 'item_id', targets).strip()},
{_windows('q', 'doc_id', queries).strip()},
hit AS (
  SELECT q.id AS query, t.id AS target, t.i AS ti, q.i AS qi
  FROM q_w q JOIN t_w t USING (e0, e1, e2, e3) WHERE e3 IS NOT NULL
),
isl AS (
  SELECT *, qi - row_number() OVER (PARTITION BY query, target, ti - qi ORDER BY qi) AS g FROM hit
),
mems AS (
  SELECT query, target, min(ti) AS t_start, max(ti) + 32 AS t_end, min(qi) AS q_start,
         max(qi) + 32 AS q_end
  FROM isl GROUP BY query, target, ti - qi, g
)"""


MEMS = _mems_of("benchmark", "documents")
LONGEST = MEMS + """,
far AS (SELECT *, max(q_end) OVER (PARTITION BY query, target ORDER BY q_start) AS f FROM mems),
kept AS (SELECT query, target, t_start, t_end, q_start, q_end FROM far WHERE q_end = f),
longest AS (
  SELECT * FROM kept a WHERE NOT EXISTS (
    SELECT 1 FROM kept b WHERE b.query = a.query AND b.target = a.target
      AND b.t_start <= a.t_start AND b.t_end >= a.t_end AND b.q_start <= a.q_start
      AND b.q_end >= a.q_end AND b.q_end - b.q_start > a.q_end - a.q_start)
)"""
BLOCKS = MEMS + """,
gaps AS (SELECT *, t_start - q_start AS d, q_start - lag(q_end) OVER
           (PARTITION BY query, target, t_start - q_start ORDER BY q_start) AS gap FROM mems),
nb AS (SELECT *, sum(CASE WHEN gap <= 8 THEN 0 ELSE 1 END) OVER
         (PARTITION BY query, target, d ORDER BY q_start ROWS UNBOUNDED PRECEDING) AS block FROM gaps),
blocks AS (
  SELECT query AS query_name, min(q_start) AS query_start, max(q_end) AS query_end,
    '+' AS strand, target AS target_name, min(t_start) AS target_start, max(t_end) AS target_end,
    CAST(sum(q_end - q_start) AS BIGINT) AS matches, max(q_end) - min(q_start) AS block_len,
    sum(q_end - q_start)::DOUBLE / (max(q_end) - min(q_start)) AS identity,
    string_agg(CASE WHEN gap <= 8 THEN gap || 'X' ELSE '' END || (q_end - q_start) || '=', ''
               ORDER BY q_start) AS cigar
  FROM nb GROUP BY query, target, d, block
)"""
DELTA = BLOCKS + r""",
firsts AS (SELECT query_name, query_start, arg_min({'e': query_end, 't': target_name, 's': target_start, 'c': cigar},
    {'t': target_name, 's': target_start, 'e': query_end, 'c': cigar}) AS b FROM blocks GROUP BY 1, 2),
follow AS (SELECT a.*, (SELECT min(n.query_start) FROM firsts n WHERE n.query_name = a.query_name AND n.query_start >= a.b.e) AS nxt FROM firsts a),
taken AS (SELECT f.* FROM follow f WHERE query_start = (SELECT min(query_start) FROM firsts g WHERE g.query_name = f.query_name)
  UNION ALL SELECT f.* FROM taken t JOIN follow f ON f.query_name = t.query_name AND f.query_start = t.nxt),
steps AS (SELECT query_name, query_start, b.t AS t, b.s AS s, unnest(regexp_extract_all(b.c, '(\d+)[=X]', 1))::BIGINT AS n,
    unnest(regexp_extract_all(b.c, '\d+([=X])', 1)) AS op, generate_subscripts(regexp_extract_all(b.c, '\d+[=X]'), 1) AS i FROM taken),
walked AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY query_name, query_start ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o FROM steps),
copies AS (SELECT query_name AS chrom, query_start + o AS qs, query_start + o + n AS qe, t AS ref_chrom, s + o AS rs, s + o + n AS re FROM walked WHERE op = '='),
led AS (SELECT *, CASE WHEN lag(qe) OVER w = qs AND lag(ref_chrom) OVER w = ref_chrom AND lag(re) OVER w = rs THEN 0 ELSE 1 END AS opens
  FROM copies WINDOW w AS (PARTITION BY chrom ORDER BY qs)),
linked AS (SELECT *, sum(opens) OVER (PARTITION BY chrom ORDER BY qs ROWS UNBOUNDED PRECEDING) AS run FROM led),
joined AS (SELECT chrom, min(ref_chrom) AS ref_chrom, min(rs) AS rs, max(re) AS re, min(qs) AS qs, max(qe) AS qe FROM linked GROUP BY chrom, run),
docs AS (SELECT coalesce(doc_id, -1) AS chrom, coalesce(text, '') AS text, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
voids AS (SELECT chrom, coalesce(lag(qe) OVER (PARTITION BY chrom ORDER BY qs), 0) AS qs, qs AS qe FROM
  (SELECT chrom, qs, qe FROM joined UNION ALL SELECT chrom, n, n FROM docs)),
pieces AS (SELECT chrom, 'copy' AS type, ref_chrom, rs, re, qs, qe FROM joined UNION ALL
  SELECT chrom, 'literal', NULL, NULL, NULL, qs, qe FROM voids WHERE qe > qs),
ops AS (SELECT p.chrom, row_number() OVER (PARTITION BY p.chrom ORDER BY qs) - 1 AS op_idx, type, ref_chrom, rs AS ref_start, re AS ref_end,
    CASE WHEN type = 'literal' THEN substr(hex(encode(d.text)), (2 * qs + 1)::BIGINT, (2 * (qe - qs))::BIGINT) END AS bytes
  FROM pieces p JOIN docs d ON d.chrom = p.chrom)"""
CUTS = MEMS + """,
sides AS (
  SELECT 'benchmark' AS g, target AS c, t_start AS s, t_end AS e, 'documents' AS g2, query AS c2,
         q_start AS s2 FROM mems
  UNION SELECT 'documents', query, q_start, q_end, 'benchmark', target, t_start FROM mems
),
cut(genome, chrom, pos) AS (
  SELECT * FROM (SELECT g, c, s FROM sides UNION SELECT g, c, e FROM sides)
  UNION
  SELECT g2, c2, s2 + pos - s FROM cut JOIN sides ON g = genome AND c = chrom
  WHERE pos > s AND pos < e
)"""
REGIONS = CUTS + """,
genomes AS (SELECT 'documents' AS genome, coalesce(source, '') AS assembly, doc_id AS chrom, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT 'benchmark', 'benchmark', item_id, coalesce(text, '') FROM benchmark),
len AS (SELECT genome, chrom, octet_length(encode(text)) AS n FROM genomes),
pts AS (
  SELECT genome, chrom, pos FROM cut JOIN len USING (genome, chrom) WHERE pos > 0 AND pos < n
  UNION SELECT genome, chrom, 0 FROM len UNION SELECT genome, chrom, n FROM len
),
spans AS (SELECT * FROM (SELECT genome, chrom, pos AS "start",
    lead(pos) OVER (PARTITION BY genome, chrom ORDER BY pos) AS "end" FROM pts) WHERE "end" IS NOT NULL),
cov AS (SELECT DISTINCT g AS genome, c AS chrom, s, e FROM sides),
f AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY genome, chrom ORDER BY s, e
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS f FROM cov),
nf AS (SELECT *, sum(f) OVER (PARTITION BY genome, chrom ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM f),
merged AS (SELECT genome, chrom, min(s) AS s, max(e) AS e FROM nf GROUP BY genome, chrom, g),
regions AS (SELECT p.genome, p.chrom, p."start", p."end", EXISTS (SELECT 1 FROM merged m WHERE m.genome = p.genome AND m.chrom = p.chrom
    AND m.s <= p."start" AND p."end" <= m.e) AS shared FROM spans p WHERE p."end" > p."start")"""
_REGION_TEXTS = """SELECT row_number() OVER (ORDER BY genome, chrom, "start") AS doc, assembly, genome, chrom, "start" AS at_, shared, h, octet_length(encode(h)) // 2 AS n
    FROM (SELECT r.*, assembly, substr(hex(encode(text)), (2 * r."start" + 1)::BIGINT, (2 * (r."end" - r."start"))::BIGINT) AS h
      FROM regions r JOIN genomes USING (genome, chrom))"""
SEGMENTS = f"""{REGIONS}, {chunk_sql([CHUNK], _REGION_TEXTS)},
segs AS (SELECT h.assembly, h.genome, h.chrom, row_number() OVER (PARTITION BY h.genome, h.chrom ORDER BY h.at_ + p.start) - 1 AS seg_idx,
    h.at_ + p.start AS start, p.length, p.hash, h.shared FROM pieces p JOIN hx h ON h.doc = p.chrom)"""

ORACLES = {
    "mem_all": f"WITH {MEMS} SELECT * FROM mems",
    "mem_maximal": f"WITH {LONGEST} SELECT * FROM longest",
    "mem_repeats": f"""WITH thrice AS (SELECT item_id, repeat(substr(text, 1, 60), 3) AS text FROM benchmark),
        later AS (SELECT item_id AS doc_id, substr(text, 4, 57) || repeat(substr(text, 1, 60), 4) AS text FROM benchmark),
        {_mems_of("thrice", "later")} SELECT * FROM mems""",
    "mem_verify": f"""WITH {MEMS},
        claims AS (
          SELECT query, target, t_start, q_start, t_end - t_start AS length, '+' AS strand FROM mems
          UNION ALL SELECT query, target, t_start + 1, q_start, t_end - t_start, '+' FROM mems
          UNION ALL SELECT query, target, t_start, q_start, t_end - t_start, '-' FROM mems
        ),
        x AS (SELECT c.*, hex(encode(b.text)) AS th, hex(encode(d.text)) AS qh
              FROM claims c JOIN benchmark b ON b.item_id = c.target
                            JOIN documents d ON d.doc_id = c.query)
        SELECT query, target, t_start, q_start, length, strand,
          t_start + length <= octet_length(encode(th)) // 2
          AND q_start + length <= octet_length(encode(qh)) // 2
          AND substr(th, 2 * t_start + 1, 2 * length) = CASE WHEN strand = '+'
            THEN substr(qh, 2 * q_start + 1, 2 * length)
            ELSE array_to_string(list_reverse(list_transform(
              regexp_extract_all(substr(qh, 2 * q_start + 1, 2 * length), '..'),
              lambda p: CASE WHEN p IN ('41', '61') THEN '54' WHEN p IN ('43', '63') THEN '47'
                WHEN p IN ('47', '67') THEN '43' WHEN p IN ('54', '74') THEN '41' ELSE '4E' END)), '')
            END AS valid
        FROM x""",
    "match_blocks": f"""WITH {BLOCKS} SELECT query_name, query_start, query_end, strand, target_name,
        target_start, target_end, matches, block_len, round(identity, 6) AS identity, cigar FROM blocks""",
    "match_block_runs": f"""WITH {MEMS} SELECT query AS query_name, target AS target_name, '+' AS strand,
        t_start AS target_start, t_end AS target_end, q_start AS query_start, q_end AS query_end
        FROM mems""",
    "delta_ops": f"WITH RECURSIVE {DELTA} SELECT * FROM ops",
    "delta_apply": f"""WITH RECURSIVE {DELTA},
        rebuilt AS (SELECT chrom, string_agg(CASE WHEN type = 'literal' THEN bytes ELSE substr(hex(encode(text)), 2 * ref_start + 1, 2 * (ref_end - ref_start)) END,
            '' ORDER BY op_idx) AS x FROM ops LEFT JOIN benchmark ON item_id = ref_chrom GROUP BY chrom)
        SELECT chrom, 'sha256:' || sha256(text) AS recorded, 'sha256:' || sha256(unhex(coalesce(x, ''))) AS rebuilt, coalesce(x, '') = hex(encode(text)) AS verified
        FROM docs LEFT JOIN rebuilt USING (chrom)""",
    "delta_summary": f"""WITH RECURSIVE {DELTA}
        SELECT chrom, coalesce(lit, 0) AS literal, coalesce(cop, 0) AS copied, coalesce(n_ops, 0) AS ops, coalesce(lit, 0) + coalesce(cop, 0) AS total,
            CASE WHEN coalesce(lit, 0) + coalesce(cop, 0) = 0 THEN 0.0 ELSE round(100.0 * lit / (lit + cop), 6) END AS literal_pct
        FROM (SELECT DISTINCT chrom FROM docs) LEFT JOIN (SELECT chrom, sum(coalesce(length(bytes), 0) // 2)::BIGINT AS lit, sum(coalesce(ref_end - ref_start, 0))::BIGINT AS cop,
            count(*) AS n_ops FROM ops GROUP BY chrom) USING (chrom)""",
    "delta_ref_gap": f"""WITH RECURSIVE {DELTA}
        SELECT chrom, op_idx, ref_start - coalesce(lag(ref_end) OVER (PARTITION BY chrom ORDER BY op_idx), 0) AS ref_gap FROM ops WHERE type = 'copy'""",
    "cut_propagation": f"WITH RECURSIVE {CUTS} SELECT * FROM cut",
    "reindex_regions": f"WITH RECURSIVE {REGIONS} SELECT * FROM regions",
    "reindex_segments": f"WITH RECURSIVE {SEGMENTS} SELECT * FROM segs",
    "reindex_summary": f"""WITH RECURSIVE {SEGMENTS},
        counts AS (SELECT hash, min(length) AS length, count(DISTINCT assembly) AS rc FROM segs GROUP BY hash),
        known AS (SELECT count(DISTINCT assembly) AS n FROM genomes)
        SELECT CAST(max(n) AS BIGINT) AS genomes, count(*) AS segments,
          CAST(sum(CASE WHEN rc = n THEN length ELSE 0 END) AS BIGINT) AS core_bytes,
          CAST(sum(CASE WHEN rc <> n AND rc <> 1 THEN length ELSE 0 END) AS BIGINT) AS partial_bytes,
          CAST(sum(CASE WHEN rc <> n AND rc = 1 THEN length ELSE 0 END) AS BIGINT) AS unique_bytes,
          CAST(sum(length) AS BIGINT) AS stored_bytes, CAST(sum(length * rc) AS BIGINT) AS naive_bytes FROM counts, known""",
}
