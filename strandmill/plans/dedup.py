"""Deduplication, coverage and transfer-plan queries over the document corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandmill.operators import network, segments
from strandmill.plans import corpus

SEG = """
seg AS (
  SELECT d.source AS assembly, d.lang AS organism, d.doc_id AS chrom, t.i - 1 AS seg_idx,
         d.l[t.i] AS data, 'sha256:' || sha256(d.l[t.i]) AS hash,
         octet_length(encode(d.l[t.i])) AS length
  FROM (SELECT *, string_split(text, chr(10)) AS l FROM documents) d,
       unnest(range(1, len(d.l) + 1)) AS t(i)
)"""
REFS = SEG + """,
refs AS (
  SELECT hash, assembly, min(length) AS length, count(*) AS occurrences
  FROM seg GROUP BY hash, assembly
),
counts AS (
  SELECT hash, max(length) AS length, count(*) AS rc, min(assembly) AS owner,
         sum(occurrences) AS occurrences
  FROM refs GROUP BY hash
),
ng AS (SELECT count(DISTINCT source) AS n FROM documents)"""
HELD = """,
held AS (
  SELECT DISTINCT hash FROM seg WHERE chrom IN (SELECT doc_id FROM labels WHERE quality = 1)
)"""
SUMMARY = """,
summary AS (
  SELECT CAST(max(n) AS BIGINT) AS genomes, count(*) AS segments,
    CAST(sum(CASE WHEN rc = n THEN length ELSE 0 END) AS BIGINT) AS core_bytes,
    CAST(sum(CASE WHEN rc <> n AND rc <> 1 THEN length ELSE 0 END) AS BIGINT) AS partial_bytes,
    CAST(sum(CASE WHEN rc <> n AND rc = 1 THEN length ELSE 0 END) AS BIGINT) AS unique_bytes,
    CAST(sum(length) AS BIGINT) AS stored_bytes,
    CAST(sum(length * rc) AS BIGINT) AS naive_bytes
  FROM counts, ng
)"""


def _refs(spark, sf):
    return segments.references(corpus.manifest(spark, sf))


def _counts(spark, sf):
    return segments.refcounts(_refs(spark, sf))


def dedup_summary(spark, sf):
    return segments.summary(_counts(spark, sf), corpus.genomes(spark, sf))


def dedup_savings(spark, sf):
    return segments.savings(dedup_summary(spark, sf))


def dedup_unique_per_assembly(spark, sf):
    return segments.unique_per_genome(_counts(spark, sf), corpus.genomes(spark, sf))


def segment_refcount(spark, sf):
    return _counts(spark, sf).select("hash", "length", "rc")


def segment_referenced_by(spark, sf):
    return _refs(spark, sf).select("hash", "assembly")


def segment_table_top(spark, sf):
    m = corpus.manifest(spark, sf)
    return segments.segment_table(m, segments.references(m), limit=50)


def genome_list(spark, sf):
    """Genomes known to the index, read off the references."""
    return corpus.manifest(spark, sf).select("assembly").distinct()


def viz_bar_widths(spark, sf):
    return segments.bar_cells(
        corpus.manifest(spark, sf), _counts(spark, sf), corpus.genomes(spark, sf)
    )


def core_partial_unique_label(spark, sf):
    n = segments.genome_count(corpus.genomes(spark, sf))
    tiered = _counts(spark, sf).withColumn("n", n)
    return tiered.groupBy(segments.tier(F.col("rc"), F.col("n")).alias("tier")).agg(
        F.count(F.lit(1)).alias("segments"), F.sum("length").alias("bytes")
    )


def store_dedup_insert(spark, sf):
    return segments.insert_new(corpus.manifest(spark, sf), corpus.held(spark, sf))


def store_delete(spark, sf):
    stored = _counts(spark, sf).select("hash", "length")
    return segments.delete_hashes(stored, corpus.held(spark, sf))


def manifest_missing_count(spark, sf):
    return segments.admission(_refs(spark, sf), corpus.held(spark, sf))


def fetch_plan(spark, sf):
    return segments.fetch_plan(_refs(spark, sf), corpus.held(spark, sf))


def publish_plan(spark, sf):
    return segments.publish_plan(corpus.manifest(spark, sf), corpus.held(spark, sf))


def coverage_per_assembly(spark, sf):
    cov = segments.coverage(_refs(spark, sf), corpus.held(spark, sf))
    return cov.withColumn("state", segments.coverage_state(F.col("have"), F.col("total")))


def coverage_per_chromosome(spark, sf):
    return segments.chromosome_coverage(
        corpus.manifest(spark, sf), _counts(spark, sf), corpus.held(spark, sf)
    )


def chromosome_picker(spark, sf):
    """Chromosomes offered for download: those not yet fully held."""
    return coverage_per_chromosome(spark, sf).where("have < segments")


def seed_stats(spark, sf):
    """Fully and not fully held genomes with the summed coverage."""
    return coverage_per_assembly(spark, sf).agg(
        F.count(F.lit(1)).alias("manifests"),
        F.count_if(F.col("state") == "full").alias("full"),
        F.count_if(F.col("state") != "full").alias("partial"),
        F.sum("have").alias("have"),
        F.sum("total").alias("total"),
    )


def delete_plan(spark, sf):
    refs = _refs(spark, sf)
    return segments.delete_plan(segments.refcounts(refs), refs)


def index_remove_genome(spark, sf):
    left = segments.refcounts(segments.remove_genome(_refs(spark, sf), "src0"))
    return left.select("hash", "length", "rc")


def benchmark_intersect(spark, sf):
    return segments.neighbour_sharing(_refs(spark, sf), corpus.genomes(spark, sf))


def mirror_totals(spark, sf):
    """Objects a static mirror holds: distinct segments, their bytes and manifests."""
    genomes = segments.genome_count(corpus.genomes(spark, sf))
    return _counts(spark, sf).agg(
        F.count(F.lit(1)).alias("objects"), F.sum("length").alias("bytes")
    ).withColumn("manifests", genomes)


def catalog_overlay(spark, sf):
    own = corpus.table(spark, sf, "labels").select(
        "doc_id", F.lit("local").alias("origin")
    )
    cached = corpus.table(spark, sf, "documents").select(
        "doc_id", F.lit("cached").alias("origin")
    )
    return network.overlay(own, cached, "doc_id")


def registry_summary(spark, sf):
    refs = _refs(spark, sf)
    return network.registry(corpus.documents(spark, sf), refs)


def discover_union(spark, sf):
    docs = corpus.documents(spark, sf)
    return network.discover(
        docs, corpus.lines(docs).drop("data"), corpus.held(spark, sf), local_node="de"
    )


QUERIES = {
    f.__name__: f
    for f in (
        dedup_summary, dedup_savings, dedup_unique_per_assembly, segment_refcount,
        segment_referenced_by, segment_table_top, genome_list, viz_bar_widths,
        core_partial_unique_label, store_dedup_insert, store_delete, manifest_missing_count,
        fetch_plan, publish_plan, coverage_per_assembly, coverage_per_chromosome,
        chromosome_picker, seed_stats, delete_plan, index_remove_genome,
        benchmark_intersect, mirror_totals, catalog_overlay, registry_summary, discover_union,
    )
}

_COVERAGE = """,
cov AS (
  SELECT r.assembly, count(h.hash) AS have, count(*) AS total
  FROM refs r LEFT JOIN held h USING (hash) GROUP BY r.assembly
),
states AS (
  SELECT assembly, have, total, CASE WHEN have >= total THEN 'full'
         WHEN have > 0 THEN 'partial' ELSE 'empty' END AS state FROM cov
)"""
_CHROM = """,
chrom_cov AS (
  SELECT s.assembly, s.chrom, count(h.hash) AS have, count(*) AS segments
  FROM seg s LEFT JOIN held h USING (hash) GROUP BY s.assembly, s.chrom
)"""

ORACLES = {
    "dedup_summary": f"WITH {REFS}{SUMMARY} SELECT * FROM summary",
    "dedup_savings": f"""WITH {REFS}{SUMMARY}
        SELECT stored_bytes, naive_bytes, naive_bytes - stored_bytes AS saved_bytes,
               round((naive_bytes - stored_bytes) * 100.0 / naive_bytes, 6) AS saved_pct
        FROM summary""",
    "dedup_unique_per_assembly": f"""WITH {REFS}
        SELECT g.assembly, CAST(coalesce(sum(c.length), 0) AS BIGINT) AS unique_bytes
        FROM (SELECT DISTINCT source AS assembly FROM documents) g
        LEFT JOIN (SELECT * FROM counts, ng WHERE rc = 1 AND n > 1) c ON c.owner = g.assembly
        GROUP BY g.assembly""",
    "segment_refcount": f"WITH {REFS} SELECT hash, length, rc FROM counts",
    "segment_referenced_by": f"WITH {SEG} SELECT DISTINCT hash, assembly FROM seg",
    "segment_table_top": f"""WITH {REFS},
        first AS (
          SELECT hash, min(length) AS length, min(row(assembly, chrom, seg_idx)) AS p
          FROM seg GROUP BY hash
        ),
        place AS (
          SELECT hash, length, assembly, chrom, seg_idx FROM (
            SELECT *, row_number() OVER (PARTITION BY hash ORDER BY assembly, chrom, seg_idx) AS r
            FROM seg) WHERE r = 1
          ORDER BY assembly, chrom, seg_idx LIMIT 50
        )
        SELECT p.hash, p.length, p.assembly, p.chrom, p.seg_idx,
               (SELECT string_agg(r.assembly, ', ' ORDER BY r.assembly)
                FROM refs r WHERE r.hash = p.hash) AS referenced_by
        FROM place p""",
    "genome_list": "SELECT DISTINCT source AS assembly FROM documents",
    "viz_bar_widths": f"""WITH {REFS},
        widest AS (SELECT max(t) AS m FROM
          (SELECT sum(length) AS t FROM seg GROUP BY assembly))
        SELECT s.assembly, s.chrom, s.seg_idx, s.length,
               CAST(greatest(1, (60 * s.length) // m) AS BIGINT) AS width,
               CASE WHEN rc = n THEN 'COR' WHEN rc > 1 THEN 'PAR' ELSE 'UNQ' END AS label
        FROM seg s JOIN counts USING (hash), widest, ng""",
    "core_partial_unique_label": f"""WITH {REFS}
        SELECT CASE WHEN rc = n THEN 'core' WHEN rc = 1 THEN 'unique' ELSE 'partial' END AS tier,
               count(*) AS segments, CAST(sum(length) AS BIGINT) AS bytes
        FROM counts, ng GROUP BY 1""",
    "store_dedup_insert": f"""WITH {SEG}{HELD}
        SELECT DISTINCT hash, length FROM seg WHERE hash NOT IN (SELECT hash FROM held)""",
    "store_delete": f"""WITH {SEG}{HELD}
        SELECT DISTINCT hash, length FROM seg WHERE hash NOT IN (SELECT hash FROM held)""",
    "manifest_missing_count": f"""WITH {SEG}{HELD}
        SELECT s.assembly, count(*) - count(h.hash) AS missing,
               count(*) = count(h.hash) AS admitted
        FROM seg s LEFT JOIN held h USING (hash) GROUP BY s.assembly""",
    "fetch_plan": f"""WITH {REFS}{HELD}
        SELECT r.assembly, r.hash,
               CASE WHEN h.hash IS NULL THEN 'missing' ELSE 'have' END AS state
        FROM refs r LEFT JOIN held h USING (hash)""",
    "publish_plan": f"""WITH {SEG}{HELD}
        SELECT assembly, hash, chrom, seg_idx FROM (
          SELECT *, row_number() OVER (PARTITION BY assembly, hash ORDER BY chrom, seg_idx) AS r
          FROM seg) WHERE r = 1 AND hash NOT IN (SELECT hash FROM held)""",
    "coverage_per_assembly": f"WITH {REFS}{HELD}{_COVERAGE} SELECT * FROM states",
    "coverage_per_chromosome": f"WITH {SEG}{HELD}{_CHROM} SELECT * FROM chrom_cov",
    "chromosome_picker": f"WITH {SEG}{HELD}{_CHROM} SELECT * FROM chrom_cov WHERE have < segments",
    "seed_stats": f"""WITH {REFS}{HELD}{_COVERAGE}
        SELECT count(*) AS manifests, count(*) FILTER (state = 'full') AS "full",
               count(*) FILTER (state <> 'full') AS partial,
               CAST(sum(have) AS BIGINT) AS have, CAST(sum(total) AS BIGINT) AS total
        FROM states""",
    "delete_plan": f"""WITH {SEG}, own AS (SELECT DISTINCT assembly, hash FROM seg)
        SELECT a.assembly, count(*) FILTER (b.hash IS NULL) AS deleted,
               count(*) FILTER (b.hash IS NOT NULL) AS kept
        FROM own a LEFT JOIN (SELECT hash FROM own GROUP BY hash HAVING count(*) > 1) b
             USING (hash)
        GROUP BY a.assembly""",
    "index_remove_genome": f"""WITH {SEG}
        SELECT hash, min(length) AS length, count(DISTINCT assembly) AS rc
        FROM seg WHERE assembly <> 'src0' GROUP BY hash""",
    "benchmark_intersect": f"""WITH {SEG},
        p AS (SELECT * FROM (SELECT assembly AS b, lag(assembly) OVER (ORDER BY assembly) AS a
              FROM (SELECT DISTINCT assembly FROM seg)) WHERE a IS NOT NULL),
        sz AS (SELECT assembly, count(*) AS n FROM seg GROUP BY assembly),
        sh AS (SELECT p.a, p.b, count(*) FILTER (EXISTS
                 (SELECT 1 FROM seg x WHERE x.assembly = p.a AND x.hash = s.hash)) AS shared
               FROM p JOIN seg s ON s.assembly = p.b GROUP BY p.a, p.b)
        SELECT sh.a, sh.b, x.n AS segments_a, y.n AS segments_b, sh.shared,
               x.n + y.n - sh.shared AS unique_segments,
               round(sh.shared / (x.n + y.n), 6) AS dedup_ratio
        FROM sh JOIN sz x ON x.assembly = sh.a JOIN sz y ON y.assembly = sh.b""",
    "mirror_totals": f"""WITH {REFS}
        SELECT count(*) AS objects, CAST(sum(length) AS BIGINT) AS bytes,
               CAST(max(n) AS BIGINT) AS manifests FROM counts, ng""",
    "catalog_overlay": """
        SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'cached' ELSE 'local' END AS origin
        FROM documents d FULL OUTER JOIN labels l ON l.doc_id = d.doc_id""",
    "registry_summary": f"""WITH {SEG}
        SELECT assembly, count(DISTINCT hash) AS segments,
               CAST(sum(length) AS BIGINT) AS bases,
               count(DISTINCT chrom) AS version, arg_min(organism, chrom) AS organism
        FROM seg GROUP BY assembly""",
    "discover_union": f"""WITH {SEG}{HELD},
        entry AS (
          SELECT organism AS node, assembly, count(DISTINCT chrom) AS version,
                 count(DISTINCT hash) AS segments
          FROM seg GROUP BY organism, assembly
        ),
        ranked AS (
          SELECT *, row_number() OVER (PARTITION BY assembly ORDER BY version DESC, node) AS r,
                 count(*) OVER (PARTITION BY assembly) AS sources,
                 bool_or(node = 'de') OVER (PARTITION BY assembly) AS local
          FROM entry
        ),
        win AS (SELECT * FROM ranked WHERE r = 1)
        SELECT w.assembly, w.node, w.version, w.segments, w.sources, w.local,
               (SELECT count(DISTINCT s.hash) FROM seg s JOIN held h ON h.hash = s.hash
                WHERE s.assembly = w.assembly AND s.organism = w.node) AS have
        FROM win w""",
}
