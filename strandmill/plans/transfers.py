"""Which genomes can be rebuilt, and what has to be fetched for them.

Each document is a genome of its own here.  Documents of good quality are held as manifests; the
others are deltas, as recipes if their id is even and as files if it is odd, against the document whose id
is the remainder of 7 id + id div 3 divided by the number of documents.  Toxic documents are the wanted
ones, and the segments held are those of good ones.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strandmill.operators import artifacts, network, segments
from strandmill.plans import corpus
from strandmill.plans.content import chunk_sql
from strandmill.session import checkpoint_dir
from strandmill.sources import snapshots

_REF = "(7 * id + id div 3) % n"


def _entries(spark, sf):
    docs = corpus.documents(spark, sf).select(F.col("chrom").alias("assembly"))
    good = corpus.table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("assembly")).distinct()
    delta = F.when(F.col("assembly") % 2 == 0, artifacts.RECIPE).otherwise(artifacts.DELTA)
    whole = good.join(docs, "assembly", "left_semi").select("assembly", F.lit(artifacts.MANIFEST).alias("kind"))
    return docs.join(good, "assembly", "left_anti").select("assembly", delta.alias("kind")).unionByName(whole)


def _needs(spark, sf):
    docs = corpus.documents(spark, sf).select(F.col("chrom").alias("assembly"))
    return docs.withColumn("n", docs.agg(F.count(F.lit(1))).scalar()).select("assembly", F.expr(_REF.replace("id", "assembly")).alias("reference"))


def artifact_dispatch(spark, sf):
    entries = _entries(spark, sf)
    return artifacts.dispatch(entries).join(artifacts.serves_delta(entries), "assembly")


def rebuild_plan(spark, sf):
    return artifacts.rebuild_plan(_entries(spark, sf), _needs(spark, sf))


def download_closure(spark, sf):
    wanted = corpus.table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("assembly"))
    contents = corpus.manifest(spark, sf).select(F.col("chrom").alias("assembly"), "hash", "length")
    return artifacts.download_closure(wanted, _entries(spark, sf), _needs(spark, sf), contents, corpus.held(spark, sf))


def chrom_subset_hashes(spark, sf):
    """Segments of the toxic documents, by assembly."""
    toxic = corpus.table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("chrom")).distinct()
    chroms = corpus.documents(spark, sf).select("assembly", "chrom").join(toxic, "chrom", "left_semi")
    return segments.chromosome_hashes(corpus.manifest(spark, sf), chroms)


def chrom_filter(spark, sf):
    """The chromosome with the smallest number, line by line."""
    manifest = corpus.manifest(spark, sf)
    return segments.only_chromosome(manifest, manifest.agg(F.min("chrom")).scalar()).select("assembly", "chrom", "seg_idx", "hash", "length")


def index_drop_reference(spark, sf):
    """Reference counts after each assembly gave up the segments of its toxic documents."""
    refs = segments.references(corpus.manifest(spark, sf))
    return segments.refcounts(segments.drop_reference(refs, chrom_subset_hashes(spark, sf))).select("hash", "length", "rc")


def request_attribution(spark, sf):
    """Requests for segments, manifests and deltas, counted by the assembly they are for."""
    m = corpus.manifest(spark, sf)
    paths = m.select(F.explode(F.array(
        F.concat(F.lit("/segments/"), F.col("hash")), F.concat(F.lit("/segments/gone"), F.col("seg_idx").cast("string")),
        F.concat(F.lit("/genomes/"), F.col("assembly"), F.lit("/manifest")), F.concat(F.lit("/deltas/"), F.col("assembly")))).alias("path"))
    found = network.attribute_requests(paths, segments.references(m))
    kind = F.regexp_extract("path", "^/([a-z]+)/", 1)
    return found.groupBy("assembly", kind.alias("kind")).agg(F.count(F.lit(1)).alias("requests"))


CHUNK = (64, 1_024)


def import_snapshots(spark, sf):
    """All documents imported into an empty store, imported again, and without the toxic ones.

    One row per import: the snapshot it ended at, what it added, and what the newest view then holds."""
    root = f"{checkpoint_dir(spark).rstrip('/')}/imports-{uuid.uuid4().hex}"
    docs = corpus.documents(spark, sf).select("assembly", "organism", F.col("chrom").alias("chrom_idx"), "chrom", F.col("text").alias("seq"))
    toxic = corpus.table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("chrom"))
    out = []
    for step, given in enumerate((docs, docs, docs.join(toxic, "chrom", "left_anti"))):
        found = snapshots.import_genomes(spark, root, given, CHUNK)
        store = found.store().agg(F.count(F.lit(1)).alias("store_segments"), F.coalesce(F.sum("length"), F.lit(0)).alias("store_bytes"))
        view = found.manifest().agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("assembly").alias("genomes"), F.count_distinct("hash").alias("hashes"))
        log = found.log().agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("logged_bytes"))
        one = store.join(view).join(log)  # three single rows
        out.append(one.select(F.lit(step).alias("step"), F.lit(found.number).alias("snapshot"), *one.columns))
    return out[0].unionByName(out[1]).unionByName(out[2])


QUERIES = {
    f.__name__: f
    for f in (artifact_dispatch, rebuild_plan, download_closure, chrom_subset_hashes, chrom_filter, index_drop_reference, request_attribution, import_snapshots)
}

_LINES = """lines AS (SELECT coalesce(source, '') AS assembly, doc_id AS chrom, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seg_idx FROM documents WHERE text IS NOT NULL),
m AS (SELECT assembly, chrom, seg_idx::BIGINT AS seg_idx, 'sha256:' || sha256(line) AS hash, octet_length(encode(line)) AS length FROM lines)"""
_FORMS = """forms AS (SELECT doc_id AS id, CASE WHEN EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1) THEN 'manifest'
    WHEN doc_id % 2 = 0 THEN 'recipe' ELSE 'delta' END AS kind, (7 * doc_id + doc_id // 3) % (SELECT count(*) FROM documents) AS ref FROM documents d)"""
_SUBSET = """toxic AS (SELECT assembly, hash, min(length) AS length FROM m WHERE chrom IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY 1, 2)"""

ORACLES = {
    "artifact_dispatch": f"WITH {_FORMS} SELECT id AS assembly, kind, kind <> 'manifest' AS delta FROM forms",
    "rebuild_plan": f"""WITH RECURSIVE {_FORMS},
        walk(assembly, here, path) AS (
          SELECT id, id, [id] FROM forms
          UNION ALL
          SELECT w.assembly, f.ref, list_append(path, f.ref) FROM walk w JOIN forms f ON f.id = w.here
          WHERE f.kind <> 'manifest' AND len(list_distinct(path)) = len(path)),
        far AS (SELECT assembly, arg_max(here, len(path)) AS here, max(len(path)) AS n FROM walk GROUP BY assembly)
        SELECT assembly, f.kind, CASE WHEN b.kind = 'manifest' THEN here END AS base, CASE WHEN b.kind = 'manifest' THEN n - 1 END AS level,
          CASE WHEN b.kind = 'manifest' THEN 'ready' WHEN here = assembly THEN 'cycle' ELSE 'behind_cycle' END AS state
        FROM far JOIN forms f ON f.id = assembly JOIN forms b ON b.id = here""",
    "download_closure": f"""WITH RECURSIVE {_LINES}, {_FORMS},
        need(id) AS (SELECT doc_id FROM labels WHERE toxic = 1 UNION SELECT f.ref FROM need n JOIN forms f ON f.id = n.id WHERE kind <> 'manifest')
        SELECT hash, min(length) AS length, CASE WHEN hash IN (SELECT hash FROM m WHERE chrom IN (SELECT doc_id FROM labels WHERE quality = 1))
          THEN 'have' ELSE 'missing' END AS state FROM m WHERE chrom IN (SELECT id FROM need) GROUP BY hash""",
    "chrom_subset_hashes": f"WITH {_LINES}, {_SUBSET} SELECT * FROM toxic",
    "chrom_filter": f"WITH {_LINES} SELECT * FROM m WHERE chrom = (SELECT min(chrom) FROM m)",
    "index_drop_reference": f"""WITH {_LINES}, {_SUBSET}, refs AS (SELECT hash, assembly, min(length) AS length FROM m GROUP BY 1, 2)
        SELECT hash, max(length) AS length, count(*) AS rc FROM refs r WHERE NOT EXISTS
          (SELECT 1 FROM toxic t WHERE t.hash = r.hash AND t.assembly = r.assembly) GROUP BY hash""",
    "request_attribution": f"""WITH {_LINES}, owner AS (SELECT hash, min(assembly) AS assembly FROM m GROUP BY hash)
        SELECT o.assembly, 'segments' AS kind, count(*) AS requests FROM m JOIN owner o USING (hash) GROUP BY 1
        UNION ALL SELECT NULL, 'segments', count(*) FROM m
        UNION ALL SELECT assembly, 'genomes', count(*) FROM m GROUP BY 1
        UNION ALL SELECT assembly, 'deltas', count(*) FROM m GROUP BY 1""",
    "import_snapshots": f"""WITH RECURSIVE {chunk_sql([CHUNK])},
        store AS (SELECT hash, min(length) AS length FROM pieces GROUP BY hash),
        left_over AS (SELECT * FROM pieces WHERE chrom NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)),
        hit AS (SELECT DISTINCT source AS assembly FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 AND text <> ''),
        views AS (SELECT 0 AS step, * FROM pieces UNION ALL SELECT 1, * FROM pieces UNION ALL SELECT 2, * FROM left_over)
        SELECT step, CASE WHEN step = 2 THEN 2 ELSE 1 END AS snapshot, (SELECT count(*) FROM store) AS store_segments,
          (SELECT sum(length)::BIGINT FROM store) AS store_bytes, count(*) AS rows, count(DISTINCT assembly) AS genomes, count(DISTINCT hash) AS hashes,
          ((SELECT sum(length) FROM pieces) + CASE WHEN step = 2 THEN (SELECT sum(length) FROM left_over JOIN hit USING (assembly)) ELSE 0 END)::BIGINT AS logged_bytes
        FROM views GROUP BY step""",
}
