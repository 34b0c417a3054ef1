"""The registered queries of this folder and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandmill.llm import decontaminate, hard_negatives, language, near_dup, neighbours, ngram_model, packing, page_text, pieces, substrings, turn_trie, url_filter, wavelet


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_simhash(spark, sf_dir):
    found = near_dup.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op1_lm_scores(spark, sf_dir):
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 0
    found = ngram_model.score(_table(spark, sf_dir, "documents"), ~held_out)
    return found.select(
        F.col("id").alias("doc_id"), (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_packing(spark, sf_dir):
    return packing.pack_digests(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_neighbours(spark, sf_dir):
    found = neighbours.search(_table(spark, sf_dir, "embeddings"))
    return found.withColumnRenamed("id", "vec_id")


def op4_page_text(spark, sf_dir):
    found = page_text.extract(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op5_decontaminate(spark, sf_dir):
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def op6_substrings(spark, sf_dir):
    return substrings.report(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_wavelet(spark, sf_dir):
    folder = wavelet.write_shards(_table(spark, sf_dir, "documents"))
    return wavelet.shard_digests(spark, folder).withColumnRenamed("id", "doc_id")


def op7_language(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    found = language.predict(docs.select("doc_id", "text"), language.fit(docs))
    held_out = ~language.learns()
    return found.select("doc_id", held_out.alias("held_out"), "language.lang_pred", "language.score")


def op10_urls(spark, sf_dir):
    found = url_filter.judge(_table(spark, sf_dir, "pages").select("page_id", "url"))
    return found.select("page_id", *[f"url_verdict.{c}" for c in ("host", "path", "rule", "verdict")])


def op11_hard_negatives(spark, sf_dir):
    label = F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)")
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings"), label_col=label)


def op12_turn_trie(spark, sf_dir):
    return turn_trie.prefix_nodes(_table(spark, sf_dir, "conversations"))


def op13_pieces(spark, sf_dir):
    found = pieces.decode(pieces.encode(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select(
        "doc_id", (F.octet_length("piece_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("piece_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {
    f.__name__: f
    for f in (op1_lm_scores, op2_packing, op3_neighbours, op4_page_text, op5_decontaminate, op6_substrings, op7_language, op8_simhash, op9_wavelet, op10_urls, op11_hard_negatives, op12_turn_trie, op13_pieces)
}
_OP5 = r"""
    WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    runs AS (SELECT DISTINCT item, size, array_to_string(w[i:i + size - 1], ' ') AS run FROM
            (SELECT item, w, least(13, len(w)) AS size, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
    sizes AS (SELECT DISTINCT size FROM runs),
    places AS (SELECT r, i, size, array_to_string(w[i:i + size - 1], ' ') AS run FROM
            (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, sizes WHERE len(w) >= size)),
    hits AS (SELECT r, i, p.size, item FROM places p JOIN runs USING (size, run)),
    words AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS pos FROM (SELECT DISTINCT r, i, size FROM hits)) GROUP BY r),
    found AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
        sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM docs LEFT JOIN words USING (r) LEFT JOIN found USING (r)"""

_OP6 = r"""
    WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    runs AS (SELECT r, doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS run FROM
            (SELECT r, doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM docs WHERE len(w) >= 20)),
    firsts AS (SELECT run, min({'d': doc_id, 'i': i}) AS first FROM runs GROUP BY run HAVING count(*) > 1),
    gone AS (SELECT DISTINCT r, unnest(range(i, i + 20)) AS pos FROM runs JOIN firsts USING (run) WHERE {'d': doc_id, 'i': i} > first),
    lists AS (SELECT r, list(pos) AS ats, count(*) AS n FROM gone GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
        sha256(coalesce(array_to_string(CASE WHEN n IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ats, i)) END, ' '), '')) AS kept_sha256
    FROM docs LEFT JOIN lists USING (r)"""

ORACLES: dict[str, str] = {"op5_decontaminate": _OP5, "op6_substrings": _OP6, "op10_urls": url_filter.oracle_sql(),
    "op11_hard_negatives": hard_negatives.oracle_sql(), "op12_turn_trie": turn_trie.oracle_sql()}
