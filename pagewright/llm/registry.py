"""Queries of the llm operators with their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from pagewright.llm import (
    bpe, centroid_clustering, embedding_dedup, exact_dedup, fingerprints, hard_negatives, language_id, lm_scoring, near_dedup, packing, quality, scratch, substring_dedup, url_filter,
)

#: Rules of the url query: (host and path, blocked?).
URL_RULES = [("org/", False), ("example.org/es/", True), ("example.org/en/1", True), ("com/fr/", False), ("com/de/", True)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    scratch.ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.components_of(table(spark, sf_dir, "documents"), width=2, percent=80)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predictions(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeats(table(spark, sf_dir, "documents"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.scores(table(spark, sf_dir, "documents"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decisions(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clustering.clusters(table(spark, sf_dir, "embeddings"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_and_next(table(spark, sf_dir, "documents"))


def queries():
    return {"op1_url_filter": op1_url_filter, "op2_near_dedup": op2_near_dedup, "op3_bpe": op3_bpe, "op4_language_id": op4_language_id, "op5_quality": op5_quality, "op6_packing": op6_packing, "op7_substring_dedup": op7_substring_dedup, "op8_lm_scoring": op8_lm_scoring, "op9_embedding_dedup": op9_embedding_dedup, "op10_exact_dedup": op10_exact_dedup, "op11_hard_negatives": op11_hard_negatives, "op12_centroid_clustering": op12_centroid_clustering, "op13_fingerprints": op13_fingerprints}


OP1_SQL = """
WITH u AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), s AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), r(h, p, v) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), m AS (
  SELECT page_id, host, path, h || p AS rule, v FROM s JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
), best AS (
  SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(v, length(rule)) AS v FROM m GROUP BY page_id, host, path
)
SELECT s.page_id, s.host, s.path, b.rule, coalesce(b.v, 'allow') AS verdict
FROM s LEFT JOIN best b ON s.page_id IS NOT DISTINCT FROM b.page_id AND s.host = b.host AND s.path = b.path
"""

OP10_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS normal FROM documents),
g AS (SELECT normal, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY normal)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t.normal) AS text_sha256
FROM t JOIN g ON t.normal = g.normal
"""


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS s FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * common >= 80 * (x.n + y.n - common)
), link AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN c ON d.doc_id = c.a LEFT JOIN n ON d.doc_id = n.doc_id
"""

OP9_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), u AS (
  SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) >= 0.9
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN comp ON vec_id = comp.a LEFT JOIN degree ON vec_id = degree.a
"""


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
), p AS (
  SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5
), n AS (
  SELECT p.a, p.b AS p, s.b AS n, p.score AS ps, s.score AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS rank
  FROM p JOIN s ON p.a = s.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
)
SELECT a AS anchor_id, p AS positive_id, CAST(rank AS INTEGER) AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE rank <= 5
"""


def op12_sql(k: int = 8, rounds: int = 10, scale: int = 1024, dim: int = 64, seed: int = 3) -> str:
    """One CTE a round for the assignment and one for the centroids."""
    parts = [f"""v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('{seed}:' || CAST(vec_id AS VARCHAR))) - 1 AS INTEGER) AS j, e FROM v ORDER BY j LIMIT {k}
)"""]
    distance = "list_sum(list_transform(list_zip(v.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, any_value(v.e) AS e, CAST(min(struct_pack(d := CAST({distance} AS BIGINT), j := j)) AS STRUCT(d BIGINT, j INTEGER)) AS s FROM v CROSS JOIN c{r} c GROUP BY vec_id)")
        if r < rounds:
            parts.append(f"""m{r} AS MATERIALIZED (
  SELECT j, list(x ORDER BY i) AS e FROM (
    SELECT s.j AS j, i, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS x FROM (SELECT s, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM a{r}) GROUP BY 1, 2
  ) GROUP BY j
), c{r + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.e, c.e) AS e FROM c{r} c LEFT JOIN m{r} m ON c.j = m.j)""")
    return "WITH " + ", ".join(parts) + f"""
SELECT vec_id, s.j AS cluster, s.d AS distance, CAST(sum(s.d) OVER (PARTITION BY s.j) AS BIGINT) AS cluster_inertia, CAST(sum(s.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.s.j = c.j"""


OP13_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id) AS k, count(*) OVER () AS n FROM documents
), e AS (
  SELECT a.doc_id, a.text, b.text AS next, CAST(length(a.text) AS BIGINT) AS n_chars, left(a.text, length(a.text) - length(a.text) // 4) || left(b.text, length(a.text) // 4) AS edited
  FROM t a JOIN t b ON b.k = a.k % a.n + 1
), texts AS (
  SELECT doc_id, 1 AS kind, text FROM e UNION ALL SELECT doc_id, 2, edited FROM e UNION ALL SELECT doc_id, 3, next FROM e
), w AS (
  SELECT doc_id, kind, list_filter(string_split(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), 'abcdefghijklmnopqrstuvwxyz     '), ' '), lambda x: x <> '') AS w FROM texts
), g AS (
  SELECT doc_id, kind, w, i, n, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2, lead(w, 3) OVER o AS w3, lead(w, 4) OVER o AS w4
  FROM (SELECT doc_id, kind, unnest(w) AS w, generate_subscripts(w, 1) AS i, len(w) AS n FROM w) WINDOW o AS (PARTITION BY doc_id, kind ORDER BY i)
), f AS (
  SELECT doc_id, kind, list(left(md5(concat_ws(' ', w, w1, w2, w3, w4)), 16)) AS h FROM g WHERE i <= greatest(n - 4, 1) GROUP BY doc_id, kind
), h AS (
  SELECT w.doc_id, w.kind, coalesce(h, []) AS h FROM w LEFT JOIN f ON w.doc_id = f.doc_id AND w.kind = f.kind
), low AS (
  SELECT doc_id, kind, h, list_filter(h, lambda x: x < '2000000000000000') AS low FROM h
), s AS (
  SELECT doc_id, kind, list_sort(list_distinct(CASE WHEN len(low) > 0 OR len(h) = 0 THEN low ELSE [list_min(h)] END)) AS s FROM low
), p AS (
  SELECT a.doc_id, a.s AS a, b.s AS b, c.s AS c, CAST(len(list_intersect(a.s, b.s)) AS DOUBLE) AS ab, CAST(len(list_intersect(a.s, c.s)) AS DOUBLE) AS ac
  FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.kind = 1 AND b.kind = 2 JOIN s c ON a.doc_id = c.doc_id AND c.kind = 3
)
SELECT p.doc_id, e.n_chars, sha256(e.edited) AS edited_sha256, array_to_string(a, '') AS fingerprint, array_to_string(b, '') AS edited_fingerprint,
  CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE ab / (len(a) + len(b) - ab) END AS near_edited, CASE WHEN len(a) + len(c) = 0 THEN 1.0 ELSE ac / (len(a) + len(c) - ac) END AS near_next,
  CASE WHEN len(a) + len(b) = 0 THEN 1.0 WHEN len(a) = 0 THEN 0.0 ELSE ab / len(a) END AS held_edited, CASE WHEN len(a) + len(c) = 0 THEN 1.0 WHEN len(a) = 0 THEN 0.0 ELSE ac / len(a) END AS held_next
FROM p JOIN e ON p.doc_id = e.doc_id
"""


def oracle_sql():
    return {
        "op2_near_dedup": OP2_SQL, "op9_embedding_dedup": OP9_SQL, "op1_url_filter": OP1_SQL, "op10_exact_dedup": OP10_SQL,
        "op11_hard_negatives": OP11_SQL, "op12_centroid_clustering": op12_sql(), "op13_fingerprints": OP13_SQL,
    }
