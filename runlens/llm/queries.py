"""Registered queries of the training-data operators, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from runlens.llm import (
    clustering, embeddings, fingerprints, lexical, licenses, line_chunks, lm_scoring, minhash, mixing,
    packing, pii, quality, suffixes)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f
    return add


@_query("op6_minhash_near_dedup", """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE
           WHEN len(w) = 0 THEN []
           WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
           ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
         END) AS s
  FROM words),
rows AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, x.n + y.n AS total, count(*) AS shared
  FROM rows x JOIN rows y ON x.g = y.g AND x.doc_id < y.doc_id
  GROUP BY ALL),
links AS (
  SELECT a, b FROM common WHERE 100 * shared >= 85 * (total - shared)
  UNION SELECT b, a FROM common WHERE 100 * shared >= 85 * (total - shared)),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT s.doc_id, len(s.s) AS n_shingles, r.component_id, s.doc_id = r.component_id AS kept
FROM sets s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) r
  ON r.doc_id = s.doc_id
""")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, folder, "documents"), 5, 85, 100)


@_query("op8_pii")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find_pii(_read(spark, folder, "documents"))
    of_kind = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long)").alias(f"n_{k}")
               for k in pii.BASE_KINDS]
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    return found.select(
        "doc_id", *of_kind, F.sha2(pii.span_text(base), 256).alias("base_sha256"),
        pii.span_text(F.col("spans")).alias("spans"))


@_query("op10_line_dedup")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return line_chunks.dedup_lines(_read(spark, folder, "documents")) \
        .select("doc_id", "n_lines_cut", "text")


@_query("op2_best_fit_packing")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(_read(spark, folder, "documents"))


@_query("op5_quality_classifier")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(
        _read(spark, folder, "documents"), _read(spark, folder, "labels"),
        F.col("source"), F.concat_ws("/", "source", "lang")).drop("version")


@_query("op3_document_fingerprints")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprints(_read(spark, folder, "documents"))


@_query("op1_embedding_near_dedup", """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_inner_product(a.v, b.v)
        / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) >= 0.98),
reach(vec_id, other) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links,
       r.component_id, e.vec_id = r.component_id AS kept
FROM embeddings e JOIN (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id) r
  ON r.vec_id = e.vec_id
""")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.near_vectors(_read(spark, folder, "embeddings"))


#: token shares asked for, of documents as the labels table tells them apart
SHARES = {"clean": 0.97, "low": 0.01, "toxic": 0.02}


@_query("op4_source_mixing")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    rates = mixing.mixture(
        _read(spark, folder, "documents"),
        mixing.label_domains(_read(spark, folder, "labels")), SHARES)
    return rates.select("doc_id", "copies", "tokens", *(
        F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(SHARES)), "rate")


@_query("op7_suffix_array_dedup")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.repeated_passages(_read(spark, folder, "documents"))


@_query("op9_license_scan", """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
named AS (
  SELECT doc_id, CASE trim(regexp_replace(lower(line), '[^a-z0-9]+', ' ', 'g'))
    WHEN 'licensed under the apache license version 2 0' THEN 'Apache-2.0'
    WHEN 'released under the mit license' THEN 'MIT'
    WHEN 'this work is licensed under the gnu general public license version 3' THEN 'GPL-3.0-only'
    WHEN 'licensed under cc by nc 4 0' THEN 'CC-BY-NC-4.0' END AS licence
  FROM lines)
SELECT doc_id, count(licence) AS n_sentences,
       coalesce(string_agg(DISTINCT licence, ',' ORDER BY licence), '') AS licences
FROM named GROUP BY doc_id
""")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan(_read(spark, folder, "documents"))
    return found.select(
        "doc_id", F.size("sentences").cast("long").alias("n_sentences"),
        F.array_join(F.array_sort(F.array_distinct(F.col("licences.licence"))), ",").alias("licences"))


@_query("op11_ranked_search", r"""
WITH terms AS (
  SELECT doc_id, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
wanted AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(
             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY ALL),
lengths AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY doc_id),
every AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS l FROM lengths),
counts AS (SELECT doc_id, term, count(*) AS tf FROM terms
           WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
            FROM counts, every GROUP BY term, docs),
scores AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf)
           // (1000 * tf + 8 * (100 - 75 + ((75 * n * docs) // l))))) AS BIGINT) AS score
  FROM counts JOIN wanted USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), every
  GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank,
       doc_id, score
FROM scores WHERE score > 0
QUALIFY rank <= 10
""")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(_read(spark, folder, "documents"), _read(spark, folder, "benchmark"))


def _round_sql(n: int) -> str:
    """Assignment to the centroids of round n - 1, and those of round n."""
    return f"""
near{n} AS (
  SELECT vec_id, arg_min(number, (distance, number)) AS number, min(distance) AS distance FROM (
    SELECT vec_id, number, list_sum(list_transform(range(1, 65),
             lambda i: (v[i] - c[i]) * (v[i] - c[i])))::BIGINT AS distance
    FROM whole, centroids{n - 1}) GROUP BY vec_id),
means{n} AS (
  SELECT number, list((s - ((s % k) + k) % k) // k ORDER BY i) AS c FROM (
    SELECT number, i, sum(v[i])::BIGINT AS s, count(*) AS k
    FROM near{n} JOIN whole USING (vec_id), range(1, 65) AS d(i) GROUP BY number, i)
  GROUP BY number),
centroids{n} AS (
  SELECT o.number, coalesce(m.c, o.c) AS c
  FROM centroids{n - 1} o LEFT JOIN means{n} m ON m.number = o.number)"""


@_query("op12_centroid_clustering", f"""
WITH whole AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
centroids0 AS (
  SELECT row_number() OVER (ORDER BY h) - 1 AS number, v AS c FROM (
    SELECT v, sha256('1:' || vec_id) AS h FROM whole ORDER BY h LIMIT 16)),
{",".join(map(_round_sql, (1, 2, 3, 4)))}
SELECT vec_id, number::INTEGER AS cluster, distance,
       (sum(distance) OVER (PARTITION BY number))::BIGINT AS cluster_inertia,
       (sum(distance) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM near4 JOIN centroids3 USING (number)
""")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return clustering.cluster_vectors(_read(spark, folder, "embeddings"))


@_query("op13_lm_scoring")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """Learns from six of seven documents; the seventh, by a hash of the id, is held out."""
    return lm_scoring.score_documents(
        _read(spark, folder, "documents"), F.crc32(F.col("doc_id").cast("string")) % 7 == 2)
