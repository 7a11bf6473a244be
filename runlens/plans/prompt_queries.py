"""Queries on prompt corpora and experiment matrices."""

from __future__ import annotations

import re
import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from runlens.operators import matrix as mx, prompts as pr, sampling, token_rows as tr
from runlens.plans import views
from runlens.plans.registry import query
from runlens.schemas import (DOMAINS, DRAFT_LENGTHS, MODEL_PAIRS, PROMPTS_PER_DOMAIN, SEED,
                             TEMPERATURES, TINY_PROMPTS_PER_DOMAIN)
from runlens.session import materialize, scratch_path
from runlens.sources.model_listing import flatten_listing, read_listing
from runlens.sources import result_store as rs
from runlens.sources.json_array import load_prompt_arrays, save_prompt_arrays
from runlens.sources.prompt_files import load_prompts, save_prompts
from runlens.sources.registry import join_registry, unknown_pairs
from runlens.sources.tables import first_available, table, text_table

_P = "WITH " + views.PROMPTS_SQL
_ALL = "prompt_id, domain, md5(raw_text) AS text_md5, token_count"


def _digest(prompts):
    return prompts.select("prompt_id", "domain", F.md5("raw_text").alias("text_md5"),
                          "token_count")


@query("prompts_build", f"{_P} SELECT {_ALL}, raw_text FROM prompts "
                        f"WHERE idx < {PROMPTS_PER_DOMAIN}")
def prompts_build(spark, d):
    return pr.in_order(views.prompts(spark, d, PROMPTS_PER_DOMAIN)).select(
        "prompt_id", "domain", F.md5("raw_text").alias("text_md5"), "token_count", "raw_text")


@query("prompts_corpus", f"{_P} SELECT {_ALL} FROM prompts")
def prompts_corpus(spark, d):
    return _digest(views.prompts(spark, d))


@query("prompts_tiny", f"{_P} SELECT 'full' AS size, domain, count(*) AS n, "
       "CAST(sum(token_count) AS BIGINT) AS tokens FROM prompts "
       f"WHERE idx < {PROMPTS_PER_DOMAIN} GROUP BY domain UNION ALL "
       "SELECT 'tiny', domain, count(*), CAST(sum(token_count) AS BIGINT) FROM prompts "
       f"WHERE idx < {TINY_PROMPTS_PER_DOMAIN} GROUP BY domain")
def prompts_tiny(spark, d):
    # one tokenised build, cut twice
    full = materialize(views.prompts(spark, d, PROMPTS_PER_DOMAIN), "prompts")

    def totals(df, size):
        return df.groupBy("domain").agg(
            F.count("*").alias("n"), F.sum("token_count").alias("tokens")).select(
            F.lit(size).alias("size"), "domain", "n", "tokens")

    return totals(full, "full").unionByName(
        totals(pr.smaller_build(full, TINY_PROMPTS_PER_DOMAIN), "tiny"))


@query("prompts_roundtrip", f"{_P} SELECT {_ALL} FROM prompts")
def prompts_roundtrip(spark, d):
    path = scratch_path(spark, "prompts-json")
    save_prompts(views.prompts(spark, d), path)
    return _digest(load_prompts(spark, path))


@query("source_fallback", f"""{_P} SELECT prompt_id, domain, md5(raw_text) AS text_md5
FROM prompts WHERE domain <> 'summarization'
UNION ALL SELECT 'summarization_' || printf('%03d', i), 'summarization', md5('Report ' || i ||
  ' describes a project that met its first goal late, its second goal early, and ' || i ||
  ' smaller goals in between.' || chr(10) || chr(10) || 'Summarize the above article:')
FROM range(50) AS bank(i)""")
def source_fallback(spark, d):
    """Two paths cannot be opened: another one has the code texts, the bank the summaries."""
    sources = views.text_sources(spark, d)

    def opened(domain, *names):
        nothing = sources[domain].table.where(F.lit(False))
        return replace(sources[domain], table=first_available(
            spark, [f"{d}/{name}.parquet" for name in names], "parquet", nothing))
    sources["code"] = opened("code", "pages_of_another_day", "pages")
    sources["summarization"] = opened("summarization", "articles_of_another_day")
    primary = pr.build_prompts(sources, None)
    # the domain as a value of the row: a literal would turn the lookup into a loop
    bank = pr.default_bank(spark).select(
        "prompt_id", F.split("prompt_id", "_")[0].alias("domain"), "raw_text")
    return pr.with_fallback(primary.select(*bank.columns), bank).select(
        "prompt_id", "domain", F.md5("raw_text").alias("text_md5"))


@query("prompts_array", f"{_P} SELECT {_ALL} FROM prompts")
def prompts_array(spark, d):
    """All prompts as JSON arrays, one a file and task, read again in ranges of bytes."""
    path = scratch_path(spark, "prompt-array")
    save_prompt_arrays(views.prompts(spark, d), path)
    return _digest(load_prompt_arrays(spark, path, 1 << 20))


@query("prompts_by_domain", f"{_P} SELECT {_ALL} FROM prompts WHERE domain = 'conversation'")
def prompts_by_domain(spark, d):
    path = scratch_path(spark, "prompts-parquet")
    save_prompts(views.prompts(spark, d), path, fmt="parquet")
    return _digest(pr.by_domain(spark.read.parquet(path), "conversation"))


@query("domain_rejects", "SELECT domain, accepted, count(*) AS n FROM ("
       "SELECT CASE role WHEN 'user' THEN 'conversation' ELSE role END AS domain, "
       "role = 'user' AS accepted FROM conversations UNION ALL "
       "SELECT 'summarization', true FROM documents UNION ALL "
       "SELECT 'code', true FROM pages) GROUP BY ALL")
def domain_rejects(spark, d):
    role = F.col("role")
    labelled = (
        table(spark, d, "conversations").select(F.when(
            role == "user", F.lit("conversation")).otherwise(role).alias("domain"))
        .unionByName(table(spark, d, "documents").select(F.lit("summarization").alias("domain")))
        .unionByName(table(spark, d, "pages").select(F.lit("code").alias("domain"))))
    good, bad = pr.split_by_domain(labelled)
    return (good.withColumn("accepted", F.lit(True))
            .unionByName(bad.withColumn("accepted", F.lit(False)))
            .groupBy("domain", "accepted").agg(F.count("*").alias("n")))


_TOKENS = r"""
WITH texts AS (SELECT 'code' AS domain, html AS t FROM pages
  UNION ALL SELECT 'conversation', text FROM conversations WHERE role = 'user'
  UNION ALL SELECT 'summarization',
    array_to_string(list_slice(regexp_extract_all(text, '\s*\S+'), 1, 512), '')
      || chr(10) || chr(10) || 'Summarize the above article:' FROM documents),
prompts AS (SELECT domain, CAST(len(regexp_extract_all(t, '\s*\S+')) AS BIGINT) AS token_count
  FROM texts)"""


def _unnumbered(spark, d):
    """The corpus without ids: statistics need no row numbering."""
    sources = views.text_sources(spark, d)
    suffix = F.lit(pr.SUMMARY_SUFFIX)
    parts = []
    for domain, src in sources.items():
        text = F.col(src.text)
        if domain == "summarization":
            text = F.concat(pr.tx.truncate_tokens(text, pr.SUMMARY_MAX_TOKENS), suffix)
        parts.append(src.table.select(F.lit(domain).alias("domain"), text.alias("raw_text")))
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("domain", pr.tx.token_count(F.col("raw_text")).alias("token_count"))


@query("prompt_stats", _TOKENS + " SELECT domain, count(*) AS n, min(token_count) AS min_tokens,"
       " round(avg(token_count), 6) AS mean_tokens, max(token_count) AS max_tokens"
       " FROM prompts GROUP BY domain")
def prompt_stats(spark, d):
    return pr.token_stats(_unnumbered(spark, d)).withColumn(
        "mean_tokens", F.round("mean_tokens", 6))


@query("domain_counts", "SELECT 'code' AS domain, count(*) AS n FROM pages "
       "UNION ALL SELECT 'conversation', count(*) FROM conversations "
       "WHERE role = 'user' UNION ALL SELECT 'summarization', count(*) FROM documents")
def domain_counts(spark, d):
    """Every text of every source; no text is read for it."""
    return pr.domain_counts(_unnumbered(spark, d))


@query("token_counts", r"SELECT doc_id, CAST(len(regexp_extract_all(text, '\s*\S+')) AS BIGINT)"
       " AS token_count FROM documents")
def token_counts(spark, d):
    return text_table(spark, d, "documents").select(
        "doc_id", pr.tx.token_count(F.col("text")).alias("token_count"))


@query("token_counts_udf", "SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) "
       "AS token_count FROM documents")
def token_counts_udf(spark, d):
    def factory():
        class ByteTokenizer:
            def encode(self, text):
                return text.encode("utf-8")

        return ByteTokenizer()

    tok = pr.custom_tokenizer(factory)
    return text_table(spark, d, "documents").select(
        "doc_id", tok.count(F.col("text")).alias("token_count"))


@query("token_rows", r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '\S+')) AS word,
                  unnest(range(len(regexp_extract_all(text, '\S+')))) AS position FROM documents)
SELECT doc_id, count(*) AS n, CAST(sum(len(word)) AS BIGINT) AS ids,
       CAST(sum(len(word) * (position % 7 + 1)) AS BIGINT) AS placed_ids FROM w GROUP BY doc_id""")
def token_rows(spark, d):
    """A tokenizer that numbers words by their length, as rows."""
    def factory():
        class LengthTokenizer:
            def encode(self, text):
                return [len(w) for w in re.findall(r"[^ \t-\r]+", text)]

        return LengthTokenizer()

    rows = tr.token_rows(text_table(spark, d, "documents"), ["doc_id"], "text", factory)
    return rows.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.sum("token_id").alias("ids"),
        F.sum(F.col("token_id") * (F.col("position") % 7 + 1)).alias("placed_ids"))


@query("token_cut", r"""
WITH w AS (SELECT doc_id, text, regexp_extract_all(text, '\S+') AS words FROM documents)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_tokens,
       md5(CASE WHEN len(words) > 64 THEN array_to_string(words[1:64], ' ') ELSE text END) AS cut_md5 FROM w""")
def token_cut(spark, d):
    """Count and cut in one trip to the tokenizer."""
    def factory():
        class WordTokenizer:
            def encode(self, text):
                return re.findall(r"[^ \t-\r]+", text)

            def decode(self, words):
                return " ".join(words)

        return WordTokenizer()

    cut = tr.counted_and_cut(text_table(spark, d, "documents"), ["doc_id"], "text", factory, 64)
    return cut.select("doc_id", "n_tokens", F.md5("cut").alias("cut_md5"))


@query("length_strata", _TOKENS + " SELECT domain, CAST(least(token_count // 64, 7) AS BIGINT)"
       " AS stratum, count(*) AS n, min(token_count) AS min_tokens,"
       " max(token_count) AS max_tokens FROM prompts WHERE token_count BETWEEN 8 AND 4096"
       " GROUP BY ALL")
def length_strata(spark, d):
    # counts are stored with the prompts, so the filter is pushed to the scan
    stored = materialize(_unnumbered(spark, d), "token-counts")
    kept = pr.of_length(stored, 8, 4096)
    return pr.length_strata(kept, 64, 8).groupBy("domain", "stratum").agg(
        F.count("*").alias("n"), F.min("token_count").alias("min_tokens"),
        F.max("token_count").alias("max_tokens"))


@query("stratified_sample", rf"""
WITH counted AS (
  SELECT doc_id, lang, CAST(least(len(regexp_extract_all(text, '\s*\S+')) // 256, 7) AS BIGINT) AS stratum
  FROM documents)
SELECT doc_id, lang, stratum FROM counted QUALIFY row_number() OVER (
  PARTITION BY lang, stratum
  ORDER BY CAST('0x' || substr(md5('{SEED}:' || doc_id), 1, 15) AS BIGINT), doc_id) <= 10 + 5 * stratum""")
def stratified_sample(spark, d):
    """Documents by language and length, longer strata with larger quotas."""
    docs = text_table(spark, d, "documents").select(
        "doc_id", "lang", pr.tx.token_count(F.col("text")).alias("token_count"))
    strata = materialize(pr.length_strata(docs, 256, 8).drop("token_count"), "strata")
    return sampling.stratified_sample(strata, ["lang", "stratum"], "doc_id", 10 + 5 * F.col("stratum"), SEED)


# --- matrices and the registry ----------------------------------------------

_TEMPS = ", ".join(f"{t}::DOUBLE" for t in TEMPERATURES)


@query("run_matrix", f"{_P} SELECT prompt_id, domain, token_count, temperature, run_idx "
       f"FROM prompts, (SELECT unnest([{_TEMPS}]) AS temperature), "
       "(SELECT unnest(range(5)) AS run_idx)")
def run_matrix(spark, d):
    base = views.prompts(spark, d).select("prompt_id", "domain", "token_count")
    return mx.run_matrix(base)


_PAIRS = ", ".join(f"'{p[0]}'" for p in MODEL_PAIRS)
_CONFIGS = f"""
configs AS (
  SELECT prompt_id, domain AS prompt_domain, model_pair_name, K, temperature
  FROM prompts, (SELECT unnest([{_PAIRS}]) AS model_pair_name),
       (SELECT unnest([%s]) AS K),
       (SELECT unnest([{_TEMPS}]) AS temperature)),
hashed_configs AS (
  SELECT *, substr(sha256('{{"K": ' || coalesce(CAST(K AS VARCHAR), 'null')
      || ', "max_new_tokens": 128, "model_pair_name": "' || model_pair_name
      || '", "prompt_domain": "' || prompt_domain || '", "seed": 42, "temperature": '
      || CASE WHEN temperature = 0 THEN '0.0' ELSE '0.6' END || '}}'), 1, 12) AS config_hash
  FROM configs)"""
_KS = ", ".join(f"{k}::BIGINT" for k in DRAFT_LENGTHS)


@query("run_matrix_full", _P + "," + _CONFIGS % _KS +
       " SELECT prompt_id, prompt_domain, model_pair_name, K, temperature, config_hash"
       " FROM hashed_configs")
def run_matrix_full(spark, d):
    base = views.prompts(spark, d).select("prompt_id", "domain")
    return mx.config_matrix(base).select(
        "prompt_id", "prompt_domain", "model_pair_name", "K", "temperature", "config_hash")


@query("config_pending", _P + "," + views.RECORDS_SQL + "," +
       _CONFIGS % ("NULL::BIGINT, " + _KS) +
       " SELECT prompt_id, config_hash FROM hashed_configs c WHERE NOT EXISTS ("
       "SELECT 1 FROM hashed h WHERE h.prompt_id = c.prompt_id"
       " AND h.config_hash = c.config_hash)")
def config_pending(spark, d):
    base = views.prompts(spark, d).select("prompt_id", "domain")
    planned = mx.config_matrix(base, (None, *DRAFT_LENGTHS))
    on = ("prompt_id", "config_hash")
    return mx.pending(planned.select(*on), views.hashed_records(spark, d), on)


@query("config_selected", _P + "," + views.RECORDS_SQL + "," +
       _CONFIGS % ("NULL::BIGINT, " + _KS) +
       " SELECT prompt_id, run_idx, config_hash, num_tokens FROM hashed h WHERE EXISTS ("
       "SELECT 1 FROM hashed_configs c WHERE h.prompt_id = c.prompt_id"
       " AND h.config_hash = c.config_hash)")
def config_selected(spark, d):
    base = views.prompts(spark, d).select("prompt_id", "domain")
    chosen = mx.config_matrix(base, (None, *DRAFT_LENGTHS))
    on = ("prompt_id", "config_hash")
    return mx.selected(views.hashed_records(spark, d), chosen.select(*on), on).select(
        "prompt_id", "run_idx", "config_hash",
        F.size("generated_ids").cast("long").alias("num_tokens"))


RUN = ["config_hash", "prompt_id"]


@query("store_pending", _P + "," + views.RECORDS_SQL + "," +
       _CONFIGS % ("NULL::BIGINT, " + _KS) +
       " SELECT prompt_id, config_hash FROM hashed_configs c WHERE NOT EXISTS ("
       "SELECT 1 FROM hashed h WHERE h.prompt_id = c.prompt_id"
       " AND h.config_hash = c.config_hash)")
def store_pending(spark, d):
    """The planned runs that a bucketed store of results lacks; only they are moved."""
    base = views.prompts(spark, d).select("prompt_id", "domain")
    planned = mx.config_matrix(base, (None, *DRAFT_LENGTHS)).select("prompt_id", "config_hash")
    return rs.pending_in_store(planned, _store(spark, d, RUN), RUN)


@query("store_by_config", f"WITH {views.RECORDS_SQL} SELECT config_hash, count(*) AS n, "
       "CAST(sum(num_tokens) AS BIGINT) AS num_tokens, max(run_idx) AS newest FROM hashed GROUP BY ALL")
def store_by_config(spark, d):
    """Results by config from the store, which is filled in two goes."""
    return rs.results_per_config(
        spark, _store(spark, d, ["config_hash"]), F.sum("num_tokens").cast("long").alias("num_tokens"),
        F.max("run_idx").alias("newest"))


def _store(spark, d, by):
    """A store of the first days, in which the results of one pair after another are replaced by all."""
    name = f"results_{uuid.uuid4().hex}"
    results = materialize(views.hashed_records(spark, d).select(
        "config_hash", "model_pair_name", "prompt_id", "run_idx",
        F.size("generated_ids").cast("long").alias("num_tokens")), "results")
    rs.create_store(results.where("run_idx < 15"), name, scratch_path(spark, "store"), 16, by)
    for pairs in (MODEL_PAIRS[:2], MODEL_PAIRS[2:]):
        mine = F.col("model_pair_name").isin(*[p[0] for p in pairs])
        rs.replace_pairs(results.where(mine), name, 16, by)
    return name


_REGISTRY = "(VALUES " + ", ".join(
    f"({i}, " + ", ".join(f"'{v}'" for v in p) + ")" for i, p in enumerate(MODEL_PAIRS)
) + ") AS g(ord, model_pair_name, draft_model_id, target_model_id, draft_dtype, target_dtype)"


@query("registry_join", "WITH " + views.RECORDS_SQL +
       " SELECT CAST(ord AS BIGINT) AS ord, model_pair_name, draft_model_id, target_model_id,"
       " draft_dtype, target_dtype, count(*) AS n_runs FROM records JOIN "
       + _REGISTRY + " USING (model_pair_name) GROUP BY ALL")
def registry_join(spark, d):
    return join_registry(views.records(spark, d)).groupBy(
        "ord", "model_pair_name", "draft_model_id", "target_model_id", "draft_dtype",
        "target_dtype").agg(F.count("*").alias("n_runs")).orderBy("ord")


@query("registry_unknown", "SELECT p_brand AS model_pair_name, count(*) AS n "
       "FROM part GROUP BY p_brand")
def registry_unknown(spark, d):
    """Part brands as requested pair names; registered names would not be listed."""
    wanted = table(spark, d, "part").select(F.col("p_brand").alias("model_pair_name"))
    known = views.records(spark, d).select("model_pair_name")
    return unknown_pairs(wanted.unionByName(known)).groupBy("model_pair_name").agg(
        F.count("*").alias("n"))


@query("model_listing", """
SELECT CASE WHEN p_partkey % 11 = 0 THEN 'unknown' ELSE p_name END AS name,
       CASE WHEN p_partkey % 13 = 0 OR p_partkey % 5 = 0 THEN '?'
            ELSE CAST(p_size AS VARCHAR) || 'B' END AS parameter_size,
       CASE WHEN p_partkey % 13 = 0 OR p_partkey % 3 = 0 THEN '?' ELSE p_type END
         AS quantization_level,
       round(CASE WHEN p_partkey % 7 = 0 THEN 0
             ELSE CAST(round(p_retailprice * 1000000) AS BIGINT) END / 1073741824.0::DOUBLE, 6)
         AS size_gb
FROM part""")
def model_listing(spark, d):
    """Saved responses made from the part table, with keys left out here and there."""
    key = F.col("p_partkey")
    details = F.struct(
        F.when(key % 5 != 0, F.concat(F.col("p_size").cast("string"), F.lit("B")))
        .alias("parameter_size"),
        F.when(key % 3 != 0, F.col("p_type")).alias("quantization_level"))
    model = F.struct(
        F.when(key % 11 != 0, F.col("p_name")).alias("name"),
        F.when(key % 7 != 0, F.round(F.col("p_retailprice") * 1000000).cast("long"))
        .alias("size"),
        F.when(key % 13 != 0, details).alias("details"))
    path = scratch_path(spark, "listing")
    # one model per response keeps a response small whatever the table holds
    (table(spark, d, "part").select(F.to_json(F.struct(F.array(model).alias("models")))
                                    .alias("value")).write.text(path))
    return flatten_listing(read_listing(spark, path)).withColumn(
        "size_gb", F.round("size_gb", 6))
