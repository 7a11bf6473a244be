"""Queries on run records: derived metrics, configs, reports and sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.functions import config as cf, sequences as seq
from runlens.functions.metrics import summary_line, with_metrics
from runlens.operators import reports as rp, results as res, sketches as sk, verification as vf
from runlens.operators.indexing import with_group_index
from runlens.plans import views
from runlens.plans.registry import query
from runlens.schemas import CONFIG, MAX_NEW_TOKENS, RECORD, RESULT
from runlens.session import materialize, scratch_path
from runlens.sources.result_files import read_records, write_records

_R = "WITH " + views.RECORDS_SQL
_S = "WITH " + views.SPEEDUPS_SQL


def _r6(*names):
    return {n: F.round(n, 6) for n in names}


def _r9(*names):
    return {n: F.round(n, 9) for n in names}


def _measured(spark, d):
    return with_metrics(views.records(spark, d))


def _speedups(spark, d):
    return rp.measured_speedup(_measured(spark, d))


# --- rows --------------------------------------------------------------------

_METRICS = ("total_time", "time_to_first_token", "peak_memory_mb", "tokens_per_second",
            "latency_p50", "latency_p95", "latency_p99", "acceptance_rate",
            "tokens_per_step")
# interpolated latencies have up to 7 decimals; 9 keeps rounding off a tie
_DIGITS = {m: 9 if m.startswith("latency") else 6 for m in _METRICS}
_METRICS_SQL = ", ".join(f"round({m}, {k}) AS {m}" for m, k in _DIGITS.items())


@query("result_metrics", f"{_R} SELECT prompt_id, kslot, run_idx, num_tokens, "
       f"acceptance_rate IS NOT NULL AS is_speculative, {_METRICS_SQL} FROM records")
def result_metrics(spark, d):
    return _measured(spark, d).select(
        "prompt_id", "kslot", "run_idx", "num_tokens", "is_speculative",
        *[F.round(m, k).alias(m) for m, k in _DIGITS.items()])


@query("result_summary_line", _R + """
SELECT prompt_id, kslot, run_idx,
       CASE WHEN acceptance_rate IS NULL THEN 'AR ' ELSE 'SD ' END || ' | ' || num_tokens
       || ' tok | ' || printf('%.1f', tokens_per_second) || ' tok/s | p50='
       || printf('%.0f', latency_p50 * 1000) || 'ms p95=' || printf('%.0f', latency_p95 * 1000)
       || 'ms | mem=' || printf('%.0f', peak_memory_mb) || 'MB'
       || CASE WHEN acceptance_rate IS NULL THEN '' ELSE ' | accept='
          || printf('%.2f', acceptance_rate) || ' rounds=' || num_speculation_rounds END
         AS line
FROM records""")
def result_summary_line(spark, d):
    return _measured(spark, d).select("prompt_id", "kslot", "run_idx",
                                      summary_line().alias("line"))


@query("assemble_results", f"{_R} SELECT user_id, kslot, run_idx, "
       "array_to_string(generated_ids, ',') AS ids, num_tokens, "
       "round(total_time, 6) AS total_time, "
       "round(time_to_first_token, 6) AS time_to_first_token, "
       "round(peak_memory_mb, 6) AS peak_memory_mb FROM records")
def assemble_results(spark, d):
    runs = res.assemble_results(views.steps(spark, d), views.RUN_KEYS, ["ts", "event_id"])
    return runs.select(
        *views.RUN_KEYS, F.concat_ws(",", F.col("generated_ids").cast("array<string>"))
        .alias("ids"), F.size("generated_ids").cast("long").alias("num_tokens"),
        *[F.round(c, 6).alias(c)
          for c in ("total_time", "time_to_first_token", "peak_memory_mb")])


_RECORD_SQL = """
, full_records AS (
  SELECT r.*, p.token_count AS prompt_token_count
  FROM records r LEFT JOIN prompts p USING (prompt_id))
SELECT model_id, prompt_id, domain, prompt_token_count, temperature, max_new_tokens, run_idx,
       num_tokens, round(total_time, 6) AS total_time,
       round(peak_memory_mb, 6) AS peak_memory_mb, round(acceptance_rate, 6) AS acceptance_rate,
       num_speculation_rounds, round(draft_time_total_ms, 6) AS draft_time_total_ms,
       round(verify_time_total_ms, 6) AS verify_time_total_ms,
       round(sampling_time_total_ms, 6) AS sampling_time_total_ms
FROM full_records"""


def _flat_records(spark, d):
    prompts = views.prompts(spark, d).select(
        "prompt_id", F.col("token_count").alias("prompt_token_count"))
    return res.flatten_records(views.records(spark, d), prompts, ["prompt_id"])


def _record_digest(records):
    return records.select(
        "model_id", "prompt_id", "domain", "prompt_token_count", "temperature",
        "max_new_tokens", "run_idx", F.size("generated_ids").cast("long").alias("num_tokens"),
        F.round("total_time", 6).alias("total_time"),
        F.round("peak_memory_mb", 6).alias("peak_memory_mb"),
        F.round("acceptance_rate", 6).alias("acceptance_rate"), "num_speculation_rounds",
        *[F.round(c, 6).alias(c) for c in (
            "draft_time_total_ms", "verify_time_total_ms", "sampling_time_total_ms")])


@query("run_records", "WITH " + views.PROMPTS_SQL + "," + views.RECORDS_SQL + _RECORD_SQL)
def run_records(spark, d):
    return _record_digest(_flat_records(spark, d))


@query("results_roundtrip", "WITH " + views.PROMPTS_SQL + "," + views.RECORDS_SQL + _RECORD_SQL)
def results_roundtrip(spark, d):
    """Records go out with their computed keys and come back by stored columns."""
    path = scratch_path(spark, "records-json")
    write_records(with_metrics(_flat_records(spark, d)), path)
    return _record_digest(read_records(spark, path, RECORD))


@query("results_union", f"{_R} SELECT is_speculative, count(*) AS n, "
       "count(acceptance_rate) AS n_rates, CAST(sum(num_tokens) AS BIGINT) AS tokens FROM "
       "(SELECT *, acceptance_rate IS NOT NULL AS is_speculative FROM records) GROUP BY 1")
def results_union(spark, d):
    stored = views.records(spark, d).select("K", *RESULT.fieldNames())
    required = [f.name for f in RESULT.fields if not f.nullable]
    plain = stored.where(F.col("K").isNull()).select(*required)
    drafted = stored.where(F.col("K").isNotNull()).drop("K")
    both = res.union_results(plain, drafted)
    return both.groupBy(F.col("acceptance_rate").isNotNull().alias("is_speculative")).agg(
        F.count("*").alias("n"), F.count("acceptance_rate").alias("n_rates"),
        F.sum(F.size("generated_ids")).cast("long").alias("tokens"))


@query("run_index", "WITH " + views.ROUNDS_SQL + """
SELECT event_id, prompt_id, temperature, row_number() OVER (
         PARTITION BY prompt_id, temperature ORDER BY ts, event_id) - 1 AS run_idx
FROM (SELECT *, printf('%s_%03d', domain, user_id) AS prompt_id
      FROM (SELECT event_id, ts, user_id, """ + views._CONDITION_SQL.strip() + """
            FROM rounds))""")
def run_index(spark, d):
    """Every event taken as one run of its prompt, numbered in time order."""
    logged = views.with_condition(views.rounds(spark, d)).select(
        "event_id", "prompt_id", "temperature", "ts")
    return with_group_index(logged, ["prompt_id", "temperature"], "ts", "event_id",
                            "run_idx").drop("ts")


# --- configs -----------------------------------------------------------------

@query("config_labels", _R + """
SELECT prompt_id, run_idx, kslot, K IS NOT NULL AS is_drafted,
       CASE WHEN K IS NULL THEN 'AR' ELSE 'SD-K' || K END AS label,
       'BenchmarkConfig(pair=''' || model_pair_name || ''', decoder='
       || CASE WHEN K IS NULL THEN 'AR' ELSE 'SD-K' || K END || ', domain=''' || domain
       || ''', temp=' || CASE WHEN temperature = 0 THEN '0.0' ELSE '0.6' END
       || ', max_new=128, seed=42)' AS display FROM records""")
def config_labels(spark, d):
    return views.records(spark, d).select(
        "prompt_id", "run_idx", "kslot", cf.is_drafted(F.col("K")).alias("is_drafted"),
        cf.decoder_label(F.col("K")).alias("label"), cf.display().alias("display"))


@query("config_hash", f"{_R} SELECT prompt_id, run_idx, kslot, canonical, config_hash FROM hashed")
def config_hash(spark, d):
    return views.records(spark, d).select(
        "prompt_id", "run_idx", "kslot", cf.canonical_json().alias("canonical"),
        cf.config_hash().alias("config_hash"))


@query("config_roundtrip", f"{_R} SELECT prompt_id, run_idx, kslot, model_pair_name, K, "
       "temperature, max_new_tokens, prompt_domain, seed FROM records")
def config_roundtrip(spark, d):
    text = views.records(spark, d).select("prompt_id", "run_idx", "kslot",
                                          cf.to_json().alias("text"))
    return text.select("prompt_id", "run_idx", "kslot", cf.from_json(F.col("text")).alias("c")
                       ).select("prompt_id", "run_idx", "kslot",
                                *[F.col(f"c.{n}").alias(n) for n in CONFIG.fieldNames()])


@query("results_by_config", f"{_R} SELECT config_hash, count(*) AS n, "
       "round(avg(tokens_per_second), 6) AS mean_tok_s, min(model_pair_name) AS model_pair_name, "
       "min(K) AS K FROM hashed GROUP BY config_hash")
def results_by_config(spark, d):
    hashed = _measured(spark, d).withColumn("config_hash", cf.config_hash())
    return rp.results_by_config(hashed).withColumns(_r6("mean_tok_s"))


@query("config_dedup", f"{_R} SELECT config_hash, prompt_id, (run_idx * 7) % 3 AS attempt, run_idx, "
       "round(total_time, 6) AS total_time FROM hashed "
       "QUALIFY row_number() OVER (PARTITION BY config_hash, prompt_id ORDER BY run_idx) = 1")
def config_dedup(spark, d):
    """Every record is sent twice, from a first attempt of its own; the first run's stays."""
    once = views.hashed_records(spark, d).select(
        "config_hash", "prompt_id", "run_idx", F.round("total_time", 6).alias("total_time"))
    sent = once.withColumn("attempt", F.explode(F.array(
        F.expr("(run_idx * 7) % 3 + 1"), F.expr("(run_idx * 7) % 3"))))
    return res.keep_one(sent, ["config_hash", "prompt_id"], ["run_idx", "attempt"])


# --- reports -----------------------------------------------------------------

_SUMMARY = """round(avg(tokens_per_second), 6) AS mean_tok_s,
       round(avg(time_to_first_token) * 1000, 6) AS mean_ttft_ms,
       round(avg(latency_p95) * 1000, 6) AS mean_p95_ms,
       round(avg(peak_memory_mb), 6) AS mean_peak_mb, count(*) AS n"""
_MEANS = ("mean_tok_s", "mean_ttft_ms", "mean_p95_ms", "mean_peak_mb")


@query("run_summary", f"{_R} SELECT domain, temperature, {_SUMMARY} FROM records GROUP BY ALL")
def run_summary(spark, d):
    return rp.run_summary(_measured(spark, d)).withColumns(_r6(*_MEANS))


@query("run_summary_rollup", f"{_R} SELECT domain, temperature, {_SUMMARY}, "
       "round(max(peak_memory_mb), 6) AS peak_mb, grouping(domain, temperature) AS level "
       "FROM records GROUP BY ROLLUP (domain, temperature)")
def run_summary_rollup(spark, d):
    return rp.run_summary_rollup(_measured(spark, d)).withColumns(_r6(*_MEANS, "peak_mb"))


@query("speedup_measured", f"{_S} SELECT prompt_id, run_idx, K, "
       "round(baseline_tok_s, 6) AS baseline_tok_s, round(speedup, 6) AS speedup FROM speedups")
def speedup_measured(spark, d):
    return _speedups(spark, d).select("prompt_id", "run_idx", "K",
                                      F.round("baseline_tok_s", 6).alias("baseline_tok_s"),
                                      F.round("speedup", 6).alias("speedup"))


@query("acceptance_cube", f"{_S} SELECT model_pair_name, domain, K, "
       "round(avg(acceptance_rate), 6) AS mean_acceptance, round(avg(speedup), 6) AS "
       "mean_speedup, count(*) AS n, grouping(model_pair_name, domain, K) AS level "
       "FROM speedups GROUP BY CUBE (model_pair_name, domain, K)")
def acceptance_cube(spark, d):
    return rp.acceptance_cube(_speedups(spark, d)).withColumns(
        _r6("mean_acceptance", "mean_speedup"))


@query("speedup_pivot", f"{_S} SELECT model_pair_name, domain, " + ", ".join(
    f"round(avg(speedup) FILTER (WHERE K = {k}), 6) AS k{k}" for k in (1, 2, 4, 8))
    + " FROM speedups GROUP BY ALL")
def speedup_pivot(spark, d):
    return rp.speedup_pivot(_speedups(spark, d)).withColumns(_r6("k1", "k2", "k4", "k8"))


_RATES = _S + """,
rates AS (
  SELECT model_pair_name, domain, K, avg(acceptance_rate) AS beta,
         avg(speedup) AS measured_speedup, count(*) AS n,
         CASE WHEN sum(verify_time_total_ms) > 0
              THEN sum(draft_time_total_ms) / (K * sum(verify_time_total_ms)) END AS cost_ratio
  FROM speedups GROUP BY model_pair_name, domain, K),
model AS (
  SELECT *, (CASE WHEN beta = 1 THEN K + 1 ELSE (1 - pow(beta, K + 1)) / (1 - beta) END)
              AS expected_tokens,
         cost_ratio * K / (1 + cost_ratio * K) AS break_even_beta
  FROM rates)"""
_MODEL = ("beta", "measured_speedup", "cost_ratio", "expected_tokens", "modelled_speedup",
          "break_even_beta")
_MODEL_SQL = ("SELECT model_pair_name, domain, K, n, " + ", ".join(
    f"round({c}, 6) AS {c}" for c in _MODEL) +
    " FROM (SELECT *, expected_tokens / (1 + cost_ratio * K) AS modelled_speedup FROM model)")


@query("speedup_model", f"{_RATES} {_MODEL_SQL}")
def speedup_model(spark, d):
    return rp.speedup_model(_speedups(spark, d)).withColumns(_r6(*_MODEL))


@query("below_break_even", f"{_RATES} {_MODEL_SQL} WHERE beta < break_even_beta")
def below_break_even(spark, d):
    return rp.below_break_even(_speedups(spark, d)).withColumns(_r6(*_MODEL))


@query("best_k", _RATES + """
SELECT model_pair_name, domain, K AS best_k, round(measured_speedup, 6) AS best_speedup,
       CASE WHEN beta > 0 AND beta < 1 THEN CAST(ceil(ln(0.05::DOUBLE) / ln(beta)) AS BIGINT)
       END AS theory_k
FROM rates QUALIFY row_number() OVER (PARTITION BY model_pair_name, domain
                                      ORDER BY measured_speedup DESC, K) = 1""")
def best_k(spark, d):
    return rp.best_k(_speedups(spark, d)).withColumns(_r6("best_speedup"))


@query("acceptance_histogram", f"{_R} SELECT K, CAST(least(floor(acceptance_rate * 10), 9) AS "
       "BIGINT) AS bin, count(*) AS n FROM records WHERE acceptance_rate IS NOT NULL GROUP BY ALL")
def acceptance_histogram(spark, d):
    return rp.acceptance_histogram(views.records(spark, d))


@query("speculation_rollup", "WITH " + views.ROUNDS_SQL + """
SELECT user_id, kslot, run_idx, round(sum(accepted) / sum(proposed), 6) AS acceptance_rate,
       round(avg(accepted + 1), 6) AS tokens_per_step, count(*) AS num_speculation_rounds
FROM rounds WHERE K IS NOT NULL GROUP BY user_id, kslot, run_idx""")
def speculation_rollup(spark, d):
    drafted = views.rounds(spark, d).where(F.col("K").isNotNull())
    return rp.round_rollup(drafted, views.RUN_KEYS).withColumns(
        _r6("acceptance_rate", "tokens_per_step"))


def _phases(spark, d):
    kind = F.col("event_type")
    return views.rounds(spark, d).select(
        *views.RUN_KEYS, F.col("value").alias("ms"),
        F.when(kind == "view", "draft").when(kind == "click", "verify")
        .when(kind == "purchase", "sampling").otherwise("other").alias("phase"))


_PHASES = "WITH " + views.ROUNDS_SQL + """,
totals AS (
  SELECT user_id, kslot, run_idx, sum(value) AS whole_ms,
         sum(CASE WHEN event_type = 'view' THEN value ELSE 0 END) AS draft_ms,
         sum(CASE WHEN event_type = 'click' THEN value ELSE 0 END) AS verify_ms,
         sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END) AS sampling_ms
  FROM rounds GROUP BY user_id, kslot, run_idx)"""


@query("phase_totals", _PHASES + " SELECT user_id, kslot, run_idx, round(draft_ms, 6) AS draft_ms,"
       " round(verify_ms, 6) AS verify_ms, round(sampling_ms, 6) AS sampling_ms FROM totals")
def phase_totals(spark, d):
    return rp.phase_totals(_phases(spark, d), views.RUN_KEYS).drop("whole_ms").withColumns(
        _r6("draft_ms", "verify_ms", "sampling_ms"))


@query("phase_breakdown", _PHASES + """
SELECT user_id, kslot, run_idx, round(draft_ms / whole_ms, 6) AS draft_share,
       round(verify_ms / whole_ms, 6) AS verify_share,
       round((whole_ms - draft_ms - verify_ms) / whole_ms, 6) + 0 AS overhead_share FROM totals""")
def phase_breakdown(spark, d):
    shares = rp.phase_breakdown(rp.phase_totals(_phases(spark, d), views.RUN_KEYS), views.RUN_KEYS)
    # + 0 turns a rounded -0.0 into 0.0
    return shares.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in (
        "draft_share", "verify_share", "overhead_share")})


# --- latencies over all steps of a group -------------------------------------

def _group_steps(spark, d):
    return views.with_condition(views.rounds(spark, d)).select(
        "model_pair_name", "domain", F.coalesce("K", F.lit(0)).alias("K"),
        (F.col("value") / 1000).alias("latency_s"))


_GROUP = ["model_pair_name", "domain", "K"]
_STEPS = "WITH " + views.ROUNDS_SQL + """,
steps AS (SELECT coalesce(K, 0) AS K, value / 1000 AS latency_s, """ + \
    views._CONDITION_SQL.strip() + " FROM rounds)"


@query("latency_pooled", _STEPS + """
SELECT model_pair_name, domain, K, count(*) AS n,
       round(quantile_cont(latency_s, 0.50), 9) AS p50,
       round(quantile_cont(latency_s, 0.95), 9) AS p95,
       round(quantile_cont(latency_s, 0.99), 9) AS p99
FROM steps GROUP BY ALL""")
def latency_pooled(spark, d):
    return rp.pooled_latency(_group_steps(spark, d), _GROUP, "latency_s").withColumns(
        _r9("p50", "p95", "p99"))


# with fewer rows per group than the accuracy (10,000) the sketch is exact
@query("latency_pooled_approx", _STEPS + """
SELECT model_pair_name, domain, K, count(*) AS n,
       round(quantile_disc(latency_s, 0.50), 9) AS p50,
       round(quantile_disc(latency_s, 0.95), 9) AS p95,
       round(quantile_disc(latency_s, 0.99), 9) AS p99
FROM steps GROUP BY ALL""")
def latency_pooled_approx(spark, d):
    return rp.pooled_latency_approx(_group_steps(spark, d), _GROUP, "latency_s").withColumns(
        _r9("p50", "p95", "p99"))


@query("latency_sketch", _STEPS.replace("value / 1000 AS latency_s", "value / 1000 AS latency_s, run_idx") + """
SELECT model_pair_name, domain, K, CAST(count(*) AS BIGINT) AS n, count(DISTINCT run_idx) AS n_days,
       TRUE AS p50_holds, TRUE AS p95_holds, TRUE AS p99_holds
FROM steps GROUP BY ALL""")
def latency_sketch(spark, d):
    """Daily sketches merged over all days; each answer's true rank must lie within the bound."""
    steps = views.with_condition(views.rounds(spark, d)).select(
        *_GROUP[:2], F.coalesce("K", F.lit(0)).alias("K"), "run_idx",
        (F.col("value") / 1000).alias("latency_s"))
    daily = materialize(sk.daily_sketches(steps, _GROUP, F.col("run_idx"), "latency_s"), "sketches")
    # the answers are written: sketches of another run could differ within the bound
    answers = materialize(sk.sketch_percentiles(sk.merged_sketches(daily, _GROUP), _GROUP, rp.TAIL), "answers")
    checked = sk.with_true_ranks(answers, steps, _GROUP, "latency_s", rp.TAIL)
    return checked.select(*_GROUP, "n", "n_days", *[
        (sk.rank_error(name, q) <= sk.RANK_ERROR).alias(f"{name}_holds") for name, q in rp.TAIL.items()])


@query("latency_cdf", _STEPS + """
SELECT DISTINCT model_pair_name, domain, K, round(latency_s, 6) AS latency_s,
       round(cume_dist() OVER (PARTITION BY model_pair_name, domain, K ORDER BY latency_s), 6)
         AS cume_dist,
       count(*) OVER (PARTITION BY model_pair_name, domain, K, latency_s) AS n
FROM steps""")
def latency_cdf(spark, d):
    return rp.latency_cdf(_group_steps(spark, d), _GROUP, "latency_s").withColumns(
        _r6("latency_s", "cume_dist"))


@query("round_offsets", "WITH " + views.ROUNDS_SQL + """
SELECT user_id, kslot, run_idx, event_id,
       CAST(sum(accepted + 1) OVER w AS BIGINT) AS end_offset,
       CAST(sum(accepted + 1) OVER w - accepted - 1 AS BIGINT) AS start_offset
FROM rounds WINDOW w AS (PARTITION BY user_id, kslot, run_idx ORDER BY ts, event_id
                         ROWS UNBOUNDED PRECEDING)""")
def round_offsets(spark, d):
    return vf.round_offsets(views.rounds(spark, d), list(views.RUN_KEYS),
                            ["ts", "event_id"]).select(
        *views.RUN_KEYS, "event_id", "end_offset", "start_offset")


# --- sequences ---------------------------------------------------------------

@query("rollback_prefix", f"{_R} SELECT user_id, kslot, run_idx, "
       "array_to_string(list_slice(generated_ids, 1, keep), ',') AS kept, "
       "CAST(len(list_slice(generated_ids, 1, keep)) AS BIGINT) AS kept_length, "
       "num_tokens AS full_length, CAST(0 AS BIGINT) AS missing_length "
       "FROM (SELECT *, user_id % 30 AS keep FROM records)")
def rollback_prefix(spark, d):
    ids = F.col("generated_ids")
    runs = views.records(spark, d).withColumn(
        "kept_ids", seq.rollback(ids, (F.col("user_id") % 30).cast("int")))
    missing = F.lit(None).cast("array<bigint>")
    return runs.select(
        *views.RUN_KEYS, F.concat_ws(",", F.col("kept_ids").cast("array<string>")).alias("kept"),
        seq.sequence_length(F.col("kept_ids")).cast("long").alias("kept_length"),
        seq.sequence_length(ids).cast("long").alias("full_length"),
        seq.sequence_length(missing).cast("long").alias("missing_length"))


@query("eos_truncate", _R + f""",
small AS (SELECT user_id, kslot, run_idx,
                 list_transform(generated_ids, lambda x: x % 97) AS ids FROM records),
stops AS (SELECT *, least({MAX_NEW_TOKENS}, coalesce(nullif(list_position(ids, 13), 0), len(ids))) AS n
          FROM small)
SELECT user_id, kslot, run_idx, array_to_string(list_slice(ids, 1, n), ',') AS ids,
       CAST(n AS BIGINT) AS n FROM stops""")
def eos_truncate(spark, d):
    """Ids folded to a vocabulary of 97, in which 13 ends a sequence."""
    runs = views.records(spark, d).select(
        *views.RUN_KEYS, F.transform("generated_ids", lambda x: x % 97).alias("ids"))
    cut = runs.withColumn("ids", seq.stop_at_eos(
        F.col("ids"), F.lit(13).cast("long"), MAX_NEW_TOKENS))
    return cut.select(*views.RUN_KEYS,
                      F.concat_ws(",", F.col("ids").cast("array<string>")).alias("ids"),
                      F.size("ids").cast("long").alias("n"))
