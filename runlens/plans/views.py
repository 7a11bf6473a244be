"""Input views derived from the given tables, in Spark and in SQL.

Each view has a SQL twin (a ``WITH`` fragment) so that oracles share one
definition. All rows of the base tables take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from runlens.functions import distributions as dist
from runlens.operators import results as res
from runlens.operators.matrix import with_config_hash
from runlens.operators.prompts import TextSource, build_prompts
from runlens.schemas import DOMAINS, DRAFT_LENGTHS, MAX_NEW_TOKENS, MODEL_PAIRS, SEED
from runlens.sources.tables import table, text_table

DRAFTS = 4
VECTORS_PER_ROUND = DRAFTS + 1
LOGIT_TEMPERATURE = 0.1

RUN_KEYS = ("user_id", "kslot", "run_idx")


def _choose(i: Column, values) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))


def _sql_choose(i: str, values) -> str:
    whens = " ".join(f"WHEN {n} THEN {v!r}" for n, v in enumerate(values))
    return f"CASE {i} {whens} END"


# --- rounds and records ----------------------------------------------------

def rounds(spark: SparkSession, folder: str) -> DataFrame:
    """Events as generation rounds: a user's events of one day make a run.

    The week decides the draft length (``kslot``); the day's own number is the
    run's, so no two days share a key however long the table is.
    """
    day = F.expr("datediff(to_date(ts), date'2024-01-01')")
    return (
        table(spark, folder, "events")
        .select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id",
                "event_type", "value",
                F.pmod(F.floor(day / 7), F.lit(5)).cast("long").alias("kslot"),
                day.cast("long").alias("run_idx"))
        .withColumn("K", F.when(F.col("kslot") > 0, _choose(
            F.col("kslot") - 1, DRAFT_LENGTHS).cast("long")))
        .withColumn("accepted", F.when(F.col("K").isNull(), F.lit(0)).otherwise(
            F.col("event_id") % (F.col("K") + 1)).cast("long"))
        .withColumn("proposed", F.coalesce("K", F.lit(0)).cast("long"))
    )


def with_condition(df: DataFrame) -> DataFrame:
    """Condition columns that follow from the user."""
    u, pair = F.col("user_id"), F.expr("user_id div 12") % 4
    return (
        df.withColumn("domain", _choose(u % 3, DOMAINS))
        .withColumn("temperature", F.when(
            F.expr("user_id div 3") % 2 == 0, F.lit(0.0)).otherwise(F.lit(0.6)))
        .withColumn("model_pair_name", _choose(pair, [p[0] for p in MODEL_PAIRS]))
        .withColumn("model_id", _choose(pair, [p[2] for p in MODEL_PAIRS]))
        .withColumn("prompt_id", F.format_string("%s_%03d", "domain", "user_id"))
        .withColumn("max_new_tokens", F.lit(MAX_NEW_TOKENS).cast("long"))
        .withColumn("seed", F.lit(SEED).cast("long"))
        .withColumn("prompt_domain", F.col("domain")))


def steps(spark: SparkSession, folder: str) -> DataFrame:
    """Rounds as step measurements: ids put out, seconds and peak bytes."""
    return (
        rounds(spark, folder)
        .withColumn("ids", F.transform(
            F.sequence(F.lit(0).cast("long"), F.col("accepted")),
            lambda i: (F.col("event_id") * 31 + i) % 50257))
        .withColumn("latency_s", F.col("value") / 1000)
        .withColumn("peak_bytes", F.col("value") * (10 * 1024 ** 2)))


def records(spark: SparkSession, folder: str) -> DataFrame:
    """Conditions, config and stored result columns, one row per run."""
    drafted = F.col("kslot") > 0

    def phase(kind: str, name: str) -> Column:
        return F.sum(F.when(drafted, F.when(
            F.col("event_type") == kind, F.col("value")).otherwise(F.lit(0.0)))).alias(name)

    runs = res.assemble_results(
        steps(spark, folder), [*RUN_KEYS, "K"], ["ts", "event_id"], extra=[
            F.when(F.max("K").isNotNull(), F.sum("accepted") / F.sum("proposed"))
            .alias("acceptance_rate"),
            F.when(F.max("K").isNotNull(), F.avg(F.col("accepted") + 1))
            .alias("tokens_per_step"),
            F.when(F.max("K").isNotNull(), F.count("*")).alias("num_speculation_rounds"),
            phase("view", "draft_time_total_ms"), phase("click", "verify_time_total_ms"),
            phase("purchase", "sampling_time_total_ms"), F.max("ts").alias("end_ts")])
    return with_condition(runs)


def hashed_records(spark: SparkSession, folder: str) -> DataFrame:
    return with_config_hash(records(spark, folder))


ROUNDS_SQL = f"""
rounds AS (
  SELECT *, CASE WHEN kslot > 0 THEN CAST(1 << (kslot - 1) AS BIGINT) END AS K,
         CASE WHEN kslot > 0 THEN event_id % ((1 << (kslot - 1)) + 1) ELSE 0 END AS accepted,
         CASE WHEN kslot > 0 THEN CAST(1 << (kslot - 1) AS BIGINT) ELSE 0 END AS proposed
  FROM (SELECT event_id, ts, user_id, event_type, value,
               (CAST(floor(run_idx / 7.0) AS BIGINT) % 5 + 5) % 5 AS kslot, run_idx
        FROM (SELECT *, CAST(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT)
                     AS run_idx
              FROM events)))"""

_CONDITION_SQL = f"""
         {_sql_choose('user_id % 3', DOMAINS)} AS domain,
         CASE WHEN (user_id // 3) % 2 = 0 THEN 0.0::DOUBLE ELSE 0.6::DOUBLE END AS temperature,
         {_sql_choose('(user_id // 12) % 4', [p[0] for p in MODEL_PAIRS])} AS model_pair_name,
         {_sql_choose('(user_id // 12) % 4', [p[2] for p in MODEL_PAIRS])} AS model_id,
         CAST({MAX_NEW_TOKENS} AS BIGINT) AS max_new_tokens,
         CAST({SEED} AS BIGINT) AS seed"""


def _percentile_sql(values: str, q: float) -> str:
    """Interpolation from the nearer end, as numpy does it; quantile_cont differs in the last digit."""
    at = f"({q}::DOUBLE * (len({values}) - 1))"
    share = f"({at} - floor({at}))"
    low = f"{values}[CAST(floor({at}) AS BIGINT) + 1]"
    high = f"{values}[least(CAST(floor({at}) AS BIGINT) + 2, len({values}))]"
    return (f"CASE WHEN {share} < 0.5 THEN {low} + ({high} - {low}) * {share}"
            f" ELSE {high} - ({high} - {low}) * (1 - {share}) END")


_LATENCIES_SQL = ", ".join(
    f"{_percentile_sql('lat', p / 100)} AS latency_p{p}" for p in (50, 95, 99))

RECORDS_SQL = ROUNDS_SQL + f""",
plain_runs AS (
  SELECT user_id, kslot, run_idx, K, max(ts) AS end_ts,
         flatten(list(list_transform(range(accepted + 1),
                 lambda i: (event_id * 31 + i) % 50257) ORDER BY ts, event_id)) AS generated_ids,
         CAST(sum(accepted + 1) AS BIGINT) AS num_tokens,
         sum(value / 1000) AS total_time,
         arg_min(value, (ts, event_id)) / 1000 AS time_to_first_token,
         max(value) * 10 AS peak_memory_mb,
         list(value / 1000 ORDER BY value) AS lat,
         CASE WHEN kslot > 0 THEN sum(accepted) / sum(proposed) END AS acceptance_rate,
         CASE WHEN kslot > 0 THEN avg(accepted + 1) END AS tokens_per_step,
         CASE WHEN kslot > 0 THEN count(*) END AS num_speculation_rounds,
         CASE WHEN kslot > 0 THEN sum(CASE WHEN event_type = 'view' THEN value ELSE 0 END) END
           AS draft_time_total_ms,
         CASE WHEN kslot > 0 THEN sum(CASE WHEN event_type = 'click' THEN value ELSE 0 END) END
           AS verify_time_total_ms,
         CASE WHEN kslot > 0 THEN sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END) END
           AS sampling_time_total_ms
  FROM rounds GROUP BY user_id, kslot, run_idx, K),
records AS (
  SELECT *, printf('%s_%03d', domain, user_id) AS prompt_id, domain AS prompt_domain,
         CASE WHEN total_time = 0 THEN 0 ELSE num_tokens / total_time END AS tokens_per_second,
         '{{"K": ' || coalesce(CAST(K AS VARCHAR), 'null')
           || ', "max_new_tokens": {MAX_NEW_TOKENS}, "model_pair_name": "' || model_pair_name
           || '", "prompt_domain": "' || domain || '", "seed": {SEED}, "temperature": '
           || CASE WHEN temperature = 0 THEN '0.0' ELSE '0.6' END || '}}' AS canonical
  FROM (SELECT *, {_LATENCIES_SQL}, {_CONDITION_SQL} FROM plain_runs)),
hashed AS (SELECT *, substr(sha256(canonical), 1, 12) AS config_hash FROM records)"""

SPEEDUPS_SQL = RECORDS_SQL + """,
baseline AS (
  SELECT prompt_id, temperature, model_pair_name, avg(tokens_per_second) AS baseline_tok_s
  FROM records WHERE K IS NULL GROUP BY ALL),
speedups AS (
  SELECT r.*, baseline_tok_s,
         CASE WHEN baseline_tok_s > 0 THEN r.tokens_per_second / baseline_tok_s END AS speedup
  FROM records r LEFT JOIN baseline USING (prompt_id, temperature, model_pair_name)
  WHERE r.K IS NOT NULL)"""


# --- prompts ---------------------------------------------------------------

def text_sources(spark: SparkSession, folder: str) -> dict[str, TextSource]:
    """Page markup as code, user turns as conversation, documents to summarise."""
    turns = text_table(spark, folder, "conversations").where(F.col("role") == "user")
    return {
        "code": TextSource(text_table(spark, folder, "pages"), "html", ("page_id",)),
        "conversation": TextSource(turns, "text", ("conv_id", "turn")),
        "summarization": TextSource(text_table(spark, folder, "documents"), "text", ("doc_id",)),
    }


def prompts(spark: SparkSession, folder: str, n: int | None = None) -> DataFrame:
    return build_prompts(text_sources(spark, folder), n)


PROMPTS_SQL = r"""
prompt_texts AS (
  SELECT 'code' AS domain, html AS raw_text,
         row_number() OVER (ORDER BY page_id) - 1 AS idx FROM pages
  UNION ALL
  SELECT 'conversation', text, row_number() OVER (ORDER BY conv_id, turn) - 1
  FROM conversations WHERE role = 'user'
  UNION ALL
  SELECT 'summarization',
         array_to_string(list_slice(regexp_extract_all(text, '\s*\S+'), 1, 512), '')
           || chr(10) || chr(10) || 'Summarize the above article:',
         row_number() OVER (ORDER BY doc_id) - 1 FROM documents),
prompts AS (
  SELECT printf('%s_%03d', domain, idx) AS prompt_id, domain, raw_text, idx,
         CAST(len(regexp_extract_all(raw_text, '\s*\S+')) AS BIGINT) AS token_count
  FROM prompt_texts)"""


# --- logits and rounds of vectors -------------------------------------------

def logits(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as target logits; round and position follow from the id."""
    v = F.col("vec_id")
    return table(spark, folder, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("target"),
        F.expr(f"vec_id div {VECTORS_PER_ROUND}").alias("round_id"),
        (v % VECTORS_PER_ROUND).alias("pos"))


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Target p and draft q per position.

    Even rounds draft with the rounded target (a self pair), odd rounds with
    the logits of the vector before (a cross pair).
    """
    base = logits(spark, folder)
    before = base.select((F.col("vec_id") + 1).alias("vec_id"),
                         F.col("target").alias("_before"))
    own = F.col("round_id") % 2 == 0
    return (
        base.join(before, "vec_id", "left")
        .withColumn("pair", F.when(own, F.lit("self")).otherwise(F.lit("cross")))
        .withColumn("draft", F.when(own, dist.quantize(F.col("target")))
                    .otherwise(F.coalesce("_before", "target")))
        .select("vec_id", "round_id", "pos", "pair",
                dist.softmax(F.col("target"), LOGIT_TEMPERATURE).alias("p"),
                dist.softmax(F.col("draft"), LOGIT_TEMPERATURE).alias("q")))


def positions(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors with the drafted token and its uniform (none at the bonus place)."""
    draft = F.col("pos") < DRAFTS
    key = F.col("vec_id")
    return (
        vectors(spark, folder)
        .withColumn("tok", F.when(draft, dist.pick(
            F.col("q"), dist.keyed_uniform(SEED, "draft", key))))
        .withColumn("u", F.when(draft, dist.keyed_uniform(SEED, "accept", key))))


def drafts(spark: SparkSession, folder: str) -> DataFrame:
    return positions(spark, folder).where(F.col("pos") < DRAFTS)


def _uniform_sql(tag: str, key: str) -> str:
    return (f"(CAST('0x' || substr(md5('{SEED}:{tag}:' || {key}), 1, 8) AS BIGINT)"
            f" / 4294967296.0::DOUBLE)")


# one row per (vector, token)
VECTORS_SQL = f"""
target AS (
  SELECT vec_id, vec_id // {VECTORS_PER_ROUND} AS round_id,
         vec_id % {VECTORS_PER_ROUND} AS pos, unnest(range(len(embedding))) AS token_id,
         CAST(unnest(embedding) AS DOUBLE) AS l
  FROM embeddings),
logit AS (
  SELECT t.*, CASE WHEN t.round_id % 2 = 0 THEN 'self' ELSE 'cross' END AS pair,
         CASE WHEN t.round_id % 2 = 0 THEN round(t.l / m.top * 7) * m.top / 7
              ELSE coalesce(b.l, t.l) END AS d
  FROM target t
  JOIN (SELECT vec_id, max(abs(l)) AS top FROM target GROUP BY vec_id) m USING (vec_id)
  LEFT JOIN target b ON b.vec_id = t.vec_id - 1 AND b.token_id = t.token_id),
weights AS (
  SELECT *, exp((l - max(l) OVER (PARTITION BY vec_id)) / {LOGIT_TEMPERATURE}::DOUBLE) AS ep,
         exp((d - max(d) OVER (PARTITION BY vec_id)) / {LOGIT_TEMPERATURE}::DOUBLE) AS eq
  FROM logit),
vectors AS (
  SELECT vec_id, round_id, pos, pair, token_id, l, d,
         ep / sum(ep) OVER (PARTITION BY vec_id) AS p,
         eq / sum(eq) OVER (PARTITION BY vec_id) AS q
  FROM weights)"""


def pick_sql(name: str, source: str, weight: str, key: str, u: str) -> str:
    """A CTE with the inverse-CDF draw of every key."""
    return f"""
{name} AS (
  SELECT {key}, coalesce(min(token_id) FILTER (WHERE cdf > u), max(token_id)) AS tok
  FROM (SELECT {key}, token_id, {u} AS u, sum({weight}) OVER (
          PARTITION BY {key} ORDER BY token_id ROWS UNBOUNDED PRECEDING) AS cdf
        FROM {source} WHERE {weight} > 0)
  GROUP BY {key})"""


POSITIONS_SQL = VECTORS_SQL + "," + pick_sql(
    "drafted", f"(SELECT * FROM vectors WHERE pos < {DRAFTS})", "q", "vec_id",
    _uniform_sql("draft", "vec_id")) + f""",
scored AS (
  SELECT v.vec_id, v.round_id, v.pos, v.pair, d.tok,
         {_uniform_sql('accept', 'v.vec_id')} AS u,
         CASE WHEN v.q > 0 THEN least(1.0::DOUBLE, v.p / v.q) END AS accept_prob
  FROM vectors v JOIN drafted d ON d.vec_id = v.vec_id AND d.tok = v.token_id)"""


def uniform_sql(tag: str, key: str) -> str:
    return _uniform_sql(tag, key)


# --- span log ---------------------------------------------------------------

def span_log(events: DataFrame) -> DataFrame:
    """Every event as a start or stop of one of three phases of its user's run."""
    kind = F.col("event_type")
    return events.select(
        F.col("user_id").cast("string").alias("run"),
        F.when(kind.isin("view", "click"), F.lit("draft"))
        .when(kind.isin("signup", "purchase"), F.lit("verify"))
        .otherwise(F.lit("sampling")).alias("phase"),
        F.when(kind.isin("view", "signup"), F.lit("start"))
        .when(kind.isin("click", "purchase"), F.lit("stop"))
        .when(F.col("event_id") % 2 == 0, F.lit("start"))
        .otherwise(F.lit("stop")).alias("op"),
        F.col("ts").cast("timestamp").alias("ts"), "event_id")


SPANS_SQL = """
log AS (
  SELECT CAST(user_id AS VARCHAR) AS run, ts, event_id,
         CASE WHEN event_type IN ('view', 'click') THEN 'draft'
              WHEN event_type IN ('signup', 'purchase') THEN 'verify'
              ELSE 'sampling' END AS phase,
         CASE WHEN event_type IN ('view', 'signup') THEN 'start'
              WHEN event_type IN ('click', 'purchase') THEN 'stop'
              WHEN event_id % 2 = 0 THEN 'start' ELSE 'stop' END AS op
  FROM events),
islands AS (
  SELECT *, coalesce(sum(CASE WHEN op = 'stop' THEN 1 ELSE 0 END) OVER (
           PARTITION BY run, phase ORDER BY ts, event_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island
  FROM log),
firsts AS (
  SELECT *, min(CASE WHEN op = 'start' THEN ts END) OVER w AS since,
         sum(CASE WHEN op = 'start' THEN 1 ELSE 0 END) OVER w AS starts
  FROM islands
  WINDOW w AS (PARTITION BY run, phase, island ORDER BY ts, event_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
spans AS (
  SELECT run, phase, event_id, ts,
         CASE WHEN op = 'start' AND starts = 1 THEN 'started'
              WHEN op = 'start' THEN 'already_running'
              WHEN since IS NOT NULL THEN 'completed' ELSE 'never_started' END AS status,
         CASE WHEN op = 'stop' AND since IS NOT NULL
              THEN (epoch_us(ts) - epoch_us(since)) / 1000.0::DOUBLE END AS elapsed_ms
  FROM firsts)"""
