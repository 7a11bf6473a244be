"""Queries that generate, continue, encode and compare text."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.operators import ngram, vocabulary as vc
from runlens.plans.registry import query
from runlens.schemas import MAX_NEW_TOKENS, SEED
from runlens.sources.tables import text_table

SAMPLE_TEMPERATURE = 0.6

_BIGRAMS = r"""
toks AS (SELECT doc_id, %s regexp_extract_all(text, '\S+') AS w FROM documents),
flat AS (SELECT %s unnest(w) AS prev, unnest(list_append(w[2:], '</s>')) AS next
         FROM toks WHERE len(w) > 0),
bigrams AS (SELECT %s prev, next, count(*) AS n FROM flat GROUP BY ALL)"""


@query("ngram_continue", "WITH RECURSIVE " + _BIGRAMS % ("", "", "") + f""",
best AS (SELECT prev, next FROM bigrams
         QUALIFY row_number() OVER (PARTITION BY prev ORDER BY n DESC, next) = 1),
prompts AS (SELECT conv_id, turn, nullif(regexp_extract(text, '(\\S+)\\s*$', 1), '') AS last
            FROM conversations WHERE role = 'user'),
starts AS (SELECT DISTINCT last AS start FROM prompts WHERE last IS NOT NULL),
walk(start, step, token) AS (
  SELECT s.start, 1, b.next FROM starts s JOIN best b ON b.prev = s.start
  UNION ALL
  SELECT w.start, w.step + 1, b.next FROM walk w JOIN best b ON b.prev = w.token
  WHERE w.step < {MAX_NEW_TOKENS} AND w.token <> '</s>'),
paths AS (SELECT start, string_agg(token, ' ' ORDER BY step) AS continuation,
                 count(*) AS n FROM walk GROUP BY start)
SELECT conv_id, turn, continuation, coalesce(n, 0) AS n
FROM prompts LEFT JOIN paths ON start = last""")
def ngram_continue(spark, d):
    turns = text_table(spark, d, "conversations").where(F.col("role") == "user")
    paths = ngram.greedy_paths_of(text_table(spark, d, "documents"), "text",
                                  MAX_NEW_TOKENS, ngram.last_words(turns, "text"))
    return ngram.continue_prompts(turns, "text", paths).select(
        "conv_id", "turn", F.array_join("path", " ").alias("continuation"),
        F.coalesce(F.size("path"), F.lit(0)).cast("long").alias("n"))


@query("ngram_sample", "WITH RECURSIVE " + _BIGRAMS % ("", "", "") + f""",
weights AS (SELECT *, pow(n / max(n) OVER (PARTITION BY prev), 1 / {SAMPLE_TEMPERATURE}) AS w
            FROM bigrams WHERE prev <> '</s>'),
shares AS (SELECT prev, next, round(w * count(*) OVER p / sum(w) OVER p, 9) AS share
           FROM weights WINDOW p AS (PARTITION BY prev)),
sums AS (SELECT *, share >= 1 AS heavy, abs(share - 1) AS gap FROM shares),
lines AS (
  SELECT *, row_number() OVER (PARTITION BY prev ORDER BY heavy, next) - 1 AS cell,
         round(sum(gap) OVER (w ROWS UNBOUNDED PRECEDING), 9) AS upto,
         round(coalesce(sum(gap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 9) AS before
  FROM sums WINDOW w AS (PARTITION BY prev, heavy ORDER BY next)),
placed AS (SELECT *, CASE WHEN heavy THEN upto ELSE before END AS place FROM lines),
filled AS (
  SELECT *, last_value(CASE WHEN heavy THEN next END IGNORE NULLS) OVER (
              PARTITION BY prev ORDER BY place DESC, heavy, next DESC
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS other,
         coalesce(max(CASE WHEN NOT heavy THEN upto END) OVER (
              PARTITION BY prev ORDER BY place, heavy DESC, next
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS drawn
  FROM placed),
cells AS (
  SELECT prev, cell, next, coalesce(other, next) AS other, count(*) OVER (PARTITION BY prev) AS size,
         CASE WHEN other IS NULL THEN 1 WHEN heavy THEN least(1, 1 + upto - drawn) ELSE share END AS keep
  FROM filled),
prompts AS (SELECT conv_id || ':' || turn AS id,
                   nullif(regexp_extract(text, '(\\S+)\\s*$', 1), '') AS last
            FROM conversations WHERE role = 'user'),
walk(id, step, token) AS (
  SELECT id, 0, last FROM prompts WHERE last IN (SELECT prev FROM bigrams)
  UNION ALL
  SELECT d.id, d.step + 1, CASE WHEN d.u * size - cell < keep THEN c.next ELSE c.other END
  FROM (SELECT w.id, w.step, w.token, size AS n,
               (CAST('0x' || substr(md5('{SEED}:step' || w.step || ':' || w.id), 1, 8) AS BIGINT)
                / 4294967296.0::DOUBLE) AS u
        FROM walk w JOIN (SELECT DISTINCT prev, size FROM cells) s ON s.prev = w.token
        WHERE w.step < {MAX_NEW_TOKENS} AND w.token <> '</s>') d
  JOIN cells c ON c.prev = d.token AND c.cell = least(CAST(floor(d.u * d.n) AS BIGINT), d.n - 1))
SELECT id, string_agg(token, ' ' ORDER BY step) AS continuation, count(*) AS n
FROM walk WHERE step > 0 GROUP BY id""")
def ngram_sample(spark, d):
    turns = text_table(spark, d, "conversations").where(F.col("role") == "user").select(
        F.concat_ws(":", "conv_id", "turn").alias("id"), "text")
    walked = ngram.sample_continuations_of(text_table(spark, d, "documents"), "text", turns, "id", "text",
                                           MAX_NEW_TOKENS, SAMPLE_TEMPERATURE, SEED)
    return walked.select("id", F.array_join("path", " ").alias("continuation"),
                         F.size("path").cast("long").alias("n"))


@query("corpus_overlap", "WITH " + _BIGRAMS % ("lang,", "lang,", "lang,") + """,
p AS (SELECT *, n / sum(n) OVER (PARTITION BY lang, prev) AS p,
             sum(n) OVER (PARTITION BY lang, prev) AS total FROM bigrams),
q AS (SELECT lang, next, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS q
      FROM bigrams GROUP BY lang, next)
SELECT p.lang, p.prev AS context, CAST(max(total) AS BIGINT) AS n,
       round(sum(least(p.p, q.q)), 6) AS alpha
FROM p JOIN q USING (lang, next) GROUP BY p.lang, p.prev""")
def corpus_overlap(spark, d):
    return ngram.corpus_overlap(text_table(spark, d, "documents"), "text", ["lang"]).withColumn(
        "alpha", F.round("alpha", 6))


@query("detokenize", r"""
WITH t AS (SELECT conv_id, turn, role,
             regexp_extract_all(text, '\s*\S+') AS w FROM conversations)
SELECT p.conv_id, p.turn,
       md5(array_to_string(p.w, '') || coalesce(array_to_string(r.w, ''), '')) AS text_md5,
       CAST(len(p.w) + coalesce(len(r.w), 0) AS BIGINT) AS n_ids
FROM t p LEFT JOIN t r ON r.conv_id = p.conv_id AND r.turn = p.turn + 1
WHERE p.role = 'user'""")
def detokenize(spark, d):
    """A user turn's ids followed by those of the turn after it, if any, as text."""
    turns = text_table(spark, d, "conversations")
    ids = turns.select("conv_id", "turn", "role", vc.encode(F.col("text")).alias("ids"))
    prompt = ids.where(F.col("role") == "user")
    reply = ids.select("conv_id", (F.col("turn") - 1).alias("turn"),
                       F.col("ids").alias("reply"))
    joined = prompt.join(reply, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", F.concat("ids", F.coalesce("reply", F.array().cast("array<bigint>")))
        .alias("ids"))
    text = vc.decode(joined, ["conv_id", "turn"], "ids", vc.vocabulary(turns, "text"))
    return text.select("conv_id", "turn", F.md5("text").alias("text_md5"), "n_ids")
