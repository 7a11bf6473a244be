"""Queries on logits, probability vectors and draft-and-verify rounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.functions import distributions as dist
from runlens.operators import long_form as lf, results as res, verification as vf
from runlens.plans import views
from runlens.plans.registry import query
from runlens.schemas import SEED

_V = "WITH " + views.VECTORS_SQL
_P = "WITH " + views.POSITIONS_SQL


@query("greedy_token", f"{_V} SELECT vec_id, min(token_id) AS token_id, round(any_value(l), 6) "
       "AS logit FROM (SELECT *, max(l) OVER (PARTITION BY vec_id) AS top FROM target) "
       "WHERE l = top GROUP BY vec_id")
def greedy_token(spark, d):
    return views.logits(spark, d).select(
        "vec_id", dist.argmax(F.col("target")).alias("token_id"),
        F.round(F.array_max("target"), 6).alias("logit"))


@query("greedy_token_long", f"{_V} SELECT vec_id, min(token_id) AS token_id FROM "
       "(SELECT *, max(l) OVER (PARTITION BY vec_id) AS top FROM target) "
       "WHERE l = top GROUP BY vec_id")
def greedy_token_long(spark, d):
    long = lf.explode_vector(views.logits(spark, d), ["vec_id"], "target", "logit")
    return lf.greedy_tokens(long, ["vec_id"]).select(
        "vec_id", F.col("token_id").cast("long").alias("token_id"))


_SOFTMAX = _V + """
SELECT vec_id, token_id, round(e / sum(e) OVER (PARTITION BY vec_id), 6) AS prob
FROM (SELECT *, exp((l - max(l) OVER (PARTITION BY vec_id)) / 0.6::DOUBLE) AS e FROM target)"""


@query("softmax_temperature", _SOFTMAX)
def softmax_temperature(spark, d):
    return views.logits(spark, d).select(
        "vec_id", F.posexplode(dist.softmax(F.col("target"), 0.6)).alias("token_id", "prob")
    ).select("vec_id", F.col("token_id").cast("long").alias("token_id"),
             F.round("prob", 6).alias("prob"))


@query("softmax_long", _SOFTMAX)
def softmax_long(spark, d):
    long = lf.explode_vector(views.logits(spark, d), ["vec_id"], "target", "logit")
    return lf.softmax(long, ["vec_id"], 0.6, out="prob").select(
        "vec_id", F.col("token_id").cast("long").alias("token_id"),
        F.round("prob", 6).alias("prob"))


_SAMPLED = (_V + "," + views.pick_sql("drawn", "vectors", "p", "vec_id",
                                      views.uniform_sql("sample", "vec_id"))
            + """,
greedy AS (SELECT vec_id, min(token_id) AS g FROM
  (SELECT *, max(l) OVER (PARTITION BY vec_id) AS top FROM target) WHERE l = top GROUP BY 1)""")


@query("sampled_token", _SAMPLED + """
SELECT vec_id, temperature, CASE WHEN temperature = 0 THEN g ELSE tok END AS token_id
FROM (SELECT drawn.vec_id, tok, g, CASE WHEN drawn.vec_id % 2 = 0 THEN 0.0::DOUBLE
        ELSE 0.1::DOUBLE END AS temperature FROM drawn JOIN greedy USING (vec_id))""")
def sampled_token(spark, d):
    """Even vectors at temperature 0 (greedy), odd ones sampled at 0.1."""
    rows = views.logits(spark, d).withColumn("temperature", F.when(
        F.col("vec_id") % 2 == 0, F.lit(0.0)).otherwise(F.lit(views.LOGIT_TEMPERATURE)))
    u = dist.keyed_uniform(SEED, "sample", F.col("vec_id"))
    return rows.select("vec_id", "temperature", dist.sample(
        F.col("target"), F.col("temperature"), u).alias("token_id"))


@query("sampled_token_long", _SAMPLED + " SELECT vec_id, tok AS token_id FROM drawn")
def sampled_token_long(spark, d):
    long = lf.explode_vector(views.logits(spark, d), ["vec_id"], "target", "logit")
    probs = lf.softmax(long, ["vec_id"], views.LOGIT_TEMPERATURE)
    u = dist.keyed_uniform(SEED, "sample", F.col("vec_id"))
    return lf.sample_tokens(probs, ["vec_id"], u).select(
        "vec_id", F.col("token_id").cast("long").alias("token_id"))


@query("accept_prob", f"{_P} SELECT vec_id, round_id, pos, pair, tok, "
       "round(u, 6) AS u, round(accept_prob, 6) AS accept_prob, u <= accept_prob AS accepted "
       "FROM scored")
def accept_prob(spark, d):
    return vf.score_positions(views.drafts(spark, d)).select(
        "vec_id", "round_id", "pos", "pair", "tok", F.round("u", 6).alias("u"),
        F.round("accept_prob", 6).alias("accept_prob"), "accepted")


@query("verify_prefix", f"{_P} SELECT round_id, pos, tok FROM scored s WHERE NOT EXISTS ("
       "SELECT 1 FROM scored r WHERE r.round_id = s.round_id AND r.pos <= s.pos "
       "AND NOT r.u <= r.accept_prob)")
def verify_prefix(spark, d):
    scored = vf.score_positions(views.drafts(spark, d))
    return vf.accepted_prefix(scored).select("round_id", "pos", "tok")


_RESIDUAL = _V + """,
excess AS (SELECT *, greatest(p - q, 0) AS d_pos,
                  sum(greatest(p - q, 0)) OVER (PARTITION BY vec_id) AS z FROM vectors)"""


@query("residual_dist", _RESIDUAL + " SELECT vec_id, token_id, round(d_pos / z, 6) AS prob, "
       "round(z, 6) AS z FROM excess WHERE z > 0")
def residual_dist(spark, d):
    p, q = F.col("p"), F.col("q")
    return (
        views.vectors(spark, d)
        .select("vec_id", dist.residual_mass(p, q).alias("z"), dist.residual(p, q).alias("r"))
        .where(F.col("r").isNotNull())
        .select("vec_id", F.round("z", 6).alias("z"),
                F.posexplode("r").alias("token_id", "prob"))
        .select("vec_id", "z", F.col("token_id").cast("long").alias("token_id"),
                F.round("prob", 6).alias("prob")))


@query("overlap_alpha", f"{_V} SELECT vec_id, pair, round(sum(least(p, q)), 6) AS alpha, "
       "round(1 - sum(least(p, q)), 6) + 0 AS z FROM vectors GROUP BY vec_id, pair")
def overlap_alpha(spark, d):
    alpha = dist.overlap(F.col("p"), F.col("q"))
    return (views.vectors(spark, d).select("vec_id", "pair", alpha.alias("a"))
            .select("vec_id", "pair", F.round("a", 6).alias("alpha"),
                    (F.round(1 - F.col("a"), 6) + F.lit(0.0)).alias("z")))


@query("overlap_alpha_long", f"{_V} SELECT vec_id, round(sum(least(p, q)), 6) AS alpha "
       "FROM vectors GROUP BY vec_id")
def overlap_alpha_long(spark, d):
    v = views.vectors(spark, d)
    p = lf.explode_vector(v, ["vec_id"], "p", "p")
    q = lf.explode_vector(v, ["vec_id"], "q", "q")
    return lf.overlap(p, q, ["vec_id"]).withColumn("alpha", F.round("alpha", 6))


@query("self_pair_alpha", f"{_V} SELECT pair, count(*) AS n, round(avg(a), 6) AS mean_alpha, "
       "round(min(a), 6) AS min_alpha, round(max(a), 6) AS max_alpha FROM "
       "(SELECT vec_id, pair, sum(least(p, q)) AS a FROM vectors GROUP BY vec_id, pair) "
       "GROUP BY pair")
def self_pair_alpha(spark, d):
    alpha = views.vectors(spark, d).select(
        "pair", dist.overlap(F.col("p"), F.col("q")).alias("a"))
    return alpha.groupBy("pair").agg(
        F.count("*").alias("n"), F.round(F.avg("a"), 6).alias("mean_alpha"),
        F.round(F.min("a"), 6).alias("min_alpha"), F.round(F.max("a"), 6).alias("max_alpha"))


@query("preservation_check", f"{_V} SELECT pair, bool_and(ok) AS preserved, "
       "count(*) AS n FROM (SELECT vec_id, pair, bool_and(abs(least(p, q) + greatest(p - q, 0) "
       "- p) < 1e-12) AS ok FROM vectors GROUP BY vec_id, pair) GROUP BY pair")
def preservation_check(spark, d):
    ok = dist.preserves_target(F.col("p"), F.col("q"))
    return views.vectors(spark, d).select("pair", ok.alias("ok")).groupBy("pair").agg(
        F.bool_and("ok").alias("preserved"), F.count("*").alias("n"))


@query("vector_rejects", "SELECT CASE WHEN vec_id % 7 = 3 THEN 'bad' ELSE 'good' END AS kind, count(*) AS n, "
       "CAST(sum(vec_id) AS BIGINT) AS ids FROM embeddings GROUP BY ALL")
def vector_rejects(spark, d):
    """Every seventh draft lacks the last token of the vocabulary; these rows are told apart."""
    q = F.col("q")
    cut = views.vectors(spark, d).withColumn("q", F.when(
        F.col("vec_id") % 7 == 3, F.slice(q, 1, F.size(q) - 1)).otherwise(q))
    kinds = zip(("good", "bad"), vf.split_bad_vectors(cut))
    good, bad = (rows.select(F.lit(kind).alias("kind"), "vec_id") for kind, rows in kinds)
    return good.unionByName(bad).groupBy("kind").agg(
        F.count("*").alias("n"), F.sum("vec_id").alias("ids"))


_ROUND_OUTPUT = (
    _P + f""",
firsts AS (
  SELECT r.round_id, min(s.pos) FILTER (WHERE NOT s.u <= s.accept_prob) AS stop
  FROM (SELECT DISTINCT round_id FROM vectors) r LEFT JOIN scored s USING (round_id)
  GROUP BY r.round_id),
final_weights AS (
  SELECT v.round_id, v.token_id,
         CASE WHEN f.stop IS NULL THEN v.p ELSE greatest(v.p - v.q, 0) END AS w
  FROM vectors v JOIN firsts f ON f.round_id = v.round_id
   AND v.pos = coalesce(f.stop, {views.DRAFTS})),
finals AS (
  SELECT round_id, token_id, w / sum(w) OVER (PARTITION BY round_id) AS w FROM final_weights)"""
    + "," + views.pick_sql("final_tok", "finals", "w", "round_id",
                           views.uniform_sql("final", "round_id"))
    + f""",
prefix AS (
  SELECT f.round_id, string_agg(CAST(s.tok AS VARCHAR), ',' ORDER BY s.pos) AS toks
  FROM firsts f JOIN scored s ON s.round_id = f.round_id
   AND s.pos < coalesce(f.stop, {views.DRAFTS}) GROUP BY f.round_id)
SELECT f.round_id, CAST(coalesce(f.stop, {views.DRAFTS}) AS BIGINT) AS n_accepted,
       CASE WHEN f.stop IS NULL THEN 'bonus' ELSE 'replacement' END AS final_kind,
       concat_ws(',', p.toks, CAST(t.tok AS VARCHAR)) AS tokens
FROM firsts f JOIN final_tok t USING (round_id) LEFT JOIN prefix p USING (round_id)""")


@query("round_output", _ROUND_OUTPUT)
def round_output(spark, d):
    out = vf.round_output(views.positions(spark, d), views.DRAFTS, SEED)
    return out.withColumn("tokens", F.concat_ws(",", F.col("tokens").cast("array<string>")))


@query("token_agreement", _V + f""",
tops AS (
  SELECT round_id, pos, arg_min(token_id, (-p, token_id)) AS a,
         arg_min(token_id, (-q, token_id)) AS b
  FROM vectors WHERE pos < {views.DRAFTS} GROUP BY round_id, pos)
SELECT round_id, count(*) AS n_compared,
       coalesce(min(pos) FILTER (WHERE a <> b), -1) AS first_mismatch,
       CASE WHEN bool_and(a = b) THEN 'equal' ELSE 'differs' END AS verdict
FROM tops GROUP BY round_id""")
def token_agreement(spark, d):
    """Greedy tokens of the target, which has one more than was drafted, and of the draft."""
    v = views.vectors(spark, d)

    def greedy(rows, vector):
        picked = rows.select("round_id", "pos", dist.argmax(F.col(vector)).alias("t"))
        return picked.groupBy("round_id").agg(F.transform(
            F.sort_array(F.collect_list(F.struct("pos", "t"))), lambda s: s["t"]).alias("ids"))

    return res.token_agreement(greedy(v, "p"), greedy(v.where(F.col("pos") < views.DRAFTS), "q"), "round_id")
