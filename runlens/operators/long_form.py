"""Distributions with one row per (key, token), for large vocabularies.

A key has at most one row per vocabulary entry, so windows over a key are
bounded by the vocabulary and the keys spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def explode_vector(df: DataFrame, keys: Sequence[str], vector: str,
                   value: str) -> DataFrame:
    return df.select(*keys, F.posexplode(vector).alias("token_id", value))


def greedy_tokens(logits: DataFrame, keys: Sequence[str],
                  logit: str = "logit") -> DataFrame:
    """Largest logit per key, smallest token on ties; folded before the shuffle."""
    best = F.min(F.struct((-F.col(logit)).alias("l"), "token_id")).alias("_b")
    return logits.groupBy(*keys).agg(best).select(*keys, F.col("_b.token_id").alias("token_id"))


def softmax(logits: DataFrame, keys: Sequence[str], temperature: float,
            logit: str = "logit", out: str = "p") -> DataFrame:
    w = Window.partitionBy(*keys)
    return (
        logits.withColumn("_e", F.exp(
            (F.col(logit) - F.max(logit).over(w)) / F.lit(float(temperature))))
        .withColumn(out, F.col("_e") / F.sum("_e").over(w)).drop("_e"))


def sample_tokens(probs: DataFrame, keys: Sequence[str], u: Column,
                  p: str = "p") -> DataFrame:
    """Inverse-CDF draw per key; impossible tokens are skipped."""
    w = Window.partitionBy(*keys).orderBy("token_id").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    cdf = probs.where(F.col(p) > 0).withColumn("_cdf", F.sum(p).over(w)).withColumn("_u", u)
    return cdf.groupBy(*keys).agg(F.coalesce(
        F.min(F.when(F.col("_cdf") > F.col("_u"), F.col("token_id"))),
        F.max("token_id")).alias("token_id"))


def overlap(p: DataFrame, q: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum of min(p, q) per key; a token missing on one side adds nothing."""
    joined = p.join(q, [*keys, "token_id"])
    return joined.groupBy(*keys).agg(F.sum(F.least("p", "q")).alias("alpha"))
