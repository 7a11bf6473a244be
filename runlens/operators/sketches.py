"""Percentiles from stored sketches: one a day, merged over any days, with their true ranks.

A sketch is made once, when a day's log is there, and is some kilobytes however
long the log. Merging sketches reads no log, so a figure over a year costs 365
rows a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from runlens.session import broadcast_if_small

#: size of a sketch, and the distance of ranks that its answers keep to: three times the
#: error that this size promises with 99 % for one answer
SKETCH_K, RANK_ERROR = 800, 0.012


def daily_sketches(log: DataFrame, keys: Sequence[str], day: Column, value: str,
                   k: int = SKETCH_K) -> DataFrame:
    """(keys, day, n, sketch): a KLL sketch of ``value`` for each group and day, to be stored.

    Null and NaN values are left out. Combined within tasks before the shuffle.
    """
    v = F.col(value).cast("double")
    return log.where(v.isNotNull() & ~F.isnan(v)).groupBy(*keys, day.alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(v, F.lit(k)).alias("sketch"))


def merged_sketches(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n, n_days, sketch) over all the days given."""
    return sketches.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.count_distinct("day").alias("n_days"),
        F.kll_merge_agg_double("sketch").alias("sketch"))


def sketch_percentiles(sketches: DataFrame, keys: Sequence[str],
                       probs: dict[str, float]) -> DataFrame:
    """The columns of ``sketches`` but the sketch, and one answer per entry of ``probs``."""
    return sketches.select(
        *[c for c in sketches.columns if c != "sketch"],
        *[F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))).alias(name)
          for name, q in probs.items()])


def with_true_ranks(answers: DataFrame, log: DataFrame, keys: Sequence[str], value: str,
                    probs: dict[str, float]) -> DataFrame:
    """Add ``<name>_low`` and ``<name>_high``: shares of the group's values below, and not above, each answer.

    One pass over the log, and one row a group and task to the shuffle. An answer is
    exact where its share lies between the two.
    """
    key = F.struct(*keys)
    asked = answers.select(key.alias("_k"), *[F.col(name).alias(f"_{name}") for name in probs])
    v = F.col("_v")
    counted = (
        log.select(key.alias("_k"), F.col(value).cast("double").alias("_v"))
        .where(v.isNotNull() & ~F.isnan(v)).join(broadcast_if_small(asked), "_k")
        .groupBy("_k").agg(*[
            F.avg(F.when(test, 1.0).otherwise(0.0)).alias(f"{name}_{end}") for name in probs
            for end, test in (("low", v < F.col(f"_{name}")), ("high", v <= F.col(f"_{name}")))]))
    return answers.withColumn("_k", key).join(counted, "_k", "left").drop("_k")


def rank_error(name: str, q: float) -> Column:
    """How far the share ``q`` lies outside the true ranks of the answer called ``name``."""
    return F.greatest(F.col(f"{name}_low") - q, q - F.col(f"{name}_high"), F.lit(0.0))
