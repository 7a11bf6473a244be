"""Result rows: assembly from step logs, flattening, union and de-duplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType

from runlens.functions.metrics import bytes_to_mb, time_to_first_token, total_time
from runlens.functions.sequences import first_mismatch
from runlens.schemas import CONDITION, RESULT, RESULT_OPTIONAL


def assemble_results(steps: DataFrame, keys: Sequence[str], order_by: Sequence[str], *,
                     ids: str = "ids", latency: str = "latency_s",
                     peak_bytes: str = "peak_bytes",
                     extra: Sequence[Column] = ()) -> DataFrame:
    """One result row per run from a log with one row per generation step.

    A run's array is bounded by its token cap, so collecting it is safe; a log
    whose runs have no cap must be cut into runs before (see the run index of
    the record view in ``plans.views``).
    """
    step = F.struct(*order_by, F.col(latency).alias("s"), F.col(ids).alias("t"))
    grouped = steps.groupBy(*keys).agg(
        F.sort_array(F.collect_list(step)).alias("_steps"),
        F.max(peak_bytes).alias("_peak"), *extra)
    return (
        grouped
        .withColumn("generated_ids", F.flatten(F.transform("_steps", lambda s: s["t"])))
        .withColumn("per_token_latencies", F.transform("_steps", lambda s: s["s"]))
        .withColumn("total_time", total_time(F.col("per_token_latencies")))
        .withColumn("time_to_first_token", time_to_first_token(F.col("per_token_latencies")))
        .withColumn("peak_memory_mb", bytes_to_mb(F.col("_peak")))
        .drop("_steps", "_peak")
    )


def flatten_records(runs: DataFrame, conditions: DataFrame | None = None,
                    on: Sequence[str] = ()) -> DataFrame:
    """Condition columns first, then the result columns, in schema order."""
    joined = runs if conditions is None else runs.join(conditions, list(on), "left")
    # arrays keep their type: a cast cannot change whether elements may be null
    return joined.select(*[
        F.col(f.name) if isinstance(f.dataType, ArrayType)
        else F.col(f.name).cast(f.dataType).alias(f.name)
        for f in CONDITION.fields + RESULT.fields])


def union_results(plain: DataFrame, drafted: DataFrame) -> DataFrame:
    """Both kinds in one table; a plain table may lack the drafting columns."""
    both = plain.unionByName(drafted, allowMissingColumns=True)
    return both.select(*[
        F.col(c).cast(RESULT_OPTIONAL[c].dataType).alias(c)
        if c in RESULT_OPTIONAL.names else F.col(c) for c in both.columns])


def keep_one(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """One row per key: the first in ``order_by``.

    An aggregate, not a row number: copies are folded before the shuffle, so a
    key with very many copies costs no more than any other.
    """
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order_by)).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def token_agreement(a: DataFrame, b: DataFrame, key: str, ids: str = "ids") -> DataFrame:
    """Token-for-token comparison of two decoders over their common length."""
    pair = a.select(key, F.col(ids).alias("_a")).join(
        b.select(key, F.col(ids).alias("_b")), key)
    n = F.least(F.size("_a"), F.size("_b"))
    return (
        pair.withColumn("n_compared", n.cast("long"))
        .withColumn("first_mismatch", first_mismatch(F.col("_a"), F.col("_b")))
        .select(key, "n_compared", "first_mismatch",
                F.when(F.col("n_compared") == 0, F.lit("empty"))
                .when(F.col("first_mismatch") < 0, F.lit("equal"))
                .otherwise(F.lit("differs")).alias("verdict")))
