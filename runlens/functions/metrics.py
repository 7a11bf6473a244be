"""Per-run derived measurements as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from runlens.functions.formatting import fixed


def num_tokens(ids: Column) -> Column:
    return F.size(ids).cast("long")


def tokens_per_second(n: Column, total_time: Column) -> Column:
    """Throughput; 0.0 for a run that took no time (ANSI mode would raise)."""
    return F.when(total_time == 0, F.lit(0.0)).otherwise(n / total_time)


def interpolated(low: Column, high: Column, share: Column) -> Column:
    """The value at ``share`` of the way from low to high, taken from the nearer end.

    From one end only, a result that is printed rounded would differ from
    numpy's in the last digit of a double, and so at a tie in the whole number.
    """
    gap = high - low
    return F.when(share < 0.5, low + gap * share).otherwise(high - gap * (1 - share))


def sorted_percentile(sorted_values: Column, q: float) -> Column:
    """Linear-interpolated percentile of an ascending array; null when empty."""
    n = F.size(sorted_values)
    pos = F.lit(float(q)) * (n - 1)
    lo = F.floor(pos).cast("int")
    hi = F.least(lo + 1, n - 1)
    a, b = F.get(sorted_values, lo), F.get(sorted_values, hi)
    return F.when(n > 0, interpolated(a, b, pos - lo))


def with_metrics(df: DataFrame) -> DataFrame:
    """Add the computed columns of a result row to its stored columns."""
    # the sort is a column of its own, so three percentiles share one sort
    return (
        df.withColumn("_sorted", F.sort_array("per_token_latencies"))
        .withColumn("num_tokens", num_tokens(F.col("generated_ids")))
        .withColumn("tokens_per_second",
                    tokens_per_second(F.col("num_tokens"), F.col("total_time")))
        .withColumns({
            f"latency_p{p}": sorted_percentile(F.col("_sorted"), p / 100)
            for p in (50, 95, 99)
        })
        .withColumn("is_speculative", F.col("acceptance_rate").isNotNull())
        .drop("_sorted")
    )


def summary_line() -> Column:
    """One line of text per run, from the stored and computed columns."""
    drafted = F.col("acceptance_rate").isNotNull()
    return F.concat(
        F.when(drafted, F.lit("SD ")).otherwise(F.lit("AR ")),
        F.lit(" | "), F.col("num_tokens").cast("string"), F.lit(" tok | "),
        fixed(F.col("tokens_per_second"), 1), F.lit(" tok/s | p50="),
        fixed(F.col("latency_p50") * 1000, 0), F.lit("ms p95="),
        fixed(F.col("latency_p95") * 1000, 0), F.lit("ms | mem="),
        fixed(F.col("peak_memory_mb"), 0), F.lit("MB"),
        F.when(drafted, F.concat(
            F.lit(" | accept="), fixed(F.col("acceptance_rate"), 2),
            F.lit(" rounds="), F.col("num_speculation_rounds").cast("string"),
        )).otherwise(F.lit("")),
    )


def total_time(latencies: Column) -> Column:
    return F.aggregate(latencies, F.lit(0.0), lambda acc, x: acc + x)


def time_to_first_token(latencies: Column) -> Column:
    return F.get(latencies, F.lit(0))


def bytes_to_mb(n: Column) -> Column:
    return n / F.lit(float(1024 ** 2))


def bytes_to_gb(n: Column) -> Column:
    return n / F.lit(float(1024 ** 3))


def seconds_to_ms(s: Column) -> Column:
    return s * F.lit(1000.0)
