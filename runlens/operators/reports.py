"""Grouped reports over run records. All groupings combine before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from runlens.functions import distributions as dist
from runlens.functions.metrics import seconds_to_ms
from runlens.operators import ranked
from runlens.schemas import DRAFT_LENGTHS

TAIL = {"p50": 0.50, "p95": 0.95, "p99": 0.99}


def summary_columns():
    """Means of a group of runs, and their number."""
    return [
        F.avg("tokens_per_second").alias("mean_tok_s"),
        seconds_to_ms(F.avg("time_to_first_token")).alias("mean_ttft_ms"),
        seconds_to_ms(F.avg("latency_p95")).alias("mean_p95_ms"),
        F.avg("peak_memory_mb").alias("mean_peak_mb"),
        F.count("*").alias("n"),
    ]


def run_summary(records: DataFrame) -> DataFrame:
    """Means by domain and temperature; p95 is the mean of the runs' own p95."""
    return (records.groupBy("domain", "temperature").agg(*summary_columns())
            .orderBy("domain", "temperature"))


def run_summary_rollup(records: DataFrame) -> DataFrame:
    """The summary, domain subtotals and the grand total with the peak memory."""
    return records.rollup("domain", "temperature").agg(
        *summary_columns(), F.max("peak_memory_mb").alias("peak_mb"),
        F.grouping_id().cast("long").alias("level"))


def peak_memory(records: DataFrame) -> DataFrame:
    return records.agg(F.max("peak_memory_mb").alias("peak_mb"))


def measured_speedup(records: DataFrame) -> DataFrame:
    """Each drafted run against its plain baseline.

    The baseline is the mean of the plain runs of the same prompt, temperature
    and pair: one row a group, combined within tasks. The join with the drafted
    runs has unique keys on that side, so a prompt with very many runs is split. A
    drafted run without a plain one stays, with no baseline and no speedup.
    """
    key = ["prompt_id", "temperature", "model_pair_name"]
    # never null itself, so runs with a null in their key find their baseline, too
    packed = F.struct(*key).alias("_k")
    baseline = records.where(F.col("K").isNull()).groupBy(packed).agg(
        F.avg("tokens_per_second").alias("baseline_tok_s"))
    drafted = records.where(F.col("K").isNotNull()).withColumn("_k", F.struct(*key))
    return (drafted.join(baseline, "_k", "left").drop("_k")
            .withColumn("speedup", F.when(
                F.col("baseline_tok_s") > 0,
                F.col("tokens_per_second") / F.col("baseline_tok_s"))))


def acceptance_cube(speedups: DataFrame) -> DataFrame:
    """Acceptance and speedup over every combination of pair, domain and K."""
    return speedups.cube("model_pair_name", "domain", "K").agg(
        F.avg("acceptance_rate").alias("mean_acceptance"),
        F.avg("speedup").alias("mean_speedup"), F.count("*").alias("n"),
        F.grouping_id().cast("long").alias("level"))


def speedup_pivot(speedups: DataFrame, ks: Sequence[int] = DRAFT_LENGTHS) -> DataFrame:
    """Heat-map table: mean speedup with one column per K."""
    return speedups.groupBy("model_pair_name", "domain").agg(*(
        F.avg(F.when(F.col("K") == k, F.col("speedup"))).alias(f"k{k}") for k in ks))


def group_rates(speedups: DataFrame) -> DataFrame:
    """Acceptance, measured speedup and cost ratio per pair, domain and K.

    One round drafts K times and verifies once, hence c = draft/(K*verify).
    """
    draft, verify = F.sum("draft_time_total_ms"), F.sum("verify_time_total_ms")
    return speedups.groupBy("model_pair_name", "domain", "K").agg(
        F.avg("acceptance_rate").alias("beta"),
        F.avg("speedup").alias("measured_speedup"),
        F.when(verify > 0, draft / (F.col("K") * verify)).alias("cost_ratio"),
        F.count("*").alias("n"))


def speedup_model(speedups: DataFrame) -> DataFrame:
    """Modelled against measured speedup, with the break-even acceptance."""
    b, k, c = F.col("beta"), F.col("K"), F.col("cost_ratio")
    return (
        group_rates(speedups)
        .withColumn("expected_tokens", dist.expected_tokens(b, k))
        .withColumn("modelled_speedup", dist.modelled_speedup(b, k, c))
        .withColumn("break_even_beta", dist.break_even_beta(k, c))
    )


def below_break_even(speedups: DataFrame) -> DataFrame:
    return speedup_model(speedups).where(F.col("beta") < F.col("break_even_beta"))


def best_k(speedups: DataFrame, epsilon: float = 0.05) -> DataFrame:
    """The K with the highest mean speedup per pair and domain.

    Ties go to the smaller K; a K without a speedup is chosen only if no other
    of its group has one.
    """
    rates = group_rates(speedups)
    best = rates.groupBy("model_pair_name", "domain").agg(
        F.min(F.struct(F.col("measured_speedup").isNull().alias("none"),
                       (-F.col("measured_speedup")).alias("s"), "K", "beta")).alias("_b"))
    return best.select(
        "model_pair_name", "domain", F.col("_b.K").alias("best_k"),
        (-F.col("_b.s")).alias("best_speedup"),
        dist.optimal_draft_length(F.col("_b.beta"), epsilon).alias("theory_k"))


def results_by_config(records: DataFrame) -> DataFrame:
    # the hash fixes pair and K; as keys they keep this a hash aggregate
    return records.groupBy("config_hash", "model_pair_name", "K").agg(
        F.count("*").alias("n"), F.avg("tokens_per_second").alias("mean_tok_s"))


def round_rollup(rounds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Run figures from its rounds: proposed and accepted drafts per round."""
    proposed = F.sum("proposed")
    return rounds.groupBy(*keys).agg(
        F.when(proposed > 0, F.sum("accepted") / proposed).alias("acceptance_rate"),
        F.avg(F.col("accepted") + 1).alias("tokens_per_step"),
        F.count("*").alias("num_speculation_rounds"))


def phase_totals(phases: DataFrame, keys: Sequence[str],
                 names: Sequence[str] = ("draft", "verify", "sampling")) -> DataFrame:
    """Milliseconds per phase of a run, and of all its phases, in one aggregate."""
    return phases.groupBy(*keys).agg(
        *(F.coalesce(F.sum(F.when(F.col("phase") == n, F.col("ms"))), F.lit(0.0)).alias(f"{n}_ms")
          for n in names),
        F.sum("ms").alias("whole_ms"))


def phase_breakdown(totals: DataFrame, keys: Sequence[str],
                    whole: str = "whole_ms") -> DataFrame:
    """Share of each phase in a run's time, of which phases without a name are part."""
    whole = F.col(whole)

    def share(x):
        return F.when(whole > 0, x / whole)

    return totals.select(
        *keys, share(F.col("draft_ms")).alias("draft_share"),
        share(F.col("verify_ms")).alias("verify_share"),
        share(whole - F.col("draft_ms") - F.col("verify_ms")).alias("overhead_share"))


def pooled_latency(steps: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Tail over all steps of a group, which is not the mean of run tails."""
    return ranked.exact_percentiles(steps, keys, value, TAIL)


def pooled_latency_approx(steps: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return ranked.approx_percentiles(steps, keys, value, TAIL)


def latency_cdf(steps: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return ranked.value_distribution(steps, keys, value)


def acceptance_histogram(records: DataFrame, keys: Sequence[str] = ("K",),
                         bins: int = 10) -> DataFrame:
    """Runs per acceptance bin; a rate of 1 belongs to the last bin."""
    rate = F.col("acceptance_rate")
    return (
        records.where(rate.isNotNull())
        .withColumn("bin", F.least(F.floor(rate * bins), F.lit(bins - 1)).cast("long"))
        .groupBy(*keys, "bin").agg(F.count("*").alias("n")))
