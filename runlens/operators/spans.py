"""Pairing of start/stop events into spans, and phase summaries.

Rules of one (run, phase): a start while running is an error and keeps the
first start; a stop without a start is an error; a stop closes the span.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F


def pair_spans(log: DataFrame, keys: Sequence[str] = ("run", "phase"),
               slice_seconds: int = 60) -> DataFrame:
    """Give every event its status, and every closing stop its elapsed time.

    ``log`` needs ``keys``, ``op``, ``ts`` and a unique ``event_id``. A key's
    timeline is cut into time slices that are paired independently; what a
    slice hands to the next one (the start still running, if any) comes from
    one summary row per slice. So a key with a third of all events is spread
    over the cluster, and only slice summaries are ordered per key.
    """
    start, stop = F.col("op") == "start", F.col("op") == "stop"
    by_slice = Window.partitionBy("_k", "_slice").orderBy("_us", "event_id")
    islands = (
        # the packed key and the slice are never null: the join below adds no
        # null test to one side only, so both sides share one shuffle
        log.withColumn("_k", F.struct(*keys)).withColumn(
            "_us", F.unix_micros(F.col("ts").cast("timestamp")))
        .withColumn("_slice", F.coalesce(
            F.expr(f"_us div {slice_seconds * 1_000_000}"), F.lit(0).cast("long")))
        .withColumn("_island", F.coalesce(F.sum(stop.cast("int")).over(
            by_slice.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        # the time travels as _us only, so both sides need the same columns
        .select("_k", "_slice", "_island", "_us", "op", "event_id")
    )
    in_island = Window.partitionBy("_k", "_slice", "_island").orderBy(
        "_us", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = (
        islands.withColumn("_first", F.min(F.when(start, F.col("_us"))).over(in_island))
        .withColumn("_starts", F.sum(start.cast("int")).over(in_island))
        .join(_carry_in(islands), ["_k", "_slice"])
        .withColumn("_carry", F.when(F.col("_island") == 0, F.col("_carry")))
    )
    since = F.coalesce("_carry", "_first")
    first_start = start & (F.col("_starts") == 1) & F.col("_carry").isNull()
    return rows.select(
        "_k.*", "event_id", F.timestamp_micros("_us").alias("ts"),
        F.when(first_start, F.lit("started")).when(start, F.lit("already_running"))
        .when(since.isNotNull(), F.lit("completed"))
        .otherwise(F.lit("never_started")).alias("status"),
        F.when(stop, (F.col("_us") - since) / F.lit(1000.0)).alias("elapsed_ms"))


def _carry_in(islands: DataFrame) -> DataFrame:
    """For each slice of a key, the start still running when the slice begins."""
    stop, start = F.col("op") == "stop", F.col("op") == "start"
    # earliest start after the last stop of the slice = last island, lowest time
    last = F.max(F.when(start, F.struct("_island", (-F.col("_us")).alias("neg"))))
    slices = (
        islands.groupBy("_k", "_slice")
        .agg(F.sum(stop.cast("int")).alias("_stops"), last.alias("_last"))
        .withColumn("_open", F.when(F.col("_last._island") == F.col("_stops"),
                                    -F.col("_last.neg")))
    )
    by_key = Window.partitionBy("_k").orderBy("_slice")
    upto = (Window.unboundedPreceding, Window.currentRow)
    return (
        slices.withColumn("_epoch", F.sum((F.col("_stops") > 0).cast("int"))
                          .over(by_key.rowsBetween(*upto)))
        .withColumn("_after", F.min("_open").over(
            Window.partitionBy("_k", "_epoch").orderBy("_slice").rowsBetween(*upto)))
        .withColumn("_carry", F.lag("_after").over(by_key))
        .select("_k", "_slice", "_carry")
    )


def latest_spans(paired: DataFrame, keys: Sequence[str] = ("run", "phase")) -> DataFrame:
    """The last completed span of each key replaces the earlier ones."""
    done = paired.where(F.col("status") == "completed")
    return done.groupBy(*keys).agg(
        F.max_by("elapsed_ms", F.struct("ts", "event_id")).alias("elapsed_ms"),
        F.min("ts").alias("first_stop"), F.count("*").alias("n_completed"))


def phase_map(latest: DataFrame, run: str = "run", phase: str = "phase") -> DataFrame:
    """One map per run, phases in the order in which they first completed.

    ``latest`` has one row per phase, so the list is as short as the phase set.
    """
    entries = F.sort_array(F.collect_list(F.struct(
        "first_stop", F.col(phase).alias("name"), "elapsed_ms")))
    return latest.groupBy(run).agg(F.map_from_entries(F.transform(
        entries, lambda e: F.struct(e["name"], e["elapsed_ms"]))).alias("phases"))
