"""The run summary kept up to date while records arrive."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from runlens.functions.metrics import with_metrics
from runlens.operators.reports import run_summary, summary_columns
from runlens.session import scratch_path
from runlens.streaming.files import drain


def live_summary(stored_records: DataFrame) -> DataFrame:
    """Streaming twin of the batch summary over stored record columns."""
    return run_summary(with_metrics(stored_records))


def drain_summary(stored_records: DataFrame) -> DataFrame:
    """Run the live summary to the end of the input and return its last state.

    Complete mode on a report-sized result (domains x temperatures), which is
    what the in-memory table holds; records themselves never reach it. State and
    progress are kept in the shared folder.
    """
    progress = scratch_path(stored_records.sparkSession, "live-summary")
    name = f"live_summary_{uuid.uuid4().hex}"
    query = (
        live_summary(stored_records).writeStream.outputMode("complete")
        .format("memory").queryName(name)
        .option("checkpointLocation", progress).trigger(availableNow=True).start())
    query.awaitTermination()
    return stored_records.sparkSession.table(name)


GROUP = ("domain", "temperature")


def windowed_summary(records: DataFrame, time: str, width: str, delay: str) -> DataFrame:
    """The run summary of every window of event time, put out once the window is over.

    A window is over when the watermark, ``delay`` behind the newest record, has
    passed its end; its state is dropped then. Append mode, so a row is final.
    """
    return (with_metrics(records).withWatermark(time, delay)
            .groupBy(F.window(time, width), *GROUP).agg(*summary_columns())
            .select(F.col("window.start").alias("window_start"),
                    F.col("window.end").alias("window_end"), *GROUP,
                    "mean_tok_s", "mean_ttft_ms", "mean_p95_ms", "mean_peak_mb", "n"))


def arrivals(records: DataFrame, time: str, width: str) -> DataFrame:
    """Records of every window and group, late ones too: one small row each."""
    return records.groupBy(F.window(time, width), *GROUP).agg(
        F.count(F.lit(1)).alias("n_arrived"), F.max(time).alias("newest"))


def drain_windowed(records: DataFrame, time: str, width: str = "1 day",
                   delay: str = "1 day") -> DataFrame:
    """Summaries of the windows that are over when the stream has been read, late records counted.

    A record whose window was over before it came is not in the summary. It is
    not lost unseen: a second query counts all records of each window, and
    ``n_late`` says how many the summary lacks. A group with late records only has
    its row too, with n = 0. Records without a time belong to no window.
    """
    spark = records.sparkSession
    closed = drain(windowed_summary(records, time, width, delay), "windowed-summary")
    name = f"arrivals_{uuid.uuid4().hex}"
    # complete mode on rows of the report's size: windows x domains x temperatures
    arrivals(records, time, width).writeStream.outputMode("complete").format("memory") \
        .queryName(name).option("checkpointLocation", scratch_path(spark, "arrivals")) \
        .trigger(availableNow=True).start().awaitTermination()
    all_rows = spark.table(name)
    newest = all_rows.agg(F.max("newest")).first()[0]
    over = all_rows.where(F.col("window.end") <= F.lit(newest) - F.expr(f"interval {delay}")).select(
        F.col("window.start").alias("_start"), F.col("window.end").alias("_end"),
        *[F.col(c).alias(f"_{c}") for c in GROUP], "n_arrived")
    same = F.col("_start") == F.col("window_start")
    for c in GROUP:
        same = same & F.col(f"_{c}").eqNullSafe(F.col(c))
    return over.join(closed, same, "left").select(
        F.col("_start").alias("window_start"), F.col("_end").alias("window_end"),
        *[F.col(f"_{c}").alias(c) for c in GROUP],
        "mean_tok_s", "mean_ttft_ms", "mean_p95_ms", "mean_peak_mb",
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
        (F.col("n_arrived") - F.coalesce("n", F.lit(0))).cast("long").alias("n_late"))
