"""Start/stop pairing of a log that arrives as a stream, in any order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from runlens.operators.spans import pair_spans
from runlens.streaming.files import drain


def pair_spans_stream(log: DataFrame, keys: Sequence[str] = ("run", "phase"),
                      slice_seconds: int = 60, expire: str | None = None) -> DataFrame:
    """Pair the events of a streamed log when the stream has ended.

    What an event means depends on all events before it, and micro-batches come
    in any order; so the stream only gathers the events, once each, in the
    shared folder, and pairing runs over what was gathered. It is the batch
    pairing, which cuts each key's time into slices, so neither the number nor
    the order of micro-batches changes the result, and a hot key is many tasks.
    With ``expire``, a start that found no stop within that interval before the
    newest event of the log gets the status ``open``.
    """
    events = drain(log.select(*keys, "ts", "event_id", "op"), "span-events")
    paired = pair_spans(events, keys, slice_seconds)
    if expire is None:
        return paired
    key = F.struct(*keys)
    newest = F.lit(events.agg(F.max("ts")).first()[0])
    # of each key, the last start that began a span, unless a stop came after it
    open_ = paired.where(F.col("status").isin("started", "completed")) \
        .groupBy(key.alias("_key")).agg(
            F.max(F.struct("ts", "event_id", "status")).alias("_last")) \
        .where(F.col("_last.status") == "started") \
        .where(F.col("_last.ts") < newest - F.expr(f"interval {expire}")) \
        .select("_key", F.col("_last.event_id").alias("_open"))
    return paired.withColumn("_key", key).join(open_, "_key", "left") \
        .withColumn("status", F.when(F.col("event_id") == F.col("_open"), "open")
                    .otherwise(F.col("status"))).drop("_key", "_open")
