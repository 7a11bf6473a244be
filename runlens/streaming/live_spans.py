"""Start/stop pairing while the log arrives, with keyed state and event-time timers.

Two stateful queries, so that a run with very many events is not one task:

* ``slice_spans`` collects the events of each (key, time slice) until the watermark
  has passed the slice, then pairs the lists of many slices a call and lets them go. What
  depends on earlier slices (the first start and the first stop) stays open.
* ``settle_slices`` keeps one start at most per key, the one still running. It
  reads three rows a slice at most, settles what was open, and a timer ends a
  start that found no stop.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MICROS = 1_000_000
#: groups of keys that share a state when slices are settled; part of the stored state
SETTLE_GROUPS = 256

_EVENT = T.StructType([
    T.StructField("slice_end", T.TimestampType()), T.StructField("event_id", T.LongType()),
    T.StructField("us", T.LongType()), T.StructField("op", T.StringType()),
    T.StructField("status", T.StringType()), T.StructField("elapsed_ms", T.DoubleType()),
    # on the row with op "end": the start still running, if a stop came before it
    T.StructField("open_id", T.LongType()), T.StructField("open_us", T.LongType())])


_ARROW = {T.LongType(): pa.int64(), T.StringType(): pa.string(), T.DoubleType(): pa.float64()}


def pair_in_slice(events: list[tuple[int, int, str]]) -> list[tuple]:
    """(event_id, us, op, status, elapsed_ms, open_id, open_us) of ordered events (us, event_id, op).

    The status is None where it depends on what was running before. The last row
    has op "end" and the start that runs on from a known state.
    """
    rows, running, stopped = [], None, False
    for us, event, op in events:
        status = elapsed = None
        if op == "start":
            if running is not None:
                status = "already_running"
            else:
                running = us, event
                status = "started" if stopped else None
        elif op == "stop":
            if stopped:
                status = "never_started" if running is None else "completed"
                elapsed = None if running is None else (us - running[0]) / 1000.0
            running, stopped = None, True
        else:
            continue
        rows.append((event, us, op, status, elapsed, None, None))
    open_us, open_id = running if stopped and running else (None, None)
    rows.append((None, events[-1][0] if events else None, "end", None, None, open_id, open_us))
    return rows


def _frame(rows: list[tuple], columns: Sequence[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=list(columns))
    for c in ("event_id", "us"):
        out[c] = out[c].astype("Int64")
    return out


def slice_spans(log: DataFrame, keys: Sequence[str] = ("run", "phase"), delay: str = "1 hour",
                slice_seconds: int = 3600) -> DataFrame:
    """Events of a streamed log, paired within slices of time once these are complete.

    ``log`` needs ``keys``, ts, event_id and op. An event may arrive ``delay`` of
    event time after a later one; what comes later still is dropped by the
    watermark if its slice is over (``numRowsDroppedByWatermark`` of the progress counts it). Events
    without a time have no place in the order and are left out. An op other than
    start and stop moves the time on and has no row of its own.
    """
    keys = list(keys)
    fields = [f for f in log.schema.fields if f.name in keys]
    fields.sort(key=lambda f: keys.index(f.name))
    out = T.StructType([*fields, *_EVENT.fields])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, columns = [], [[] for _ in _EVENT.fields[1:]]
            for i, events in enumerate(batch.column("_events").to_pylist()):
                rows = pair_in_slice([(e["us"], e["event_id"], e["op"]) for e in events])
                group += [i] * len(rows)
                for column, values in zip(columns, zip(*rows)):
                    column += values
            at = pa.array(group, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(at) for c in (*keys, "slice_end")]
                + [pa.array(c, _ARROW[f.dataType]) for f, c in zip(_EVENT.fields[1:], columns)],
                names=out.fieldNames())

    event = F.struct(F.unix_micros("ts").alias("us"), "event_id", "op")
    # the slices that a micro-batch touches change by one row each; only those that are over leave
    slices = (
        log.where(F.col("ts").isNotNull())
        .select(*keys, F.col("ts").cast("timestamp").alias("ts"), "event_id", "op")
        .withWatermark("ts", delay)
        .groupBy(*keys, F.window("ts", f"{slice_seconds} seconds").alias("_slice"))
        .agg(F.collect_list(event).alias("_events")))
    return slices.select(*keys, F.col("_slice.end").alias("slice_end"), F.sort_array("_events").alias("_events")) \
        .mapInArrow(pair, out)


def settle_slices(slices: DataFrame, keys: Sequence[str] = ("run", "phase"),
                  slice_seconds: int = 3600, expire: str | None = None) -> DataFrame:
    """What ``slice_spans`` left open, settled in the order of the slices of each key.

    With ``expire`` (a whole number of seconds, minutes, hours or days) a start that
    is still running at the first slice border at least that much after it gets
    one more row with the status ``open`` and is forgotten: a stop that comes later
    was never started. The state of a key is one start, or nothing; the keys are dealt
    into ``SETTLE_GROUPS`` states by hash.

    Batches of ``slice_spans`` must not be split over batches of this query, so
    its source takes no limit of files.
    """
    keys = list(keys)
    width = slice_seconds * MICROS
    wait = None if expire is None else _micros(expire)
    fields = sorted((f for f in slices.schema.fields if f.name in keys), key=lambda f: keys.index(f.name))
    kept = [f for f in _EVENT.fields if f.name in ("event_id", "us", "status", "elapsed_ms")]

    def deadline(since: int) -> int:
        return -(-(since + wait) // width) * width

    def settle(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # of each key the start that is running: time and event_id
        running = {k: (us, i) for k, us, i in zip(*state.get)} if state.exists else {}
        rows: list[tuple] = []

        def ended_by(name: str, border: int) -> None:
            if wait is not None and name in running and deadline(running[name][0]) <= border:
                us, event = running.pop(name)
                rows.append((name, event, us, "open", None))

        if not state.hasTimedOut:
            table = pd.concat(list(batches))
            table["open_id"] = table["open_id"].astype("Int64")
            # the end row has the time of the last event, so it is sorted by its op, too
            table = table.sort_values(["border", "last", "us", "event_id"], na_position="last")
            # ends come last in a slice, and every key has one in each of its slices
            for r in table.itertuples(index=False):
                ended_by(r.key, int(r.border) - width)
                since = running.get(r.key)
                if r.op == "start":
                    rows.append((r.key, int(r.event_id), int(r.us), "already_running" if since else "started", None))
                    running.setdefault(r.key, (int(r.us), int(r.event_id)))
                elif r.op == "stop":
                    rows.append((r.key, int(r.event_id), int(r.us), "completed" if since else "never_started",
                                 (int(r.us) - since[0]) / 1000.0 if since else None))
                    running.pop(r.key, None)
                else:
                    if not pd.isna(r.open_id):
                        running[r.key] = int(r.open_us), int(r.open_id)
                    ended_by(r.key, int(r.border))
        # what a stop could still end lies beyond the watermark
        for name in list(running):
            ended_by(name, state.getCurrentWatermarkMs() * 1000)
        if not running:
            state.remove()
        else:
            state.update((list(running), [us for us, _ in running.values()], [i for _, i in running.values()]))
            if wait is not None:
                state.setTimeoutTimestamp(max(min(deadline(us) for us, _ in running.values()) // 1000,
                                              state.getCurrentWatermarkMs() + 1))
        if rows:
            yield _frame(rows, ["key", *[f.name for f in kept]])

    # one state and one call of Python for many keys; the key goes along as JSON
    key = F.struct(*keys)
    open_rows = slices.where(F.col("status").isNull()).select(
        F.pmod(F.xxhash64(*keys), F.lit(SETTLE_GROUPS)).alias("_group"), F.to_json(key).alias("key"),
        "slice_end", F.unix_micros("slice_end").alias("border"), "us", "event_id", "op",
        (F.col("op") == "end").alias("last"), "open_id", "open_us")
    settled = open_rows.withWatermark("slice_end", "0 seconds").groupBy("_group").applyInPandasWithState(
        settle, T.StructType([T.StructField("key", T.StringType()), *kept]),
        "names array<string>, since array<long>, ids array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    return settled.withColumn("key", F.from_json("key", T.StructType(fields))).select(
        "key.*", *[f.name for f in kept])


def _micros(interval: str) -> int:
    number, unit = interval.split()
    return int(number) * MICROS * {
        "second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]


def pair_spans_live(log: DataFrame, path: str, keys: Sequence[str] = ("run", "phase"),
                    delay: str = "1 hour", slice_seconds: int = 3600,
                    expire: str | None = None) -> DataFrame:
    """Pair what has arrived of a streamed log, and return all that is settled so far.

    State, progress and results are kept below ``path`` (in the shared folder), so a
    later call goes on from there, also on other machines. Columns: keys,
    event_id, ts, status and elapsed_ms, as the batch pairing gives them, and with
    ``expire`` an extra row ``open`` for each start that found no stop in time. Events
    of slices that the watermark has not passed are still held back; an event of
    another op (see ``files.heartbeats``) later than everything lets them go.
    """
    spark = log.sparkSession
    keys = list(keys)
    parts = slice_spans(log, keys, delay, slice_seconds)
    _advance(parts, f"{path}/slices")
    schema = parts.schema
    try:
        stored = spark.read.schema(schema).parquet(f"{path}/slices/data")
    except AnalysisException:
        # no file has arrived yet
        return spark.createDataFrame([], schema).select(*_result(keys))
    again = spark.readStream.schema(schema).parquet(f"{path}/slices/data")
    settled = settle_slices(again, keys, slice_seconds, expire)
    _advance(settled, f"{path}/settled")
    rest = spark.read.schema(settled.schema).parquet(f"{path}/settled/data")
    return stored.where(F.col("status").isNotNull()).select(*_result(keys)) \
        .unionByName(rest.select(*_result(keys)))


def _result(keys: list[str]) -> list:
    return [*keys, "event_id", F.timestamp_micros("us").alias("ts"), "status", "elapsed_ms"]


def _advance(stream: DataFrame, path: str) -> None:
    stream.writeStream.format("parquet").outputMode("append") \
        .option("path", f"{path}/data").option("checkpointLocation", f"{path}/progress") \
        .trigger(availableNow=True).start().awaitTermination()
