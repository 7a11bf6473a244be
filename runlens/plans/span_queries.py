"""Queries on start/stop logs and their streaming twins."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from runlens.operators.spans import latest_spans, pair_spans, phase_map
from runlens.plans import views
from runlens.plans.registry import query
from runlens.plans.result_queries import _MEANS, _R, _SUMMARY, _r6
from runlens.schemas import RESULT
from runlens.session import materialize, scratch_path
from runlens.sources.result_files import write_records
from runlens.sources.tables import table
from runlens.streaming.files import heartbeats, read_stream
from runlens.streaming.ledger import drain_once
from runlens.streaming.live_spans import pair_spans_live
from runlens.streaming.summary import drain_summary, drain_windowed

_SPANS = "WITH " + views.SPANS_SQL
_STATUS = " SELECT run, phase, event_id, status, round(elapsed_ms, 6) AS elapsed_ms FROM spans"


def _log(spark, d):
    return views.span_log(table(spark, d, "events"))


@query("span_pairs", _SPANS + _STATUS)
def span_pairs(spark, d):
    return pair_spans(_log(spark, d)).select(
        "run", "phase", "event_id", "status", F.round("elapsed_ms", 6).alias("elapsed_ms"))


@query("span_latest", _SPANS + " SELECT run, phase, round(arg_max(elapsed_ms, (ts, event_id)), 6)"
       " AS elapsed_ms, count(*) AS n_completed FROM spans WHERE status = 'completed'"
       " GROUP BY run, phase")
def span_latest(spark, d):
    return latest_spans(pair_spans(_log(spark, d))).select(
        "run", "phase", F.round("elapsed_ms", 6).alias("elapsed_ms"), "n_completed")


@query("phase_map", _SPANS + """,
latest AS (SELECT run, phase, arg_max(elapsed_ms, (ts, event_id)) AS elapsed_ms, min(ts) AS first_stop
           FROM spans WHERE status = 'completed' GROUP BY run, phase)
SELECT run, string_agg(phase, ',' ORDER BY first_stop, phase) AS phases, count(*) AS n_phases,
       round(max(elapsed_ms) FILTER (WHERE phase = 'draft'), 6) AS draft,
       round(max(elapsed_ms) FILTER (WHERE phase = 'verify'), 6) AS verify,
       round(max(elapsed_ms) FILTER (WHERE phase = 'sampling'), 6) AS sampling
FROM latest GROUP BY run""")
def phase_maps(spark, d):
    """One map per run of its phases' latest spans, in the order in which they first completed."""
    maps = phase_map(latest_spans(pair_spans(_log(spark, d))))
    return maps.select(
        "run", F.array_join(F.map_keys("phases"), ",").alias("phases"),
        F.size("phases").cast("long").alias("n_phases"),
        *[F.round(F.try_element_at("phases", F.lit(p)), 6).alias(p) for p in ("draft", "verify", "sampling")])


def _send(rows, path):
    """One more file of a log; only its own rows come to one task."""
    rows.repartition(1).write.mode("append").parquet(path)


def _send_by_time(rows, time, key, path, files=6):
    """Rows in files of an equal part of the time each, half of every file one file late.

    Returns the newest time and the seconds by which a row can be behind a newer one.
    """
    ends = rows.agg(F.min(time).alias("lo"), F.max(time).alias("hi")).first()
    if ends["lo"] is None:
        return None, 0
    width = max(1, -(-int((ends["hi"] - ends["lo"]).total_seconds() + 1) // files))
    number = (F.unix_seconds(time) - F.unix_seconds(F.lit(ends["lo"]))) / width
    late = F.pmod(F.xxhash64(*key), F.lit(2))
    numbered = rows.withColumn("_file", F.floor(number).cast("int") + late)
    for i in range(files + 1):
        _send(numbered.where(F.col("_file") == i).drop("_file"), path)
    return ends["hi"], 2 * width


SPAN_SLICE = 5 * 86400


@query("stream_spans", _SPANS + _STATUS)
def stream_spans(spark, d):
    """The log in files that are not ordered by time, one to a micro-batch, then its end."""
    path = scratch_path(spark, "span-log")
    events = materialize(_log(spark, d), "span-events")
    newest, behind = _send_by_time(events, "ts", ["event_id"], path)
    if newest is not None:
        for n in (2, 4):
            _send(heartbeats(spark, events.schema,
                             newest + n * timedelta(seconds=behind + SPAN_SLICE)), path)
    stream = read_stream(spark, path, events.schema, "parquet", max_files=1)
    paired = pair_spans_live(stream, scratch_path(spark, "live-spans"), delay=f"{behind} seconds",
                             slice_seconds=SPAN_SLICE)
    return paired.select("run", "phase", "event_id", "status",
                         F.round("elapsed_ms", 6).alias("elapsed_ms"))


@query("stream_summary", f"{_R} SELECT domain, temperature, {_SUMMARY} FROM records GROUP BY ALL")
def stream_summary(spark, d):
    path = scratch_path(spark, "live-records")
    stored = views.records(spark, d).select("domain", "temperature", *RESULT.fieldNames())
    write_records(stored, path)
    stream = read_stream(spark, path, stored.schema, "json")
    return drain_summary(stream).withColumns(_r6(*_MEANS))


@query("stream_summary_windowed", f"""{_R},
dated AS (SELECT *, CAST(date_trunc('day', end_ts) AS TIMESTAMP) AS window_start FROM records),
per_day AS (SELECT window_start, domain, temperature, {_SUMMARY.replace(", 6)", ", 10)")}
            FROM dated GROUP BY ALL)
SELECT *, CASE WHEN window_start = (SELECT min(window_start) FROM dated) THEN n ELSE 0 END AS n_late
FROM per_day""")
def stream_summary_windowed(spark, d):
    """Records of a day are summarised when it is over; those of the first day come once more, too late."""
    path = scratch_path(spark, "live-records")
    stored = materialize(views.records(spark, d).select(
        "domain", "temperature", "end_ts", *RESULT.fieldNames()), "records")
    newest, behind = _send_by_time(stored, "end_ts", ["end_ts", "domain"], path, files=3)
    if newest is not None:
        # what came just before it is judged by the watermark that was known then
        for n in (2, 3):
            _send(heartbeats(spark, stored.schema, newest + timedelta(seconds=2 * behind, days=n),
                             "end_ts"), path)
        first = stored.agg(F.min(F.to_date("end_ts"))).first()[0]
        _send(stored.where(F.to_date("end_ts") == F.lit(first)), path)
    stream = read_stream(spark, path, stored.schema, "parquet", max_files=1)
    return drain_windowed(stream, "end_ts", "1 day", f"{behind} seconds") \
        .withColumns({m: F.round(m, 10) for m in _MEANS}).drop("window_end")


@query("stream_dedup", f"{_R} SELECT config_hash, prompt_id, run_idx, "
       "round(total_time, 6) AS total_time FROM hashed")
def stream_dedup(spark, d):
    """Every record is sent twice at once and again at the end; one copy stays, however late."""
    path = scratch_path(spark, "sent-records")
    records = materialize(views.hashed_records(spark, d).select(
        "config_hash", "prompt_id", "run_idx", "total_time"), "sent")
    for _ in range(3):
        records.write.mode("append").parquet(path)
    stream = read_stream(spark, path, records.schema, "parquet", max_files=4)
    return drain_once(stream, scratch_path(spark, "record-ledger")).select(
        "config_hash", "prompt_id", "run_idx", F.round("total_time", 6).alias("total_time"))
