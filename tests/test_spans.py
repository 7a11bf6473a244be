"""Span pairing against a plain walk over the events, in batch and in streams."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from runlens.operators.spans import latest_spans, pair_spans, phase_map
from runlens.streaming.files import read_stream
from runlens.streaming.spans import pair_spans_stream

SCHEMA = "run string, phase string, op string, ts timestamp, event_id bigint"
T0 = dt.datetime(2024, 1, 1)


def walk(rows):
    """The rules, one event after the other."""
    out, since = {}, {}
    for run, phase, op, ts, eid in sorted(rows, key=lambda r: (r[3], r[4])):
        key = (run, phase)
        if op == "start":
            out[eid] = ("already_running" if key in since else "started", None)
            since.setdefault(key, ts)
        elif key in since:
            ms = (ts - since.pop(key)) / dt.timedelta(milliseconds=1)
            out[eid] = ("completed", ms)
        else:
            out[eid] = ("never_started", None)
    return out


def random_log(n, seed, seconds):
    """Half of the events belong to one key."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        hot = rng.random() < 0.5
        run = "hot" if hot else f"r{rng.randint(0, 9)}"
        phase = "draft" if hot else rng.choice(["draft", "verify"])
        op = "start" if rng.random() < 0.6 else "stop"
        ts = T0 + dt.timedelta(milliseconds=rng.randint(0, seconds * 1000))
        rows.append((run, phase, op, ts, i))
    return rows


def results(df):
    return {r.event_id: (r.status, r.elapsed_ms) for r in df.collect()}


def check(got, want):
    assert set(got) == set(want)
    for eid, (status, ms) in want.items():
        assert got[eid][0] == status
        assert got[eid][1] == (pytest.approx(ms) if ms is not None else None)


def test_known_case(spark):
    sec = [T0 + dt.timedelta(seconds=s) for s in range(6)]
    rows = [("r", "a", "start", sec[1], 1), ("r", "a", "start", sec[2], 2),
            ("r", "a", "stop", sec[4], 3), ("r", "b", "stop", sec[5], 4)]
    got = results(pair_spans(spark.createDataFrame(rows, SCHEMA)))
    assert got == {1: ("started", None), 2: ("already_running", None),
                   3: ("completed", 3000.0), 4: ("never_started", None)}


@pytest.mark.parametrize("slice_seconds", [1, 60, 100_000])
def test_batch_equals_walk(spark, slice_seconds):
    rows = random_log(3_000, 1, 3_600)
    got = results(pair_spans(spark.createDataFrame(rows, SCHEMA),
                             slice_seconds=slice_seconds))
    check(got, walk(rows))


def test_null_run_is_kept(spark):
    rows = [(None, "a", "start", T0, 1), (None, "a", "stop", T0 + dt.timedelta(seconds=2), 2)]
    got = results(pair_spans(spark.createDataFrame(rows, SCHEMA)))
    assert got == {1: ("started", None), 2: ("completed", 2000.0)}


def test_latest_span_wins_and_map_keeps_first_order(spark):
    sec = [T0 + dt.timedelta(seconds=s) for s in range(9)]
    rows = [("r", "b", "start", sec[0], 1), ("r", "b", "stop", sec[1], 2),
            ("r", "a", "start", sec[2], 3), ("r", "a", "stop", sec[4], 4),
            ("r", "b", "start", sec[5], 5), ("r", "b", "stop", sec[8], 6)]
    latest = latest_spans(pair_spans(spark.createDataFrame(rows, SCHEMA)))
    row = phase_map(latest).select(F.map_keys("phases").alias("k"),
                                   F.map_values("phases").alias("v")).first()
    assert (row.k, row.v) == (["b", "a"], [3000.0, 2000.0])


def write_files(spark, rows, path, files, seed=1):
    """Files in no order of time, read one per micro-batch."""
    rows = list(rows)
    random.Random(seed).shuffle(rows)
    size = -(-len(rows) // files)
    for i in range(files):
        spark.createDataFrame(rows[i * size:(i + 1) * size], SCHEMA).coalesce(1) \
            .write.mode("append").parquet(path)


def stream(spark, path):
    schema = spark.createDataFrame([], SCHEMA).schema
    return read_stream(spark, path, schema, "parquet", max_files=1)


@pytest.mark.parametrize("runs, files", [(2, 4), (1, 6)])
def test_stream_in_any_order_equals_walk(spark, tmp_path, runs, files):
    """Also with one hot run, whose events lie in every micro-batch."""
    rows = random_log(300, runs, 3_600)
    path = str(tmp_path / "log")
    write_files(spark, rows, path, files)
    check(results(pair_spans_stream(stream(spark, path))), walk(rows))


def test_stream_marks_abandoned_starts(spark, tmp_path):
    hour = dt.timedelta(hours=1)
    rows = [("left", "a", "start", T0, 1), ("left", "a", "start", T0 + hour, 6),
            ("r", "a", "start", T0 + 30 * hour, 2), ("r", "a", "stop", T0 + 31 * hour, 3),
            ("r", "a", "start", T0 + 60 * hour, 4), ("r", "a", "stop", T0 + 61 * hour, 5),
            ("new", "a", "start", T0 + 60 * hour, 7)]
    path = str(tmp_path / "log")
    write_files(spark, rows, path, 3)
    paired = pair_spans_stream(stream(spark, path), expire="10 hours")
    got = {r.event_id: r.status for r in paired.collect()}
    assert got == {1: "open", 6: "already_running", 2: "started", 3: "completed", 4: "started",
                   5: "completed", 7: "started"}
