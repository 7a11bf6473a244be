"""Pairing of a log that arrives in files, while it arrives."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from runlens.operators.spans import pair_spans
from runlens.streaming import live_spans as ls
from runlens.streaming.files import heartbeats, read_stream

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "run string, phase string, op string, ts timestamp, event_id bigint"
HOUR, MICROS = 3600, 1_000_000


@pytest.fixture(autouse=True, scope="module")
def few_state_partitions(spark):
    """State of these small streams in two partitions; every micro-batch writes each of them."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def events(n, seed=0, hot=0):
    """n events over 100 hours; ``hot`` more of one run."""
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "b", "c", None]), rng.choice(["draft", "verify"]),
             rng.choice(["start", "stop", "start"]), at(rng.randrange(100 * HOUR) / HOUR), i)
            for i in range(n)]
    return rows + [("hot", "draft", rng.choice(["start", "stop"]), at(rng.randrange(100 * HOUR) / HOUR), n + i)
                   for i in range(hot)]


def send(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(path))


def close(spark, path, *hours):
    for h in hours:
        heartbeats(spark, spark.createDataFrame([], SCHEMA).schema, at(h)).coalesce(1) \
            .write.mode("append").parquet(str(path))


def stream(spark, path):
    return read_stream(spark, str(path), spark.createDataFrame([], SCHEMA).schema, "parquet", max_files=1)


def sequential(rows, slice_seconds, expire_seconds):
    """One event after another per key, with starts that expire at slice borders."""
    out, by_key = [], {}
    width = slice_seconds * MICROS

    def micros(ts):
        return int((ts - dt.datetime(1970, 1, 1)).total_seconds()) * MICROS
    for run, phase, op, ts, i in rows:
        by_key.setdefault((run, phase), []).append((micros(ts), i, op))
    for key, log in by_key.items():
        running = None
        for us, i, op in [*sorted(log), (1 << 61, None, "heartbeat")]:
            if running:
                border = -(-(running[0] + expire_seconds * MICROS) // width) * width
                if border <= us // width * width:
                    out.append((*key, running[1], "open", None))
                    running = None
            if op == "start":
                out.append((*key, i, "already_running" if running else "started", None))
                running = running or (us, i)
            elif op == "stop":
                out.append((*key, i, "completed" if running else "never_started",
                            (us - running[0]) / 1000 if running else None))
                running = None
    return sorted(out, key=repr)


def as_rows(df):
    return sorted(((r["run"], r["phase"], r["event_id"], r["status"], r["elapsed_ms"])
                   for r in df.collect()), key=repr)


@pytest.mark.parametrize("order", range(2))
def test_equals_batch_pairing_over_files_in_any_order(spark, tmp_path, order):
    rows = events(600, seed=order, hot=300)
    files = [rows[i::6] for i in range(6)]
    random.Random(order).shuffle(files)
    for part in files:
        send(spark, tmp_path / "log", part)
    close(spark, tmp_path / "log", 400, 800)
    got = ls.pair_spans_live(stream(spark, tmp_path / "log"), str(tmp_path / "out"), delay="200 hours")
    assert as_rows(got) == as_rows(pair_spans(spark.createDataFrame(rows, SCHEMA)))


def test_results_appear_while_the_log_goes_on_and_state_stays_small(spark, tmp_path):
    rows = sorted(events(500, seed=7, hot=500), key=lambda r: r[3])
    log, out = tmp_path / "log", str(tmp_path / "out")
    seen = []
    for i in range(5):
        send(spark, log, random.Random(i).sample(rows[i * 200:(i + 1) * 200], 200))
        seen.append(ls.pair_spans_live(stream(spark, log), out, delay="2 hours").count())
    # every call goes on from the last; all but the last few hours are there
    assert seen == sorted(seen) and seen[1] > 150 and 800 < seen[4] < 1000
    close(spark, log, 400, 800)
    got = ls.pair_spans_live(stream(spark, log), out, delay="2 hours")
    assert as_rows(got) == as_rows(pair_spans(spark.createDataFrame(rows, SCHEMA)))

    query = (ls.slice_spans(stream(spark, log), delay="2 hours").writeStream.format("noop")
             .option("checkpointLocation", str(tmp_path / "again")).trigger(availableNow=True).start())
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    # slices of a file that reaches over 20 hours at most, never those of all 100
    assert max(held) < 0.4 * len({(r[0], r[1], r[3].replace(minute=0, second=0)) for r in rows})
    assert held[-1] <= 1


@pytest.mark.parametrize("slice_seconds,expire", [(HOUR, 3 * HOUR), (2 * HOUR, 4 * HOUR)])
def test_starts_expire(spark, tmp_path, slice_seconds, expire):
    rows = sorted(events(250, seed=expire, hot=50), key=lambda r: r[3])
    for i in range(3):
        send(spark, tmp_path / "log", rows[i * 100:(i + 1) * 100])
    close(spark, tmp_path / "log", 400, 800, 1200)
    got = ls.pair_spans_live(stream(spark, tmp_path / "log"), str(tmp_path / "out"), delay="1 minute",
                             slice_seconds=slice_seconds, expire=f"{expire} seconds")
    want = sequential(rows, slice_seconds, expire)
    assert as_rows(got) == want and any(r[3] == "open" for r in want)


def test_empty_stream_and_events_without_a_time(spark, tmp_path):
    (tmp_path / "log").mkdir()
    assert ls.pair_spans_live(stream(spark, tmp_path / "log"), str(tmp_path / "o1")).count() == 0
    send(spark, tmp_path / "log", [("a", "draft", "start", None, 1), ("a", "draft", "start", at(1), 2)])
    close(spark, tmp_path / "log", 40, 80)
    got = ls.pair_spans_live(stream(spark, tmp_path / "log"), str(tmp_path / "o2"))
    assert as_rows(got) == [("a", "draft", 2, "started", None)]


def test_python_is_called_for_many_slices_and_keys_at_once(spark, tmp_path):
    """Slices are gathered without Python, and keys share the states that settle them."""
    rows = [(f"r{i}", "draft", op, at(1 + (op == "stop")), 2 * i + (op == "stop"))
            for i in range(1_000) for op in ("start", "stop")]
    log = tmp_path / "log"
    send(spark, log, rows)
    close(spark, log, 40, 80)
    parts = ls.slice_spans(stream(spark, log))
    assert "FlatMapGroupsInPandasWithState" not in parts._jdf.queryExecution().logical().toString()
    out = tmp_path / "out"
    got = ls.pair_spans_live(stream(spark, log), str(out))
    assert as_rows(got) == as_rows(pair_spans(spark.createDataFrame(rows, SCHEMA)))
    again = ls.settle_slices(spark.readStream.schema(parts.schema).parquet(f"{out}/slices/data"))
    query = (again.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "again"))
             .trigger(availableNow=True).start())
    query.awaitTermination()
    held = [o["numRowsUpdated"] for p in query.recentProgress for o in p["stateOperators"]]
    assert max(held) <= ls.SETTLE_GROUPS
