"""Live summary and re-sent records."""

from __future__ import annotations

import datetime as dt

from runlens.functions.metrics import with_metrics
from runlens.operators.reports import run_summary
from runlens.schemas import RECORD
from runlens.sources.result_files import read_records, write_records
from runlens.streaming.dedup import drop_resent, with_arrival
from runlens.streaming.files import drain, read_stream
from runlens.streaming.summary import drain_summary


def records(spark, n=60):
    rows = []
    for i in range(n):
        lat = [0.01 * (1 + (i + j) % 7) for j in range(1 + i % 5)]
        rows.append(("m", f"code_{i:03d}", ("code", "conversation")[i % 2], 5, 0.6 * (i % 3 > 0),
                     128, 0, list(range(len(lat))), lat, sum(lat), float(i), lat[0])
                    + (None,) * 6)
    return spark.createDataFrame(rows, RECORD)


def test_live_summary_equals_batch(spark, tmp_path):
    path = str(tmp_path / "records")
    df = records(spark)
    for part in df.randomSplit([1.0, 1.0, 1.0], seed=1):
        write_records(part.coalesce(1), path, mode="append")
    live = drain_summary(read_stream(spark, path, RECORD, "json", max_files=1)).collect()
    batch = run_summary(with_metrics(df)).collect()
    assert [r[:2] + (r.n,) for r in live] == [r[:2] + (r.n,) for r in batch]
    for a, b in zip(live, batch):
        assert abs(a.mean_tok_s - b.mean_tok_s) < 1e-9 and abs(a.mean_p95_ms - b.mean_p95_ms) < 1e-9


def test_records_round_trip(spark, tmp_path):
    path = str(tmp_path / "out" / "records")
    df = records(spark)
    write_records(with_metrics(df), path)
    assert '"acceptance_rate":null' in spark.read.text(path).first().value
    back = read_records(spark, path)
    assert back.exceptAll(with_metrics(df).select(*back.columns)).count() == 0
    assert back.count() == df.count()


def test_resent_records_come_through_once(spark, tmp_path):
    """One record is sent very many times, over several micro-batches."""
    t0 = dt.datetime(2024, 1, 1)
    rows = [(f"h{i}", "p", i, t0 + dt.timedelta(minutes=i)) for i in range(50)]
    rows += [("hot", "p", 0, t0 + dt.timedelta(minutes=i % 50)) for i in range(400)]
    schema = "config_hash string, prompt_id string, run_idx bigint, end_ts timestamp"
    path = str(tmp_path / "sent")
    for lo in range(0, len(rows), 150):
        spark.createDataFrame(rows[lo:lo + 150], schema).coalesce(2) \
            .write.mode("append").parquet(path)
    spark.createDataFrame(rows[:50], schema).coalesce(1).write.mode("append").parquet(path)
    stream = read_stream(spark, path, spark.read.parquet(path).schema, "parquet", max_files=2)
    got = drain(drop_resent(with_arrival(stream)), "test-dedup")
    assert sorted(r.config_hash for r in got.collect()) == sorted({r[0] for r in rows})


def test_old_records_that_arrive_late_are_kept(spark, tmp_path):
    """A hundred days of records, the newest file first; then some of them again."""
    t0 = dt.datetime(2024, 1, 1)
    schema = "config_hash string, prompt_id string, run_idx bigint, end_ts timestamp"
    path = str(tmp_path / "days")
    rows = [(f"h{i}", "p", i, t0 + dt.timedelta(days=i)) for i in reversed(range(100))]
    for lo in range(0, 100, 20):
        spark.createDataFrame(rows[lo:lo + 20], schema).coalesce(1).write.mode("append").parquet(path)
    spark.createDataFrame(rows[10:70], schema).coalesce(1).write.mode("append").parquet(path)
    stream = read_stream(spark, path, spark.read.parquet(path).schema, "parquet", max_files=1)
    got = drain(drop_resent(with_arrival(stream)), "test-late")
    assert sorted(r.config_hash for r in got.collect()) == sorted(r[0] for r in rows)


def test_a_stream_without_files_gives_no_rows(spark, tmp_path):
    empty = tmp_path / "empty"
    empty.mkdir()
    stream = read_stream(spark, str(empty), RECORD, "json")
    got = drain(stream.select("prompt_id"), "test-empty")
    assert got.columns == ["prompt_id"] and got.count() == 0
