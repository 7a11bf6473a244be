"""Tables that take every record once, and summaries of windows that are over."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, TimestampType

from runlens.schemas import RECORD
from runlens.streaming.files import heartbeats, read_stream
from runlens.streaming.ledger import append_new, drain_once, read_ledger
from runlens.streaming.summary import drain_windowed

T0 = dt.datetime(2024, 1, 1)
SENT = "config_hash string, prompt_id string, run_idx bigint, sent timestamp"


@pytest.fixture(autouse=True, scope="module")
def few_state_partitions(spark):
    """State of these small streams in two partitions; every micro-batch writes each of them."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_copies_a_hundred_days_apart_come_through_once(spark, tmp_path):
    path, out = str(tmp_path / "sent"), str(tmp_path / "table")
    rows = [(f"h{i}", "p", i % 3, T0) for i in range(60)] + [("hot", "p", 0, T0)] * 500 + [(None, "p", 0, T0)] * 2
    spark.createDataFrame(rows, SENT).repartition(4).write.mode("append").parquet(path)

    def run():
        return drain_once(read_stream(spark, path, spark.read.parquet(path).schema, "parquet", max_files=2), out)
    first = run()
    assert first.count() == 62
    late = [(h, p, i, T0 + dt.timedelta(days=100)) for h, p, i, _ in rows[:200]] + [("new", "p", 0, T0)]
    spark.createDataFrame(late + [(None, "p", 0, T0)], SENT).coalesce(1).write.mode("append").parquet(path)
    second = run()
    assert second.count() == 63
    assert second.where(F.col("sent") > F.lit(T0)).count() == 0
    assert run().exceptAll(second).count() == 0                      # nothing new: nothing added


def test_a_batch_that_is_run_again_adds_nothing(spark, tmp_path):
    out = str(tmp_path / "table")
    batches = [spark.createDataFrame([(f"h{i}", "p", 0, T0) for i in part], SENT)
               for part in (range(10), range(5, 15), range(12, 20))]
    for n, rows in enumerate(batches):
        append_new(rows, n, out)
    before = sorted(map(tuple, read_ledger(spark, out, batches[0].schema).collect()))
    append_new(batches[2], 2, out)
    append_new(batches[2], 2, out)
    assert sorted(map(tuple, read_ledger(spark, out, batches[0].schema).collect())) == before
    assert len(before) == 20


def test_only_keys_of_the_table_are_read(spark, tmp_path):
    out = str(tmp_path / "table")
    rows = spark.createDataFrame([("h", "p", 0, T0)], SENT)
    append_new(rows, 0, out)
    earlier = read_ledger(spark, out, rows.schema).where("batch < 1").select("config_hash")
    plan = earlier._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<config_hash:string>" in plan and "PartitionFilters" in plan


def records(spark, spec):
    rows = [("m", f"p{i}", "code", 5, 0.0, 128, 0, [1], [0.1], 0.1, 1.0, 0.1) + (None,) * 6 + (ts,)
            for i, ts in enumerate(spec)]
    return spark.createDataFrame(rows, StructType([*RECORD.fields, StructField("end_ts", TimestampType())]))


def test_windows_close_and_late_records_are_counted(spark, tmp_path):
    path = str(tmp_path / "records")
    day = dt.timedelta(days=1)
    sends = [[T0, T0 + day / 2, T0 + day], [T0 + day / 4, T0 + 2 * day], [T0 + 10 * day],
             [T0 + 10 * day],                                       # lateness is told by the batch before
             [T0 + day / 3, T0 + 5 * day, None]]                    # a day 0 and a day 5 record, too late
    for times in sends:
        records(spark, times).coalesce(1).write.mode("append").parquet(path)
    schema = spark.read.parquet(path).schema
    heartbeats(spark, schema, T0 + 20 * day, "end_ts").coalesce(1).write.mode("append").parquet(path)
    got = drain_windowed(read_stream(spark, path, schema, "parquet", max_files=1), "end_ts", "1 day", "1 day")
    rows = {(r["window_start"] - T0).days: (r["n"], r["n_late"]) for r in got.collect()}
    assert rows == {0: (3, 1), 1: (1, 0), 2: (1, 0), 5: (0, 1), 10: (2, 0)}
