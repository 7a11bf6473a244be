"""Derived measurements: known values, limits and agreement with numpy."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.functions.metrics import sorted_percentile, summary_line, with_metrics
from runlens.schemas import RESULT

LATENCIES = [0.25, 0.05, 0.15, 0.45, 0.35, 0.75]
PLAIN = ([3, 1, 4, 1, 5, 9], LATENCIES, 2.0, 640.0, 0.25) + (None,) * 6
DRAFTED = ([2, 7, 1, 8, 2, 8], LATENCIES, 0.75, 3072.0, 0.05,
           0.64, 3.5, 11, 42.25, 97.5, 6.125)


def measured(spark, *rows):
    return with_metrics(spark.createDataFrame(list(rows), RESULT))


def test_percentiles_interpolate(spark):
    row = measured(spark, PLAIN).first()
    # between the sorted values 0.25 and 0.35, then between 0.45 and 0.75
    assert row.latency_p50 == pytest.approx(0.30)
    assert row.latency_p95 == pytest.approx(0.45 + 0.75 * 0.30)
    assert row.latency_p99 == pytest.approx(0.45 + 0.95 * 0.30)
    assert row.latency_p50 <= row.latency_p95 <= row.latency_p99


def test_percentiles_equal_numpy(spark):
    rng = random.Random(3)
    rows = []
    for n in (1, 2, 3, 7, 20, 128, 500):
        lat = [rng.expovariate(20) for _ in range(n)]
        rows.append((list(range(n)), lat, sum(lat), 1.0, lat[0]) + (None,) * 6)
    for row in measured(spark, *rows).collect():
        for p in (50, 95, 99):
            assert row[f"latency_p{p}"] == pytest.approx(
                np.percentile(row.per_token_latencies, p), abs=1e-12)


def test_one_token_has_one_latency(spark):
    row = measured(spark, ([7], [0.25], 0.25, 0.0, 0.25) + (None,) * 6).first()
    assert row.latency_p50 == row.latency_p95 == row.latency_p99 == 0.25


def test_no_latencies_give_null(spark):
    row = measured(spark, ([], [], 0.0, 0.0, 0.0) + (None,) * 6).first()
    assert row.latency_p50 is None and row.num_tokens == 0


def test_throughput(spark):
    zero = ([1, 2, 3], [0.0] * 3, 0.0, 0.0, 0.0) + (None,) * 6
    rows = measured(spark, PLAIN, DRAFTED, zero).collect()
    assert [r.tokens_per_second for r in rows] == [3.0, 8.0, 0.0]
    assert [r.num_tokens for r in rows] == [6, 6, 3]
    assert [r.is_speculative for r in rows] == [False, True, False]


def test_summary_lines(spark):
    lines = [r.line for r in measured(spark, PLAIN, DRAFTED).select(
        summary_line().alias("line")).collect()]
    assert lines == [
        "AR  | 6 tok | 3.0 tok/s | p50=300ms p95=675ms | mem=640MB",
        "SD  | 6 tok | 8.0 tok/s | p50=300ms p95=675ms | mem=3072MB"
        " | accept=0.64 rounds=11"]


def test_json_line_keeps_nulls_and_has_no_newline(spark):
    text = measured(spark, PLAIN).select(
        F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("t")).first().t
    assert "\n" not in text
    back = json.loads(text)
    assert back["acceptance_rate"] is None and back["num_tokens"] == 6
    assert set(back) == {*RESULT.fieldNames(), "num_tokens", "tokens_per_second",
                         "latency_p50", "latency_p95", "latency_p99", "is_speculative"}


def test_printed_percentiles_are_those_of_numpy(spark):
    """Two latencies whose interpolated value lies on a tie of the printed milliseconds."""
    cases = [[0.0070599999999999994, 0.20194], [0.06301, 0.03281]]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, v array<double>") \
        .withColumn("s", F.sort_array("v"))
    for q in (0.5, 0.95, 0.99):
        got = df.orderBy("i").select(sorted_percentile(F.col("s"), q)).collect()
        assert [r[0] for r in got] == [np.percentile(c, 100 * q) for c in cases]
