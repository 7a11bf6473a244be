"""Stratified samples against a sort by the same hash, and stored sketches against exact ranks."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.operators import sampling, sketches
from runlens.operators.reports import TAIL


def brute(rows, quota, seed=42):
    out, strata = set(), {}
    for s, k in rows:
        strata.setdefault(s, []).append(k)
    for s, keys in strata.items():
        keys.sort(key=lambda k: (int(hashlib.md5(f"{seed}:{k}".encode()).hexdigest()[:15], 16), k))
        out |= {(s, k) for k in keys[:max(0, quota(s))]}
    return out


ROWS = [("hot", i) for i in range(9_000)] + [("small", i) for i in range(900)] + \
       [(None, i) for i in range(90)] + [("one", 7)]


@pytest.mark.parametrize("border", [1024, 4, 1])
@pytest.mark.parametrize("quota", [1, 50, 500, 20_000])
def test_equals_the_smallest_hashes(spark, border, quota):
    df = spark.createDataFrame(ROWS, "s string, k long").repartition(5)
    got = sampling.stratified_sample(df, ["s"], "k", quota, 42, border)
    assert got.columns == ["s", "k"]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(ROWS, lambda s: quota)


def test_quotas_by_stratum_and_any_partitioning(spark):
    df = spark.createDataFrame(ROWS, "s string, k long")
    quota = F.when(F.col("s") == "hot", 100).when(F.col("s") == "small", 0).when(F.col("s").isNull(), 1000)
    want = brute(ROWS, lambda s: {"hot": 100, None: 1000}.get(s, 0))
    for n in (1, 13):
        got = sampling.stratified_sample(df.repartition(n), ["s"], "k", quota, 42, 16)
        assert {tuple(r) for r in got.collect()} == want


def test_no_window_over_a_stratum(spark):
    """Rows ordered at the border are few, although one stratum holds nearly all."""
    df = spark.createDataFrame(ROWS, "s string, k long")
    narrow = df.select(F.struct("s").alias("_s"), sampling.keyed_hash(42, F.col("k")).alias("_h"),
                       F.lit(50).cast("long").alias("_q"))
    state = sampling._next_digit(narrow, None, 48)
    assert {r["_s"]["s"]: r["need"] > 0 for r in state.collect()} == {
        "hot": True, "small": True, None: True, "one": False}
    assert state.agg(F.max("here")).first()[0] < 20


def test_empty_table_and_equal_keys(spark):
    none = spark.createDataFrame([], "s string, k long")
    assert sampling.stratified_sample(none, ["s"], "k", 3, 1).count() == 0
    same = spark.createDataFrame([("a", 1)] * 10 + [("a", 2)], "s string, k long")
    assert sampling.stratified_sample(same, ["s"], "k", 4, 1).count() == 4


def test_merged_sketches_keep_their_rank_bound(spark):
    rng = np.random.default_rng(5)
    rows = [("hot", int(d), float(v)) for d, v in zip(rng.integers(0, 20, 60_000), rng.lognormal(0, 2, 60_000))]
    rows += [("copies", 1, 5.0)] * 3_000 + [("few", 2, 1.0), (None, 3, 2.0), ("few", 2, None), ("few", 2, float("nan"))]
    log = spark.createDataFrame(rows, "g string, day int, v double")
    daily = sketches.daily_sketches(log, ["g"], F.col("day"), "v")
    assert daily.count() == 23
    # a stored sketch does not grow with its log
    assert daily.agg(F.max(F.length("sketch"))).first()[0] < 40_000
    answers = sketches.sketch_percentiles(sketches.merged_sketches(daily, ["g"]), ["g"], TAIL)
    answers = spark.createDataFrame(answers.collect(), answers.schema)
    got = {r["g"]: r for r in sketches.with_true_ranks(answers, log, ["g"], "v", TAIL).collect()}
    assert {g: (r["n"], r["n_days"]) for g, r in got.items()} == {
        "hot": (60_000, 20), "copies": (3_000, 1), "few": (1, 1), None: (1, 1)}
    values = np.sort([v for g, _, v in rows if g == "hot"])
    for name, q in TAIL.items():
        low, high = (np.searchsorted(values, got["hot"][name], s) / len(values) for s in ("left", "right"))
        assert got["hot"][f"{name}_low"] == pytest.approx(low) and got["hot"][f"{name}_high"] == pytest.approx(high)
        assert max(low - q, q - high, 0) <= sketches.RANK_ERROR
        assert got["copies"][name] == 5.0 and got["copies"][f"{name}_low"] == 0 and got[None][name] == 2.0
    worst = sketches.with_true_ranks(answers.withColumn("p50", F.lit(0.01)), log, ["g"], "v", TAIL) \
        .where("g = 'hot'").select(sketches.rank_error("p50", 0.5)).first()[0]
    assert worst > sketches.RANK_ERROR                                # a wrong answer is told
