"""Exact ranks under skew, against numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.operators import ranked
from runlens.operators.reports import TAIL


def skewed(spark):
    rng = np.random.default_rng(7)
    rows = [("hot", float(v)) for v in rng.lognormal(0, 2, 4_000)]
    rows += [("hot", 5.0)] * 2_000  # many copies of one value
    rows += [("mixed", float(v)) for v in rng.normal(0, 3, 2_000)]
    rows += [("zero", 0.0)] * 50 + [("one", 3.25)] + [(None, 1.0), (None, 2.0)]
    rows += [("hot", None)]
    return rows, spark.createDataFrame(rows, "g string, v double")


def groups(rows):
    out = {}
    for g, v in rows:
        if v is not None:
            out.setdefault(g, []).append(v)
    return out


def test_exact_percentiles(spark):
    rows, df = skewed(spark)
    got = {r.g: r for r in ranked.exact_percentiles(df, ["g"], "v", TAIL).collect()}
    want = groups(rows)
    assert set(got) == set(want)  # the null group is kept
    for g, values in want.items():
        assert got[g].n == len(values)
        for name, q in TAIL.items():
            assert got[g][name] == pytest.approx(np.quantile(values, q), rel=1e-12, abs=1e-12)


def test_value_distribution(spark):
    rows, df = skewed(spark)
    want = groups(rows)
    got = {(r.g, r.v): r for r in ranked.value_distribution(df, ["g"], "v").collect()}
    assert len(got) == sum(len(set(v)) for v in want.values())
    for (g, v), r in got.items():
        values = np.array(want[g])
        assert r.n == (values == v).sum()
        assert r.cume_dist == pytest.approx((values <= v).mean(), abs=1e-12)


def test_approximate_percentiles_stay_in_their_rank_bound(spark):
    rows, df = skewed(spark)
    accuracy = 1_000
    got = {r.g: r for r in ranked.approx_percentiles(
        df, ["g"], "v", TAIL, accuracy).collect()}
    for g, values in groups(rows).items():
        n, values = len(values), np.sort(values)
        for name, q in TAIL.items():
            lo = np.searchsorted(values, got[g][name], "left")
            hi = np.searchsorted(values, got[g][name], "right")
            assert lo - n / accuracy - 1 <= q * n <= hi + n / accuracy + 1


def test_percentiles_are_interpolated_as_numpy_does(spark):
    """Two values on a tie of their printed mean; the nearer end decides the last digit."""
    df = spark.createDataFrame([("a", 0.20194), ("a", 0.0070599999999999994), ("b", 0.06301), ("b", 0.03281)],
                               "g string, v double")
    got = {r.g: r for r in ranked.exact_percentiles(df, ["g"], "v", TAIL).collect()}
    for g, values in (("a", [0.20194, 0.0070599999999999994]), ("b", [0.06301, 0.03281])):
        for name, q in TAIL.items():
            assert got[g][name] == np.percentile(values, 100 * q)


def test_values_that_lie_close_together_are_split_evenly(spark):
    """One group holds most rows, and all its values lie within 0.05 %."""
    rng = np.random.default_rng(1)
    values = 100 + rng.random(40_000) * 0.04
    df = spark.createDataFrame([("hot", float(v)) for v in values] + [("few", 1.0)], "g string, v double")
    sizes = [r["count"] for r in ranked._ranges(df, ["g"], "v").groupBy("_part").count().collect()]
    assert len(sizes) == 8 and max(sizes) <= 2 * sum(sizes) / len(sizes)
    got = {r.g: r for r in ranked.exact_percentiles(df, ["g"], "v", TAIL).collect()}
    assert [got["hot"][n] for n in TAIL] == [np.quantile(values, q) for q in TAIL.values()]
    cdf = ranked.value_distribution(df, ["g"], "v")
    assert {r.v: r.cume_dist for r in cdf.where("g = 'hot'").collect()} == {
        float(v): (i + 1) / 40_000 for i, v in enumerate(np.sort(values))}
    # a range is one task of the ranking, dealt by its number and not by a hash
    plan = cdf._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning(_part" in plan and "hashpartitioning(_part" not in plan


def test_infinite_values_have_ranks(spark):
    df = spark.createDataFrame([(v,) for v in (float("inf"), float("-inf"), 0.0, -0.0, 2.0)], "v double")
    rows = {r.v: (r.n, r.cume_dist) for r in ranked.value_distribution(df, [], "v").collect()}
    assert rows == {float("-inf"): (1, 0.2), 0.0: (2, 0.6), 2.0: (1, 0.8), float("inf"): (1, 1.0)}


def test_one_group_and_whole_numbers(spark):
    df = spark.range(1, 1001).withColumn("v", F.col("id") * F.lit(10 ** 12))
    row = ranked.exact_percentiles(df, [], "v", TAIL).first()
    assert row.n == 1000
    assert row.p50 == pytest.approx(500.5e12) and row.p95 == pytest.approx(950.05e12)
    cdf = ranked.value_distribution(df, [], "v")
    assert cdf.columns == ["v", "n", "cume_dist"] and cdf.count() == 1000
