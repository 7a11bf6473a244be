"""Every registered query against its SQL twin on the smallest tables."""

from __future__ import annotations

import compare
import pytest

from runlens.plans import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(folder):
    connection = compare.connect(folder)
    yield connection
    connection.close()


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, folder, con, name):
    df = QUERIES[name](spark, folder)
    assert compare.differences(df, con, ORACLES[name]) is None
    plan = df._jdf.queryExecution().executedPlan().toString()
    # pairs of everything with everything must not come back
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["domain", "temperature", "mean_tok_s", "mean_ttft_ms",
                          "mean_p95_ms", "mean_peak_mb", "n"]
    assert df.count() > 0
    assert set(entry.queries()) >= set(entry.oracle_sql())
