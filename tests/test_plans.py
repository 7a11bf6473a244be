"""Physical plans: what reaches the scan, what is shared, what is avoided."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from runlens.operators import prompts as pr, ranked, spans
from runlens.operators.indexing import first_n
from runlens.plans import QUERIES, views
from runlens.session import materialize, shared_dir
from runlens.sources.prompt_files import save_prompts
from runlens.sources.tables import spread, table


def plan(df, run=False):
    if run:
        df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


def test_domain_lookup_prunes_partitions(spark, folder, tmp_path):
    path = str(tmp_path / "prompts")
    save_prompts(views.prompts(spark, folder, 3), path, "parquet")
    text = plan(pr.by_domain(spark.read.parquet(path), "code"))
    assert "PartitionFilters: [isnotnull(domain" in text


def test_first_n_reaches_the_scan(spark, folder):
    text = plan(first_n(table(spark, folder, "documents"), ["doc_id"], 5).select("doc_id"))
    assert "LessThanOrEqual(doc_id,4)" in text and "ReadSchema: struct<doc_id:bigint>" in text


def test_summary_reads_only_its_columns(spark, folder):
    text = plan(QUERIES["phase_totals"](spark, folder))
    scan = next(line for line in text.splitlines() if "FileScan" in line)
    assert "props" not in scan


def test_length_filter_is_pushed_down(spark, folder):
    stored = materialize(views.prompts(spark, folder, 5), "test-prompts")
    text = plan(pr.of_length(stored, 8, 100))
    assert "GreaterThanOrEqual(token_count,8)" in text


@pytest.fixture
def events(spark, folder):
    return table(spark, folder, "events")


def test_ranks_share_the_value_counts(spark, events):
    """Counts are written once; both readers take them from there, and no one reads the log again."""
    df = events.select("event_type", "value")
    text = plan(ranked.exact_percentiles(df, ["event_type"], "value", {"p50": 0.5}), run=True)
    assert "_part" in text and "value" not in text.replace("_v", "")
    assert "BroadcastHashJoin" in text


def test_speedup_joins_one_baseline_a_group(spark, folder):
    from runlens.functions.metrics import with_metrics
    from runlens.operators.reports import measured_speedup
    text = plan(measured_speedup(with_metrics(views.records(spark, folder))))
    # no window, so no task has all the runs of a prompt
    assert "Window" not in text and "Join" in text


def test_span_slices_share_one_shuffle(spark, events):
    text = plan(spans.pair_spans(views.span_log(events)), run=True)
    assert "ReusedExchange" in text and text.count("FileScan") == 1


def test_copies_are_folded_before_the_shuffle(spark, events):
    from runlens.operators.results import keep_one

    text = plan(keep_one(events.select("user_id", "event_id", "value"), ["user_id"],
                         ["event_id"]))
    below = text[text.index("Exchange"):]
    assert "partial_min_by" in below and "Window" not in text


def test_matrix_has_no_join_and_no_shuffle(spark, folder):
    from runlens.operators.matrix import run_matrix

    text = plan(run_matrix(table(spark, folder, "pages").select("page_id")))
    assert "Join" not in text and "Exchange" not in text


def test_large_inputs_are_not_spread(spark):
    many = spark.range(0, 1000, numPartitions=64)
    assert spread(many) is many
    few = spark.range(0, 1000, numPartitions=1)
    assert spread(few).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_written_tables_lie_in_the_shared_folder(spark):
    df = materialize(spark.range(5).withColumn("x", F.lit("a")), "test-where")
    assert all(shared_dir(spark) in f for f in df.inputFiles())
    assert df.count() == 5


def test_runs_of_a_hundred_days_keep_apart(spark, tmp_path):
    """A user's events of every day, also before the first day that is counted from, are a run each."""
    days = list(range(-20, 100))
    spark.range(len(days)).selectExpr(
        "id AS event_id", "timestamp'2023-12-12 08:00:00' + make_interval(0, 0, 0, cast(id AS int)) AS ts",
        "7L AS user_id", "'view' AS event_type", "cast(id AS double) AS value", "'' AS props") \
        .write.parquet(f"{tmp_path}/events.parquet")
    runs = views.rounds(spark, str(tmp_path)).groupBy(*views.RUN_KEYS).count().collect()
    assert sorted(r["run_idx"] for r in runs) == days and {r["count"] for r in runs} == {1}
    assert {r["kslot"] for r in runs} == set(range(5))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = con.execute(f"WITH {views.ROUNDS_SQL} SELECT kslot, run_idx FROM rounds").fetchall()
    assert sorted(want) == sorted((r["kslot"], r["run_idx"]) for r in runs)
