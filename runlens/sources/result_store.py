"""Results as a stored table that is laid out for lookups by configuration.

The table is bucketed and sorted by the config fingerprint, or by it and more keys
of a run, and split by model pair. What is planned is compared with it on the
same keys, and its results are grouped by them, without moving the stored side;
results of a pair are replaced by writing that pair alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

HASH, PAIR = "config_hash", "model_pair_name"
#: a bucket is one task of every lookup; about 1 GB of results each is a good size
BUCKETS = 64
_MODE = "spark.sql.sources.partitionOverwriteMode"


def create_store(results: DataFrame, name: str, path: str | None = None,
                 buckets: int = BUCKETS, by: Sequence[str] = (HASH,)) -> None:
    """Store results (with ``by`` and ``model_pair_name``) as the table ``name``.

    Rows are dealt by the keys before they are written, so a bucket is one file
    and not one per task. A bucket is read by one task: where one fingerprint may hold
    a large part of all results, store by fingerprint and prompt. ``path`` puts the files
    outside the warehouse.
    """
    writer = (results.repartition(buckets, *by).write.format("parquet").mode("overwrite")
              .partitionBy(PAIR).bucketBy(buckets, *by).sortBy(*by))
    (writer.option("path", path) if path else writer).saveAsTable(name)


def replace_pairs(results: DataFrame, name: str, buckets: int = BUCKETS,
                  by: Sequence[str] = (HASH,)) -> None:
    """Replace the stored results of the model pairs that ``results`` has; others stay."""
    spark = results.sparkSession
    columns = spark.table(name).columns
    # a writer into a table takes this from the session only
    before = spark.conf.get(_MODE)
    spark.conf.set(_MODE, "dynamic")
    try:
        results.repartition(buckets, *by).select(*columns).write.insertInto(name, overwrite=True)
    finally:
        spark.conf.set(_MODE, before)


def pending_in_store(planned: DataFrame, name: str, by: Sequence[str] = (HASH,)) -> DataFrame:
    """Planned rows without a stored result; a row with a null key has none.

    With the keys that the store was made by, its side is read by bucket where it
    lies, and only the planned rows move.
    """
    return planned.join(planned.sparkSession.table(name).select(*by).hint("merge"), list(by), "left_anti")


def planned_in_store(planned: DataFrame, name: str, by: Sequence[str] = (HASH,)) -> DataFrame:
    """Planned rows that have a stored result."""
    return planned.join(planned.sparkSession.table(name).select(*by).hint("merge"), list(by), "left_semi")


def results_per_config(spark: SparkSession, name: str, *measures: Column) -> DataFrame:
    """Results of every config, grouped where they lie: config_hash, n and ``measures``."""
    return spark.table(name).groupBy(HASH).agg(F.count(F.lit(1)).alias("n"), *measures)
