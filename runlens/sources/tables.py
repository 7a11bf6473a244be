"""Named Parquet tables below one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table whose rows are costly to work on: see :func:`spread`."""
    return spread(table(spark, folder, name))


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share of a table that comes in too few pieces.

    A table with at least one scan task per core, which any large one has, is
    returned as it is; filters and column pruning pass through either way.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def require_path(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """Open an input now, so that a missing one fails before any work starts."""
    try:
        return spark.read.format(fmt).load(path)
    except AnalysisException as exc:
        raise FileNotFoundError(f"input not found or unreadable: {path}") from exc


def first_available(spark: SparkSession, paths: list[str], fmt: str,
                    fallback: DataFrame) -> DataFrame:
    """The first path that can be opened, else the fallback table."""
    for path in paths:
        try:
            return spark.read.format(fmt).load(path)
        except AnalysisException:
            continue
    return fallback
