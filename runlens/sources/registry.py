"""The fixed table of draft/target pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from runlens.schemas import MODEL_PAIRS, PAIR
from runlens.session import small_table


def registry(spark: SparkSession) -> DataFrame:
    """Four rows, in definition order."""
    names = PAIR.fieldNames()
    return small_table(spark, [dict(zip(names, (i, *row)))
                               for i, row in enumerate(MODEL_PAIRS)])


def pair_names() -> list[str]:
    return [row[0] for row in MODEL_PAIRS]


def lookup_pair(spark: SparkSession, name: str) -> DataFrame:
    if name not in pair_names():
        raise KeyError(f"unknown pair {name!r}; available: {', '.join(pair_names())}")
    return registry(spark).where(F.col("pair_name") == name)


def join_registry(df: DataFrame, key: str = "model_pair_name") -> DataFrame:
    """Add the pair's models and dtypes; the side sent out is always 4 rows."""
    dim = registry(df.sparkSession).withColumnRenamed("pair_name", key)
    return df.join(F.broadcast(dim), key, "left")


def unknown_pairs(df: DataFrame, key: str = "model_pair_name") -> DataFrame:
    """Rows whose pair is not registered."""
    dim = registry(df.sparkSession).select(F.col("pair_name").alias(key))
    return df.join(F.broadcast(dim), key, "left_anti")
