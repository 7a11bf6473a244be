"""Saved model-listing responses (one JSON document per line)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from runlens.functions.metrics import bytes_to_gb
from runlens.schemas import MODEL_LISTING


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MODEL_LISTING).json(path)


def flatten_listing(responses: DataFrame) -> DataFrame:
    """One row per listed model; absent keys get their defaults."""
    return responses.select(F.explode("models").alias("m")).select(
        F.coalesce("m.name", F.lit("unknown")).alias("name"),
        F.coalesce("m.details.parameter_size", F.lit("?")).alias("parameter_size"),
        F.coalesce("m.details.quantization_level", F.lit("?")).alias("quantization_level"),
        bytes_to_gb(F.coalesce("m.size", F.lit(0))).alias("size_gb"))
