"""Run records as JSON Lines: written whole, read by their stored columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from runlens.functions.metrics import with_metrics
from runlens.schemas import RECORD, RESULT_REQUIRED


def write_records(records: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per line; null keys are kept (dropped by default)."""
    records.write.mode(mode).option("ignoreNullFields", "false").json(path)


def read_records(spark: SparkSession, path: str, schema=RECORD) -> DataFrame:
    """Stored columns only: computed keys in the file are ignored and redone."""
    stored = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    missing = [c for c in RESULT_REQUIRED.fieldNames()]
    present = F.lit(True)
    for name in missing:
        present = present & F.col(name).isNotNull()
    checked = stored.where(F.when(present, F.lit(True)).otherwise(F.raise_error(
        F.lit("a record lacks one of " + ", ".join(missing))).cast("boolean")))
    return with_metrics(checked)
