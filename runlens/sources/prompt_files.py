"""Prompt files: JSON arrays for exchange, JSON Lines or Parquet for scale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from runlens.operators.prompts import require_domains
from runlens.schemas import PROMPT

_KEYS = sorted(PROMPT.fieldNames())


def save_prompts(prompts: DataFrame, path: str, fmt: str = "json") -> None:
    """Overwrite ``path``; folders are created and text is written as UTF-8.

    Parquet output is split by domain, so reading one domain prunes the rest.
    """
    out = prompts.select(*PROMPT.fieldNames()).write.mode("overwrite")
    if fmt == "parquet":
        out.partitionBy("domain").parquet(path)
    else:
        out.option("ignoreNullFields", "false").json(path)


def load_prompts(spark: SparkSession, path: str, *, array_file: bool = False) -> DataFrame:
    """Read prompts strictly: exactly the four keys, and a known domain.

    The schema-driven reader accepts missing and extra keys, so each object is
    read as a map first and its keys are compared in the same pass.
    ``array_file`` reads one top-level array per file; such a file cannot be
    split, so large corpora belong in JSON Lines.
    """
    if array_file:
        raw = spark.read.text(path, wholetext=True)
        objects = raw.select(F.explode(F.from_json(
            "value", "array<map<string,string>>", {"mode": "FAILFAST"})).alias("m"))
    else:
        raw = spark.read.text(path)
        # the generator keeps the checks below from being pushed under the
        # parser, which would then run once per check
        objects = raw.select(F.explode(F.array(F.from_json(
            "value", "map<string,string>", {"mode": "FAILFAST"}))).alias("m"))
    exact = F.array_sort(F.map_keys("m")) == F.array(*[F.lit(k) for k in _KEYS])
    problem = F.concat(F.lit("prompt keys must be "), F.lit(", ".join(_KEYS)),
                       F.lit("; got "), F.concat_ws(", ", F.map_keys("m")))
    checked = objects.where(
        F.when(exact, F.lit(True)).otherwise(F.raise_error(problem).cast("boolean")))
    return require_domains(checked.select(*[
        F.col("m")[f.name].cast(f.dataType).alias(f.name) for f in PROMPT.fields]))


def load_prompts_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*PROMPT.fieldNames())
