"""Run configurations: labels, text forms and the fingerprint."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from runlens.functions.formatting import (
    json_ascii_string, json_number, python_float, python_quoted)
from runlens.schemas import CONFIG

CONFIG_COLUMNS = tuple(CONFIG.fieldNames())


def is_drafted(k: Column) -> Column:
    return k.isNotNull()


def decoder_label(k: Column) -> Column:
    return F.when(k.isNull(), F.lit("AR")).otherwise(
        F.concat(F.lit("SD-K"), k.cast("string")))


def display() -> Column:
    """Readable text of a config, from the config columns."""
    return F.concat(
        F.lit("BenchmarkConfig(pair="), python_quoted(F.col("model_pair_name")),
        F.lit(", decoder="), decoder_label(F.col("K")),
        F.lit(", domain="), python_quoted(F.col("prompt_domain")),
        F.lit(", temp="), python_float(F.col("temperature")),
        F.lit(", max_new="), F.col("max_new_tokens").cast("string"),
        F.lit(", seed="), F.col("seed").cast("string"), F.lit(")"))


def to_json() -> Column:
    return F.to_json(F.struct(*CONFIG_COLUMNS), {"ignoreNullFields": "false"})


def from_json(text: Column) -> Column:
    return F.from_json(text, CONFIG, {"mode": "FAILFAST"})


def canonical_json() -> Column:
    """Key-sorted JSON text of a config ("K" sorts before lower case)."""
    return F.concat(
        F.lit('{"K": '), F.coalesce(F.col("K").cast("string"), F.lit("null")),
        F.lit(', "max_new_tokens": '), F.col("max_new_tokens").cast("string"),
        F.lit(', "model_pair_name": '), json_ascii_string(F.col("model_pair_name")),
        F.lit(', "prompt_domain": '), json_ascii_string(F.col("prompt_domain")),
        F.lit(', "seed": '), F.col("seed").cast("string"),
        F.lit(', "temperature": '), json_number(F.col("temperature")), F.lit("}"))


def config_hash() -> Column:
    """First 12 hex digits of SHA-256 over the canonical text."""
    return F.substring(F.sha2(canonical_json(), 256), 1, 12)
