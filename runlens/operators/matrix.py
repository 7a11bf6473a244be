"""Experiment matrices and the configs still to run.

Factors are small lists: they are exploded from literals or joined by domain,
narrow steps that keep the partitioning of the prompts.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from runlens.functions.config import config_hash
from runlens.schemas import (DOMAINS, DRAFT_LENGTHS, MAX_NEW_TOKENS, MODEL_PAIRS, NUM_RUNS,
                             SEED, TEMPERATURES)
from runlens.session import small_table


# a dimension of this many configs is a few MB at most
MAX_BROADCAST_CONFIGS = 20_000


def run_matrix(prompts: DataFrame, temperatures: Sequence[float] = TEMPERATURES,
               num_runs: int = NUM_RUNS) -> DataFrame:
    """Prompts x temperatures x runs."""
    temps = F.array(*[F.lit(float(t)) for t in temperatures])
    runs = F.sequence(F.lit(0).cast("long"), F.lit(num_runs - 1).cast("long"))
    return (prompts.withColumn("temperature", F.explode(temps))
            .withColumn("run_idx", F.explode(runs)))


def config_dimension(spark: SparkSession,
                     draft_lengths: Sequence[int | None] = DRAFT_LENGTHS,
                     temperatures: Sequence[float] = TEMPERATURES,
                     max_new_tokens: int = MAX_NEW_TOKENS, seed: int = SEED) -> DataFrame:
    """Every pair x domain x K x temperature with its fingerprint."""
    rows = [
        {"model_pair_name": pair[0], "K": k, "temperature": float(t),
         "max_new_tokens": max_new_tokens, "prompt_domain": domain, "seed": seed}
        for pair, domain, k, t in product(MODEL_PAIRS, DOMAINS, draft_lengths, temperatures)]
    schema = pa.schema([("model_pair_name", pa.string()), ("K", pa.int64()),
                        ("temperature", pa.float64()), ("max_new_tokens", pa.int64()),
                        ("prompt_domain", pa.string()), ("seed", pa.int64())])
    return with_config_hash(small_table(spark, rows, schema))


def config_matrix(prompts: DataFrame, draft_lengths: Sequence[int | None] = DRAFT_LENGTHS,
                  temperatures: Sequence[float] = TEMPERATURES, **fixed: int) -> DataFrame:
    """Prompts with every config of their domain, fingerprint included.

    Fingerprints are made once per config and joined by domain, instead of
    hashing each of the many (prompt, config) rows.
    """
    dim = config_dimension(prompts.sparkSession, draft_lengths, temperatures, **fixed)
    size = len(MODEL_PAIRS) * len(DOMAINS) * len(draft_lengths) * len(temperatures)
    if size <= MAX_BROADCAST_CONFIGS:
        dim = F.broadcast(dim)
    return prompts.join(dim, prompts["domain"] == dim["prompt_domain"]).drop("domain")


def with_config_hash(df: DataFrame) -> DataFrame:
    return df.withColumn("config_hash", config_hash())


def pending(planned: DataFrame, done: DataFrame,
            on: Sequence[str] = ("config_hash",)) -> DataFrame:
    """Planned rows without a result yet."""
    keys = list(on)
    return planned.join(done.select(*keys).distinct(), keys, "left_anti")


def selected(results: DataFrame, chosen: DataFrame,
             on: Sequence[str] = ("config_hash",)) -> DataFrame:
    """Results that belong to the chosen configs."""
    keys = list(on)
    return results.join(chosen.select(*keys).distinct(), keys, "left_semi")
