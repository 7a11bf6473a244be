"""Run an experiment matrix with the caller's model, one Arrow batch at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

from pyspark.sql import DataFrame, functions as F, types as T

from runlens.functions.metrics import time_to_first_token, total_time
from runlens.schemas import MAX_NEW_TOKENS, NUM_RUNS, TEMPERATURES

PROMPT_COLUMNS = ("model_id", "prompt_id", "domain", "prompt_token_count", "raw_text")
# finished records that a task holds before it hands them on
RECORDS_HELD = 500


class Model(Protocol):
    eos_id: int | None

    def stream(self, text: str, temperature: float, key: str) -> Iterator[int]:
        """Yield token ids one by one; ``key`` seeds the sampling."""

    def peak_memory_mb(self) -> float: ...


def generate_records(prompts: DataFrame, load_model: Callable[[str], Model],
                     temperatures: Sequence[float] = TEMPERATURES,
                     num_runs: int = NUM_RUNS, max_new_tokens: int = MAX_NEW_TOKENS,
                     partitions: int | None = None, ways: int = 1) -> DataFrame:
    """Records of prompts x temperatures x runs: token ids and seconds per token.

    A prompt's text moves once, with all its conditions, and the matrix is
    unfolded in the worker. With fewer prompts than cores, ``ways`` deals the
    conditions of a prompt out to that many rows. Rows are spread over a fixed
    number of partitions, because adaptive merging goes by bytes and not by
    the work; inside one they are sorted by model, so a worker holds one model
    at a time however many the prompts name.
    """
    spark = prompts.sparkSession
    partitions = partitions or 4 * spark.sparkContext.defaultParallelism
    conditions = [(float(t), r) for t in temperatures for r in range(num_runs)]
    kept = [c for c in PROMPT_COLUMNS if c != "raw_text"]
    schema = T.StructType([prompts.schema[c] for c in kept] + [
        T.StructField("temperature", T.DoubleType()),
        T.StructField("max_new_tokens", T.LongType()),
        T.StructField("run_idx", T.LongType()),
        T.StructField("generated_ids", T.ArrayType(T.LongType())),
        T.StructField("per_token_latencies", T.ArrayType(T.DoubleType())),
        T.StructField("peak_memory_mb", T.DoubleType()),
    ])

    def run(batches):
        from time import perf_counter

        import pandas as pd

        loaded, model = None, None
        out = []
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.model_id != loaded:
                    model, loaded = load_model(row.model_id), row.model_id
                for temperature, run_idx in conditions[row.way::ways]:
                    ids, seconds = [], []
                    key = f"{row.prompt_id}:{temperature}:{run_idx}"
                    tokens = iter(model.stream(row.raw_text, temperature, key))
                    while len(ids) < max(1, max_new_tokens):
                        began = perf_counter()
                        token = next(tokens, None)
                        if token is None:
                            break
                        seconds.append(perf_counter() - began)
                        ids.append(int(token))
                        if token == model.eos_id:
                            break
                    out.append((*(getattr(row, c) for c in kept), temperature,
                                max_new_tokens, run_idx, ids, seconds,
                                model.peak_memory_mb()))
                    if len(out) == RECORDS_HELD:
                        yield pd.DataFrame(out, columns=schema.names)
                        out = []
        yield pd.DataFrame(out, columns=schema.names)

    dealt = prompts.select(*PROMPT_COLUMNS, F.explode(
        F.sequence(F.lit(0), F.lit(ways - 1))).alias("way"))
    spread = (dealt.repartition(partitions, "model_id", "prompt_id", "way")
              .sortWithinPartitions("model_id"))
    return (
        spread.mapInPandas(run, schema)
        .withColumn("total_time", total_time(F.col("per_token_latencies")))
        .withColumn("time_to_first_token",
                    time_to_first_token(F.col("per_token_latencies"))))
