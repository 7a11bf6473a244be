"""Schemas of the stored tables and the small fixed dimensions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

PROMPT = T.StructType([
    T.StructField("prompt_id", T.StringType(), False),
    T.StructField("domain", T.StringType(), False),
    T.StructField("raw_text", T.StringType(), False),
    T.StructField("token_count", T.LongType(), False),
])

RESULT_REQUIRED = T.StructType([
    T.StructField("generated_ids", T.ArrayType(T.LongType(), False), False),
    T.StructField("per_token_latencies", T.ArrayType(T.DoubleType(), False), False),
    T.StructField("total_time", T.DoubleType(), False),
    T.StructField("peak_memory_mb", T.DoubleType(), False),
    T.StructField("time_to_first_token", T.DoubleType(), False),
])

# null on plain (draft-free) runs
RESULT_OPTIONAL = T.StructType([
    T.StructField("acceptance_rate", T.DoubleType(), True),
    T.StructField("tokens_per_step", T.DoubleType(), True),
    T.StructField("num_speculation_rounds", T.LongType(), True),
    T.StructField("draft_time_total_ms", T.DoubleType(), True),
    T.StructField("verify_time_total_ms", T.DoubleType(), True),
    T.StructField("sampling_time_total_ms", T.DoubleType(), True),
])

RESULT = T.StructType(RESULT_REQUIRED.fields + RESULT_OPTIONAL.fields)

# recomputed after every read, never trusted from a file
RESULT_COMPUTED = ("num_tokens", "tokens_per_second", "latency_p50",
                   "latency_p95", "latency_p99", "is_speculative")

CONFIG = T.StructType([
    T.StructField("model_pair_name", T.StringType(), False),
    T.StructField("K", T.LongType(), True),
    T.StructField("temperature", T.DoubleType(), False),
    T.StructField("max_new_tokens", T.LongType(), False),
    T.StructField("prompt_domain", T.StringType(), False),
    T.StructField("seed", T.LongType(), False),
])

CONDITION = T.StructType([
    T.StructField("model_id", T.StringType(), True),
    T.StructField("prompt_id", T.StringType(), False),
    T.StructField("domain", T.StringType(), False),
    T.StructField("prompt_token_count", T.LongType(), True),
    T.StructField("temperature", T.DoubleType(), False),
    T.StructField("max_new_tokens", T.LongType(), False),
    T.StructField("run_idx", T.LongType(), False),
])

RECORD = T.StructType(CONDITION.fields + RESULT.fields)

PAIR = T.StructType([
    T.StructField("ord", T.LongType(), False),
    T.StructField("pair_name", T.StringType(), False),
    T.StructField("draft_model_id", T.StringType(), False),
    T.StructField("target_model_id", T.StringType(), False),
    T.StructField("draft_dtype", T.StringType(), False),
    T.StructField("target_dtype", T.StringType(), False),
])

MODEL_LISTING = T.StructType([
    T.StructField("models", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("details", T.StructType([
            T.StructField("parameter_size", T.StringType()),
            T.StructField("quantization_level", T.StringType()),
        ])),
    ]))),
])

# --- fixed values ---------------------------------------------------------
DOMAINS = ("code", "conversation", "summarization")
DTYPES = ("float16", "bfloat16", "float32", "int4")
TEMPERATURES = (0.0, 0.6)
NUM_RUNS = 5
MAX_NEW_TOKENS = 128
SEED = 42
DRAFT_LENGTHS = (1, 2, 4, 8)
PROMPTS_PER_DOMAIN = 50
TINY_PROMPTS_PER_DOMAIN = 5
SUMMARY_MAX_TOKENS = 512
SUMMARY_SUFFIX = "\n\nSummarize the above article:"
MODEL_PAIRS = (
    ("gpt2_dev", "gpt2", "gpt2-xl", "float16", "float16"),
    ("tinyllama_llama3", "TinyLlama/TinyLlama-1.1B-Chat-v1.0",
     "meta-llama/Meta-Llama-3-8B-Instruct", "float16", "float16"),
    ("phi3_llama3", "microsoft/Phi-3-mini-4k-instruct",
     "meta-llama/Meta-Llama-3-8B-Instruct", "float16", "float16"),
    ("llama3_self", "meta-llama/Meta-Llama-3-8B-Instruct",
     "meta-llama/Meta-Llama-3-8B-Instruct", "int4", "float16"),
)
# --------------------------------------------------------------------------


def domain_rank(domain: Column) -> Column:
    """Position of a domain in the fixed report order (null if unknown)."""
    rank = F.lit(None).cast("int")
    for i, name in enumerate(DOMAINS):
        rank = F.when(domain == name, F.lit(i)).otherwise(rank)
    return rank
