"""Prompt corpora: sources per domain, build, lookups and statistics."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from runlens.functions import text as tx
from runlens.operators.indexing import first_n, with_row_index
from runlens.schemas import DOMAINS, SUMMARY_MAX_TOKENS, SUMMARY_SUFFIX, domain_rank
from runlens.session import small_table


@dataclass(frozen=True)
class TextSource:
    """Texts of one domain: a table, its text column and a unique order."""

    table: DataFrame
    text: str
    order_by: tuple[str, ...]


@dataclass(frozen=True)
class Tokenizer:
    """How to count and cut tokens; the default stays inside the JVM."""

    count: Callable[[Column], Column] = tx.token_count
    truncate: Callable[[Column, int], Column] = tx.truncate_tokens


def custom_tokenizer(factory: Callable[[], object]) -> Tokenizer:
    """Use the caller's object with ``encode`` and ``decode``."""
    return Tokenizer(count=tx.count_udf(factory),
                     truncate=lambda t, n: tx.truncate_udf(factory, n)(t))


def prompt_id(domain: Column | str, idx: Column) -> Column:
    d = domain if isinstance(domain, Column) else F.lit(domain)
    return F.format_string("%s_%03d", d, idx)


def check_domain(domain: str) -> str:
    if domain not in DOMAINS:
        raise KeyError(f"unknown domain {domain!r}; valid: {', '.join(DOMAINS)}")
    return domain


def build_prompts(sources: dict[str, TextSource], n_per_domain: int | None = 50,
                  tokenizer: Tokenizer = Tokenizer()) -> DataFrame:
    """Concatenate the first n texts of each domain into one prompt table.

    Selection comes before tokenising, because no optimiser rule moves it
    there; numbering comes after, so a cut text is moved and not a whole one.
    Summaries are cut and given their instruction.
    """
    parts = []
    for domain in DOMAINS:
        if domain not in sources:
            continue
        src = sources[domain]
        order = [f"_o{i}" for i in range(len(src.order_by))]
        picked = first_n(src.table, src.order_by, n_per_domain)
        text = F.col(src.text)
        if domain == "summarization":
            text = F.concat(tokenizer.truncate(text, SUMMARY_MAX_TOKENS),
                            F.lit(SUMMARY_SUFFIX))
        texts = (
            picked.select(*[F.col(c).alias(o) for c, o in zip(src.order_by, order)],
                          text.alias("raw_text"))
            .withColumn("token_count", tokenizer.count(F.col("raw_text"))))
        parts.append(with_row_index(texts, order, at_most=n_per_domain).select(
            prompt_id(domain, F.col("idx")).alias("prompt_id"),
            F.lit(domain).alias("domain"), "raw_text", "token_count", "idx"))
    return reduce(DataFrame.unionByName, parts)


def smaller_build(prompts: DataFrame, n_per_domain: int) -> DataFrame:
    """A smaller dataset from an indexed one, without building it again."""
    return prompts.where(F.col("idx") < n_per_domain)


def in_order(prompts: DataFrame) -> DataFrame:
    """All prompts in insertion order: domains in their order, then index."""
    return prompts.orderBy(domain_rank(F.col("domain")), "idx")


def by_domain(prompts: DataFrame, domain: str) -> DataFrame:
    return prompts.where(F.col("domain") == check_domain(domain))


def split_by_domain(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a known domain, and the rejects."""
    known = F.coalesce(F.col("domain").isin(*DOMAINS), F.lit(False))
    return df.where(known), df.where(~known)


def require_domains(df: DataFrame) -> DataFrame:
    """Same rows; the query fails if one has an unknown domain."""
    known = F.coalesce(F.col("domain").isin(*DOMAINS), F.lit(False))
    return df.where(F.when(known, F.lit(True)).otherwise(F.raise_error(
        F.concat(F.lit("unknown domain: "), F.coalesce("domain", F.lit("null"))))
        .cast("boolean")))


def with_fallback(primary: DataFrame, bank: DataFrame) -> DataFrame:
    """Bank rows stand in for every domain the primary table lacks.

    The side sent out holds at most one row per known domain.
    """
    known, _ = split_by_domain(primary.select("domain"))
    return primary.unionByName(
        bank.join(F.broadcast(known.distinct()), "domain", "left_anti"))


def token_stats(prompts: DataFrame) -> DataFrame:
    """Count and min/mean/max tokens per domain, in domain order."""
    return (
        prompts.groupBy("domain").agg(
            F.count("*").alias("n"), F.min("token_count").alias("min_tokens"),
            F.avg("token_count").alias("mean_tokens"),
            F.max("token_count").alias("max_tokens"))
        .orderBy(domain_rank(F.col("domain")))
    )


def domain_counts(prompts: DataFrame) -> DataFrame:
    """Prompts per domain, with a zero row for an empty one."""
    dim = small_table(prompts.sparkSession, [{"domain": d} for d in DOMAINS])
    counts = prompts.groupBy("domain").agg(F.count("*").alias("n"))
    return dim.join(counts, "domain", "left").select(
        "domain", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def length_strata(prompts: DataFrame, width: int, strata: int) -> DataFrame:
    """Stratum 0..strata-1 by token count; longer texts go to the last one."""
    return prompts.withColumn("stratum", F.least(
        F.floor(F.col("token_count") / width), F.lit(strata - 1)).cast("long"))


def of_length(prompts: DataFrame, low: int, high: int) -> DataFrame:
    return prompts.where(F.col("token_count").between(low, high))


def default_bank(spark: SparkSession, counts: Sequence[int] = (51, 50, 50)) -> DataFrame:
    """Plain prompts made from a rule, for domains without any source.

    The texts are ours. Like any bank they are used as they are: not cut, and
    the summaries already end with their instruction.
    """
    n = dict(zip(DOMAINS, counts))
    i = F.col("idx").cast("string")
    texts = {
        "code": F.concat(F.lit("def step_"), i, F.lit('(values):\n    """Return the sum '
                         'of every entry whose position is a multiple of '),
                         (F.col("idx") + 1).cast("string"), F.lit('."""\n')),
        "conversation": F.concat(F.lit("Explain in plain words how you would plan task "
                                       "number "), i, F.lit(" of a long list.")),
        "summarization": F.concat(
            F.lit("Report "), i, F.lit(" describes a project that met its first goal "
                                       "late, its second goal early, and "),
            i, F.lit(" smaller goals in between."), F.lit(SUMMARY_SUFFIX)),
    }
    parts = [
        spark.range(n[d]).select(F.col("id").alias("idx"))
        .select(prompt_id(d, F.col("idx")).alias("prompt_id"), F.lit(d).alias("domain"),
                texts[d].alias("raw_text"), "idx")
        .withColumn("token_count", tx.token_count(F.col("raw_text")))
        .select("prompt_id", "domain", "raw_text", "token_count", "idx")
        for d in DOMAINS
    ]
    return reduce(DataFrame.unionByName, parts)
