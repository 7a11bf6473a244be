"""The corpus pipeline: five stages over ``documents``, each a dealt operator.

A stage takes the documents that its predecessor kept, with the columns of the
table, and returns them with its decisions taken; the last one returns where
each piece of each document is packed. Rows equal in doc_id and text are one
document: the stages keep or drop them together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from runlens.llm import line_chunks, minhash, mixing, packing, quality
from runlens.llm.rows import kept_rows, wrapped
from runlens.session import materialize

#: token shares of clean, poor and toxic documents. Clean documents are the full
#: domain and no rate is above one, so they stay once each and others are thinned.
SHARES = {"clean": 0.98, "low": 0.01, "toxic": 0.01}


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = quality.classify(docs, labels, F.col("source"), F.concat_ws("/", "source", "lang"))
    return kept_rows(docs, judged.where("kept"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines go; n_chars follows the text."""
    cut = line_chunks.dedup_lines(docs).drop("n_lines_cut")
    return cut.withColumn("n_chars", F.char_length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at a word-shingle similarity of 0.8 stays."""
    named = _with_own_id(docs)
    groups = minhash.near_duplicates(named.select("doc_id", "text")).select(
        F.col("doc_id").alias("id"), "component_id")
    ids = named.select(F.col("doc_id").alias("id"), "key").where("id is not null").distinct()
    # of each group the smallest doc_id, and of its texts the smallest version
    first = groups.where("id is not null").join(ids, "id").groupBy("component_id").agg(
        F.min("key").alias("key")).select("key.*")
    return docs.where("doc_id is null").unionByName(kept_rows(docs.where("doc_id is not null"), first))


def _with_own_id(docs: DataFrame) -> DataFrame:
    """(doc_id, text, key): texts under an id of their own, also where they share a doc_id.

    ``key`` is (doc_id, version), and doc_id a hash of it. Should two keys share a hash,
    another one is taken. A null doc_id stays null.
    """
    rows = wrapped(docs).select(F.struct("doc_id", "version").alias("key"), F.col("row.text").alias("text"))
    for salt in range(64):
        own = rows.withColumn("doc_id", F.when(
            F.col("key.doc_id").isNotNull(), F.xxhash64(F.lit(salt), "key.doc_id", "key.version")))
        if own.select("doc_id", "key").distinct().where("doc_id is not null").groupBy("doc_id").agg(
                F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            return own
    raise RuntimeError("every hash that was tried gave two texts one id")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of toxic and poor domains are thinned to their token shares."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rates = mixing.mixture(docs, mixing.label_domains(labels), SHARES, full="clean", most=1.0)
    return mixing.apply_rates(docs, rates, slack=0.05)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_filter", quality_filter),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix", mix),
    ("pack", pack),
]

#: rates and packings are found by iteration and search, which SQL cannot state
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
