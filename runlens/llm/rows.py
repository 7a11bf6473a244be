"""Whole rows carried through joins, whatever their columns are called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def wrapped(docs: DataFrame) -> DataFrame:
    """(row, doc_id, version): each row as a struct, and the key of its document.

    ``version`` is a hash of the text, so rows equal in both keys are equal
    documents, and rows of one doc_id with different texts are told apart.
    """
    return docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"))


def unwrapped(rows: DataFrame, columns: list[str], **replaced: Column) -> list[Column]:
    """The columns of the rows that ``wrapped`` packed, some of them replaced."""
    return [(replaced[c] if c in replaced else F.col("row")[c]).alias(c) for c in columns]


def kept_rows(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, version) is in ``keys``; a null id matches itself.

    Merged at every size, so the plan does not turn on how many keys there are.
    """
    right = keys.select(F.col("doc_id").alias("d"), F.col("version").alias("v")).distinct()
    rows = wrapped(docs)
    return rows.join(right.hint("merge"), F.col("doc_id").eqNullSafe(F.col("d"))
                     & (F.col("version") == F.col("v")), "left_semi") \
        .select(*unwrapped(rows, docs.columns))
