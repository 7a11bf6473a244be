"""A token vocabulary as a table: encode and decode by join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from runlens.functions.text import tokens


def token_id(piece: Column) -> Column:
    """A stable 60-bit id of a piece, equal on every machine and run."""
    return F.conv(F.substring(F.md5(piece), 1, 15), 16, 10).cast("long")


def vocabulary(texts: DataFrame, text: str) -> DataFrame:
    """(token_id, piece) of every token that occurs."""
    return (texts.select(F.explode(tokens(F.col(text))).alias("piece")).distinct()
            .select(token_id(F.col("piece")).alias("token_id"), "piece"))


def encode(text: Column) -> Column:
    return F.transform(tokens(text), token_id)


def decode(sequences: DataFrame, keys: Sequence[str], ids: str,
           vocab: DataFrame, out: str = "text") -> DataFrame:
    """Text of each id sequence; ``keys`` identify a sequence.

    A vocabulary can outgrow a broadcast, so pieces are joined in long form
    and put back in order; each rebuilt group is one sequence. Unknown ids
    add no text.
    """
    long = sequences.select(*keys, F.posexplode(ids).alias("_pos", "token_id"))
    pieces = F.sort_array(F.collect_list(F.struct("_pos", "piece")))
    full = long.join(vocab, "token_id", "left").groupBy(*keys).agg(
        F.array_join(F.transform(pieces, lambda p: p["piece"]), "").alias(out),
        F.count("*").alias("n_ids"))
    empty = sequences.where(F.size(ids) == 0).select(
        *keys, F.lit("").alias(out), F.lit(0).cast("long").alias("n_ids"))
    return full.unionByName(empty)
