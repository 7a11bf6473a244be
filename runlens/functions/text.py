"""Tokens of a text, native by default, with a plug for the caller's tokenizer."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, IntegerType

# a token keeps the white space before it, so joining tokens gives the text back
TOKEN = r"\s*\S+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), 0)


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN)).cast("long")


def truncate_tokens(text: Column, n: int) -> Column:
    """The first ``n`` tokens, as text.

    A possessive prefix match stops reading after ``n`` tokens instead of
    splitting a whole long text first; the result equals joining the first
    ``n`` entries of :func:`tokens`.
    """
    return F.regexp_extract(text, rf"^(?:\s*+\S++){{0,{n}}}+", 0)


def count_udf(tokenizer_factory: Callable[[], object]):
    """Vectorised ``text -> number of tokens`` for a tokenizer with ``encode``.

    ``tokenizer_factory`` runs once per Python worker; rows reach it in Arrow
    batches, and only the numbers come back.
    """
    cache: dict[str, object] = {}

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        if "tok" not in cache:
            cache["tok"] = tokenizer_factory()
        tok = cache["tok"]
        return texts.map(lambda t: None if t is None else len(tok.encode(t))).astype("Int64")

    return count


def truncate_udf(tokenizer_factory: Callable[[], object], n: int):
    """Vectorised ``text -> text of its first n tokens``, in one trip to the worker."""
    cache: dict[str, object] = {}

    @F.pandas_udf("string")
    def truncate(texts: pd.Series) -> pd.Series:
        if "tok" not in cache:
            cache["tok"] = tokenizer_factory()
        tok = cache["tok"]
        return texts.map(lambda t: None if t is None else tok.decode(list(tok.encode(t)[:n])))

    return truncate
