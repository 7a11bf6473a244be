"""Tokens of a caller's tokenizer as rows, or counted and cut in the same pass over the text."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

#: token rows handed on at once
_PIECE = 1 << 16


def token_rows(df: DataFrame, keys: Sequence[str], text: str,
               factory: Callable[[], object]) -> DataFrame:
    """(keys, position, token_id): a row for every token of ``text``, positions from 0.

    An Arrow table function over batches of rows; ``factory`` gives an object with
    ``encode`` once per worker. A null or empty text has no rows. Rows leave the worker
    in pieces of bounded size, also those of one very long text.
    """
    keys = list(keys)
    key_types = [T.StructField(f"_k{i}", df.schema[k].dataType) for i, k in enumerate(keys)]
    out = T.StructType([*key_types, T.StructField("position", T.IntegerType()),
                        T.StructField("token_id", T.LongType())])

    @F.arrow_udtf(returnType=out)
    class TokenRows:
        def __init__(self):
            self.tokenizer = factory()

        def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
            rows: list[int] = []
            places: list[int] = []
            ids: list[int] = []

            def piece() -> pa.Table:
                taken = pa.array(rows, pa.int64())
                columns = [batch.column(i).take(taken) for i in range(len(keys))]
                return pa.table([*columns, pa.array(places, pa.int32()), pa.array(ids, pa.int64())],
                                names=out.fieldNames())
            for row, value in enumerate(batch.column(len(keys)).to_pylist()):
                encoded = self.tokenizer.encode(value) if value else ()
                for at in range(0, len(encoded), _PIECE):
                    part = encoded[at:at + _PIECE]
                    rows += [row] * len(part)
                    places += range(at, at + len(part))
                    ids += part
                    if len(ids) >= _PIECE:
                        yield piece()
                        rows, places, ids = [], [], []
            yield piece()

    found = TokenRows(_narrow(df, keys, text).asTable())
    return found.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], "position", "token_id")


def _narrow(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    return df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                     F.col(text).cast("string").alias("_text"))


def counted_and_cut(df: DataFrame, keys: Sequence[str], text: str, factory: Callable[[], object],
                    limit: int) -> DataFrame:
    """(keys, n_tokens, cut): tokens of ``text``, and the text of its first ``limit`` tokens.

    One trip to the worker for both; no list of ids comes back. A text within the limit
    returns as it is, a null one as null with no tokens.
    """
    keys = list(keys)
    key_types = [T.StructField(f"_k{i}", df.schema[k].dataType) for i, k in enumerate(keys)]
    out = T.StructType([*key_types, T.StructField("n_tokens", T.LongType()),
                        T.StructField("cut", T.StringType())])

    @F.arrow_udtf(returnType=out)
    class CountedAndCut:
        def __init__(self):
            self.tokenizer = factory()

        def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
            counts, cuts = [], []
            for value in batch.column(len(keys)).to_pylist():
                encoded = self.tokenizer.encode(value) if value else ()
                counts.append(len(encoded))
                cuts.append(value if len(encoded) <= limit
                            else self.tokenizer.decode(list(encoded[:limit])))
            yield pa.table([*[batch.column(i) for i in range(len(keys))],
                            pa.array(counts, pa.int64()), pa.array(cuts, pa.string())],
                           names=out.fieldNames())

    found = CountedAndCut(_narrow(df, keys, text).asTable())
    return found.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], "n_tokens", "cut")
