"""Operations on one generated token sequence."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def rollback(ids: Column, keep: Column) -> Column:
    """The first ``keep`` ids; the source column is left as it is."""
    return F.slice(ids, F.lit(1), F.greatest(keep, F.lit(0)))


def sequence_length(ids: Column) -> Column:
    """Length of a sequence; a missing one has length 0."""
    return F.coalesce(F.when(ids.isNotNull(), F.size(ids)), F.lit(0))


def stop_at_eos(ids: Column, eos_id: Column, max_new_tokens: int) -> Column:
    """End at the first EOS, inclusive, and never beyond the cap.

    A cap below 1 still yields one token, because the first token is picked
    before the cap is looked at.
    """
    at = F.array_position(ids, eos_id)
    stop = F.when(at > 0, at).otherwise(F.size(ids)).cast("int")
    return F.slice(ids, F.lit(1), F.least(F.lit(max(1, max_new_tokens)), stop))


def first_mismatch(a: Column, b: Column) -> Column:
    """0-based place of the first differing id in the common length, else -1."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n),
                      lambda x, y: x == y)
    return F.array_position(same, F.lit(False)).cast("long") - 1
