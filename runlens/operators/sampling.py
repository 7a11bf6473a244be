"""Samples of exact size from every stratum, by a keyed uniform.

Of each stratum the rows with the smallest hashes are taken. The hash that
parts them from the rest is found digit by digit: rows are counted by stratum
and leading bits, the digit in which the quota is reached is the only one that is
looked into further. Counts merge within tasks, so a stratum that holds nearly
all rows costs no more than another, and no window sees a stratum.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from runlens.session import broadcast_if_small, materialize

_BITS, _DIGIT = 60, 12
_BEYOND = 1 << 62
#: rows of a stratum that may be ordered at the border
BORDER_ROWS = 1024


def keyed_hash(seed: int, key: Column) -> Column:
    """60 bits that depend on seed and key only."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, _BITS // 4),
                  16, 10).cast("long")


def stratified_sample(rows: DataFrame, strata: Sequence[str], key: str, quota: int | Column,
                      seed: int, border_rows: int = BORDER_ROWS) -> DataFrame:
    """``quota`` rows of every stratum, all of a smaller one; the same rows at any partitioning.

    ``key`` is a column without nulls that tells the rows of a stratum apart; rows that share
    a key also share their hash, and any of them may be left out at the border. A null
    in ``strata`` is a value like others. ``quota`` may be a column over ``strata``; null or
    less than one takes none. Returns the columns of ``rows``.
    """
    columns = rows.columns
    quota = quota if isinstance(quota, Column) else F.lit(quota)
    hashed = rows.select(
        F.struct(*strata).alias("_s"), keyed_hash(seed, F.col(key)).alias("_h"),
        F.greatest(quota.cast("long"), F.lit(0)).alias("_q"), F.struct(*columns).alias("_row"))
    narrow = hashed.select("_s", "_h", "_q")
    state, shift = None, _BITS
    while shift > 0:
        shift -= _DIGIT
        state = materialize(_next_digit(narrow, state, shift), "quota")
        # the digits of a stratum that holds no more than its quota need no border
        most = state.where("need > 0").agg(F.max("here")).first()[0]
        if (most or 0) <= border_rows:
            break
    digit = F.shiftright("_h", shift)
    met = hashed.join(broadcast_if_small(state), "_s").select("_s", "_h", "_row", "prefix", "need", digit.alias("_d"))
    inside = met.where(F.col("_d") < F.col("prefix")).select("_row.*")
    at_border = met.where((F.col("_d") == F.col("prefix")) & (F.col("need") > 0)).withColumn(
        "_rank", F.row_number().over(Window.partitionBy("_s").orderBy("_h", F.col("_row")[key])))
    return inside.unionByName(at_border.where(F.col("_rank") <= F.col("need")).select("_row.*"))


def _next_digit(narrow: DataFrame, state: DataFrame | None, shift: int) -> DataFrame:
    """Per stratum: the leading bits at the border, rows wanted with these, and rows that have them.

    Rows with smaller leading bits are all wanted. Where the quota takes all rows the
    border lies beyond all hashes, where it takes none, before them; ``need`` is 0 then.
    """
    digit = F.shiftright("_h", shift)
    if state is None:
        open_rows = narrow.withColumnRenamed("_q", "need")
    else:
        open_rows = narrow.join(broadcast_if_small(state.where("need > 0")), "_s").where(
            F.shiftright("_h", shift + _DIGIT) == F.col("prefix"))
    counts = open_rows.groupBy("_s", digit.alias("_d")).agg(
        F.count(F.lit(1)).alias("_n"), F.max("need").alias("_need"))
    # a window over the digits of one stratum: 4096 rows at most
    upto = F.sum("_n").over(Window.partitionBy("_s").orderBy("_d"))
    at_border = (F.col("_upto") >= F.col("_need")) & (F.col("_upto") - F.col("_n") < F.col("_need"))
    found = counts.withColumn("_upto", upto).groupBy("_s").agg(
        F.max("_need").alias("_need"), F.max(F.when(at_border, F.struct(
            F.col("_d").alias("prefix"), (F.col("_need") - F.col("_upto") + F.col("_n")).alias("need"),
            F.col("_n").alias("here")))).alias("_b"))
    found = found.select(
        "_s", F.when(F.col("_need") < 1, F.lit(0)).otherwise(
            F.coalesce("_b.prefix", F.lit(_BEYOND))).cast("long").alias("prefix"),
        F.coalesce("_b.need", F.lit(0)).cast("long").alias("need"),
        F.coalesce("_b.here", F.lit(0)).cast("long").alias("here"))
    return found if state is None else found.unionByName(state.where("need = 0"))
