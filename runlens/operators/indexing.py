"""Row numbers and first-n over a table without one task seeing all of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from runlens.session import materialize

# up to this many rows one task may order and number them
SINGLE_TASK_ROWS = 1_000
_ROW_BITS = 33  # layout of monotonically_increasing_id: partition, then row


def row_index(rows: DataFrame, order_by: Sequence[str] | None = None,
              out: str = "idx") -> DataFrame:
    """``rows`` with the 0-based position of each row in the order of ``order_by``.

    Nulls come first; rows equal in ``order_by`` (by default all columns) follow
    each other in an order fixed by a hash of the whole row, and each keeps one
    position. Rows are range-partitioned (a hot key is split by the hash),
    numbered inside their partition, written once, and shifted by the sizes of
    the partitions before. The written table fixes the partition borders for
    both of its readers.
    """
    names = rows.columns
    order = [*(order_by or names), "_tie"]
    # a map has no hash; its text has
    tie = F.xxhash64(*(F.to_json(F.struct(c)) if t.startswith("map") else F.col(c)
                       for c, t in rows.dtypes))
    ranged = (
        rows.withColumn("_tie", tie)
        .repartitionByRange(*order).sortWithinPartitions(*order).drop("_tie")
        .withColumn("_id", F.monotonically_increasing_id())
    )
    stored = materialize(ranged, "row-index")
    part = F.shiftright("_id", _ROW_BITS)
    row = F.col("_id").bitwiseAND((1 << _ROW_BITS) - 1)
    # one row per range partition, so this window and broadcast stay small
    starts = (
        stored.groupBy(part.alias("_part")).agg((F.max(row) + 1).alias("_n"))
        .withColumn("_start", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n"))
        .select("_part", "_start")
    )
    return (
        stored.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .select(*names, (F.col("_start") + row).cast("long").alias(out))
    )


def with_row_index(df: DataFrame, order_by: Sequence[str], out: str = "idx",
                   at_most: int | None = None) -> DataFrame:
    """Add the position of each row; every row, also a tied or null one, gets its own.

    All columns move once, in the pass that numbers them. ``at_most`` is a known
    bound on the number of rows.
    """
    if at_most is not None and at_most <= SINGLE_TASK_ROWS:
        return df.withColumn(out, (F.row_number().over(
            Window.orderBy(*order_by)) - 1).cast("long"))
    return row_index(df, order_by, out)


def first_n(df: DataFrame, order_by: Sequence[str], n: int | None) -> DataFrame:
    """The first ``n`` rows in order, nulls first, never more; all rows for None.

    The n-th key is found from the key columns alone and becomes a plain
    filter, which reaches the scan: text columns are read only where it holds.
    Of rows tied at the n-th key as many are kept as are wanted.
    """
    if n is None:
        return df
    keys = df.select(*order_by)
    if n <= SINGLE_TASK_ROWS:
        head = keys.orderBy(*order_by).limit(n)
    else:
        head = row_index(keys, out="_idx").where(F.col("_idx") < n)
    found = head.agg(F.max(F.struct(*order_by)).alias("k"), F.count(F.lit(1)).alias("n")).first()
    last = found["k"]
    if last is None:
        return df.where(F.lit(False))
    types = dict(df.dtypes)
    limits = [F.lit(last[c]).cast(types[c]) for c in order_by]
    first = F.col(order_by[0])
    inside = first.isNull() if last[order_by[0]] is None else first.isNull() | (first <= limits[0])
    if len(order_by) > 1:
        # structs compare their fields in turn, null before any value
        inside = inside & (F.struct(*order_by) <= F.struct(*[
            v.alias(c) for v, c in zip(limits, order_by)]))
    reached = df.where(inside)
    if n <= SINGLE_TASK_ROWS:
        return reached.orderBy(*order_by).limit(n)
    return row_index(reached, order_by, "_idx").where(F.col("_idx") < n).drop("_idx")


def with_group_index(df: DataFrame, keys: Sequence[str], time: str, tie: str,
                     out: str, slice_seconds: int = 60) -> DataFrame:
    """Add the 0-based position of each row among the rows of its group.

    Rows of a group are ordered by a timestamp and a unique ``tie`` column.
    They are counted inside time slices, and a slice starts where the ones
    before it end; so the rows of a hot group are numbered by many tasks, and
    only its slice counts are ordered in one.
    """
    sliced = (
        df.withColumn("_k", F.struct(*keys))
        .withColumn("_slice", F.coalesce(F.expr(
            f"unix_micros({time}) div {slice_seconds * 1_000_000}"), F.lit(0).cast("long"))))
    starts = (
        sliced.groupBy("_k", "_slice").agg(F.count("*").alias("_n"))
        .withColumn("_start", F.sum("_n").over(
            Window.partitionBy("_k").orderBy("_slice")) - F.col("_n"))
        .select("_k", "_slice", "_start"))
    row = F.row_number().over(Window.partitionBy("_k", "_slice").orderBy(time, tie))
    return (sliced.join(starts, ["_k", "_slice"])
            .withColumn(out, (F.col("_start") + row - 1).cast("long"))
            .drop("_k", "_slice", "_start"))
