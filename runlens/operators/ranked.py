"""Order-based results that never gather a whole group in one task.

A window ordered by value sorts every row of a group in one task, so a group
holding a third of the data would be done by one core. Here the rows are first
reduced to (group, value, count) and cut into ranges of equal size over group
and value, at splitters that Spark samples from the rows themselves, so the
ranges are even however the values lie. Ranks come from running sums over
ranges, a few rows a group, plus running sums inside one range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from runlens.functions.metrics import interpolated
from runlens.session import broadcast_if_small, materialize


def _value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    # map-side combined: one row per distinct value of a group; the packed key
    # is never null itself, so groups with a null in their key join like others
    key = F.struct(*keys) if keys else F.struct(F.lit(True).alias("all"))
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(key.alias("_k"), F.col(value).alias("_v"))
        .agg(F.count("*").alias("_c")))


def _ranges(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Value counts with the number of their range; written, so that the borders stay."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = _value_counts(df, keys, value).repartitionByRange(n, "_k", "_v")
    return materialize(counts.withColumn("_part", F.spark_partition_id()), "ranges")


def _unpacked(keys: Sequence[str]) -> list[Column]:
    return [F.col("_k")[k].alias(k) for k in keys]


def _starts(ranges: DataFrame) -> DataFrame:
    """For each group and range: rows of the group, before the range and up to its end.

    There are as many rows as groups and ranges together, and as ranges in a group.
    """
    group = Window.partitionBy("_k")
    return (
        ranges.groupBy("_k", "_part").agg(F.sum("_c").alias("_rows"))
        .withColumn("_upto", F.sum("_rows").over(group.orderBy("_part")))
        .withColumn("_n", F.sum("_rows").over(group))
        .withColumn("_before", F.col("_upto") - F.col("_rows"))
        .drop("_rows"))


def _upto_in_range() -> Column:
    return F.sum("_c").over(Window.partitionBy("_part", "_k").orderBy("_v"))


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str,
                      probs: dict[str, float]) -> DataFrame:
    """Linear-interpolated percentiles of ``value`` for each group.

    Result: ``keys``, ``n`` and one column per entry of ``probs``. Only the
    few ranges that hold a wanted rank are ranked value by value.
    """
    ranges = _ranges(df, keys, value)
    pos = {name: F.lit(float(q)) * (F.col("_n") - 1) for name, q in probs.items()}
    ranks = F.array_distinct(F.array(
        *[F.floor(p).cast("long") for p in pos.values()],
        *[F.ceil(p).cast("long") for p in pos.values()]))
    wanted = (
        _starts(ranges)
        .withColumn("_ranks", F.filter(ranks, lambda r: (r >= F.col("_before"))
                                       & (r < F.col("_upto"))))
        .where(F.size("_ranks") > 0)
        .select("_k", "_part", "_before", "_n", "_ranks")
    )
    hits = (
        ranges.join(broadcast_if_small(wanted), ["_k", "_part"])
        .withColumn("_hi", F.col("_before") + _upto_in_range())
        .withColumn("_lo", F.col("_hi") - F.col("_c"))
        .select("_k", "_n", "_v", F.explode(F.filter(
            "_ranks", lambda r: (r >= F.col("_lo")) & (r < F.col("_hi")))).alias("_r"))
    )

    def at(rank: Column) -> Column:
        return F.max(F.when(F.col("_r") == rank, F.col("_v")))

    def between(p: Column) -> Column:
        return interpolated(at(F.floor(p).cast("long")), at(F.ceil(p).cast("long")),
                            F.max(p - F.floor(p)))

    # at most two rows per percentile and group reach this aggregate
    return (
        hits.groupBy("_k")
        .agg(F.max("_n").alias("n"), *[between(p).alias(k) for k, p in pos.items()])
        .select(*_unpacked(keys), "n", *pos))


def value_distribution(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Empirical CDF: ``keys``, value, ``n`` copies and ``cume_dist``.

    Every range is one task, which has an even share of all values.
    """
    ranges = _ranges(df, keys, value)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        ranges.repartitionByRange(n, "_part").withColumn("_own", _upto_in_range())
        .join(broadcast_if_small(_starts(ranges)), ["_k", "_part"])
        .select(*_unpacked(keys), F.col("_v").alias(value), F.col("_c").alias("n"),
                ((F.col("_before") + F.col("_own")) / F.col("_n")).alias("cume_dist"))
    )


def approx_percentiles(df: DataFrame, keys: Sequence[str], value: str,
                       probs: dict[str, float], accuracy: int = 10_000) -> DataFrame:
    """Mergeable sketch version for logs where an exact pass costs too much."""
    sketch = F.percentile_approx(value, list(probs.values()), accuracy)
    return (
        df.groupBy(*keys).agg(F.count(value).alias("n"), sketch.alias("_q"))
        .select(*keys, "n", *[F.get("_q", F.lit(i)).alias(name)
                              for i, name in enumerate(probs)])
    )
