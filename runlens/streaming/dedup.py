"""Drop records that were sent again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

RECORD_KEY = ("config_hash", "prompt_id", "run_idx")


def with_arrival(stream: DataFrame, out: str = "arrived") -> DataFrame:
    """Add the time at which a record's file was written."""
    return stream.select("*", F.col("_metadata.file_modification_time").alias(out))


def drop_resent(stream: DataFrame, arrived: str = "arrived", within: str = "1 day",
                keys: Sequence[str] = RECORD_KEY, lanes: int = 16) -> DataFrame:
    """One record per key; a key is remembered for ``within`` of arrival time.

    The watermark follows the time of arrival, so a record is never dropped for
    what its own time is, however old; ``within`` must cover how long after the
    first a copy may still arrive, and bounds the state. A record sent very many
    times would send all its copies to one task, so copies are first dropped
    inside ``lanes`` lanes per key and the survivors, at most one per lane, once
    more by the key alone.
    """
    keys = list(keys)
    watermarked = stream.withWatermark(arrived, within)
    laned = watermarked.withColumn("_lane", F.pmod(F.spark_partition_id(), F.lit(lanes)))
    return (laned.dropDuplicatesWithinWatermark([*keys, "_lane"]).drop("_lane")
            .dropDuplicatesWithinWatermark(keys))
