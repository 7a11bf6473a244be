"""Tables that a stream adds to, where every record counts once, however often it is sent.

The table is its own ledger: a micro-batch writes the records whose key no
earlier batch has written, into a folder named by its number. A batch that is
run again, because a machine or the driver was lost, reads the batches before
it and overwrites its own folder, so it adds nothing. No key is ever forgotten,
so a copy may come at any time later.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from runlens.operators.results import keep_one
from runlens.session import broadcast_if_small
from runlens.streaming.dedup import RECORD_KEY

BATCH = "batch"


def read_ledger(spark: SparkSession, path: str, schema) -> DataFrame:
    """All records of the table, with the number of the batch that brought them."""
    try:
        stored = spark.read.option("basePath", path).parquet(f"{path}/{BATCH}=*")
    except AnalysisException:
        return spark.createDataFrame([], schema).withColumn(BATCH, F.lit(0).cast("long"))
    return stored.withColumn(BATCH, F.col(BATCH).cast("long"))


def append_new(rows: DataFrame, batch: int, path: str, keys: Sequence[str] = RECORD_KEY,
               order_by: Sequence[str] = ()) -> None:
    """Add the rows whose key no batch before ``batch`` has written; of copies the first in order.

    Copies within the batch are folded by an aggregate. Of the table only the key
    columns of earlier batches are read, and only the keys that come again leave
    their tasks: the batch's keys go to the table where they are few, and both are
    shuffled where they are not. Keys with nulls are equal to each other.
    """
    keys = list(keys)
    once = keep_one(rows, keys, list(order_by) or sorted(set(rows.columns) - set(keys)))
    packed = F.struct(*keys).alias("_k")
    earlier = read_ledger(rows.sparkSession, path, rows.schema).where(F.col(BATCH) < batch)
    again = earlier.select(packed).join(
        broadcast_if_small(once.select(packed)), "_k", "left_semi").distinct()
    fresh = once.withColumn("_k", F.struct(*keys)).join(again, "_k", "left_anti").drop("_k")
    fresh.select(*rows.columns).write.mode("overwrite").parquet(f"{path}/{BATCH}={batch}")


def drain_once(stream: DataFrame, path: str, keys: Sequence[str] = RECORD_KEY,
               order_by: Sequence[str] = ()) -> DataFrame:
    """Add what has arrived of a stream to the table at ``path``, and return the table."""
    query = (
        stream.writeStream.foreachBatch(
            lambda rows, batch: append_new(rows, batch, f"{path}/data", keys, order_by))
        .option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start())
    query.awaitTermination()
    return read_ledger(stream.sparkSession, f"{path}/data", stream.schema).drop(BATCH)
