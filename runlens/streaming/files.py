"""File streams that run to the end of the input and stop."""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

from runlens.session import scratch_path

MAX_FILES_PER_TRIGGER = 1000


def read_stream(spark: SparkSession, path: str, schema: StructType, fmt: str,
                max_files: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """Files as a stream, with a bound on what one micro-batch takes in.

    The bound is a number of files or, for operators that hold one key's share
    of a micro-batch, a number of bytes.
    """
    limit = (("maxBytesPerTrigger", max_bytes) if max_bytes
             else ("maxFilesPerTrigger", max_files or MAX_FILES_PER_TRIGGER))
    return spark.readStream.schema(schema).format(fmt).option(*limit).load(path)


def drain(stream: DataFrame, label: str) -> DataFrame:
    """Append what a stream puts out to a table in the shared folder, and read it.

    State and progress are kept in the shared folder too, so the query goes on
    where it was if its machines are lost.
    """
    spark = stream.sparkSession
    out = scratch_path(spark, label)
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", f"{out}/data").option("checkpointLocation", f"{out}/progress")
        .trigger(availableNow=True).start())
    query.awaitTermination()
    try:
        return spark.read.schema(stream.schema).parquet(f"{out}/data")
    except AnalysisException:
        # no file has arrived, so no batch has run and the sink has no folder
        return spark.createDataFrame([], stream.schema)


def heartbeats(spark: SparkSession, schema: StructType, at: datetime, time: str = "ts") -> DataFrame:
    """One row that has a time and nothing else: it moves a stream's watermark on."""
    fields = [StructField(f.name, f.dataType) for f in schema.fields]
    return spark.createDataFrame(
        [tuple(at if f.name == time else None for f in fields)], StructType(fields))
