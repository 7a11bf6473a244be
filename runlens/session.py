"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join key even where that costs one more exchange
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # hash a side whose every partition turns out to be small, instead of
    # sorting both sides
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
}


_shipped: set[str] = set()
#: paths handed out in each open ``scratch_scope``
_scopes: list[list[str]] = []


def build_session(app_name: str = "runlens", master: str | None = None,
                  **settings: str) -> SparkSession:
    """Create a session with the settings the operators expect.

    Cluster sizing (executors, memory, shuffle partitions) stays with the
    caller: pass it as ``settings`` or in the submit command.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package wherever they run.

    Spark hands the archive to every executor, also to one that joins later. It
    is made once per application and holds source files only.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="runlens-")) / "runlens.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder; on a cluster a
    machine-local folder would be lost with its machine.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "set spark.checkpoint.dir to a folder shared by all executors")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="runlens-"))
    return sc.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    path = f"{shared_dir(spark)}/runlens/{label}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where two branches must see the very same rows (row numbering) or
    where lineage would grow with a loop. The written table outlives lost
    executors, and readers still get column pruning.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Remove what the shared folder got in this block, when the block ends.

    Results made in it must have been written or counted by then. Blocks may be
    nested, each removes its own.
    """
    _scopes.append([])
    try:
        yield
    finally:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in _scopes.pop():
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)


def small_table(spark: SparkSession, rows: list[dict],
                schema: pa.Schema | None = None) -> DataFrame:
    """A fixed dimension as a local relation, whose size the planner knows."""
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=schema))


def broadcast_if_small(df: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """Mark ``df`` for broadcast after counting that it is small; else leave it.

    For narrow tables on top of stored data, where the count costs little. A
    larger table keeps the planner's choice, which is a shuffled join.
    """
    small = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if small else df
