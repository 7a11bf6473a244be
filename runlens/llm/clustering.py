"""Clustering of whole-numbered vectors around centroids, by the threshold algorithm.

For every dimension the centroids are listed by their value there. A vector
walks each list outward from its own value; a centroid that is met for the
first time has its exact distance taken. What is left unmet in a dimension is
at least as far as the walk has come, so the sum of these frontier distances is
a lower bound for every centroid not met at all, and the walk ends once it
strictly exceeds the best exact distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from runlens.session import materialize, small_table

CLUSTERS, ROUNDS, DIMENSIONS, SCALE = 16, 3, 64, 64
#: a component at or beyond this has squares whose sum would not fit a long
LARGEST = 1 << 26
#: vectors walked at once
ROWS = 4096


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each vector's nearest centroid, the smaller number
    among equals. Whole numbers throughout."""
    n, (k, size) = len(vectors), centroids.shape
    order = np.argsort(centroids, axis=0, kind="stable")
    lists = np.take_along_axis(centroids, order, axis=0)
    best = np.full(n, np.iinfo(np.int64).max)
    cluster = np.zeros(n, dtype=np.int32)
    met = np.zeros((n, k), dtype=bool)
    # next place to look at on either side, in every dimension
    above = np.empty((n, size), dtype=np.int64)
    for d in range(size):
        above[:, d] = np.searchsorted(lists[:, d], vectors[:, d])
    below = above - 1
    walking, column = np.arange(n), np.arange(size)[None, :]
    for _ in range(k):
        x, lo, hi = vectors[walking], below[walking], above[walking]
        down = np.where(lo >= 0, x - lists[np.maximum(lo, 0), column], np.iinfo(np.int64).max)
        up = np.where(hi < k, lists[np.minimum(hi, k - 1), column] - x, np.iinfo(np.int64).max)
        lower = down <= up
        here = order[np.where(lower, np.maximum(lo, 0), np.minimum(hi, k - 1)), column]
        below[walking], above[walking] = lo - lower, hi + ~lower
        fresh = np.zeros((len(walking), k), dtype=bool)
        np.put_along_axis(fresh, here, True, axis=1)
        fresh &= ~met[walking]
        met[walking] |= fresh
        row, number = np.nonzero(fresh)
        exact = ((x[row] - centroids[number]) ** 2).sum(axis=1)
        offered = np.full((len(walking), k), np.iinfo(np.int64).max)
        offered[row, number] = exact
        # argmin takes the smaller number among equals met in this step
        pick = offered.argmin(axis=1)
        value = offered[np.arange(len(walking)), pick]
        better = (value < best[walking]) | ((value == best[walking]) & (pick < cluster[walking]))
        best[walking] = np.where(better, value, best[walking])
        cluster[walking] = np.where(better, pick, cluster[walking])
        frontier = (np.minimum(down, up) ** 2).sum(axis=1)
        walking = walking[(frontier <= best[walking]) & ~met[walking].all(axis=1)]
        if not len(walking):
            break
    return cluster, best


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _sums(centroids: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's sums: cluster, vectors, and the sum of every component."""
    k, size = centroids.shape
    counts, sums = np.zeros(k, dtype=np.int64), np.zeros((k, size), dtype=np.int64)
    for batch in batches:
        vectors = _matrix(batch.column("v"), size)
        for at in range(0, len(vectors), ROWS):
            part = vectors[at:at + ROWS]
            cluster, _ = nearest(part, centroids)
            counts += np.bincount(cluster, minlength=k)
            for c in np.unique(cluster):
                sums[c] += part[cluster == c].sum(axis=0)
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_pydict({
        "cluster": pa.array(np.repeat(some, size), pa.int32()),
        "dimension": pa.array(np.tile(np.arange(size), len(some)), pa.int32()),
        "n": pa.array(np.repeat(counts[some], size), pa.int64()),
        "total": pa.array(sums[some].ravel(), pa.int64())})


def _assigned(centroids: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = _matrix(batch.column("v"), centroids.shape[1])
        found = [nearest(vectors[at:at + ROWS], centroids) for at in range(0, len(vectors), ROWS)]
        yield pa.RecordBatch.from_pydict({
            "vec_id": batch.column("vec_id"),
            "cluster": pa.array(np.concatenate([c for c, _ in found] or [np.empty(0)]), pa.int32()),
            "distance": pa.array(np.concatenate([d for _, d in found] or [np.empty(0)]), pa.int64())})


def whole_vectors(vectors: DataFrame, size: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the usable vectors with every component as floor(scale * x)."""
    v = F.col("embedding").cast("array<double>")
    limit = F.lit(float(LARGEST))
    fits = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.floor(x * scale) >= -limit)
                    & (F.floor(x * scale) < limit))
    return vectors.where((F.size("embedding") == size) & fits).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform(v, lambda x: F.floor(x * scale).cast("long")).alias("v"))


def cluster_vectors(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS,
                    size: int = DIMENSIONS, scale: int = SCALE, seed: int = 1) -> DataFrame:
    """Clusters of whole-numbered vectors after some rounds from hashed first centroids.

    ``vectors`` needs vec_id and embedding (array of numbers); other columns are
    ignored. Kept are vectors of exactly ``size`` components, none null or
    non-finite, each turned into floor(scale * x). Vectors with a component of
    2^26 or more after that are left out, as a squared distance between them
    would not fit a long. The first centroids are the vectors with the smallest
    SHA-256 of "seed:vec_id", a null id last, rows of one id by their components;
    with fewer vectors there are fewer centroids. Each round assigns every vector
    to its nearest centroid (the smaller number among equals) and moves every
    non-empty centroid to the floor of its vectors' mean; then vectors are
    assigned once more.

    Returns one row per kept row, repeated ones too: vec_id, cluster, distance
    (squared), cluster_inertia and inertia (distance summed over the cluster and
    over all; null should the sum not fit a long) and centroid_sha256 (of the
    final centroid's components, joined by commas). Without usable vectors the
    result is empty.

    What reaches the driver is ``clusters`` x ``size`` numbers a round; sums are
    made within tasks first.
    """
    spark = vectors.sparkSession
    kept = whole_vectors(vectors, size, scale)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.orderBy(F.asc_nulls_last(key), "v").limit(clusters).select("v").collect()
    centroids = np.array([r["v"] for r in first], dtype=np.int64).reshape(-1, size)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, "
                                     "cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = _moved(kept, centroids)
    final = centroids
    assigned = materialize(kept.mapInArrow(
        lambda batches: _assigned(final, batches),
        "vec_id long, cluster int, distance long"), "assigned")
    sums = assigned.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()
    inertia = sum(int(r["total"]) for r in sums)
    facts = small_table(spark, [{
        "number": r["cluster"], "cluster_inertia": _long(int(r["total"])), "inertia": _long(inertia),
        "centroid_sha256": hashlib.sha256(",".join(map(str, final[r["cluster"]])).encode()).hexdigest()}
        for r in sums], pa.schema([("number", pa.int32()), ("cluster_inertia", pa.int64()),
                                   ("inertia", pa.int64()), ("centroid_sha256", pa.string())]))
    # a row for each centroid at most
    return assigned.join(F.broadcast(facts), F.col("cluster") == F.col("number")) \
        .select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _long(x: int) -> int | None:
    return x if -(1 << 63) <= x < 1 << 63 else None


def _moved(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids at the floor of the mean of the vectors nearest to them."""
    sums = kept.select("v").mapInArrow(
        lambda batches: _sums(centroids, batches),
        "cluster int, dimension int, n long, total long") \
        .groupBy("cluster", "dimension").agg(
            F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    moved = centroids.copy()
    for r in sums.collect():
        moved[r["cluster"], r["dimension"]] = int(r["total"]) // r["n"]
    return moved
