"""Near-duplicate vectors by a forest of random-projection trees.

Vectors of one label are split again and again at a random point near the
median of a random direction. Vectors close to the split go to both sides, so
that a near pair is seldom parted; several trees make it rarer still. Pairs
are compared within leaves. A tree is fitted on a bounded sample of its node;
every vector is then led to its leaves, and leaves that are still large are
split again the same way, until they are small or cannot be split. Leaves that
stay large, such as thousands of near copies, are compared in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from runlens.llm.components import components
from runlens.llm.minhash import spread_labels
from runlens.session import materialize

#: trees, and half-width of the overlap around a split, on unit vectors. A pair
#: at cosine 0.98 is 0.2 apart; along a random direction of 64 it lies 0.025 apart
TREES, SPILL = 6, 0.02
#: vectors of a leaf below which it is not split, and of one comparison block
LEAF, BLOCK = 128, 512
#: expected sample rows a node's subtree is fitted on, and rounds of splitting
SAMPLE, ROUNDS = 2000, 12


def _direction(seed: int, node: int, size: int) -> np.ndarray:
    v = np.random.default_rng([seed & 0xFFFFFFFF, seed >> 32 & 0xFFFFFFFF, node]) \
        .standard_normal(size)
    return v / np.linalg.norm(v)


def fit_subtree(unit: np.ndarray, seed: int, rows: int, leaf: int = LEAF,
                spill: float = SPILL) -> tuple[list[int], list[float]]:
    """Splits of one node's subtree: heap positions and thresholds.

    ``unit`` is a sample of the ``rows`` unit vectors of the node. A position
    is split while it stands for more than ``leaf`` vectors, its sample is large
    enough to judge, and both sides come out clearly smaller.
    """
    positions, thresholds = [], []
    scale = rows / max(len(unit), 1)
    todo = [(1, np.arange(len(unit)))]
    while todo:
        node, at = todo.pop()
        if len(at) * scale <= leaf or len(at) < 16 or node >= 1 << 40:
            continue
        along = unit[at] @ _direction(seed, node, unit.shape[1])
        # a random point of the middle half
        pick = np.random.default_rng([seed & 0xFFFFFFFF, node, 1]).uniform(0.4, 0.6)
        cut = float(np.quantile(along, pick))
        left, right = at[along <= cut + spill], at[along >= cut - spill]
        if max(len(left), len(right)) > 0.9 * len(at):
            continue
        positions.append(node)
        thresholds.append(cut)
        todo += [(2 * node, left), (2 * node + 1, right)]
    return positions, thresholds


def descend(unit: np.ndarray, seed: int, positions: list[int], thresholds: list[float],
            spill: float = SPILL) -> list[tuple[int, np.ndarray]]:
    """Leaves of a subtree with the rows that reach them."""
    split = dict(zip(positions, thresholds))
    todo, out = [(1, np.arange(len(unit)))], []
    while todo:
        node, at = todo.pop()
        if not len(at):
            continue
        if node not in split:
            out.append((node, at))
            continue
        along = unit[at] @ _direction(seed, node, unit.shape[1])
        todo += [(2 * node, at[along <= split[node] + spill]),
                 (2 * node + 1, at[along >= split[node] - spill])]
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _unit_vectors(vectors: DataFrame) -> DataFrame:
    """Usable vectors as one row per distinct (label, vector): node, label, size, unit."""
    good = F.expr("vec_id is not null and label is not null and size(v) > 0 "
                  "and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) "
                  "and exists(v, x -> x <> 0)")
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
        F.col("embedding").cast("array<double>").alias("v")).where(good)
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("s")) \
        .select("vec_id", "s.label", "s.v")


def near_vectors(vectors: DataFrame, threshold: float = 0.98, trees: int = TREES,
                 seed: int = 7) -> DataFrame:
    """Groups of vectors linked by cosine, within their label.

    ``vectors`` needs vec_id, embedding (array of numbers) and label; other
    columns are ignored. Two vectors are linked if their labels are equal and
    not null, their lengths are equal, and their cosine in double precision is
    at least ``threshold``. A vector that is null, empty or zero, or holds a
    null or non-finite component, links with nothing. Equal vectors of a label
    are compared once for all of them.

    Returns one row per vec_id: vec_id, n_links (other vectors linked directly),
    component_id (smallest vec_id reachable by links, itself included) and kept
    (vec_id is component_id). Repeated rows of a vec_id are one vector, the
    usable one with the smallest label and components. Rows with a null vec_id
    are returned as they are, each with no links, a null component and kept.
    """
    usable = materialize(_unit_vectors(vectors), "vectors")
    classes = usable.groupBy("label", "v").agg(
        F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"))
    classes = materialize(classes, "vector-classes")
    members = usable.join(classes.select("label", "v", "node", "copies"), ["label", "v"]) \
        .select("vec_id", "node", "copies")
    leaves = _leaves(classes, trees, seed)
    compared = materialize(_compare(classes, leaves, threshold), "vector-links")
    counts = compared.where("links is not null").groupBy("a").agg(F.sum("links").alias("links")) \
        .withColumnRenamed("a", "node")
    linked = members.join(counts, "node", "left").select(
        "vec_id", "node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    linked = materialize(linked, "vector-counts")
    roots = components(compared.where("b is not null").select("a", "b").unionByName(
        linked.where("vec_id <> node").select(F.col("node").alias("a"), F.col("vec_id").alias("b"))))
    known = linked.join(roots.withColumnRenamed("node", "vec_id"), "vec_id", "left") \
        .select("vec_id", "n_links", F.coalesce("root", "vec_id").alias("component_id"))
    every = vectors.select(F.col("vec_id").cast("long").alias("vec_id"))
    named = every.where("vec_id is not null").distinct().join(known, "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id")) \
        .withColumn("kept", F.expr("vec_id = component_id"))
    return named.unionByName(every.where("vec_id is null").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"),
        F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept")))


def _leaves(classes: DataFrame, trees: int, seed: int) -> DataFrame:
    """(node, leaf): the leaves that every vector class reaches in all trees."""
    placed = materialize(classes.select("node", F.explode(F.transform(
        F.sequence(F.lit(1), F.lit(trees)),
        lambda t: F.xxhash64("label", F.size("v"), t, F.lit(seed)))).alias("leaf")), "leaves")
    units = classes.select("node", "v")
    done = None
    sizes = placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))
    for _ in range(ROUNDS):
        open_ = materialize(sizes.where(F.col("n") > LEAF), "open-leaves")
        if open_.isEmpty():
            break
        held = placed.join(open_, "leaf", "left_anti")
        done = held if done is None else done.unionByName(held)
        rows = placed.join(open_, "leaf").join(units, "node")
        splits = materialize(_splits(rows), "splits")
        stuck = splits.where(F.size("positions") == 0).select("leaf")
        done = done.unionByName(placed.join(stuck, "leaf", "left_semi"))
        moving = placed.join(splits.where(F.size("positions") > 0), "leaf").join(units, "node")
        placed = materialize(_led(moving), "leaves")
        sizes = placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))
    return placed if done is None else done.unionByName(placed)


def _splits(rows: DataFrame) -> DataFrame:
    """A subtree per open leaf, fitted on a sample of about ``SAMPLE`` vectors.

    The sample is taken by a hash of vector and leaf before any shuffle, so a
    leaf of any size sends the same bounded number of rows to its fit.
    """
    sampled = rows.where(F.expr(
        f"pmod(xxhash64(node, leaf, 1), 1000000) < least(1000000, 1000000L * {SAMPLE} div n)"))

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(frame["v"].to_numpy()).astype(np.float64)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        leaf = int(frame["leaf"].iloc[0])
        positions, thresholds = fit_subtree(
            v[np.argsort(frame["node"].to_numpy())], leaf & (1 << 63) - 1, int(frame["n"].iloc[0]))
        return pd.DataFrame({"leaf": [leaf], "positions": [positions], "thresholds": [thresholds]})

    return sampled.select("leaf", "node", "n", "v").groupBy("leaf").applyInPandas(
        fit, "leaf long, positions array<long>, thresholds array<double>")


def _led(rows: DataFrame) -> DataFrame:
    """Vectors led down their leaf's subtree: (node, leaf) with the new leaves."""
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            leaf = part.column("leaf").to_numpy()
            order = np.argsort(leaf, kind="stable")
            cuts = np.flatnonzero(np.diff(leaf[order])) + 1
            for at in np.split(order, cuts):
                if not len(at):
                    continue
                group = part.take(pa.array(at))
                v = _matrix(group.column("v"))
                v /= np.linalg.norm(v, axis=1, keepdims=True)
                own = int(leaf[at[0]])
                nodes = group.column("node").to_numpy()
                for position, reached in descend(
                        v, own & (1 << 63) - 1, group.column("positions")[0].as_py(),
                        group.column("thresholds")[0].as_py()):
                    yield pa.RecordBatch.from_arrays([
                        pa.array(nodes[reached]), pa.array(np.full(len(reached), own)),
                        pa.array(np.full(len(reached), position, dtype=np.int64))],
                        names=["node", "leaf", "position"])

    return rows.select("node", "leaf", "positions", "thresholds", "v") \
        .mapInArrow(batches, "node long, leaf long, position long") \
        .select("node", F.xxhash64("leaf", "position").alias("leaf"))


def _compare(classes: DataFrame, leaves: DataFrame, threshold: float) -> DataFrame:
    """Links within leaves: rows (a, links) with counts and (a, b) with a tree.

    Every vector carries the list of its leaves, and a pair is counted only in
    the first leaf that both reach, so counts are of distinct vectors though
    pairs are never written. A leaf of more than ``BLOCK`` vectors is cut into
    blocks by hash, and each pair of blocks is a task of its own.
    """
    leaves = leaves.distinct()
    sizes = leaves.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where("n > 1") \
        .select("leaf", F.ceil(F.col("n") / BLOCK).cast("int").alias("k"))
    lists = leaves.groupBy("node").agg(F.sort_array(F.collect_list("leaf")).alias("reached"))
    rows = leaves.join(sizes, "leaf").join(
        classes.select("node", "copies", "v").join(lists, "node"), "node")
    tasks = rows.withColumn("block", F.expr("cast(pmod(xxhash64(node), k) as int)")) \
        .select("node", "copies", "v", "reached", "leaf", "block",
                F.explode(F.expr("transform(sequence(0, k - 1), j -> "
                                 "struct(least(j, block) as low, greatest(j, block) as high))"))
                .alias("t")) \
        .select("node", "copies", "v", "reached", "leaf", "block", "t.*")
    key = ["leaf", "low", "high"]
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = tasks.repartition(n, *key).sortWithinPartitions(*key, "node")

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for part in parts:
            keys = np.stack([part.column(c).to_numpy() for c in key], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)]
            for low, high in zip(cuts[:-1], cuts[1:]):
                piece = part.slice(low, high - low)
                if held and [held[0].column(c)[0].as_py() for c in key] \
                        != [piece.column(c)[0].as_py() for c in key]:
                    yield from _linked(held, threshold)
                    held = []
                if len(piece):
                    held.append(piece)
        if held:
            yield from _linked(held, threshold)

    return dealt.mapInArrow(batches, "a long, b long, links long")


def _linked(held: list[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Counts and a spanning tree of the links of one comparison task."""
    rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    if len(rows) < 2:
        return
    v = _matrix(rows.column("v"))
    norm = np.sqrt((v * v).sum(axis=1))
    cosine = (v @ v.T) / (norm[:, None] * norm[None, :])
    linked = cosine >= threshold
    np.fill_diagonal(linked, False)
    block = rows.column("block").to_numpy()
    if rows.column("low")[0].as_py() != rows.column("high")[0].as_py():
        linked &= block[:, None] != block[None, :]
    nodes = rows.column("node").to_numpy()
    x, y = np.nonzero(np.triu(linked))
    if not len(x):
        return
    leaf = rows.column("leaf")[0].as_py()
    reached = [np.array(r.as_py()) for r in rows.column("reached")]
    first = _first_common(reached, x, y) == leaf
    copies = rows.column("copies").to_numpy()
    links = np.bincount(x[first], copies[y[first]], len(nodes)) \
        + np.bincount(y[first], copies[x[first]], len(nodes))
    label = spread_labels(linked | np.eye(len(nodes), dtype=bool))
    child = np.flatnonzero(label != np.arange(len(nodes)))
    none = pa.nulls(len(nodes), pa.int64())
    yield pa.RecordBatch.from_arrays(
        [pa.array(nodes), none, pa.array(links.astype(np.int64))], names=["a", "b", "links"])
    yield pa.RecordBatch.from_arrays(
        [pa.array(nodes[child]), pa.array(nodes[label[child]]), pa.nulls(len(child), pa.int64())],
        names=["a", "b", "links"])


def _first_common(reached: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Smallest leaf that both vectors of each pair reach."""
    every, coded = np.unique(np.concatenate(reached), return_inverse=True)
    owner = np.repeat(np.arange(len(reached)), [len(r) for r in reached])
    flags = np.zeros((len(reached), len(every)), dtype=bool)
    flags[owner, coded] = True
    out = np.empty(len(x), dtype=np.int64)
    step = max(1, (1 << 24) // len(every))
    for low in range(0, len(x), step):
        at = slice(low, low + step)
        out[at] = np.argmax(flags[x[at]] & flags[y[at]], axis=1)
    return every[out]
