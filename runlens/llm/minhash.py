"""Near-duplicate documents by SuperMinHash signatures over word shingles.

1. Every text becomes a signature in one pass; texts with the very same
   shingle set are folded into a class, of which one member goes on.
2. Bands of equal signature values link class members to the smallest document
   of the band bucket. The connected groups are the candidate groups; they hold
   every pair that shares a band, and no pair list is written for them.
3. Each candidate group gets the texts of its members, once, and is compared in
   full by exact set overlap. A large group is cut into blocks by set size and
   hash, and only block pairs whose sizes allow the similarity are compared.
4. Exact links, as spanning trees per block pair, are united over all groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from runlens.llm.components import components
from runlens.llm.hashing import mix, shingle_sets
from runlens.session import materialize

#: bands x rows of the signature: a pair at similarity 0.8 shares no band with
#: probability 5e-5, one at 0.85 with 4e-7
BANDS, BAND_ROWS = 25, 5
#: documents and shingles of one block of a large candidate group
BLOCK_DOCS, BLOCK_SHINGLES = 512, 200_000

_U = np.uint64
_STEP = _U(0xD1342543DE82EF95)
_COLUMNS = 4096


def superminhash(sets: list[np.ndarray], size: int) -> np.ndarray:
    """Signatures of several shingle sets, as float values, one row a set.

    Element e visits the ``size`` places in a random order of its own; at its
    k-th place it offers k plus a random fraction, and each place keeps the
    smallest offer. All elements take step k together. A set stops as soon as
    its largest kept value lies below the next k, as later offers are larger.
    """
    counts = np.array([len(s) for s in sets])
    best = np.full((len(sets), size), np.inf)
    flat = best.reshape(-1)
    alive = np.flatnonzero(counts)
    if not len(alive):
        return best
    element = np.concatenate([sets[i] for i in alive])
    owner = np.repeat(alive, counts[alive])
    order = None
    for k in range(size):
        draw = mix(element + _U((k + 1) * int(_STEP) & 0xFFFFFFFFFFFFFFFF))
        # high bits choose the place, low bits are the fraction
        jump = ((draw >> _U(32)) * _U(size - k) >> _U(32)).astype(np.int64) + k
        offer = k + (draw & _U(0xFFFFFFFF)).astype(np.float64) / 2.0 ** 32
        if k == 0:
            place = jump
        else:
            if order is None:  # the first swap, made up for
                order = np.tile(np.arange(size, dtype=np.int16), (len(element), 1))
                _swap(order, 0, first_jump)
            place = _swap(order, k, jump)
        np.minimum.at(flat, owner * size + place, offer)
        left = best.max(axis=1) >= k + 1
        stay = left[owner]
        if not stay.any():
            break
        if k == 0:
            first_jump = jump[stay]
        if not stay.all():
            element, owner = element[stay], owner[stay]
            order = order if order is None else order[stay]
    return best


def _swap(order: np.ndarray, k: int, jump: np.ndarray) -> np.ndarray:
    """Swap entries k and ``jump`` of every row; what now stands at k."""
    at = np.arange(len(order))
    chosen = order[at, jump].astype(np.int64)
    order[at, jump] = order[:, k]
    order[:, k] = chosen
    return chosen


def signatures(docs: DataFrame, shingle: int = 5, bands: int = BANDS,
               rows: int = BAND_ROWS) -> DataFrame:
    """Shingle count, set hash and band keys of every row of ``docs``.

    Returns doc_id, n_shingles, set_hash (null for an empty set) and band_keys
    (array of long, null for an empty set).
    """
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for ids, sets in _grouped(part, shingle):
                signature = superminhash(sets, bands * rows)
                key = np.zeros((len(sets), bands), dtype=np.uint64)
                bits = signature.view(np.uint64).reshape(len(sets), bands, rows)
                for r in range(rows):
                    key = mix(key * _STEP + bits[:, :, r])
                key = mix(key + np.arange(bands, dtype=np.uint64) * _STEP)
                filled = np.array([len(s) > 0 for s in sets])
                keys = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, key.size + 1, bands, dtype=np.int32)),
                    pa.array(key.reshape(-1).view(np.int64)))
                empty = pa.array(~filled)
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(_set_hashes(sets).view(np.int64), mask=~filled),
                    pa.compute.if_else(empty, pa.scalar(None, keys.type), keys),
                ], names=["doc_id", "n_shingles", "set_hash", "band_keys"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text") \
        .mapInArrow(batches, "doc_id long, n_shingles long, set_hash long, band_keys array<long>")


def _grouped(part: pa.RecordBatch, shingle: int, at_once: int = 60_000):
    """Rows of a batch with their sets, in runs of a bounded number of shingles."""
    ids, sets, n, first = part.column(0), [], 0, 0
    for s in shingle_sets(part.column(1), shingle):
        sets.append(s)
        n += len(s)
        if n >= at_once:
            yield ids.slice(first, len(sets)), sets
            first, sets, n = first + len(sets), [], 0
    if sets:
        yield ids.slice(first, len(sets)), sets


def _set_hashes(sets: list[np.ndarray]) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.array([np.bitwise_xor.reduce(mix(s)) if len(s) else 0 for s in sets],
                            dtype=np.uint64)
                   + np.array([mix(s ^ _STEP).sum(dtype=np.uint64) if len(s) else 0
                               for s in sets], dtype=np.uint64))


def near_duplicates(docs: DataFrame, shingle: int = 5, numerator: int = 80,
                    denominator: int = 100) -> DataFrame:
    """Groups of documents linked by word-shingle overlap.

    ``docs`` needs doc_id and text; other columns are ignored, whatever their
    names. Words are runs between white space with A-Z lower-cased; a text of
    fewer words than ``shingle`` has its whole sequence as one shingle; a text
    that is null, empty or blank has none and links with nothing. Two documents
    are linked when denominator * |A and B| >= numerator * |A or B|, checked on
    the full sets of 64-bit shingle hashes.

    Returns one row per document: doc_id, n_shingles, component_id (smallest
    doc_id reachable by links, itself included) and kept (doc_id is
    component_id). Repeated rows of one doc_id are one document, with the text
    of the smallest set hash. Rows with a null doc_id link with nothing; each
    is returned, with a null component_id, and kept. An empty table gives an
    empty result.
    """
    signed = materialize(signatures(docs, shingle), "signatures")
    named = signed.where("doc_id is not null").groupBy("doc_id").agg(
        F.min(F.struct("set_hash", "n_shingles", "band_keys")).alias("s")) \
        .select("doc_id", "s.*")
    classes = materialize(_classes(named), "classes")
    linked = _verified(docs, classes, shingle, numerator, denominator)
    roots = components(linked.unionByName(
        classes.where("doc_id <> class_id")
        .select(F.col("class_id").alias("a"), F.col("doc_id").alias("b"))))
    result = classes.select("doc_id", "n_shingles") \
        .join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left") \
        .select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id")) \
        .withColumn("kept", F.expr("doc_id = component_id"))
    nameless = signed.where("doc_id is null").select(
        "doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"),
        F.lit(True).alias("kept"))
    return result.unionByName(nameless)


def _classes(named: DataFrame) -> DataFrame:
    """Fold documents of equal shingle sets; only the first keeps its bands."""
    full = named.where("set_hash is not null")
    first = full.groupBy("set_hash", "n_shingles").agg(
        F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n")) \
        .where("n > 1").drop("n")
    folded = named.join(first, ["set_hash", "n_shingles"], "left") \
        .withColumn("class_id", F.coalesce("class_id", "doc_id"))
    return folded.select("doc_id", "class_id", "set_hash", "n_shingles",
                         F.expr("if(doc_id = class_id, band_keys, null)").alias("band_keys"))


def _candidates(classes: DataFrame) -> DataFrame:
    """(node, root): groups of class members connected by shared bands."""
    bands = classes.select("doc_id", F.explode("band_keys").alias("key"))
    first = bands.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")) \
        .where("a <> z").drop("z")
    return components(bands.join(first, "key").select("a", F.col("doc_id").alias("b")))


def _verified(docs: DataFrame, classes: DataFrame, shingle: int,
              numerator: int, denominator: int) -> DataFrame:
    """Spanning trees (a, b) of the exact links within the candidate groups."""
    members = _candidates(classes).join(
        classes.select(F.col("doc_id").alias("node"), "set_hash", "n_shingles"), "node")
    placed = materialize(_blocks(members, numerator, denominator), "blocks")
    # merged at every size: no list of members is ever sent to all tasks
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text") \
        .join(placed.hint("merge"), "node") \
        .select("node", "set_hash", "text", F.explode("tasks").alias("task")) \
        .select("node", "set_hash", "text", "task.*")
    key = ["root", "low_class", "low_block", "high_class", "high_block"]
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts.repartition(n, *key).sortWithinPartitions(*key, "node")

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sets, current = [], [], None
        for part in parts:
            sizes = np.stack([part.column(c).to_numpy(zero_copy_only=False) for c in key], axis=1)
            cut = np.flatnonzero((sizes[1:] != sizes[:-1]).any(axis=1)) + 1
            cut = set(cut.tolist())
            expected = part.column("set_hash").to_pylist()
            nodes = part.column("node").to_pylist()
            for i, s in enumerate(shingle_sets(part.column("text"), shingle)):
                if i in cut or i == 0 and current is not None and current != tuple(sizes[0]):
                    yield from _linked(ids, sets, numerator, denominator)
                    ids, sets = [], []
                current = tuple(sizes[i])
                # another row of a repeated doc_id is not the document
                if int(_set_hashes([s]).view(np.int64)[0]) == expected[i] \
                        and not (ids and ids[-1] == nodes[i]):
                    ids.append(nodes[i])
                    sets.append(s)
        yield from _linked(ids, sets, numerator, denominator)

    return dealt.mapInArrow(batches, "a long, b long")


def _blocks(members: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """The comparison tasks of each member of a candidate group.

    A group that fits a block is one task. A larger one is split by size class,
    so that linked sets lie in the same or in neighbouring classes, and within
    the class by hash; every pair of blocks that may hold links is a task.
    """
    step = float(np.log(denominator / numerator))
    whole = members.groupBy("root").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("w"))
    large = whole.where((F.col("n") > BLOCK_DOCS) | (F.col("w") > BLOCK_SHINGLES)) \
        .select("root", F.lit(True).alias("large"))
    classed = members.join(large, "root", "left").withColumn(
        "cls", F.when(F.col("large"), F.floor(F.log("n_shingles") / step).cast("int"))
        .otherwise(0))
    counts = classed.groupBy("root", "cls").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / BLOCK_DOCS),
        F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("k"))
    around = counts.select("root", F.explode(F.array(
        F.struct(F.col("cls").alias("cls"), F.lit(0).alias("d"), "k"),
        F.struct((F.col("cls") - 1).alias("cls"), F.lit(1).alias("d"), "k"),
        F.struct((F.col("cls") + 1).alias("cls"), F.lit(-1).alias("d"), "k"))).alias("e")) \
        .select("root", "e.*").groupBy("root", "cls").agg(
        F.max(F.expr("if(d = 0, k, 0)")).alias("k"),
        F.max(F.expr("if(d = 1, k, 0)")).alias("up"),
        F.max(F.expr("if(d = -1, k, 0)")).alias("down")).where("k > 0")
    blocked = classed.join(around, ["root", "cls"]).withColumn(
        "block", F.expr("if(large, cast(pmod(xxhash64(node), k) as int), 0)"))
    pick = "struct(root, {0} low_class, {1} low_block, {2} high_class, {3} high_block)"
    own = "transform(sequence(0, if(large, k, 1) - 1), j -> " \
        + pick.format("cls", "least(j, block)", "cls", "greatest(j, block)") + ")"
    up = "if(large and up > 0, transform(sequence(0, up - 1), j -> " \
        + pick.format("cls", "block", "cls + 1", "j") + "), array())"
    down = "if(large and down > 0, transform(sequence(0, down - 1), j -> " \
        + pick.format("cls - 1", "j", "cls", "block") + "), array())"
    return blocked.select("node", "set_hash", F.expr(f"concat({own}, {up}, {down})").alias("tasks"))


def _linked(ids: list[int], sets: list[np.ndarray], numerator: int,
            denominator: int) -> Iterator[pa.RecordBatch]:
    """A spanning tree of the links among the sets of one task."""
    if len(ids) < 2:
        return
    size = np.array([len(s) for s in sets], dtype=np.int64)
    common = overlaps(sets)
    union = size[:, None] + size[None, :] - common
    linked = denominator * common >= numerator * union
    np.fill_diagonal(linked, True)
    label = spread_labels(linked)
    child = np.flatnonzero(label != np.arange(len(ids)))
    if len(child):
        ids = np.array(ids, dtype=np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[label[child]]), pa.array(ids[child])], names=["a", "b"])


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of 0/1 matrices."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    everything = np.concatenate(sets)
    _, column, seen = np.unique(everything, return_inverse=True, return_counts=True)
    shared = seen > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    column, owner = number[column[keep]], owner[keep]
    common = np.zeros((n, n), dtype=np.int64)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    total = int(shared.sum())
    for low in range(0, total, _COLUMNS):
        a, b = np.searchsorted(column, [low, low + _COLUMNS])
        block = np.zeros((n, min(_COLUMNS, total - low)), dtype=np.float32)
        block[owner[a:b], column[a:b] - low] = 1
        common += (block @ block.T).astype(np.int64)
    return common


def spread_labels(linked: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each row of a symmetric link matrix."""
    n = len(linked)
    label = np.arange(n)
    while True:
        new = np.where(linked, label[None, :], n).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new
