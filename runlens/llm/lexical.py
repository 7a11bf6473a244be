"""Ranked lexical search turned round: documents stream past an index of the items.

The items are few and the documents many, so the inverted index holds the
items' terms and goes to every task. A first pass over the documents counts
them, their terms, and how many hold each item term. A second one leads each
document's term counts through the index, adds up its score for every item it
shares a term with, and keeps the best documents of each item in a bounded
heap. Only the heaps leave the tasks; they are merged in two steps.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from runlens.llm import hashing as H
from runlens.session import materialize

TOP = 10
#: items and bytes of item text of one index block; a longer item is one block
BLOCK_ITEMS, BLOCK_BYTES = 2048, 8 << 20
#: (document, item) sums held at once in a task
CELLS = 2 << 20

#: terms are runs of 0-9, A-Z, a-z and everything beyond ASCII
_SEPARATOR = np.ones(256, dtype=bool)
_SEPARATOR[0x30:0x3A] = _SEPARATOR[0x41:0x5B] = _SEPARATOR[0x61:0x7B] = _SEPARATOR[0x80:] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


@dataclass
class ItemIndex:
    """Inverted index over one block of items: term -> (item, times it occurs there).

    ``terms`` are sorted hashes; the terms' own bytes stand in ``letters``, so
    that a match of hashes is confirmed. ``weights`` follow after the first pass.
    """
    ids: list
    terms: np.ndarray
    letters: np.ndarray
    letters_at: np.ndarray
    start: np.ndarray
    item: np.ndarray
    times: np.ndarray
    n_documents: int = 0
    n_terms: int = 0
    weights: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))

    @classmethod
    def build(cls, ids: list, texts: pa.Array) -> "ItemIndex":
        hashes, owners, letters = [], [], {}
        for first, _, text, rows in H.slabs(texts):
            found, starts, ends, begin = H.words(text, rows, _SEPARATOR)
            hashes.append(found)
            owners.append(first + np.repeat(np.arange(len(rows) - 1), np.diff(begin)))
            lowered = _LOWER[text]
            for i in np.unique(found, return_index=True)[1]:
                letters.setdefault(int(found[i]), lowered[starts[i]:ends[i]].tobytes())
        terms, term = np.unique(np.concatenate(hashes or [np.empty(0, np.uint64)]),
                                return_inverse=True)
        spelled = [letters[int(t)] for t in terms]
        pairs, times = np.unique(term * max(len(ids), 1) + np.concatenate(
            owners or [np.empty(0, np.int64)]), return_counts=True)
        return cls(
            ids, terms, np.frombuffer(b"".join(spelled), dtype=np.uint8),
            np.cumsum([0, *map(len, spelled)]),
            np.searchsorted(pairs // max(len(ids), 1), np.arange(len(terms) + 1)),
            pairs % max(len(ids), 1), times.astype(np.int64))

    def lookup(self, text: np.ndarray, rows: np.ndarray):
        """Term counts of a slab: document, term and occurrences of each pair, and all
        terms of each document, known or not."""
        found, starts, ends, begin = H.words(text, rows, _SEPARATOR)
        lengths = np.diff(begin)
        empty = np.empty(0, np.int64)
        if not len(self.terms) or not len(found):
            return empty, empty, empty, lengths
        at = np.minimum(np.searchsorted(self.terms, found), len(self.terms) - 1)
        hit = np.flatnonzero(self.terms[at] == found)
        at = at[hit]
        size = self.letters_at[at + 1] - self.letters_at[at]
        same = size == ends[hit] - starts[hit]
        hit, at, size = hit[same], at[same], size[same]
        if len(hit):
            ramp = H.ramp(size)
            equal = _LOWER[text[np.repeat(starts[hit], size) + ramp]] \
                == self.letters[np.repeat(self.letters_at[at], size) + ramp]
            same = np.logical_and.reduceat(equal, np.cumsum(size) - size)
            hit, at = hit[same], at[same]
        document = np.searchsorted(begin, hit, side="right") - 1
        pairs, times = np.unique(document * len(self.terms) + at, return_counts=True)
        return pairs // len(self.terms), pairs % len(self.terms), times.astype(np.int64), lengths


def count_terms(index: ItemIndex, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's counts: documents (term -1), terms (-2), documents holding each item term."""
    documents = terms = 0
    holding = np.zeros(len(index.terms), dtype=np.int64)
    for batch in batches:
        for _, _, text, rows in H.slabs(batch.column("text")):
            _, term, _, lengths = index.lookup(text, rows)
            documents += int(np.count_nonzero(lengths))
            terms += int(lengths.sum())
            holding += np.bincount(term, minlength=len(holding))
    held = np.flatnonzero(holding)
    yield pa.RecordBatch.from_pydict({
        "term": pa.array(np.concatenate([[-1, -2], held]), pa.int64()),
        "n": pa.array(np.concatenate([[documents, terms], holding[held]]), pa.int64())})


class Heaps:
    """The best documents of every item, best by score, then by smallest id, nulls last."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.heaps: list[list] = [[] for _ in range(items)]
        self.least = np.ones(items, dtype=np.int64)

    def offer(self, scores: np.ndarray, ids: list) -> None:
        """``scores`` (document, item); a score below an item's full heap is passed over."""
        for d, i in zip(*np.nonzero(scores >= self.least)):
            doc = ids[d]
            entry = (int(scores[d, i]), doc is not None, -(doc or 0))
            heap = self.heaps[i]
            if len(heap) < self.top:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.top:
                self.least[i] = heap[0][0]

    def rows(self) -> tuple[list, list, list]:
        flat = [(i, -doc if known else None, score)
                for i, heap in enumerate(self.heaps) for score, known, doc in heap]
        return tuple(map(list, zip(*flat))) if flat else ([], [], [])


def search_documents(index: ItemIndex, top: int,
                     batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's heaps: item (its place in the block), doc_id, score."""
    heaps, n_items = Heaps(len(index.ids), top), len(index.ids)
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        for first, last, text, rows in H.slabs(batch.column("text")):
            document, term, times, lengths = index.lookup(text, rows)
            if not len(document):
                continue
            m = 100 - 75 + (75 * lengths * index.n_documents) // index.n_terms
            part = index.weights[term] * (
                (1_000_000_000 * times) // (1000 * times + 8 * m[document]))
            postings = index.start[term + 1] - index.start[term]
            # documents are taken so many at a time that their sums stay bounded
            step = max(1, CELLS // n_items)
            for lo in range(0, last - first, step):
                a, b = np.searchsorted(document, [lo, lo + step])
                for c, d in _pieces(postings[a:b], document[a:b], a):
                    base = int(document[c])
                    count = postings[c:d]
                    at = np.repeat(index.start[term[c:d]], count) + H.ramp(count)
                    scores = np.zeros((int(document[d - 1]) - base + 1, n_items), dtype=np.int64)
                    np.add.at(scores, (np.repeat(document[c:d] - base, count), index.item[at]),
                              np.repeat(part[c:d], count) * index.times[at])
                    heaps.offer(scores, ids[first + base:first + int(document[d - 1]) + 1])
    item, doc, score = heaps.rows()
    yield pa.RecordBatch.from_pydict({
        "item": pa.array(item, pa.int32()), "doc_id": pa.array(doc, pa.int64()),
        "score": pa.array(score, pa.int64())})


def _pieces(postings: np.ndarray, document: np.ndarray, offset: int):
    """Ranges of whole documents with about ``CELLS`` postings each."""
    at, sums, n = 0, np.cumsum(postings), len(postings)
    while at < n:
        reach = int(np.searchsorted(sums, (sums[at - 1] if at else 0) + CELLS, side="right"))
        # back to the start of the document that is cut, or on to its end
        end = n if reach >= n else int(np.searchsorted(document, document[reach], side="left"))
        if end <= at:
            end = int(np.searchsorted(document, document[at], side="right"))
        yield offset + at, offset + end
        at = end


def _blocks(items: DataFrame) -> tuple[DataFrame, int]:
    """Items with the number of their block. No block has more than the limits allow,
    unless it is a single item."""
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    every = items.agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes")).first()
    blocks = max(1, -(-every["n"] // BLOCK_ITEMS), -(-(every["bytes"] or 0) // BLOCK_BYTES))
    while True:
        dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
        over = dealt.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes")) \
            .where((F.col("n") > BLOCK_ITEMS) | ((F.col("bytes") > BLOCK_BYTES) & (F.col("n") > 1)))
        if blocks == 1 and every["n"] <= BLOCK_ITEMS or over.isEmpty():
            return dealt, blocks
        blocks *= 2


def search(documents: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` best documents for every item.

    ``documents`` needs doc_id and text, ``items`` item_id and text; other
    columns are ignored. Terms are runs of ASCII letters and digits and of
    characters beyond ASCII, with A-Z lower-cased. A term's weight is
    floor(1000 ln((2N+2)/(2df+1))), and a document's score the sum over the
    item's terms, repeats included, of weight * (10^9 tf div (1000 tf + 8 m))
    with m = 25 + 75 n N div L (N documents with terms, L terms of all, n of
    the document, df documents with the term, tf occurrences in the document).

    Returns item_id, rank (from 1), doc_id, score: documents with a score above
    zero, equal scores by ascending doc_id. A null or empty text has no terms,
    so it is never found, and an item without one finds nothing. Every row of
    ``documents`` is a document, also one that repeats another's id or text; a
    null doc_id comes after the others among equal scores. Rows equal in item_id
    and text are one item; an item_id with several texts has a ranking for each.
    Items are taken in blocks of bounded size, each with two passes over the
    documents, so any number of items can be searched.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    wanted = items.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    dealt, n_blocks = _blocks(wanted)
    if n_blocks > 1:
        dealt = materialize(dealt, "items")
    found = None
    for block in range(n_blocks):
        rows = dealt.where(F.col("block") == block).orderBy("item_id", "text") \
            .select("item_id", "text").toArrow()
        index = ItemIndex.build(rows.column("item_id").to_pylist(), rows.column("text"))
        best = _search_block(docs, index, top).withColumn("block", F.lit(block))
        found = best if found is None else found.unionByName(best)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    # heaps of lanes of tasks first, so no step takes the heaps of all tasks at once
    lanes = Window.partitionBy("block", "item", "lane").orderBy(*order)
    whole = Window.partitionBy("block", "item").orderBy(*order)
    return found.withColumn("rank", F.row_number().over(lanes)).where(F.col("rank") <= top) \
        .withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= top) \
        .select("item_id", "rank", "doc_id", "score")


def _search_block(docs: DataFrame, index: ItemIndex, top: int) -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(index)
    counts = docs.select("text").mapInArrow(
        lambda batches: count_terms(shared.value, batches), "term long, n long") \
        .groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    count = dict(zip(counts.column("term").to_pylist(), counts.column("n").to_pylist()))
    index.n_documents, index.n_terms = count.get(-1, 0), count.get(-2, 0)
    index.weights = np.array([
        math.floor(1000 * math.log((2 * index.n_documents + 2) / (2 * count.get(t, 0) + 1)))
        for t in range(len(index.terms))], dtype=np.int64)
    weighed = spark.sparkContext.broadcast(index)
    names = pa.array(index.ids, pa.int64())

    def heaps(batches):
        for batch in search_documents(weighed.value, top, batches):
            yield batch.append_column("item_id", names.take(batch.column("item")))

    lanes = max(1, math.isqrt(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return docs.mapInArrow(heaps, "item int, doc_id long, score long, item_id long") \
        .withColumn("lane", F.pmod(F.spark_partition_id(), F.lit(lanes)))
