"""Adjacent words of a corpus, counted as packed numbers.

Words get 64-bit numbers by hash, and a table of all words proves them unique. Tasks
read texts in chunks, count the pairs of a chunk, and deal them to shards as arrays of
numbers, so Spark moves a few rows a chunk and shard instead of one row a pair.

A shard holds all pairs of its words. Of a word that is frequent in the whole corpus,
pairs are dealt by the other word instead, so no shard holds an unbounded group; what
its pairs sum up to is known from the table of words.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from runlens.session import materialize, ship_package

EOS = "</s>"
#: bytes of text of a chunk; tokens of a shard, and of one where that makes too few for
#: all cores; documents taken at a time
CHUNK_BYTES, SHARD_TOKENS, LEAST_TOKENS, _ROWS = 24 << 20, 2 << 20, 1 << 16, 500
#: a word with more than the tokens of a shard is frequent; this many there are at most
FREQUENT = 4096
_DEALT_WORDS = "kid long, shard int, ids binary, words string, n binary, m binary"
_WORDS = "kid long, id long, word string, n long, m long, clash boolean"
_PAIR_ROWS = "kid long, shard int, prev binary, next binary, n binary"
_DRAFT_ROWS = "kid long, shard int, prev binary, n binary, q binary"

#: of each key: numbers of its frequent words, ascending, and how often each occurs
Frequent = dict[int, tuple[np.ndarray, np.ndarray]]
_NONE = np.empty(0, np.int64), np.empty(0, np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_ids(words: pa.StringArray, salt: int) -> np.ndarray:
    """A hash of each word, taken eight bytes at a time over all words."""
    starts = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1].astype(np.int64)
    size = np.diff(starts)
    data = np.frombuffer((words.buffers()[2] or pa.py_buffer(b"")).to_pybytes() + bytes(8), np.uint8)
    eights = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))  # at every byte
    out = _mixed(size.astype(np.uint64) + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    at, left = np.arange(len(words)), 0
    while len(at := at[size[at] > left]):
        unused = np.maximum(left + 8 - size[at], 0).astype(np.uint64) * np.uint64(8)
        out[at] = _mixed(out[at] * np.uint64(0x9E3779B97F4A7C15) ^ (eights[starts[at] + left] << unused))
        left += 8
    return out.view(np.int64)


@dataclass(frozen=True)
class Words:
    """All words of a corpus: kid, id, word, n (pairs it begins), m (pairs it ends)."""

    table: DataFrame
    keys: DataFrame  # kid and the keys it stands for
    rows: DataFrame  # kid and text
    salt: int
    shards: int
    first: Frequent  # as first and as second word of a pair
    second: Frequent

    @property
    def end(self) -> int:
        return int(word_ids(pa.array([EOS]), self.salt)[0])


def _chunks(batches: Iterator[pa.RecordBatch], salt: int, most: int):
    """(kid, words, ids, prev, next) of each key of each chunk; prev and next are places in words."""
    held, size = defaultdict(list), 0
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            part = batch.slice(at, _ROWS)
            kids = part.column("kid").to_numpy()
            order = np.argsort(kids, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(kids[order])) + 1):
                held[int(kids[rows[0]])].append(part.column("text").take(pa.array(rows)).drop_null().cast(pa.string()))
            size += pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
            if size >= most:
                yield from _closed(held, salt)
                held, size = defaultdict(list), 0
    yield from _closed(held, salt)


def _closed(held: dict, salt: int):
    for kid, texts in held.items():
        # splits where Java's \s does, and leaves an empty word beside white space at an end
        split = pc.ascii_split_whitespace(pa.concat_arrays(texts))
        found, bounds = split.values, split.offsets.to_numpy()
        kept = pc.binary_length(found).to_numpy() > 0
        found, bounds = found.filter(pa.array(kept)), np.append(0, np.cumsum(kept))[bounds]
        if not len(found):
            continue
        coded = found.dictionary_encode()
        words, prev = coded.dictionary, coded.indices.to_numpy()
        end = words.index(EOS).as_py()
        if end < 0:
            end, words = len(words), pa.concat_arrays([words, pa.array([EOS])])
        following = np.append(prev[1:], prev[:1])
        following[bounds[1:][np.diff(bounds) > 0] - 1] = end
        yield kid, words, word_ids(words, salt), prev, following


def _deal_words(salt: int, most: int, shards: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for kid, words, ids, prev, following in _chunks(batches, salt, most):
        n, m = (np.bincount(x, minlength=len(words)) for x in (prev, following))
        yield _dealt(kid, ids, ids, np.zeros(len(ids), bool), shards, {"ids": ids, "words": words, "n": n, "m": m})


def _add_words(table: pa.Table) -> pa.Table:
    """Each word of a shard once; clash: its number is that of another word, too."""
    out, texts = [], table.column("words").combine_chunks()
    for kid, rows, (ids, n, m) in _of_keys(table, ids=np.int64, n=np.int64, m=np.int64):
        order = np.argsort(ids, kind="stable")
        words = pc.ascii_split_whitespace(texts.take(pa.array(rows))).values.take(pa.array(order))
        ids = ids[order]
        begins, _ = _groups(ids)
        # of two words in turn under one number, the later gives the sign
        other = ~pc.equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False) & (ids[1:] == ids[:-1])
        clash = np.add.reduceat(np.append(False, other).astype(np.int64), begins) > 0
        out.append(pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(begins), kid, np.int64)), pa.array(ids[begins]), words.take(pa.array(begins)),
             *(pa.array(np.add.reduceat(x[order], begins)) for x in (n, m)), pa.array(clash)],
            names=["kid", "id", "word", "n", "m", "clash"]))
    return pa.Table.from_batches(out)


def _found(among: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of ``ids`` are in ``among``, their places there)."""
    if not len(among):
        return np.zeros(len(ids), bool), np.zeros(len(ids), np.int64)
    at = np.minimum(np.searchsorted(among, ids), len(among) - 1)
    return among[at] == ids, at


def _dealt(kid: int, by: np.ndarray, other: np.ndarray, frequent: np.ndarray, shards: int,
           columns: dict[str, np.ndarray | pa.Array]) -> pa.RecordBatch:
    """One row a shard: the columns of what goes there, as bytes; words with a space between."""
    to = np.where(frequent, other, by).view(np.uint64) % np.uint64(shards)
    to = to.astype(np.uint16 if shards <= 1 << 16 else np.int32)
    order = np.argsort(to, kind="stable")
    begins = np.searchsorted(to[order], np.arange(shards, dtype=to.dtype))
    full = np.flatnonzero(np.diff(begins, append=len(to)))
    bounds = np.append(begins[full], len(to))

    def packed(values):
        if isinstance(values, pa.Array):
            return pc.binary_join(pa.ListArray.from_arrays(
                pa.array(bounds.astype(np.int32)), values.take(pa.array(order))), " ")
        ends = pa.py_buffer((bounds * values.itemsize).astype(np.int64))
        return pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(full), [None, ends, pa.py_buffer(values[order])]).cast(pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(full), kid, np.int64)), pa.array(full.astype(np.int32)), *map(packed, columns.values())],
        names=["kid", "shard", *columns])


def _deal_pairs(words_of: tuple[int, int], shards: int, by: str, split: Frequent,
                batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for kid, words, ids, prev, following in _chunks(batches, *words_of):
        pairs, n = np.unique(prev.astype(np.int64) * len(words) + following, return_counts=True)
        prev, following = np.divmod(pairs, len(words))
        frequent = _found(split.get(kid, _NONE)[0], ids)[0]
        columns = {"prev": ids[prev], "next": ids[following], "n": n.astype(np.int32)}
        other = "next" if by == "prev" else "prev"
        yield _dealt(kid, columns[by], columns[other], frequent[prev if by == "prev" else following], shards, columns)


def _of_keys(table: pa.Table, **types: type) -> Iterator[tuple]:
    """(kid, its rows, arrays) of each key of a shard."""
    kids = table.column("kid").to_numpy()
    lists = [(table.column(name).to_pylist(), kind) for name, kind in types.items()]
    order = np.argsort(kids, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(kids[order])) + 1):
        yield int(kids[rows[0]]), rows, [
            np.frombuffer(b"".join([values[i] for i in rows]), kind) for values, kind in lists]


def _summed(first: np.ndarray, second: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each pair once, in order, with its count."""
    order = np.lexsort((second, first))
    first, second = first[order], second[order]
    begins = np.flatnonzero(np.concatenate(
        [[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])]))
    return first[begins], second[begins], np.add.reduceat(n[order].astype(np.int64), begins)


def _groups(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, size) of each run of one value."""
    begins = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return begins, np.diff(begins, append=len(ordered))


def _totals(ids: np.ndarray, sums: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """``sums``; of frequent words, whose pairs are in many shards, what is known of all."""
    hit, at = _found(frequent[0], ids)
    return np.where(hit, frequent[1][at], sums) if hit.any() else sums


def _draft(first: Frequent, second: Frequent, shards: int, table: pa.Table) -> pa.Table:
    """Pairs dealt by their second word: that word's share of all, dealt by the first word."""
    out, everything = [], table.column("total").to_numpy()
    for kid, rows, (prev, following, n) in _of_keys(table, prev=np.int64, next=np.int64, n=np.int32):
        following, prev, n = _summed(following, prev, n)
        begins, sizes = _groups(following)
        q = _totals(following[begins], np.add.reduceat(n, begins), second.get(kid, _NONE)) / everything[rows[0]]
        out.append(_dealt(kid, prev, following, _found(first.get(kid, _NONE)[0], prev)[0], shards,
                          {"prev": prev, "n": n, "q": np.repeat(q, sizes)}))
    return pa.Table.from_batches(out)


def _overlap(first: Frequent, table: pa.Table) -> pa.Table:
    """Sum of min(p, q) of each context of a shard; a frequent one has a part in many."""
    out = []
    for kid, _, (prev, n, q) in _of_keys(table, prev=np.int64, n=np.int64, q=np.float64):
        order = np.argsort(prev, kind="stable")
        prev, n, q = prev[order], n[order], q[order]
        begins, sizes = _groups(prev)
        n_prev = _totals(prev[begins], np.add.reduceat(n, begins), first.get(kid, _NONE))
        alpha = np.add.reduceat(np.minimum(n / np.repeat(n_prev, sizes), q), begins)
        out.append(pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(begins), kid, np.int64)), pa.array(prev[begins]), pa.array(n_prev), pa.array(alpha)],
            names=["kid", "id", "n", "alpha"]))
    return pa.Table.from_batches(out)


def _best(first: Frequent, table: pa.Table) -> pa.Table:
    """The most frequent successors of each word of a shard; lone: no other can be better or equal."""
    out = []
    for kid, _, (prev, following, n) in _of_keys(table, prev=np.int64, next=np.int64, n=np.int32):
        prev, following, n = _summed(prev, following, n)
        begins, sizes = _groups(prev)
        top = np.flatnonzero(n == np.repeat(np.maximum.reduceat(n, begins), sizes))
        at, ties = _groups(prev[top])
        lone = np.repeat((ties == 1) & ~_found(first.get(kid, _NONE)[0], prev[top][at])[0], ties)
        out.append(pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(top), kid, np.int64)), pa.array(prev[top]), pa.array(following[top]),
             pa.array(n[top]), pa.array(lone)], names=["kid", "prev", "next", "n", "lone"]))
    return pa.Table.from_batches(out)


def _frequent(table: DataFrame, count: str, least: float) -> Frequent:
    """Words with more than ``least`` of the tokens, of which there are few."""
    out = defaultdict(list)
    for r in table.where(F.col(count) > least).select("kid", "id", count).collect():
        out[r[0]].append((r[1], r[2]))
    return {kid: tuple(np.array(x, np.int64) for x in zip(*sorted(rows))) for kid, rows in out.items()}


def count_words(texts: DataFrame, text: str, keys: Sequence[str] = (),
                chunk_bytes: int = CHUNK_BYTES, shard_tokens: int = SHARD_TOKENS) -> Words:
    """Number and count the words of all texts, per value of ``keys``."""
    spark = texts.sparkSession
    ship_package(spark)
    parts, pieces = int(spark.conf.get("spark.sql.shuffle.partitions")), texts.rdd.getNumPartitions()
    for salt in range(64):
        # a null leaves a hash as it is, so it is told beside it
        kid = F.xxhash64(F.lit(salt), *(x for k in keys for x in (F.col(k).isNull(), F.col(k))))
        named = texts.select(kid.alias("kid"), *keys).distinct() if keys else texts.select(kid.alias("kid")).limit(1)
        named = materialize(named, "keys")
        rows = texts.select(kid.alias("kid"), F.col(text).cast("string").alias("text"))
        # as many shards of words as there are pieces of input, so that they grow no larger
        dealt = rows.mapInArrow(partial(_deal_words, salt, chunk_bytes, max(parts, pieces)), _DEALT_WORDS)
        table = materialize(_in_shards(dealt, _add_words, _WORDS), "words")
        if table.where("clash").isEmpty() and named.groupBy("kid").count().where("count > 1").isEmpty():
            break
    else:
        raise RuntimeError("every hash that was tried gave two words one number")
    tokens = table.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-tokens // shard_tokens), min(4 * parts, -(-tokens // LEAST_TOKENS)))
    return Words(table, named, rows, salt, shards, *(
        _frequent(table, c, tokens / min(shards, FREQUENT)) for c in ("n", "m")))


def _pairs(words: Words, by: str, chunk_bytes: int) -> DataFrame:
    split = words.first if by == "prev" else words.second
    return words.rows.mapInArrow(
        partial(_deal_pairs, (words.salt, chunk_bytes), words.shards, by, split), _PAIR_ROWS)


def _in_shards(rows: DataFrame, work: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    def of_shard(table: pa.Table) -> pa.Table:
        return work(table)
    return rows.groupBy("shard").applyInArrow(of_shard, schema)


def overlaps(words: Words, totals: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(kid, id, n, alpha) of each context; ``totals``: kid and total, its tokens."""
    drafts = _in_shards(_pairs(words, "next", chunk_bytes).join(totals, "kid"),
                        partial(_draft, words.first, words.second, words.shards), _DRAFT_ROWS)
    parts = _in_shards(drafts, partial(_overlap, words.first), "kid long, id long, n long, alpha double")
    return parts.groupBy("kid", "id").agg(F.max("n").alias("n"), F.sum("alpha").alias("alpha"))


def best_next(words: Words, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(prev, next): numbers of each word and its most frequent successor, the smallest on ties."""
    best = materialize(_in_shards(
        _pairs(words, "prev", chunk_bytes), partial(_best, words.first),
        "kid long, prev long, next long, n long, lone boolean"), "best")
    names = words.table.select(F.col("id").alias("next"), "word")
    first = F.min(F.struct((-F.col("n")).alias("neg"), "word", "next")).alias("_b")
    tied = best.where("not lone").join(names, "next").groupBy("prev").agg(first)
    return best.where("lone").select("prev", "next").unionByName(
        tied.select("prev", F.col("_b.next").alias("next")))
