"""Packing of token pieces into sequences of bounded length.

Texts are tokenized where they are read; only (length, place) goes on. The
lengths' histogram, at most one row per possible length, is packed by bin
completion on the driver; every piece then finds its place from its rank among
the pieces of its length. Nothing else passes through one place, and ranks
come from counts per task, so a very frequent length is no hot key.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from runlens.llm import bin_completion
from runlens.llm.hashing import slabs
from runlens.session import materialize

MAX_TOKENS = 2048
END_OF_DOCUMENT = 0
TOKENIZER = "word_bpe_49k.json"
#: distinct chunks that a worker process remembers, and bytes of text at once
_MEMO = 1_000_000
_SLAB_BYTES = 4 << 20

_LETTER = np.zeros(256, dtype=bool)
_LETTER[ord("A"):ord("Z") + 1] = _LETTER[ord("a"):ord("z") + 1] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[33:127] = True
_MARK[ord("0"):ord("9") + 1] = False
_MARK &= ~_LETTER


class ChunkTokenizer:
    """Token ids of whole texts, made from remembered ids of their chunks.

    The tokenizer drops white space, never looks across it, and always breaks
    between a letter and a following ASCII mark. So the ids of a text are those
    of its chunks in order, where a chunk ends before a non-blank that follows
    a blank or newline, and between an ASCII letter and an ASCII mark. Capital
    ASCII letters are lowered first, which the tokenizer does anyway, except
    before a non-ASCII character that could combine with them. A slab that
    spells the start of a special token is cut at blanks only and not lowered.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._forget()

    def _forget(self) -> None:
        self._known: dict[bytes, int] = {}
        self._starts = np.zeros(1 << 16, dtype=np.int64)
        self._ids = np.empty(1 << 18, dtype=np.uint32)

    def _learn(self, chunks: list[bytes]) -> None:
        n = len(self._known)
        ids = [e.ids for e in self._tokenizer.encode_batch(
            [c.decode("utf-8") for c in chunks], add_special_tokens=False)]
        ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids))) + self._starts[n]
        while len(self._starts) <= n + len(ids):
            self._starts = np.resize(self._starts, 2 * len(self._starts))
        while len(self._ids) < ends[-1]:
            self._ids = np.resize(self._ids, 2 * len(self._ids))
        self._ids[self._starts[n]:ends[-1]] = np.fromiter(
            chain.from_iterable(ids), np.uint32, int(ends[-1] - self._starts[n]))
        self._starts[n + 1:n + 1 + len(ids)] = ends
        self._known.update(zip(chunks, range(n, n + len(ids))))

    def encode(self, text: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a slab of texts, and where each text's ids begin (and end)."""
        n = len(text)
        if not n:
            return np.empty(0, np.uint32), np.zeros(len(rows), np.int64)
        blank = (text == 32) | (text == 10)
        cut = np.zeros(n + 1, dtype=bool)
        cut[1:-1] = blank[:-1] & ~blank[1:]
        if not ((text[:-1] == ord("<")) & (text[1:] == ord("|"))).any():
            cut[1:-1] |= _LETTER[text[:-1]] & _MARK[text[1:]]
            capital = (text >= ord("A")) & (text <= ord("Z"))
            capital[:-1] &= text[1:] < 128
            text = text + capital.view(np.uint8) * np.uint8(32)
        cut[rows] = True
        cut[0] = True
        starts = np.flatnonzero(cut)
        chunks = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(starts) - 1,
            [None, pa.py_buffer(starts), pa.py_buffer(np.ascontiguousarray(text))])
        coded = chunks.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self._known) > _MEMO:
            self._forget()
        known = self._known
        new = [c for c in distinct if c not in known]
        if new:
            self._learn(new)
        at = np.fromiter(map(known.__getitem__, distinct), np.int64, len(distinct))
        begin, size = self._starts[at], self._starts[at + 1] - self._starts[at]
        code = coded.indices.to_numpy()
        size = size[code]
        end = np.cumsum(size)
        out = self._ids[np.repeat(begin[code] - (end - size), size) + np.arange(end[-1])]
        return out, np.append(0, end)[np.searchsorted(starts, rows)]


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> ChunkTokenizer:
    """One per worker process, so that what a task has learnt serves the next."""
    return ChunkTokenizer(path)


def token_pieces(docs: DataFrame, tokenizer: str | None = None,
                 max_tokens: int = MAX_TOKENS, with_ids: bool = False) -> DataFrame:
    """Cut every document's token ids into pieces of at most ``max_tokens``.

    ``docs`` needs doc_id and text, other columns are ignored. A document is
    the ids of its text (null: empty), without special tokens added, then id 0,
    so each row gives at least one piece. Only a document longer than
    ``max_tokens`` is cut; all its pieces but the last are full. ``tokenizer``
    is a tokenizer file that every executor can open; the default is a
    vocabulary of the installed package of public tokenizers.

    Returns doc_id, piece, start, length, ids_crc32 (of the ids as little-endian
    unsigned 32-bit numbers), task and nth (position among the task's pieces of
    that length), and with ``with_ids`` the ids. Repeated rows are documents of
    their own.
    """
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        path = tokenizer
        if path is None:
            import public_tokenizers
            path = public_tokenizers.path(TOKENIZER)
        encoder = _tokenizer(path)
        task = TaskContext.get().partitionId()
        used = np.zeros(max_tokens + 1, dtype=np.int64)
        for part in parts:
            for first, last, text, rows in slabs(part.column(1), _SLAB_BYTES):
                ids, at = encoder.encode(text, rows)
                yield _cut(part.column(0).slice(first, last - first), ids, at,
                           max_tokens, task, used, with_ids)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        batches, schema + (", ids array<int>" if with_ids else ""))


def _cut(doc_ids: pa.Array, ids: np.ndarray, at: np.ndarray, most: int, task: int,
         used: np.ndarray, with_ids: bool) -> pa.RecordBatch:
    row, piece, start, length, crc, pieces = [], [], [], [], [], []
    end = np.array([END_OF_DOCUMENT], dtype="<u4")
    for i in range(len(doc_ids)):
        whole = np.concatenate([ids[at[i]:at[i + 1]].astype("<u4"), end])
        for n, low in enumerate(range(0, len(whole), most)):
            part = whole[low:low + most]
            row.append(i)
            piece.append(n)
            start.append(low)
            length.append(len(part))
            crc.append(zlib.crc32(part.tobytes()))
            if with_ids:
                pieces.append(part.astype(np.int32))
    length = np.array(length, dtype=np.int64)
    order = np.argsort(length, kind="stable")
    first = np.searchsorted(length[order], length[order])
    nth = np.empty(len(length), dtype=np.int64)
    nth[order] = np.arange(len(length)) - first
    nth += used[length]
    used += np.bincount(length, minlength=len(used))
    columns = {
        "doc_id": doc_ids.take(pa.array(row, pa.int64())), "piece": pa.array(piece, pa.int32()),
        "start": pa.array(start, pa.int64()), "length": pa.array(length),
        "ids_crc32": pa.array(crc, pa.int64()),
        "task": pa.array(np.full(len(length), task, dtype=np.int32)), "nth": pa.array(nth)}
    if with_ids:
        columns["ids"] = pa.ListArray.from_arrays(
            pa.array(np.append(0, np.cumsum(length)).astype(np.int32)),
            pa.array(np.concatenate(pieces) if pieces else np.empty(0, np.int32)))
    return pa.RecordBatch.from_pydict(columns)


def pack_pieces(pieces: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Place every row of a written ``pieces`` table into a sequence.

    Adds sequence_id (from 0) and offset to the columns of ``token_pieces``,
    without task and nth. Sequences are gapless and hold at most ``max_tokens``
    tokens. ``pieces`` is read twice and must give the same rows both times, as
    a written table does. The plan that all tasks share has a row per piece
    length and filling, however many pieces there are.
    """
    tallies = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = tallies.withColumn("before", F.coalesce(F.sum("n").over(
        Window.partitionBy("length").orderBy("task").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0))).select("length", "task", "before")
    # one row per possible length
    histogram = {r["length"]: r["n"] for r in
                 tallies.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = _places(bin_completion.pack(histogram, max_tokens))
    ranked = pieces.join(before, ["length", "task"]) \
        .withColumn("nth", F.expr("nth + before")).drop("task", "before")
    fields = [c for c in pieces.columns if c not in ("task", "nth")]
    schema = ", ".join(f"{c} {t}" for c, t in pieces.dtypes if c in fields)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            length = part.column("length").to_numpy()
            nth = part.column("nth").to_numpy()
            sequence = np.empty(len(length), dtype=np.int64)
            offset = np.empty(len(length), dtype=np.int64)
            for size in np.unique(length):
                at = np.flatnonzero(length == size)
                starts, base, copies, room = plan[int(size)]
                i = np.searchsorted(starts, nth[at], side="right") - 1
                inside = nth[at] - starts[i]
                sequence[at] = base[i] + inside // copies[i]
                offset[at] = room[i] + inside % copies[i] * size
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in fields), pa.array(sequence), pa.array(offset)],
                names=[*fields, "sequence_id", "offset"])

    return ranked.select(*fields, "nth").mapInArrow(
        batches, schema + ", sequence_id long, offset long")


def _places(packing: list[bin_completion.Filling]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each size: first rank, first sequence, copies and offset by filling."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    base = 0
    for filling in packing:
        offset = 0
        for size, copies in filling.sizes:
            rows.setdefault(size, []).append((used.get(size, 0), base, copies, offset))
            used[size] = used.get(size, 0) + copies * filling.times
            offset += size * copies
        base += filling.times
    return {s: tuple(np.array(x, dtype=np.int64).T) for s, x in rows.items()}


def pack_documents(docs: DataFrame, tokenizer: str | None = None,
                   max_tokens: int = MAX_TOKENS, with_ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack ``docs``; see ``token_pieces`` and ``pack_pieces``.

    An empty table gives an empty result. Very long texts become many full
    pieces and one rest.
    """
    pieces = materialize(token_pieces(docs, tokenizer, max_tokens, with_ids), "pieces")
    return pack_pieces(pieces, max_tokens)
