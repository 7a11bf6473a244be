"""Log-probabilities of texts under an n-gram model, by a weighted backoff automaton.

The model is all n-grams of the training documents. It grows with the corpus,
so no task holds it whole. Documents are gathered into chunks of bounded size.
Each chunk names the n-grams that it holds, with their counts in its training
documents; the n-grams are dealt by hash to shards, which add the counts of all
chunks and answer each chunk in its own order. With the answers a chunk builds
the part of the automaton that its documents can reach:

* states are the contexts seen in training, the empty one (the root) included;
* an arc leads from a context by a word seen after it to the longest context
  that ends there, and weighs the word's smoothed log-probability;
* a failure arc leads from a context to the one without its first word, and
  weighs what smoothing leaves for words not seen there. The root has an arc
  for every word, also for unknown ones.

Texts then run through it from left to right, many side by side: each carries
its state, and its log-probability adds up on the way.

Smoothing: P(w|h) = (c(hw) + m P(w|h')) / (c(h) + m), h' being h without its first
word; at the root (c(w) + 1) / (N + V + 1).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from runlens.llm import hashing as H
from runlens.session import materialize

#: words of a context plus one, and the weight m of the shorter context
ORDER, STRENGTH = 2, 4.0
#: bytes of text of a chunk; a longer text is a chunk of its own
CHUNK_BYTES = 12 << 20
#: n-grams named to one shard, all chunks together
SHARD_GRAMS = 1 << 20
#: words after which a long text continues as another runner (see ``score_tokens``)
STRIDE = 512

_U = np.uint64
#: stands for the end of a text; no word hashes to it but by chance
END = _U(0x5B1F9D2E6A47C083)

_CHUNK = ("chunk long, ids array<long>, held array<boolean>, lengths array<long>, "
          "words binary, tokens binary, train_tokens long, n_tokens long")
_REQUEST = "shard int, chunk long, grams array<binary>, counts array<binary>"
_ANSWER = "shard int, chunk long, totals array<binary>, n_words long"
_SCORE = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
          "base_score double, score double")


def pack(values: np.ndarray) -> bytes:
    """Whole numbers as compressed byte planes, so that leading zeros cost nothing."""
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(values).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = pa.decompress(data[8:], 8 * n, codec="zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, n).T) \
        .reshape(-1).view("<u8").astype(np.uint64)


def _deltas(sorted_values: np.ndarray) -> np.ndarray:
    return np.diff(sorted_values, prepend=_U(0))


def chunk_documents(batches: Iterator[pa.RecordBatch],
                    limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Chunks of whole documents: word hashes once each, and every text as their ranks."""
    part = TaskContext.get().partitionId() << 32
    ids, held, hashes, lengths, size = [], [], [], [], 0

    def flush():
        nonlocal part, size
        found, local, count = np.unique(np.concatenate(hashes), return_inverse=True,
                                        return_counts=True)
        # frequent words get small numbers, which pack well
        rank = np.empty(len(found), dtype=np.int64)
        rank[np.argsort(-count, kind="stable")] = np.arange(len(found))
        of_word = np.empty(len(found), dtype=np.uint64)
        of_word[rank] = found
        n = np.concatenate(lengths)
        trained = ~np.array(held, dtype=bool)
        row = pa.RecordBatch.from_pydict({
            "chunk": pa.array([part], pa.int64()),
            "ids": pa.array([ids], pa.list_(pa.int64())),
            "held": pa.array([held], pa.list_(pa.bool_())),
            "lengths": pa.array([n], pa.list_(pa.int64())),
            "words": pa.array([pack(of_word)], pa.binary()),
            "tokens": pa.array([pack(rank[local])], pa.binary()),
            "train_tokens": pa.array([int((n[trained] + 1).sum())], pa.int64()),
            "n_tokens": pa.array([int((n + 1).sum())], pa.int64())})
        part, size = part + 1, 0
        for part_list in (ids, held, hashes, lengths):
            part_list.clear()
        return row

    for batch in batches:
        keys, flags = batch.column("doc_id").to_pylist(), batch.column("held").to_pylist()
        for first, last, text, rows in H.slabs(batch.column("text"), H.SLAB_BYTES):
            if size and size + len(text) > limit:
                yield flush()
            found, _, _, begin = H.words(text, rows)
            ids += keys[first:last]
            held += flags[first:last]
            hashes.append(found)
            lengths.append(np.diff(begin))
            # a document costs as much as a few words, so that empty texts add up, too
            size += len(text) + 32 * (last - first)
            if size > limit:
                yield flush()
    if ids:
        yield flush()


class Grams:
    """The distinct n-grams of a chunk, order by order, and where each token's stand.

    Order k has: ``key`` (sorted; place of the first k-1 words in order k-1, times
    the number of words, plus the last word), ``prefix`` and ``suffix`` (place of
    the first and last k-1 words in order k-1), ``hash``, and ``trained``, its
    occurrences in the chunk's training documents. ``tokens`` has the words of all
    texts, each text followed by the end.
    """

    def __init__(self, words: np.ndarray, tokens: np.ndarray, lengths: np.ndarray,
                 held: np.ndarray, order: int):
        self.words = np.append(words, END)
        self.n_words = n_words = len(self.words)
        self.ends = np.cumsum(lengths + 1)
        self.starts = self.ends - lengths - 1
        self.tokens = np.full(int(self.ends[-1]), n_words - 1, dtype=np.int64)
        inner = np.ones(len(self.tokens), dtype=bool)
        inner[self.ends - 1] = False
        self.tokens[inner] = tokens
        learned = np.repeat(~held, lengths + 1)
        # words of the text before each token
        depth = np.arange(len(self.tokens)) - np.repeat(self.starts, lengths + 1)
        self.orders: list[dict[str, np.ndarray]] = []
        place = np.zeros(len(self.tokens), dtype=np.int64)
        for k in range(1, order + 1):
            at = np.flatnonzero(depth >= k - 1)
            before = place[at - 1] if k > 1 else np.zeros(len(at), dtype=np.int64)
            key, first, local = np.unique(before * n_words + self.tokens[at],
                                          return_index=True, return_inverse=True)
            prefix, last = key // n_words, key % n_words
            hashes = self.words[last] if k == 1 else H.mix(
                self.orders[-1]["hash"][prefix] * _U(0x9E3779B97F4A7C15) + self.words[last])
            self.orders.append({
                "key": key, "prefix": prefix, "last": last, "hash": hashes,
                # ``place`` still holds order k-1, where this n-gram's last words end
                "suffix": place[at[first]] if k > 1 else np.zeros(len(key), dtype=np.int64),
                "trained": np.bincount(local, weights=learned[at], minlength=len(key))
                .astype(np.int64)})
            place = np.full(len(self.tokens), -1, dtype=np.int64)
            place[at] = local

    def slices(self, shards: int):
        """For each order, n-grams by hash and where each shard's range of hashes begins."""
        bounds = shard_bounds(shards)
        for grams in self.orders:
            by_hash = np.argsort(grams["hash"], kind="stable")
            yield by_hash, np.append(np.searchsorted(grams["hash"][by_hash], bounds), len(by_hash))


def shard_bounds(shards: int) -> np.ndarray:
    """First hash of each shard; shards have equal ranges."""
    return np.array([(i << 64) // shards for i in range(shards)], dtype=np.uint64)


def _load(row: dict, order: int) -> Grams:
    return Grams(unpack(row["words"]), unpack(row["tokens"]).astype(np.int64),
                 np.array(row["lengths"], dtype=np.int64), np.array(row["held"], dtype=bool), order)


def name_grams(order: int, shards: int,
               batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each chunk asks of each shard: n-gram hashes in order, and their counts."""
    for batch in batches:
        for i in range(len(batch)):
            row = batch.slice(i, 1).to_pylist()[0]
            grams = _load(row, order)
            sliced = list(grams.slices(shards))
            for shard in range(shards):
                hashes, counts = [], []
                for of, (by_hash, cut) in zip(grams.orders, sliced):
                    mine = by_hash[cut[shard]:cut[shard + 1]]
                    hashes.append(pack(_deltas(of["hash"][mine])))
                    counts.append(pack(of["trained"][mine]))
                yield pa.RecordBatch.from_pydict({
                    "shard": pa.array([shard], pa.int32()),
                    "chunk": pa.array([row["chunk"]], pa.int64()),
                    "grams": pa.array([hashes], pa.list_(pa.binary())),
                    "counts": pa.array([counts], pa.list_(pa.binary()))})


def add_counts(table: pa.Table) -> pa.Table:
    """One shard: the counts of every n-gram over all chunks, handed back to each chunk.

    ``n_words`` is the number of words (order 1) seen in training, on one row.
    """
    asked = table.to_pydict()
    rows, n_words = len(asked["chunk"]), 0
    totals: list[list[bytes]] = [[] for _ in range(rows)]
    for k in range(len(asked["grams"][0])):
        lists = [np.cumsum(unpack(g[k]), dtype=np.uint64) for g in asked["grams"]]
        _, local = np.unique(np.concatenate(lists), return_inverse=True)
        counts = np.concatenate([unpack(c[k]) for c in asked["counts"]]).astype(np.int64)
        total = np.zeros(int(local.max()) + 1 if len(local) else 0, dtype=np.int64)
        np.add.at(total, local, counts)
        if k == 0:
            n_words = int(np.count_nonzero(total))
        at = 0
        for row, one in zip(totals, lists):
            row.append(pack(total[local[at:at + len(one)]]))
            at += len(one)
    return pa.table({
        "shard": pa.array(asked["shard"], pa.int32()), "chunk": pa.array(asked["chunk"], pa.int64()),
        "totals": pa.array(totals, pa.list_(pa.binary())),
        "n_words": pa.array([n_words] + [0] * (rows - 1), pa.int64())})


class Automaton:
    """The part of the backoff automaton that the texts of a chunk can reach.

    A state is (k, place): a context of k words by its place among the chunk's
    n-grams of order k; k = 0 is the root. ``arcs[k]`` holds the arcs that leave
    states of k words: ``at`` (sorted; state, then word), ``weight``, and the order and
    place of the state they lead to. ``failure[k]`` holds the weight of each state's
    failure arc, ``shorter[k]`` the place of the state it leads to.
    """

    def __init__(self, grams: Grams, totals: list[np.ndarray], n_tokens: int, n_words: int,
                 strength: float):
        self.n_words = grams.n_words
        order = len(grams.orders)
        self.arcs, self.failure, self.shorter = [], [None], [None]
        lower, context = None, None
        for k, (of, count) in enumerate(zip(grams.orders, totals)):
            if k == 0:
                p = (count + 1.0) / (n_tokens + n_words + 1)
                seen = np.ones(len(count), dtype=bool)
            else:
                p = (count + strength * lower[of["suffix"]]) / (context[of["prefix"]] + strength)
                seen = count > 0
            at = np.flatnonzero(seen)
            # an arc leads to its whole n-gram if that is short enough and was seen as a
            # context, else to what follows the n-gram's first word
            if k + 1 < order:
                to_order = np.where(count[at] > 0, k + 1, 0)
                to = np.where(count[at] > 0, at, 0)
            else:
                to_order = np.full(len(at), k)
                to = of["suffix"][at]
            self.arcs.append({"at": of["key"][at], "weight": np.log10(p[at]),
                              "order": to_order, "to": to})
            self.failure.append(np.log10(strength / (count + strength)))
            self.shorter.append(of["suffix"])
            lower, context = p, count

    def step(self, state_order: np.ndarray, state: np.ndarray, word: np.ndarray,
             score: np.ndarray) -> None:
        """Every runner reads one word: along its arc, or down failure arcs until one fits."""
        for k in range(len(self.arcs) - 1, -1, -1):
            there = np.flatnonzero(state_order == k)
            if not len(there):
                continue
            arcs = self.arcs[k]
            wanted = state[there] * self.n_words + word[there]
            at = np.minimum(np.searchsorted(arcs["at"], wanted), max(len(arcs["at"]) - 1, 0))
            found = arcs["at"][at] == wanted if len(arcs["at"]) else np.zeros(len(there), bool)
            on, at = there[found], at[found]
            score[on] += arcs["weight"][at]
            # marked, so that a state reached just now is not left again in this step
            state_order[on] = arcs["order"][at] + _DONE
            state[on] = arcs["to"][at]
            off = there[~found]
            if k:
                score[off] += self.failure[k][state[off]]
                state_order[off] = k - 1
                state[off] = self.shorter[k][state[off]] if k > 1 else 0
        state_order -= _DONE


#: added to the order of a state while its runner has read the present word
_DONE = 1 << 8


def score_tokens(grams: Grams, automaton: Automaton) -> np.ndarray:
    """Log-probability of every text. All texts run side by side, word by word.

    A state depends on the last ORDER - 1 words only, so a long text is run by
    several runners: each starts that many words before its own stretch, at the
    root, and counts from its stretch on. The sum is that of a single run.
    """
    order = len(grams.orders)
    lengths = grams.ends - grams.starts
    runs = -(-lengths // STRIDE)
    text = np.repeat(np.arange(len(lengths)), runs)
    begin = np.repeat(grams.starts, runs) + H.ramp(runs) * STRIDE
    end = np.minimum(begin + STRIDE, grams.ends[text])
    lead = np.minimum(order - 1, begin - grams.starts[text])
    length = end - begin + lead
    by_length = np.argsort(-length, kind="stable")
    text, begin, lead, length = text[by_length], (begin - lead)[by_length], lead[by_length], length[by_length]
    state_order, state = np.zeros(len(text), dtype=np.int64), np.zeros(len(text), dtype=np.int64)
    score = np.zeros(len(text))
    for t in range(int(length[0]) if len(length) else 0):
        running = int(np.searchsorted(-length, -t, side="left"))
        automaton.step(state_order[:running], state[:running],
                       grams.tokens[begin[:running] + t], score[:running])
        if t < order:
            score[:running][lead[:running] == t + 1] = 0.0
    return np.bincount(text, weights=score, minlength=len(lengths))


def score_chunk(order: int, shards: int, strength: float, n_tokens: int, n_words: int,
                chunk: pa.Table, answers: pa.Table) -> pa.Table:
    """Scores of the documents of one chunk from its shards' answers."""
    row = chunk.to_pylist()[0]
    grams = _load(row, order)
    by_shard = sorted(zip(answers["shard"].to_pylist(), answers["totals"].to_pylist()))
    if [s for s, _ in by_shard] != list(range(shards)):
        raise RuntimeError("a chunk lacks the answers of some shards")
    totals = []
    for k, (by_hash, _) in enumerate(grams.slices(shards)):
        total = np.empty(len(by_hash), dtype=np.int64)
        total[by_hash] = np.concatenate([unpack(t[k]) for _, t in by_shard]).astype(np.int64)
        totals.append(total)
    score = score_tokens(grams, Automaton(grams, totals, n_tokens, n_words, strength))
    # order 1 is sorted by word, and every word of the chunk stands in it
    count = np.zeros(grams.n_words, dtype=np.int64)
    count[grams.orders[0]["last"]] = totals[0]
    base = np.log10((count + 1.0) / (n_tokens + n_words + 1))
    return pa.table({
        "doc_id": pa.array(row["ids"], pa.int64()), "held_out": pa.array(row["held"], pa.bool_()),
        "n_tokens": pa.array(grams.ends - grams.starts, pa.int64()),
        "n_known": pa.array(np.add.reduceat((count > 0)[grams.tokens].astype(np.int64), grams.starts)),
        "train_tokens": pa.array(np.full(len(score), n_tokens), pa.int64()),
        "base_score": pa.array(np.add.reduceat(base[grams.tokens], grams.starts)),
        "score": pa.array(score)})


def score_documents(docs: DataFrame, held_out, order: int = ORDER, strength: float = STRENGTH,
                    chunk_bytes: int = CHUNK_BYTES, shard_grams: int = SHARD_GRAMS) -> DataFrame:
    """Log10-probability of every whole text under the n-grams of the training texts.

    ``docs`` needs doc_id and text; other columns are ignored. ``held_out`` is a
    boolean column over ``docs``: rows where it is true are scored only, the others
    (null included) are learned from as well. Tokens are the words of a text, with
    A-Z lower-cased, and one end. ``order`` is the number of words of the longest
    n-grams (2: a word after a word).

    Returns one row per row of ``docs``: doc_id, held_out, n_tokens, n_known (tokens
    seen in training), train_tokens (of all training documents), base_score (log10
    of (c+1)/(N+V+1) summed over the tokens) and score (the automaton's). A null
    or empty text has the end as its only token. Repeated rows and rows with a
    null doc_id count and are scored like any other. An empty table gives an
    empty result; without training documents every word weighs the same.

    Words and n-grams are told apart by 64-bit hashes: of 10^9 different n-grams
    two share a count with a probability of 0.03. Nothing is pruned. A
    chunk is one text at least; its size does not depend on the corpus, and the
    number of shards grows with it. An n-gram that is frequent everywhere reaches
    its shard once per chunk.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(held_out, F.lit(False)).alias("held"), "text")
    chunks = materialize(rows.mapInArrow(
        lambda batches: chunk_documents(batches, chunk_bytes), _CHUNK), "chunks")
    sizes = chunks.agg(F.sum("train_tokens").alias("n"), F.sum("n_tokens").alias("all")).first()
    n_tokens = sizes["n"] or 0
    shards = max(1, -(-(sizes["all"] or 0) * order // shard_grams))
    asked = chunks.mapInArrow(lambda batches: name_grams(order, shards, batches), _REQUEST)
    answers = materialize(asked.groupBy("shard").applyInArrow(add_counts, _ANSWER), "gram-counts")
    n_words = answers.agg(F.sum("n_words")).first()[0] or 0
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        lambda chunk, answer: score_chunk(order, shards, strength, n_tokens, n_words, chunk, answer),
        _SCORE)
