"""Ranked search against a plain scorer, and its defined results at the edges."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from runlens.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top=10):
    """(item, text) -> [(doc_id, score)], best first; every row is a document."""
    counted = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n_docs = sum(n > 0 for _, _, n in counted)
    total = sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = {}
    for item, text in set(items):
        scored = []
        for doc, c, n in counted:
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                * (10 ** 9 * c[t] // (1000 * c[t] + 8 * (25 + 75 * n * n_docs // total)))
                for t in terms(text) if c[t])
            if score > 0:
                scored.append((-score, doc is None, doc, score))
        scored.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        if scored:
            out[item, text] = [(s[2], s[3]) for s in scored[:top]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out.setdefault(r["item_id"], []).append((r["rank"], r["doc_id"], r["score"]))
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    words = ["Ab", "é1", "x", "日本", "zz9", "Q", "w-w", "ÀB", "the", "of"]
    docs = [(i, rng.choice([" ", ", ", "\n", "."]).join(
        rng.choices(words, [1, 1, 2, 1, 1, 1, 1, 1, 20, 9], k=rng.randint(0, 40)))) for i in range(400)]
    docs += [(400 + i, "the ab é1 日本") for i in range(60)]        # ties across tasks
    docs += [(900, None), (901, ""), (902, " \t.-"), (None, "ab ab"), (1, "second text of id 1"),
             (903, "the " * 30000 + "rareword")]
    items = [(i, " ".join(rng.choices(words, k=6))) for i in range(12)]
    items += [(50, "nowhere"), (51, None), (52, ""), (53, "RAREWORD the the"), (54, "ab É1")]
    return docs, items


def test_equals_brute_force(spark, corpus):
    docs, items = corpus
    got = found(lexical.search(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(7),
        spark.createDataFrame(items, "item_id long, text string")))
    want = {i: [(n + 1, d, s) for n, (d, s) in enumerate(rows)]
            for (i, _), rows in brute(docs, items).items()}
    assert got == want
    assert {50, 51, 52}.isdisjoint(got)


def test_blocks_of_items_give_the_same(spark, corpus, monkeypatch):
    docs, items = corpus
    frames = (spark.createDataFrame(docs, "doc_id long, text string"),
              spark.createDataFrame(items, "item_id long, text string"))
    one = found(lexical.search(*frames))
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 6)
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 90)
    assert lexical._blocks(frames[1])[1] > 2
    assert found(lexical.search(*frames)) == one


def test_small_pieces_give_the_same(spark, corpus, monkeypatch):
    docs, items = corpus
    index = lexical.ItemIndex.build([i for i, _ in items], lexical.pa.array([t for _, t in items]))
    index.n_documents, index.n_terms = 400, 9000
    index.weights = 7 + lexical.np.arange(len(index.terms))
    batch = lexical.pa.RecordBatch.from_pydict({
        "doc_id": lexical.pa.array([d for d, _ in docs], lexical.pa.int64()),
        "text": lexical.pa.array([t for _, t in docs])})

    def rows():
        return sorted(next(iter(lexical.search_documents(index, 10, iter([batch])))).to_pylist(), key=repr)
    whole = rows()
    monkeypatch.setattr(lexical, "CELLS", 40)
    assert rows() == whole and whole


def test_null_ids_repeats_and_extra_columns(spark):
    docs = spark.createDataFrame(
        [(3, "k", 1, "a"), (3, "k", 1, "a"), (None, "k", 2, "b"), (2, "k", 3, None)],
        "doc_id long, text string, item_id long, score string")
    items = spark.createDataFrame(
        [(7, "k", 0), (7, "k", 1), (7, "k k", 0), (None, "K", 0)], "item_id long, text string, doc_id int")
    rows = lexical.search(docs, items).collect()
    by_item = Counter(r["item_id"] for r in rows)
    # the rows of item 7 with equal texts are one item, its other text has its own ranking
    assert by_item == {7: 8, None: 4}
    assert [r["doc_id"] for r in sorted(rows, key=lambda r: r["rank"]) if r["item_id"] is None] == [2, 3, 3, None]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    as_items = lambda df: df.withColumnRenamed("doc_id", "item_id")
    for docs, items in ((none, some), (some, none), (none, none)):
        got = lexical.search(docs, as_items(items))
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.count() == 0
