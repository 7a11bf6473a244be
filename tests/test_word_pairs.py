"""Pairs of words counted as packed numbers."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from runlens.operators import ngram, word_pairs as wp

ODD = ["\x0b a\x1cb  a c\t</s> a\r\n", " ", "", None, "</s>", "averyveryverylongword a averyveryverylongwore",
       "é ab abcdefgh abcdefghi é", " x \x85 x"]


def corpus(seed=1, texts=60):
    draw = random.Random(seed)
    words = ["the", "of", *(f"w{i}" for i in range(40))]
    rows = [(draw.choice(["x", "y", None]), draw.choice([1, None]), " ".join(
        draw.choices(words, [60, 30, *[1] * 40], k=draw.randrange(40)))) for _ in range(texts)]
    return rows + [("x", 1, t) for t in ODD] + [(None, 1, "the of"), ("x", None, "of the")]


def counted(rows):
    out = defaultdict(lambda: defaultdict(Counter))
    for *key, text in rows:
        w = re.findall(r"\S+", text or "", re.ASCII)
        for a, b in zip(w, [*w[1:], wp.EOS]):
            out[tuple(key)][a][b] += 1
    return out


def overlap(rows):
    want = {}
    for key, table in counted(rows).items():
        unigram = sum(table.values(), Counter())
        total = sum(unigram.values())
        for context, c in table.items():
            n = sum(c.values())
            want[*key, context] = (n, sum(min(c[t] / n, unigram[t] / total) for t in c))
    return want


def same(got, want):
    assert set(got) == set(want)
    for k, (n, alpha) in got.items():
        assert n == want[k][0] and alpha == pytest.approx(want[k][1], abs=1e-12)


def test_overlap_of_odd_texts_and_null_keys(spark):
    rows = corpus()
    texts = spark.createDataFrame(rows, "lang string, part int, text string")
    got = ngram.corpus_overlap(texts, "text", ["lang", "part"])
    assert got.columns == ["lang", "part", "context", "n", "alpha"]
    same({(r.lang, r.part, r.context): (r.n, r.alpha) for r in got.collect()}, overlap(rows))


def test_frequent_words_are_dealt_to_many_shards(spark):
    rows = corpus(2)
    texts = spark.createDataFrame(rows, "lang string, part int, text string")
    words = wp.count_words(texts, "text", ["lang"], chunk_bytes=300, shard_tokens=20)
    frequent = {r.id for r in words.table.where("word in ('the', 'of')").collect()}
    for by, split in (("prev", words.first), ("next", words.second)):
        assert frequent & {int(i) for ids, _ in split.values() for i in ids}
        shards = defaultdict(set)
        for r in wp._pairs(words, by, 300).collect():
            for i in np.frombuffer(r[by], np.int64):
                shards[int(i), r.kid].add(r.shard)
        split_ids = {(int(i), kid) for kid, (ids, _) in split.items() for i in ids}
        assert max(len(s) for k, s in shards.items() if k in split_ids) > 3
        assert all(len(s) == 1 for k, s in shards.items() if k not in split_ids)
    totals = words.table.groupBy("kid").agg(F.sum("m").alias("total"))
    named = wp.overlaps(words, totals, 300).join(words.table.select("kid", "id", "word"), ["kid", "id"]).join(
        words.keys, "kid").collect()
    same({(r.lang, r.word): (r.n, r.alpha) for r in named}, overlap([(g, t) for g, _, t in rows]))


def test_no_row_per_pair_is_written_or_moved(spark, monkeypatch):
    """Intermediates have a row a word or shard: pairs travel packed."""
    rows = [("x", " ".join(f"v{i} v{j}" for j in range(30))) for i in range(30)]
    texts = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    sizes = []
    for module in (ngram, wp):
        def seen(df, label, write=module.materialize):
            out = write(df, label)
            sizes.append(out.count())
            return out
        monkeypatch.setattr(module, "materialize", seen)
    assert ngram.corpus_overlap(texts, "text", ["lang"]).count() == 30
    assert sizes and max(sizes) <= 31  # 30 words and the end; over 800 pairs
    assert wp._pairs(wp.count_words(texts, "text", ["lang"]), "next", wp.CHUNK_BYTES).count() == 1


def test_two_words_under_one_number_are_told():
    def row(ids, words, n):
        return {"kid": 5, "shard": 0, "ids": np.array(ids).tobytes(), "words": words,
                "n": np.array(n).tobytes(), "m": np.array(n).tobytes()}
    got = wp._add_words(pa.Table.from_pylist([row([7, 8], "a b", [1, 2]), row([8, 9], "b c", [3, 4])])).to_pylist()
    assert [(r["id"], r["word"], r["n"], r["clash"]) for r in got] == [
        (7, "a", 1, False), (8, "b", 5, False), (9, "c", 4, False)]
    got = wp._add_words(pa.Table.from_pylist([row([7, 8], "a b", [1, 2]), row([8, 9], "x c", [3, 4])])).to_pylist()
    assert [(r["id"], r["clash"]) for r in got] == [(7, False), (8, True), (9, False)]


def test_numbers_differ_and_do_not_depend_on_place():
    words = pa.array(["", "a", "a\0", "b", "abcdefgh", "abcdefgh\0", "abcdefghi", "x" * 100, "x" * 99 + "y", "é"])
    ids = wp.word_ids(words, 0)
    assert len(set(ids)) == len(words) and set(ids).isdisjoint(wp.word_ids(words, 1))
    assert list(wp.word_ids(words.slice(3, 5), 0)) == list(ids[3:8])
    assert list(wp.word_ids(words.take(pa.array([7, 1])), 0)) == [ids[7], ids[1]]


@pytest.mark.parametrize("cap", [1, 5, 8])
def test_greedy_paths_of_texts_equal_a_plain_walk(spark, cap, monkeypatch):
    rows = corpus(3)
    texts = spark.createDataFrame(rows, "lang string, part int, text string")
    monkeypatch.setattr(wp, "LEAST_TOKENS", 64)  # several shards, with frequent words in many
    table = counted([(t,) for *_, t in rows])[()]
    best = {a: min(c, key=lambda b: (-c[b], b.encode())) for a, c in table.items()}
    want = {}
    for start in ["the", "w1", "w2", "w3", "w4", "é", "averyveryverylongword", "</s>"]:
        path = [best[start]]
        while len(path) < cap and path[-1] != wp.EOS:
            path.append(best[path[-1]])
        want[start] = path
    starts = spark.createDataFrame([(t,) for t in [*want, "the", "unknown"]], "token string")
    got = ngram.greedy_paths_of(texts, "text", cap, starts).collect()
    assert len(got) == len(want) and {r.token: list(r.path) for r in got} == want
    plain = ngram.greedy_paths(ngram.bigram_counts(texts, "text"), cap, starts).collect()
    assert {r.token: list(r.path) for r in plain} == want


def test_continuation_writes_no_row_per_pair(spark, monkeypatch):
    """Pairs travel packed, and jumps are doubled over the words that a word leads to alone."""
    rows = [(" ".join(f"v{i} v{j}" for j in range(1, 30)),) for i in range(1, 30)]
    rows += [(f"u{i} v1",) for i in range(50)]
    texts = spark.createDataFrame(rows, "text string").coalesce(1)
    sizes = []

    def seen(df, label, write=ngram.materialize):
        out = write(df, label)
        sizes.append((label, out.count()))
        return out
    monkeypatch.setattr(ngram, "materialize", seen)
    counts = wp.count_words(texts, "text")
    starts = spark.createDataFrame([("u7",)], "token string")
    assert ngram.greedy_paths_of(texts, "text", 8, starts).count() == 1
    jumps = [n for label, n in sizes if label == "jumps"]
    assert jumps[0] == 79 and max(jumps[1:]) <= 29
    assert wp._pairs(counts, "prev", wp.CHUNK_BYTES).count() == 1
