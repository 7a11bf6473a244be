"""Alias tables built from packed pairs, and walks over them."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.operators import alias_shards, indexing, ngram, word_pairs as wp
from runlens.plans import QUERIES
from test_word_pairs import corpus, counted


def prompts_of(spark, words, n=300):
    rows = [(f"{i}:0", f"x {words[i % len(words)]}") for i in range(n)]
    return spark.createDataFrame([*rows, ("none", "x unknown"), ("end", "x </s>"), ("empty", " "), ("null", None)],
                                 "id string, text string")


@pytest.mark.parametrize("most, page_cells", [(1 << 16, 1024), (5, 3), (1 << 16, 3)])
def test_draws_are_those_of_the_table_of_pairs(spark, monkeypatch, most, page_cells):
    """Through blocks, shards and pages too; from words with a hash of any kind, and past the end."""
    monkeypatch.setattr(wp, "LEAST_TOKENS", 64)
    rows = corpus(5, 150)
    texts = spark.createDataFrame(rows, "lang string, part int, text string")
    table = counted([(t,) for *_, t in rows])[()]
    assert any(len(c) > 5 for c in table.values())
    prompts = prompts_of(spark, ["the", "of", "w1", "w2", "é", "averyveryverylongword"])
    got = {r.id: list(r.path) for r in ngram.sample_continuations_of(
        texts, "text", prompts, "id", "text", 6, 0.6, 42, steps=4, most=most,
        page_cells=page_cells).collect()}
    want = {r.id: list(r.path) for r in ngram.sample_continuations(
        prompts, "id", "text", ngram.bigram_counts(texts, "text"), 6, 0.6, 42, most=most).collect()}
    assert len(got) == 300 and got == want
    assert any(p[-1] == wp.EOS and len(p) < 6 for p in got.values()) and any(len(p) == 6 for p in got.values())


def test_tables_are_those_of_the_table_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(wp, "LEAST_TOKENS", 64)
    rows = corpus(6, 200)
    texts = spark.createDataFrame(rows, "lang string, part int, text string")
    want = {(r.prev, r.cell): (r.next, r.other, r.keep) for r in ngram.alias_table(
        ngram.bigram_counts(texts, "text"), 0.6).collect()}
    made = alias_shards.alias_tables(wp.count_words(texts, "text"), 0.6, 1 << 16)
    words = {r.number: r.word for r in made.names.collect()}
    assert [words[i] for i in range(made.n_words)] == sorted(words.values(), key=str.encode)
    got = {}
    for r in made.pages.collect():
        for i, (a, b) in enumerate(zip(r.starts, r.starts[1:])):
            for c in range(b - a):
                keep, other = (r.keep[a + c], r.other[a + c]) if r.keep else (alias_shards.FULL, r.next[a + c])
                got[words[r.page * alias_shards.PAGE_WORDS + i], c] = (
                    words[r.next[a + c]], words[other], keep / alias_shards.FULL)
    assert set(got) == set(want)
    for k, (item, other, keep) in got.items():
        assert item == want[k][0] and keep == pytest.approx(want[k][2], abs=1e-8)
        assert other == want[k][1] or keep == 1  # nothing is drawn from beside a full cell


def test_cells_hold_the_weights_of_many_tables():
    draw = random.Random(3)
    sizes = [1, 2, 40, 1, 7, 300, 3]
    weights = [[draw.choice([1, 1, 1, 2, 5, 90]) ** 1.7 for _ in range(n)] for n in sizes] + [[3.0] * 9, [1e6, 1e-3]]
    begins = np.cumsum([0, *(len(w) for w in weights)])
    order, keep, other = alias_shards.alias_cells(begins[:-1], np.concatenate(weights))
    for begin, end, of in zip(begins, begins[1:], weights):
        assert sorted(order[begin:end]) == list(range(begin, end)) and keep[begin:end].min() >= 0
        mass = defaultdict(float)
        for c in range(begin, end):
            mass[order[c]] += keep[c] / alias_shards.FULL
            mass[order[begin + other[c]]] += 1 - keep[c] / alias_shards.FULL
        for i, w in enumerate(of):
            assert mass[begin + i] / len(of) == pytest.approx(w / sum(of), abs=1e-6)
    assert (keep[begins[-3]:begins[-2]] == alias_shards.FULL).all()


def test_the_query_writes_no_row_per_pair(spark, monkeypatch, tmp_path):
    """Pairs and cells travel packed, in a few rows a shard and page; a step joins without a condition."""
    texts = [(i, " ".join(f"v{i} v{j}" for j in range(60))) for i in range(60)]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 0, "user", "see v7"), (1, 0, "user", "v8"), (1, 1, "assistant", "v9")],
                          "conv_id long, turn long, role string, text string").write.parquet(
        f"{tmp_path}/conversations.parquet")
    sizes, plans = Counter(), []
    for module in (ngram, wp, alias_shards, indexing):
        def seen(df, label, write=module.materialize):
            if label == "walk":
                plans.append(df._jdf.queryExecution().executedPlan().toString())
            out = write(df, label)
            sizes[label] = max(sizes[label], out.count())
            return out
        monkeypatch.setattr(module, "materialize", seen)
    rows = {r.id: r.continuation.split() for r in QUERIES["ngram_sample"](spark, str(tmp_path)).collect()}
    assert set(rows) == {"0:0", "1:0"} and all(len(p) == 128 or p[-1] == wp.EOS for p in rows.values())
    assert max(sizes.values()) <= 61  # 60 words and the end; over 3,000 pairs
    steps = [line for p in plans[1:] for line in p.split("\n") if "HashJoin" in line]
    assert steps and all("InMemoryTableScan" in p for p in plans[1:]) and not any("isnotnull" in s for s in steps)


def test_without_any_word(spark):
    texts = spark.createDataFrame([(" ",), (None,)], "text string")
    assert ngram.sample_continuations_of(
        texts, "text", prompts_of(spark, ["a"]), "id", "text", 3, 1.0, 42).collect() == []


def test_draws_from_one_word_are_spread(spark, monkeypatch):
    """Very many successors and prompts, over blocks whose tables are wide: a page has few of the cells."""
    sizes, moved = [], ngram._moved

    def seen(state, made, laid, *rest):
        sizes.append(laid.agg(F.max(F.size("next"))).first()[0])
        return moved(state, made, laid, *rest)
    monkeypatch.setattr(ngram, "_moved", seen)
    texts = spark.range(3_000).select(F.concat(F.lit("hub s"), "id", F.lit(" hub")).alias("text"))
    prompts = spark.range(20_000).select(F.col("id").alias("k"), F.lit("hub").alias("text"))
    got = ngram.sample_continuations_of(texts, "text", prompts, "k", "text", 2, 1.0, 7, most=1_000,
                                        page_cells=64).collect()
    first = Counter(r.path[0] for r in got)
    assert len(got) == 20_000 and first[wp.EOS] / 20_000 == pytest.approx(0.5, abs=0.02)
    assert sizes and max(sizes) <= 64
    assert len(first) > 2_500 and all(len(r.path) == 1 or r.path[1] == "hub" for r in got)
