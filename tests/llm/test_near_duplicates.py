"""SuperMinHash near duplicates, components and hashing, by brute force."""

from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from runlens.llm import components, hashing, minhash


def word_list(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def shingle_set(text, size=5):
    words = word_list(text)
    if not words:
        return frozenset()
    if len(words) < size:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i:i + size]) for i in range(len(words) - size + 1))


def brute(rows, numerator, denominator):
    """doc_id -> (set size, smallest reachable id), from all pairs."""
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and denominator * len(x & y) >= numerator * len(x | y):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, n = [], 0
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.choice([3, 6, 40, 200]))
        for _ in range(rng.choice([1, 2, 5])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((n, " ".join(copy)))
            n += 1
    rows += [(900, None), (901, ""), (902, " \n\t "), (903, "Hello"), (904, "hello"),
             (905, "a b c d e"), (906, "A  b\nc d e"), (907, "été " * 4000)]
    return rows


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


@pytest.mark.parametrize("share", [80, 85])
def test_groups_equal_all_pairs(spark, corpus, share):
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    got = result(minhash.near_duplicates(docs, 5, share, 100))
    want = brute(corpus, share, 100)
    assert got == {i: (n, c, i == c) for i, (n, c) in want.items()}


def test_a_large_group_is_compared_in_blocks(spark, corpus, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 3)
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    want = brute(corpus, 85, 100)
    assert {i: v[1] for i, v in result(minhash.near_duplicates(docs, 5, 85, 100)).items()} \
        == {i: c for i, (_, c) in want.items()}


def test_null_ids_repeats_and_clashing_columns(spark):
    rows = [(1, "a b c d e f", 1, True), (1, "a b c d e f", 2, False), (None, "a b c d e f", 3, None),
            (2, "a b c d e f", 4, None), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int, kept boolean")
    got = sorted((tuple(r) for r in minhash.near_duplicates(docs).collect()), key=repr)
    assert got == sorted([(1, 2, 1, True), (2, 2, 1, False), (None, 2, None, True),
                          (None, 0, None, True)], key=repr)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(docs).collect() == []


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    b = np.concatenate([a[:240], rng.integers(0, 1 << 62, 60).astype(np.uint64)])
    x, y, z = minhash.superminhash([a, b, a[:1]], 1000)
    assert abs((x == y).mean() - 240 / 360) < 0.06
    assert sorted(np.floor(z).tolist()) == list(range(1000))
    assert np.isinf(minhash.superminhash([a[:0]], 8)).all()


def test_signature_is_the_same_in_any_company():
    rng = np.random.default_rng(2)
    sets = [rng.integers(0, 1 << 62, n).astype(np.uint64) for n in (1, 4, 30, 900)]
    together = minhash.superminhash(sets, 64)
    assert all((minhash.superminhash([s], 64)[0] == row).all() for s, row in zip(sets, together))


def test_words_and_shingles_follow_the_pattern():
    texts = ["", None, "A b\tc", "x", "a b c d e f", "a b c d e a b c d e", "É é Z"]
    sets = list(hashing.shingle_sets(pa.array(texts), 5))
    assert [len(s) for s in sets] == [len(shingle_set(t)) for t in texts]
    same = list(hashing.shingle_sets(pa.array(["Ab cD", "aB Cd", "ab cd "]), 5))
    assert all((s == same[0]).all() for s in same)


def test_a_slab_bound_changes_nothing(monkeypatch):
    texts = pa.array([f"word{i} and more words {i * 7} here" for i in range(50)])
    whole = list(hashing.shingle_sets(texts, 5))
    monkeypatch.setattr(hashing.slabs, "__defaults__", (40,))
    assert all((a == b).all() for a, b in zip(whole, hashing.shingle_sets(texts, 5)))


def test_components_of_a_path_a_star_and_noise(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(1000, i) for i in range(1001, 1100)]
    edges = path + star + [(5, 4), (7, 7), (None, 3), (2000, 1999)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(df).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 1000 for i in range(1000, 1100)},
                   1999: 1999, 2000: 1999}
    assert components.components(df.where("false")).collect() == []
