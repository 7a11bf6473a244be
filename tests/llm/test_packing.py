"""Token pieces against the tokenizer, packings against their rules."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from runlens.llm import bin_completion, hashing, packing

TEXTS = [None, "", "Hello, World! it's we'll 'SI'M", "  a  b\n\n", "W̊x ẘx É é",
         "<|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>", "ΣΑΣ ÉTÉ İ",
         "a b　c \x0b d", "\n", "x" * 9000, "word " * 5000, "1,234.5% A-b_c (d) €5",
         "你好 world\U0001f600!! ok"]


@pytest.fixture(scope="module")
def path():
    return public_tokenizers.path(packing.TOKENIZER)


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def test_remembered_chunks_give_the_ids_of_whole_texts(path):
    tokenizer, encoder = Tokenizer.from_file(path), packing.ChunkTokenizer(path)
    for _ in range(2):  # the second time from memory
        for first, last, text, rows in hashing.slabs(pa.array(TEXTS, pa.string())):
            ids, at = encoder.encode(text, rows)
            for i in range(first, last):
                assert [*ids[at[i - first]:at[i - first + 1]].tolist(), 0] \
                    == ids_of(tokenizer, TEXTS[i])


@pytest.mark.parametrize("most", [16, 2048])
def test_pieces_and_places(spark, path, most):
    rows = [*((i, t, i) for i, t in enumerate(TEXTS)), (2, TEXTS[2], 0), (None, "a null id", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece int").repartition(3)
    got = packing.pack_documents(docs, max_tokens=most, with_ids=True).collect()
    tokenizer = Tokenizer.from_file(path)
    want = []
    for i, t, _ in rows:
        ids = ids_of(tokenizer, t)
        for n, low in enumerate(range(0, len(ids), most)):
            part = ids[low:low + most]
            want.append((i, n, low, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), part))
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted(want, key=repr)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= most
    total = sum(r["length"] for r in got)
    assert -(-total // most) <= len(bins) <= 1.3 * -(-total // most) + 1


def test_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(docs).collect() == []


def exact(items, capacity):
    """Fewest bins, by trying every place for every item."""
    items = sorted(items, reverse=True)
    best = len(items)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + items[i] <= capacity and bins[j] not in bins[:j]:
                bins[j] += items[i]
                place(i + 1, bins)
                bins[j] -= items[i]
        place(i + 1, [*bins, items[i]])
    place(0, [])
    return best


def contents(packing_, capacity):
    out = {}
    for f in packing_:
        assert sum(s * c for s, c in f.sizes) <= capacity
        for s, c in f.sizes:
            out[s] = out.get(s, 0) + c * f.times
    return out


def histogram(items):
    return {s: items.count(s) for s in set(items)}


def test_bin_completion_is_exact_on_small_cases():
    rng = random.Random(11)
    for _ in range(60):
        capacity = rng.choice([10, 20, 30])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        found = bin_completion.pack(histogram(items), capacity)
        assert contents(found, capacity) == histogram(items)
        assert sum(f.times for f in found) == exact(items, capacity)


def test_bin_completion_beats_best_fit_where_it_can():
    rng = random.Random(4)
    items = [rng.randint(400, 800) for _ in range(600)]
    found = bin_completion.pack(histogram(items), 2048)
    greedy = bin_completion.best_fit(histogram(items), 2048)
    assert contents(found, 2048) == contents(greedy, 2048) == histogram(items)
    bound = bin_completion.lower_bound(histogram(items), 2048)
    assert bound <= sum(f.times for f in found) < sum(f.times for f in greedy)


def test_counts_in_the_billions_take_no_longer():
    sizes = {s: 10 ** 9 + s for s in range(1, 2049, 7)}
    found = bin_completion.pack(sizes, 2048)
    assert contents(found, 2048) == sizes
    assert sum(f.times for f in found) >= bin_completion.lower_bound(sizes, 2048)


def test_many_empty_documents_fill_whole_sequences():
    found = bin_completion.pack({1: 5000, 2000: 3}, 2048)
    assert contents(found, 2048) == {1: 5000, 2000: 3}
    with pytest.raises(ValueError):
        bin_completion.pack({11: 1}, 10)
    assert bin_completion.pack({}, 10) == []
