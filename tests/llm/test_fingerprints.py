"""Order MinHash against a plain reading of its definition's results."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from runlens.llm import fingerprints

WORDS = [f"{a}{b}" for a in "abcdefgh" for b in ("ro", "ti", "sen", "mul", "dra", "kop")]


def run(spark, rows, schema="doc_id long, text string", **options):
    df = spark.createDataFrame(rows, schema)
    return sorted(fingerprints.fingerprints(df, **options).collect(),
                  key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))


def text_of(seed, n):
    return " ".join(WORDS[(seed * 31 + i * i * 7 + i * seed) % len(WORDS)] for i in range(n))


def test_edited_texts_and_next_documents(spark):
    rows = [(i * 3, text_of(i, 5 + 9 * i) + " é\U0001f600" * (i % 3)) for i in range(40)]
    rows += [(1000, None), (1001, ""), (1002, "x"), (1003, "ab\ncd")]
    order = [t or "" for _, t in sorted(rows, reverse=True)]
    ids = sorted((i for i, _ in rows), reverse=True)
    for bins in (1, 7):
        got = {r["doc_id"]: r for r in run(spark, rows, bins=bins)}
        assert len(got) == len(rows)
        for n, (i, text) in enumerate(zip(ids, order)):
            cut = len(text) // 3
            edited = text[:len(text) - cut] + order[(n + 1) % len(order)][:cut]
            assert got[i]["n_chars"] == len(text)
            assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            if edited == text:
                assert got[i]["near_edited"] == 1.0
                assert got[i]["fingerprint"] == got[i]["edited_fingerprint"]


def test_equal_texts_have_equal_fingerprints_and_order_counts(spark):
    words = [f"word{i:03d}" for i in range(600)]
    swapped = words[300:] + words[:300]
    scattered = [words[i * 7 % 600] for i in range(600)]
    changed = words[:300] + ["other"] + words[301:]
    rows = [(i, " ".join(w)) for i, w in enumerate([words, words, swapped, scattered, changed])]
    df = spark.createDataFrame(rows, "doc_id long, text string") \
        .withColumn("s", fingerprints.signature("text"))
    s = {r["doc_id"]: r["s"] for r in df.collect()}
    near = {}
    for a, b in ((0, 1), (0, 2), (0, 3), (0, 4)):
        near[b] = len(set(s[a]) & set(s[b])) / len(set(x >> 24 for x in s[a] + s[b]))
    assert near[1] == 1.0
    # one changed word costs little, moved halves more, a shuffle everything
    assert near[4] > 0.9 > near[2] > 0.3 and near[3] < 0.05


def test_repeated_kmers_are_numbered(spark):
    rows = [(0, "same " * 50), (1, "same " * 100), (2, "same " * 100)]
    df = spark.createDataFrame(rows, "doc_id long, text string") \
        .withColumn("s", fingerprints.signature("text"))
    s = {r["doc_id"]: r["s"] for r in df.collect()}
    # a set of k-mers could not tell these apart, and would fill one bin
    assert len(s[0]) > 10 and s[0] != s[1] and s[1] == s[2]


def likenesses(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string") \
        .withColumn("x", fingerprints.signature("a")).withColumn("y", fingerprints.signature("b"))
    return [r["l"] for r in df.select(fingerprints.likeness(F.col("x"), F.col("y")).alias("l")).collect()]


def test_cuts_do_not_shift(spark):
    rng = random.Random(8)
    latin = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=4000))
    cjk = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(4000))
    emoji = "".join(chr(rng.randrange(0x1F300, 0x1F5FF)) for _ in range(2000))
    near = likenesses(spark, [
        (latin, "x" + latin), (cjk, "\u4e2d" + cjk), (emoji, "x" + emoji), (latin, latin[1:]), (cjk, latin)])
    assert all(n > 0.9 for n in near[:4]) and near[4] == 0.0


def test_lengths_around_the_former_switch(spark):
    text = ("the quick brown fox jumps over lazy dogs while some of them sleep on")[:64]
    near = likenesses(spark, [(text[:63], text), (text[:40], text[:41]), (text[:20], text[:21])])
    assert near[0] > 0.6 and near[1] > 0.5 and near[2] > 0.3


def test_signature_by_brute_force(spark):
    """Elements, bins and tuples rebuilt from their definition; only the hash is Spark's."""
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["the", "memo", "queue", "ü", "日本語", "x\ty", "aaaa"], k=n)) for n in (0, 1, 2, 5, 40, 300)]
    texts += ["a" * 200_000, "", " \n "]

    def pieces(text):
        out = []
        for run in re.findall(r"[^ \t-\r]+", text):
            piece = ""
            data = run.encode("utf-16-be")
            for i in range(0, len(data), 2):
                piece += data[i:i + 2].decode("latin-1")
                if data[i + 1] % 8 == 5:
                    out.append(piece)
                    piece = ""
            if piece:
                out.append(piece)
        return out

    lists = [pieces(t) for t in texts]
    kmers = sorted({tuple(w[i:i + 3]) for w in lists for i in range(len(w) - 2)})
    low = (1 << 23) - 1

    def hashed(expression, rows, schema):
        if not rows:
            return {}
        df = spark.createDataFrame([(*([r] if not isinstance(r, tuple) else r),) for r in rows], schema)
        return dict(zip(rows, (x[0] for x in df.select(F.expr(expression)).collect())))
    base = {k: h & ~low for k, h in hashed("xxhash64(a, b, c)", kmers, "a string, b string, c string").items()}
    numbered = [(base[k], n) for w in lists for k, c in Counter(
        tuple(w[i:i + 3]) for i in range(len(w) - 2)).items() for n in range(1, c)]
    again = {k: h & ~low for k, h in hashed("xxhash64(h, n)", sorted(set(numbered)), "h long, n int").items()}
    short = {tuple(w): h & ~low for w, h in zip(
        [w for w in lists if 0 < len(w) < 3],
        [r[0] for r in spark.createDataFrame([(w,) for w in lists if 0 < len(w) < 3], "w array<string>")
         .selectExpr("xxhash64(w)").collect()])}

    def unsigned(x):
        return x & (1 << 64) - 1
    chosen = {}
    for n, w in enumerate(lists):
        seen, elements = Counter(), []
        for i in range(len(w) - 2):
            k = tuple(w[i:i + 3])
            elements.append(((again[base[k], seen[k]] if seen[k] else base[k]), i))
            seen[k] += 1
        if 0 < len(w) < 3:
            elements = [(short[tuple(w)], 0)]
        bins = {}
        # signed order, as numbers of a bin share their top bits
        for h, i in sorted(elements):
            bins.setdefault(unsigned(h) >> 58, []).append((h, i))
        for b, members in bins.items():
            ordered = [unsigned(h | i) >> 24 & (1 << 40) - 1 for h, i in sorted(
                members[:2], key=lambda e: (e[1], unsigned(e[0] | e[1]) >> 24 & (1 << 40) - 1))]
            # what the place leaves of 40 bits goes into the tuple
            chosen.setdefault(n, {})[b] = tuple(ordered)
    tuples = sorted({t for c in chosen.values() for t in c.values()})
    of = dict(zip(tuples, (r[0] for r in spark.createDataFrame([(list(t),) for t in tuples], "t array<long>")
                           .selectExpr("xxhash64(t) & 16777215L").collect())))
    got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "n int, text string").repartition(1)
           .sortWithinPartitions("n").select(fingerprints.signature("text")).collect()]
    for n in range(len(texts)):
        want = [(b << 24) | of[t] for b, t in sorted(chosen.get(n, {}).items())]
        assert sorted(x & (1 << 32) - 1 for x in got[n]) == sorted(x & (1 << 32) - 1 for x in want), texts[n][:40]


def test_nulls_repeats_extra_columns_and_an_empty_table(spark):
    schema = "doc_id long, text string, part int, following string, guest string"
    rows = [(5, "a b c d e f", 1, "x", "y"), (5, "a b c d e f", 2, None, None),
            (None, "a b c d e f", None, None, None), (None, None, 1, "", "")]
    got = run(spark, rows, schema)
    assert [r["doc_id"] for r in got] == [5, 5, None, None]
    assert len({r["fingerprint"] for r in got if r["n_chars"]}) == 1
    nameless = [r for r in got if r["doc_id"] is None and r["n_chars"]][0]
    assert nameless["edited_sha256"] == hashlib.sha256(b"a b c d ").hexdigest()
    assert run(spark, [], schema) == []
