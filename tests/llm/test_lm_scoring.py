"""The backoff automaton against probabilities worked out from n-gram counts."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from runlens.llm import lm_scoring

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return WORD.findall((text or "").translate(LOWER)) + ["</s>"]


def held_out(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 7 == 2


def brute(docs, order, m=lm_scoring.STRENGTH):
    counts = Counter()
    for doc, text in docs:
        if not held_out(doc):
            t = tokens(text)
            counts.update(tuple(t[i:i + k]) for k in range(1, order + 1) for i in range(len(t) - k + 1))
    n = sum(c for g, c in counts.items() if len(g) == 1)
    v = sum(len(g) == 1 for g in counts)

    def p(word, context):
        if not context:
            return (counts[word,] + 1) / (n + v + 1)
        return (counts[*context, word] + m * p(word, context[1:])) / (counts[context] + m)
    out = []
    for doc, text in docs:
        t = tokens(text)
        score = sum(math.log10(p(w, tuple(t[max(0, i - order + 1):i]))) for i, w in enumerate(t))
        base = sum(math.log10(p(w, ())) for w in t)
        out.append((doc, held_out(doc), len(t), sum(counts[w,] > 0 for w in t), n, base, score))
    return out


def same(df, want):
    got = sorted(map(tuple, df.collect()), key=repr)
    # floats differ in the last digits, so they are left out of the order
    key = lambda r: (repr(r[:5]), round(r[5], 6), round(r[6], 6))
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string")


def by_hash():
    return F.crc32(F.col("doc_id").cast("string")) % 7 == 2


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)] + ["É", "The", "the"]
    docs = [(i, " ".join(rng.choices(words, [1 / (j + 1) for j in range(63)], k=rng.randint(0, 60))))
            for i in range(150)]
    docs += [(150 + i, docs[3][1]) for i in range(20)]                  # copies
    docs += [(200, None), (201, ""), (202, " \n"), (None, "w1 w2"), (3, docs[3][1]), (3, docs[3][1]),
             (203, "a b unseen" + str(rng.random())),
             (204, " ".join(rng.choices(words, k=3 * lm_scoring.STRIDE + 5))),
             (205, " ".join(rng.choices(words, k=lm_scoring.STRIDE - 1)))]
    return docs


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_equals_counted_probabilities(spark, corpus, order):
    same(lm_scoring.score_documents(frame(spark, corpus).repartition(3), by_hash(), order), brute(corpus, order))


def test_small_chunks_and_shards_give_the_same(spark, corpus):
    same(lm_scoring.score_documents(frame(spark, corpus), by_hash(), 3, chunk_bytes=400, shard_grams=500),
         brute(corpus, 3))


def test_sql_of_the_word_pairs(spark, corpus):
    """The same scores of order 2 by joins of count tables."""
    frame(spark, corpus).withColumn("held", F.coalesce(by_hash(), F.lit(False))) \
        .withColumn("row", F.monotonically_increasing_id()).createOrReplaceTempView("lm_docs")
    rows = spark.sql(r"""
    WITH t AS (SELECT row, held, posexplode(concat(filter(regexp_extract_all(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\\x20\\x09-\\x0D]+', 0), w -> w <> ''), array('</s>'))) AS (i, w) FROM lm_docs),
    pairs AS (SELECT *, lag(w) OVER (PARTITION BY row ORDER BY i) AS h FROM t),
    one AS (SELECT w, count(*) AS c FROM t WHERE NOT held GROUP BY w),
    two AS (SELECT h, w, count(*) AS c FROM pairs WHERE NOT held AND h IS NOT NULL GROUP BY h, w),
    n AS (SELECT sum(c) AS n, count(*) AS v FROM one),
    p AS (SELECT row, pairs.h, (coalesce(one.c, 0) + 1) / (n + v + 1) AS p1, coalesce(two.c, 0) AS c2,
                 coalesce(ctx.c, 0) AS ch
          FROM pairs CROSS JOIN n LEFT JOIN one ON one.w = pairs.w
          LEFT JOIN two ON two.h = pairs.h AND two.w = pairs.w LEFT JOIN one ctx ON ctx.w = pairs.h)
    SELECT row, sum(log10(p1)) AS base, sum(log10(IF(h IS NULL, p1, (c2 + 4 * p1) / (ch + 4)))) AS score
    FROM p GROUP BY row""").collect()
    got = lm_scoring.score_documents(frame(spark, corpus), by_hash(), 2).collect()
    assert sorted(round(r["score"], 6) for r in got) == sorted(round(r["score"], 6) for r in rows)


def test_held_out_texts_gain(spark, folder):
    """On the test tables the pair model predicts unseen documents better than single words."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    row = lm_scoring.score_documents(docs, by_hash()).where("held_out").agg(
        F.sum("score"), F.sum("base_score")).first()
    assert row[0] > row[1]


def test_empty_table_and_clashing_columns(spark):
    assert lm_scoring.score_documents(frame(spark, []), by_hash()).count() == 0
    docs = spark.createDataFrame([(2, "x y", 5, "z"), (None, None, None, None)],
                                 "doc_id long, text string, chunk int, held string")
    rows = lm_scoring.score_documents(docs, F.lit(True)).collect()
    # nothing was learned: every word weighs log10(1 / 1)
    assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"], r["score"]) for r in rows) == [
        (1, 0, 0, 0.0), (3, 0, 0, 0.0)]


def test_pack_round_trip():
    import numpy as np
    for values in ([], [0], [1, 2 ** 63, 2 ** 64 - 1], list(range(1000))):
        array = np.array(values, dtype=np.uint64)
        assert (lm_scoring.unpack(lm_scoring.pack(array)) == array).all()
