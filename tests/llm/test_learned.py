"""Quality, mixing and the pipeline: held-out accuracy, targets, rows."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from runlens.session import materialize
from runlens.llm import minhash, mixing, quality, queries

WORDS = "the of and to in is that for it as with was on are by".split()


def good(rng):
    lines = []
    for _ in range(rng.randint(1, 6)):
        words = [rng.choice(WORDS) if rng.random() < .4 else
                 "".join(rng.choice("aeioutnrsl") for _ in range(rng.randint(3, 8)))
                 for _ in range(rng.randint(8, 20))]
        lines.append(" ".join(words).capitalize() + ".")
    return "\n".join(lines)


def bad(rng):
    return " ".join(rng.choice(["$$$", "BUY!!", "|", "NOW!!", "%%%"]) for _ in range(60))


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(9)
    rows = []
    for i in range(400):
        low = i % 4 == 0
        # site s0 is poor: most of its texts are bad
        site = "s0" if low and i % 8 == 0 else f"s{1 + i % 5}"
        rows.append((i, bad(rng) if low else good(rng), site, int(not low)))
    docs = spark.createDataFrame([(i, t, s, "x") for i, t, s, _ in rows],
                                 "doc_id long, text string, source string, p_host string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, _, q in rows[:200]],
                                   "doc_id long, quality int, toxic int")
    return docs, labels, {i: q for i, _, _, q in rows}


def classify(docs, labels, **options):
    return quality.classify(docs, labels, F.col("source"), F.col("source"), **options)


def test_held_out_accuracy(judged):
    docs, labels, truth = judged
    got = classify(docs, labels).collect()
    held = [r for r in got if r["doc_id"] >= 200]
    assert len(got) == 400
    assert sum(r["kept"] == bool(truth[r["doc_id"]]) for r in held) >= 0.98 * len(held)


def test_sites_shrink_and_move_documents(judged):
    docs, labels, _ = judged
    rows = {r["doc_id"]: r for r in classify(docs, labels).collect()}
    poor = [r["p_host"] for i, r in rows.items() if i % 8 == 0]
    fine = [r["p_host"] for i, r in rows.items() if i % 4]
    assert max(poor) < 0.2 < min(fine)
    assert all(r["p_quality"] <= r["p_document"] for i, r in rows.items() if i % 8 == 0)


def test_quality_edge_cases(spark, judged):
    docs, labels, _ = judged
    odd = spark.createDataFrame(
        [(1000, None, None), (1001, "", "s1"), (1002, " \n", "s1"), (None, "plain words here", None),
         (1003, "word " * 30_000, "only")], "doc_id long, text string, source string")
    both = docs.select("doc_id", "text", "source").unionByName(odd).unionByName(odd)
    rows = {r["doc_id"]: r for r in classify(both, labels).collect()}
    assert all(rows[i]["p_quality"] == 0 and not rows[i]["kept"] for i in (1000, 1001, 1002))
    assert rows[None]["p_quality"] is not None
    assert classify(docs.where("false"), labels).collect() == []
    # no labels: one probability for all texts
    assert len({round(r["p_document"], 9) for r in classify(docs, labels.where("false")).collect()}) == 1


def test_logistic_separates_and_falls_back():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((500, quality.FEATURES))
    y = (x[:, 3] > 0).astype(float)
    w, b = quality.fit_logistic(x[:300], y[:300])
    assert (((x[300:] @ w + b) > 0) == y[300:]).mean() > 0.95
    w, b = quality.fit_logistic(x[:9], np.ones(9))
    assert not w.any() and b == pytest.approx(np.log(10))


# --- mixing ----------------------------------------------------------------

@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(2)
    marks = {"a": "alpha apple axe", "b": "beta bird bell", "c": "gamma gold gate"}
    rows = []
    for i in range(300):
        d = "aaabbc"[i % 6]
        words = [f"u{rng.randrange(4000)}" for _ in range(40)] + rng.choices(marks[d].split(), k=4)
        rng.shuffle(words)
        rows.append((i, " ".join(words), d))
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, rate string")
    labelled = spark.createDataFrame([(i, d) for i, _, d in rows[:200]], "doc_id long, domain string")
    return docs, labelled, {i: d for i, _, d in rows}


SHARES = {"a": 0.2, "b": 0.3, "c": 0.5}


def test_expected_shares_meet_the_targets(mixed):
    docs, labelled, truth = mixed
    rows = mixing.mixture(docs, labelled, SHARES).collect()
    totals = np.array([[r["tokens"] * r["rate"] * p for p in r["p"]] for r in rows]).sum(axis=0)
    assert totals / totals.sum() == pytest.approx(list(SHARES.values()), abs=1e-3)
    assert min(r["rate"] for r in rows) >= 0
    held = [r for r in rows if r["doc_id"] >= 200]
    assert sum("abc"[int(np.argmax(r["p"]))] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_rates_solve_the_bounded_least_squares(spark):
    rng = np.random.default_rng(5)
    p = rng.dirichlet([0.4] * 3, 200)
    tokens = rng.integers(1, 500, 200)
    df = spark.createDataFrame([(i, 0, 1, int(t), q.tolist()) for i, (t, q) in enumerate(zip(tokens, p))],
                               "doc_id long, version long, copies long, tokens long, p array<double>")
    targets = [float(x) for x in (p * tokens[:, None]).sum(axis=0) * [0.3, 2.0, 0.8]]
    rates = np.array([r["rate"] for r in mixing.fit_rates(df, targets, most=1.0, steps=200)
                      .orderBy("doc_id").collect()])
    assert rates.min() >= 0 and rates.max() <= 1

    def loss(r):
        return (((p * (tokens * r)[:, None]).sum(axis=0) - targets) ** 2 / targets).sum()
    # the same problem in numpy, with many small steps
    r = np.ones(200)
    for _ in range(20_000):
        miss = ((p * (tokens * r)[:, None]).sum(axis=0) - targets) / targets
        r = np.clip(r - 0.1 * p @ miss, 0, 1)
    assert loss(rates) <= loss(r) * 1.01 + 1e-6


def test_rates_become_copies(spark, mixed):
    docs, labelled, _ = mixed
    rates = mixing.mixture(docs, labelled, SHARES)
    times = {r["doc_id"]: r["rate"] for r in rates.collect()}
    got = mixing.apply_rates(docs, rates)
    assert got.columns == docs.columns
    counts = {r["doc_id"]: r["count"] for r in got.groupBy("doc_id").count().collect()}
    assert all(abs(counts.get(i, 0) - x) < 1.05 for i, x in times.items())
    assert abs(sum(counts.values()) - sum(times.values())) < 25


def test_a_domain_far_above_its_target_is_thinned_not_deleted(spark):
    # three in ten tokens are toxic and one in a hundred may be
    docs = spark.range(9000).select(F.col("id").alias("doc_id"),
                                    F.concat(F.lit("word "), "id").alias("text"))
    members = docs.select(
        "doc_id", F.xxhash64("text").alias("version"), F.lit(1).cast("long").alias("copies"),
        F.lit(2).cast("long").alias("tokens"),
        F.expr("if(doc_id % 10 < 3, array(0.001D, 0.999D), array(0.999D, 0.001D))").alias("p"))
    full = 2 * (6300 * 0.999 + 2700 * 0.001)
    rates = mixing.fit_rates(members, [full, full / 99], most=1.0, steps=8)
    got = mixing.apply_rates(docs, rates, slack=0.05)
    toxic, clean = got.where("doc_id % 10 < 3").count(), got.where("doc_id % 10 >= 3").count()
    assert clean == 6300 and 0.006 < toxic / (toxic + clean) < 0.014
    fixed = docs.select("doc_id", F.xxhash64("text").alias("version"),
                        F.expr("element_at(array(0.03D, 0.97D, 1.96D), cast(doc_id % 3 as int) + 1)").alias("rate"))
    for slack, middle in ((0.0, 2910), (0.05, 3000)):
        n = {r["k"]: r["count"] for r in mixing.apply_rates(docs, fixed, slack=slack)
             .groupBy((F.col("doc_id") % 3).alias("k")).count().collect()}
        assert abs(n[0] - 90) < 30 and abs(n[1] - middle) < (30 if middle < 3000 else 1)
        assert abs(n[2] - 5880) < 40


def test_mixing_edge_cases(spark, mixed):
    docs, labelled, _ = mixed
    odd = spark.createDataFrame([(500, None), (501, ""), (None, "alpha beta"), (502, "zeta " * 50_000),
                                 (0, "another text"), (503, "dup dup"), (503, "dup dup")],
                                "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(odd)
    rows = {(r["doc_id"], r["tokens"]): r for r in mixing.mixture(both, labelled, SHARES).collect()}
    assert len(rows) == 306 and rows[503, 2]["copies"] == 2 and rows[500, 0]["tokens"] == 0
    assert mixing.mixture(docs.where("false"), labelled, SHARES).collect() == []
    flat = mixing.mixture(docs, labelled.where("false"), SHARES).collect()
    assert {tuple(round(x, 9) for x in r["p"]) for r in flat} == {(0.333333333,) * 3}


def test_mixing_runs_no_python_on_executors(mixed):
    docs, labelled, _ = mixed
    rates = mixing.mixture(docs, labelled, SHARES)
    for df in (rates, mixing.apply_rates(docs, rates)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


# --- pipeline and registration ----------------------------------------------

def test_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "pack":
            assert out.columns == columns
        docs = out.cache()
        seen[name] = docs
    start = {r["doc_id"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    kept = {r["doc_id"] for r in seen["quality_filter"].collect()}
    clean = {i for i, r in labels.items() if r["quality"] == 1 and r["toxic"] == 0}
    assert kept < start and len(clean - kept) <= 0.01 * len(clean)
    assert {r["doc_id"] for r in seen["line_dedup"].collect()} == kept
    alone = {r["doc_id"] for r in seen["near_dedup"].collect()}
    again = minhash.near_duplicates(seen["near_dedup"]).collect()
    assert alone <= kept and all(r["kept"] for r in again)
    packed = seen["pack"].collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in seen["mix"].collect()} <= alone
    for df in seen.values():
        df.unpersist()


def test_near_dedup_tells_texts_of_one_id_apart(spark):
    words = [f"w{i}" for i in range(60)]
    a, b, near = " ".join(words), " ".join(reversed(words)), " ".join(words[:-1] + ["x"])
    rows = [(5, a, 1), (5, b, 2), (5, a, 3), (2, near, 4), (9, b, 5), (None, a, 6), (7, None, 7), (8, "", 8), (7, None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, version int")
    kept = {r["version"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    # of a and near the smaller id, of b the smaller id, although that id's other text is a copy
    assert kept == {4, 2, 6, 7, 8, 9}
    assert corpus_pipeline.near_dedup(spark, docs.where("false"), "").count() == 0


def test_stages_on_nulls_repeats_and_long_texts(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(40)
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (9001, None, "en", None, None), (9002, "", None, "src0", 0),
         (9003, "word " * 60_000, "en", "src0", 300_000), (9003, "word " * 60_000, "en", "src0", 300_000)],
        docs.schema)
    rows = docs.unionByName(odd).unionByName(docs.limit(3))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, folder)
        if name != "pack":
            assert out.columns == docs.columns
            rows = materialize(out, "stage")
            assert stage(spark, docs.where("false"), folder).count() == 0
        else:
            assert out.count() > 0


def test_every_operator_is_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, folder, name):
    import compare

    con = compare.connect(folder)
    assert compare.differences(queries.QUERIES[name](spark, folder), con, queries.ORACLES[name]) is None
    con.close()
