"""Probability vectors: agreement with numpy, algebra and edge cases."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.functions import distributions as dist
from runlens.operators import long_form as lf, verification as vf

P = [0.4, 0.2, 0.125, 0.025, 0.15, 0.1]
Q = [0.125, 0.375, 0.25, 0.025, 0.2, 0.025]


def one(spark, expr, **cols):
    kinds = {list: "array<double>", float: "double", int: "bigint", bool: "boolean"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in cols.items())
    return spark.createDataFrame([tuple(cols.values())], schema).select(
        expr.alias("x")).first().x


def test_residual_equals_numpy(spark):
    p, q = np.array(P), np.array(Q)
    rest = np.maximum(p - q, 0)
    got = one(spark, dist.residual(F.col("p"), F.col("q")), p=P, q=Q)
    assert got == pytest.approx((rest / rest.sum()).tolist(), abs=1e-12)
    assert one(spark, dist.residual_mass(F.col("p"), F.col("q")), p=P, q=Q) \
        == pytest.approx(rest.sum())
    assert one(spark, dist.overlap(F.col("p"), F.col("q")), p=P, q=Q) \
        == pytest.approx(np.minimum(p, q).sum())


def test_equal_vectors_leave_no_residual(spark):
    assert one(spark, dist.residual(F.col("p"), F.col("q")), p=P, q=P) is None


def test_target_is_preserved(spark):
    rng = np.random.default_rng(0)
    rows = [(rng.dirichlet(np.ones(40)).tolist(), rng.dirichlet(np.ones(40)).tolist())
            for _ in range(50)]
    df = spark.createDataFrame(rows, "p array<double>, q array<double>")
    ok = df.select(dist.preserves_target(F.col("p"), F.col("q")).alias("ok"),
                   (dist.overlap(F.col("p"), F.col("q"))
                    + dist.residual_mass(F.col("p"), F.col("q"))).alias("one"))
    for r in ok.collect():
        assert r.ok and r.one == pytest.approx(1.0, abs=1e-12)


def test_accept_probability(spark):
    for p, q in ((0.9, 0.3), (0.25, 0.25), (0.2, 0.64), (0.0, 0.1)):
        want = min(1.0, p / q)
        got = one(spark, dist.accept_probability(F.col("p"), F.col("q"), F.col("t")),
                  p=[p], q=[q], t=0)
        assert got == pytest.approx(want)
    assert one(spark, dist.accept_probability(F.col("p"), F.col("q"), F.col("t")),
               p=[0.5], q=[0.0], t=0) is None


def test_softmax(spark):
    z = [1.0, 2.0, -3.0, 700.0, 699.0]
    got = one(spark, dist.softmax(F.col("z"), 0.5), z=z)
    e = np.exp((np.array(z) - 700) / 0.5)
    assert got == pytest.approx((e / e.sum()).tolist(), abs=1e-15)
    hot = one(spark, dist.softmax(F.col("z"), 1e6), z=[0.0, 1.0])
    assert hot == pytest.approx([0.5, 0.5], abs=1e-6)


def test_argmax_takes_the_first_of_equals(spark):
    assert one(spark, dist.argmax(F.col("z")), z=[1.0, 3.0, 3.0]) == 1


@pytest.mark.parametrize("u, want", [(0.0, 1), (0.29, 1), (0.3, 3), (0.999999, 3), (1.0, 3)])
def test_pick_edges(spark, u, want):
    assert one(spark, dist.pick(F.col("p"), F.col("u")), p=[0.0, 0.3, 0.0, 0.7, 0.0],
               u=u) == want


def test_pick_follows_the_distribution(spark):
    u = dist.keyed_uniform(42, "t", F.col("id"))
    p = F.array(*[F.lit(x) for x in P])
    n = 20_000
    got = {r.k: r["count"] / n for r in spark.range(n).select(
        dist.pick(p, u).alias("k")).groupBy("k").count().collect()}
    for i, x in enumerate(P):
        assert got[i] == pytest.approx(x, abs=0.02)


def test_uniform_depends_on_key_only(spark):
    u = dist.keyed_uniform(42, "t", F.col("id"))
    a = spark.range(1000, numPartitions=1).select("id", u.alias("u"))
    b = spark.range(1000, numPartitions=7).select("id", u.alias("u"))
    assert a.exceptAll(b).count() == 0
    assert 0 <= a.agg(F.min("u")).first()[0] and a.agg(F.max("u")).first()[0] < 1


def test_greedy_at_temperature_zero(spark):
    expr = dist.sample(F.col("z"), F.col("t"), F.col("u"))
    assert one(spark, expr, z=[0.0, 5.0, 1.0], t=0.0, u=0.99) == 1
    assert one(spark, expr, z=[0.0, 0.0, 0.0], t=1.0, u=0.99) == 2


def test_quantized_vector_stays_close(spark):
    z = [0.3, -0.7, 0.05, 0.0]
    got = one(spark, dist.quantize(F.col("z")), z=z)
    assert got == pytest.approx([0.3, -0.7, 0.1, 0.0])
    assert one(spark, dist.quantize(F.col("z")), z=[0.0, 0.0]) == [0.0, 0.0]


@pytest.mark.parametrize("beta, k, cost", [(0.65, 3, 0.25), (0.9, 7, 0.05), (0.15, 2, 0.5), (1.0, 6, 0.2)])
def test_expected_tokens_and_speedup(spark, beta, k, cost):
    b, n = F.lit(beta), F.lit(k)
    row = spark.range(1).select(
        dist.expected_tokens(b, n).alias("e"),
        dist.modelled_speedup(b, n, F.lit(cost)).alias("s"),
        dist.break_even_beta(n, F.lit(cost)).alias("m")).first()
    tokens = sum(beta ** i for i in range(k + 1))
    assert row.e == pytest.approx(tokens)
    assert row.s == pytest.approx(tokens / (1 + cost * k))
    assert row.m == pytest.approx(cost * k / (1 + cost * k))


def test_optimal_draft_length(spark):
    for beta, want in ((0.5, 5), (0.9, 29), (0.0, None), (1.0, None)):
        got = one(spark, dist.optimal_draft_length(F.col("b")), b=beta)
        assert got == want


def test_long_form_equals_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=30).tolist(), rng.normal(size=30).tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "k bigint, a array<double>, b array<double>")
    u = dist.keyed_uniform(1, "x", F.col("k"))
    pa, pb = dist.softmax(F.col("a"), 0.7), dist.softmax(F.col("b"), 0.7)
    dense = {r.k: r for r in df.select(
        "k", dist.argmax(F.col("a")).alias("g"), dist.pick(pa, u).alias("s"),
        dist.overlap(pa, pb).alias("o")).collect()}
    la = lf.softmax(lf.explode_vector(df, ["k"], "a", "logit"), ["k"], 0.7)
    lb = lf.softmax(lf.explode_vector(df, ["k"], "b", "logit"), ["k"], 0.7, out="q")
    greedy = lf.greedy_tokens(la, ["k"]).collect()
    sampled = lf.sample_tokens(la, ["k"], u).collect()
    assert all(r.token_id == dense[r.k].g for r in greedy) and len(greedy) == 40
    assert all(r.token_id == dense[r.k].s for r in sampled) and len(sampled) == 40
    for r in lf.overlap(la.drop("logit"), lb.drop("logit"), ["k"]).collect():
        assert r.alpha == pytest.approx(dense[r.k].o, abs=1e-12)


ROUND = [
    # drafted token, target, draft, uniform: two to accept, one to reject
    (1, [0.1, 0.6, 0.2, 0.1], [0.2, 0.5, 0.2, 0.1], 0.35),
    (2, [0.3, 0.2, 0.45, 0.05], [0.25, 0.25, 0.4, 0.1], 0.9),
    (0, [0.2, 0.3, 0.3, 0.2], [0.8, 0.1, 0.05, 0.05], 0.5),
]


def positions(spark, uniforms, k=3):
    rows = [(0, i, t, p, q, u) for i, ((t, p, q, _), u) in enumerate(zip(ROUND, uniforms))]
    rows.append((0, k, None, [0.0, 0.0, 0.0, 1.0], [0.25] * 4, None))
    return spark.createDataFrame(
        rows, "round_id bigint, pos bigint, tok bigint, p array<double>, q array<double>, "
              "u double")


def test_round_stops_at_the_first_rejection(spark):
    df = positions(spark, [r[3] for r in ROUND])
    prefix = vf.accepted_prefix(vf.score_positions(df.where("pos < 3"))).collect()
    assert sorted(r.pos for r in prefix) == [0, 1]
    out = vf.round_output(df, 3, 42).first()
    assert (out.n_accepted, out.final_kind, len(out.tokens)) == (2, "replacement", 3)
    assert out.tokens[:2] == [1, 2] and out.tokens[2] in (1, 2, 3)


def test_round_with_all_accepted_gets_the_bonus(spark):
    out = vf.round_output(positions(spark, [0.1, 0.1, 0.1]), 3, 42).first()
    assert (out.n_accepted, out.final_kind, list(out.tokens)) == (3, "bonus", [1, 2, 0, 3])


def test_vectors_of_different_size_are_rejected(spark):
    df = spark.createDataFrame([(1, [0.5, 0.5], [1.0]), (2, [1.0], [1.0])],
                               "i int, p array<double>, q array<double>")
    good, bad = vf.split_bad_vectors(df)
    assert [r.i for r in good.collect()] == [2] and [r.i for r in bad.collect()] == [1]
