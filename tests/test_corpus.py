"""Next-token tables, vocabularies, sequences, generation and agreement."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from runlens.functions import sequences as seq
from runlens.operators import ngram, results as res, vocabulary as vc
from runlens.operators.generate import generate_records

TEXTS = [(0, "x", "the cat sat on the mat"), (1, "x", "the cat ran"), (2, "y", "on the mat"),
         (3, "y", "  a  the cat\nsat "), (4, "y", ""), (5, None, "the the the")]


def texts(spark):
    return spark.createDataFrame(TEXTS, "id int, lang string, text string")


def bigrams(rows):
    out = defaultdict(Counter)
    for text in rows:
        w = text.split()
        for a, b in zip(w, [*w[1:], ngram.EOS]):
            out[a][b] += 1
    return out


@pytest.mark.parametrize("cap", [1, 3, 8])
def test_paths_equal_a_plain_walk(spark, cap):
    best = {a: min(c, key=lambda b: (-c[b], b)) for a, c in bigrams(
        t for _, _, t in TEXTS).items()}
    want = {}
    for start in best:
        path = [best[start]]
        while len(path) < cap and path[-1] != ngram.EOS:
            path.append(best[path[-1]])
        want[start] = path
    got = ngram.greedy_paths(ngram.bigram_counts(texts(spark), "text"), cap).collect()
    assert {r.token: list(r.path) for r in got} == want
    assert all(len(r.path) <= cap for r in got)


def test_continuation_of_prompts(spark):
    paths = ngram.greedy_paths(ngram.bigram_counts(texts(spark), "text"), 2)
    prompts = spark.createDataFrame([(0, "see the cat"), (1, "nothing known"), (2, " ")],
                                    "id int, text string")
    got = {r.id: r.path for r in ngram.continue_prompts(prompts, "text", paths).collect()}
    assert got == {0: ["sat", "</s>"], 1: None, 2: None}


@pytest.mark.parametrize("most", [1 << 16, 3])
def test_alias_tables_hold_the_softmax(spark, most):
    """The mass of every successor, over its own cells and those it tops up, through blocks too."""
    table = bigrams(t for _, _, t in TEXTS)
    table["many"] = Counter({f"s{i}": 1 + i % 7 * (i % 5) for i in range(40)})
    table["tie"] = Counter({"a": 3, "b": 3, "c": 1, "d": 1})
    counts = spark.createDataFrame(
        [(p, t, n) for p, c in table.items() for t, n in c.items()], "prev string, next string, n long")
    rows = ngram.alias_table(counts, 0.5, most).collect()
    cells = defaultdict(list)
    for r in rows:
        cells[r.prev, r.block].append(r)
        assert 0 <= r.keep <= 1

    def masses(prev, block):
        own = cells[prev, block]
        assert sorted(r.cell for r in own) == list(range(len(own)))
        out = Counter()
        for r in own:
            for share, token, to in ((r.keep, r.next, r.next_block), (1 - r.keep, r.other, r.other_block)):
                if token is None:
                    for inner, m in masses(prev, to).items():
                        out[inner] += m * share / len(own)
                else:
                    out[token] += share / len(own)
        return out
    assert {p for p, _ in cells} == set(table)
    assert any(b for _, b in cells) == (most == 3)
    for prev, c in table.items():
        weight = {t: n ** 2 for t, n in c.items()}
        got = masses(prev, 0)
        assert {t for t, m in got.items() if m > 1e-8} == set(weight)
        for token, w in weight.items():
            assert got[token] == pytest.approx(w / sum(weight.values()), abs=1e-7)
    # a walk comes to the table that its token has
    for r in rows:
        if r.next is not None and r.next in table:
            assert r.n_next == len(cells[r.next, 0])
        elif r.next is None:
            assert r.n_next == len(cells[r.prev, r.next_block])


@pytest.mark.parametrize("most", [1 << 16, 2])
def test_sampling_frequencies_and_replay(spark, most):
    counts = ngram.bigram_counts(texts(spark), "text")
    prompts = spark.range(4_000).select(F.col("id").alias("k"), F.lit("on the").alias("text"))
    walked = ngram.sample_continuations(prompts, "k", "text", counts, 3, 1.0, 42, most=most)
    rows = {r.k: list(r.path) for r in walked.collect()}
    assert len(rows) == 4_000
    c = bigrams(t for _, _, t in TEXTS)
    first = Counter(p[0] for p in rows.values())
    for token, n in c["the"].items():
        assert first[token] / 4_000 == pytest.approx(n / sum(c["the"].values()), abs=0.03)
    for path in rows.values():
        assert len(path) == 3 or path[-1] == ngram.EOS
        assert ngram.EOS not in path[:-1]
        assert all(b in c[a] for a, b in zip(["the", *path], path))
    again = {r.k: list(r.path) for r in ngram.sample_continuations(
        prompts.repartition(5), "k", "text", counts, 3, 1.0, 42, steps=1, most=most).collect()}
    assert again == rows


def test_cells_stay_in_place_over_all_rounds(spark, monkeypatch):
    """Each round reads the cached cells; also those of a token with several rows of them."""
    plans, write = [], ngram.materialize

    def seen(df, label):
        if label == "walk":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, label)
    monkeypatch.setattr(ngram, "materialize", seen)
    counts = spark.createDataFrame([("a", f"s{i}", 1) for i in range(40)] + [(f"s{i}", "a", 1) for i in range(40)],
                                   "prev string, next string, n long")
    prompts = spark.range(2_000).select(F.col("id").alias("k"), F.lit("a").alias("text"))
    rows = ngram.sample_continuations(prompts, "k", "text", counts, 3, 1.0, 42, steps=1).collect()
    assert len(rows) == 2_000 and all(len(r.path) == 3 and r.path[1] == "a" for r in rows)
    assert {r.path[i] for r in rows for i in (0, 2)} == {f"s{i}" for i in range(40)}
    assert len(plans) == 4 and all("InMemoryTableScan" in p for p in plans[1:])


def test_overlap_equals_brute_force(spark):
    want = {}
    for lang in {t[1] for t in TEXTS}:
        table = bigrams(t for _, g, t in TEXTS if g == lang)
        unigram = Counter()
        for c in table.values():
            unigram.update(c)
        total = sum(unigram.values())
        for context, c in table.items():
            n = sum(c.values())
            want[lang, context] = (n, sum(min(c[t] / n, unigram[t] / total) for t in c))
    got = ngram.corpus_overlap(texts(spark), "text", ["lang"]).collect()
    assert len(got) == len(want)  # the texts without a language are kept
    for r in got:
        n, alpha = want[r.lang, r.context]
        assert r.n == n and r.alpha == pytest.approx(alpha, abs=1e-12)


def test_decode_gives_the_text_back(spark):
    df = texts(spark)
    ids = df.select("id", vc.encode(F.col("text")).alias("ids"))
    got = {r.id: (r.text, r.n_ids) for r in vc.decode(
        ids, ["id"], "ids", vc.vocabulary(df, "text")).collect()}
    assert {k: v[0] for k, v in got.items()} == {i: t.rstrip() for i, _, t in TEXTS}
    assert got[4] == ("", 0)


def test_rollback(spark):
    df = spark.createDataFrame([(list(range(20)),), (None,)], "ids array<bigint>")
    for keep, want in ((10, 10), (1, 1), (0, 0), (50, 20)):
        rows = df.withColumn("kept", seq.rollback(F.col("ids"), F.lit(keep))).select(
            seq.sequence_length(F.col("kept")).alias("k"),
            seq.sequence_length(F.col("ids")).alias("n")).collect()
        assert sorted(tuple(r) for r in rows) == [(0, 0), (want, 20)]


@pytest.mark.parametrize("ids, cap, want", [
    ([1, 2, 9, 3], 10, [1, 2, 9]), ([1, 2, 9, 3], 2, [1, 2]), ([1, 2], 10, [1, 2]),
    ([9, 9], 5, [9]), ([4, 5], 0, [4])])
def test_stop_at_eos(spark, ids, cap, want):
    df = spark.createDataFrame([(ids,)], "ids array<bigint>")
    got = df.select(seq.stop_at_eos(F.col("ids"), F.lit(9).cast("long"), cap).alias("x"))
    assert got.first().x == want


def test_token_agreement(spark):
    a = spark.createDataFrame([(1, [1, 2, 3]), (2, [1, 2]), (3, []), (4, [5])],
                              "k int, ids array<bigint>")
    b = spark.createDataFrame([(1, [1, 2, 3, 4]), (2, [1, 9]), (3, [1]), (5, [5])],
                              "k int, ids array<bigint>")
    got = {r.k: (r.n_compared, r.first_mismatch, r.verdict)
           for r in res.token_agreement(a, b, "k").collect()}
    assert got == {1: (3, -1, "equal"), 2: (2, 1, "differs"), 3: (0, -1, "empty")}


def test_assembled_run(spark):
    rows = [("r", 2, [30], 0.3, 3 * 1024 ** 2), ("r", 0, [10, 11], 0.1, 1024 ** 2),
            ("r", 1, [20], 0.2, 2 * 1024 ** 2)]
    df = spark.createDataFrame(
        rows, "run string, step int, ids array<bigint>, latency_s double, peak_bytes bigint")
    row = res.assemble_results(df, ["run"], ["step"]).first()
    assert row.generated_ids == [10, 11, 20, 30]
    assert row.per_token_latencies == [0.1, 0.2, 0.3]
    assert row.total_time == pytest.approx(0.6, abs=1e-9)
    assert row.time_to_first_token == 0.1 and row.peak_memory_mb == 3.0


def test_keep_one_folds_many_copies(spark):
    df = spark.range(1_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"),
        F.col("id").alias("v"))
    got = res.keep_one(df, ["k"], ["v"])
    assert got.count() == 1_000 - 334 + 1
    assert got.where("k = 'hot'").first().v == 0


def test_union_fills_missing_columns(spark):
    plain = spark.createDataFrame([(1,)], "id int")
    drafted = spark.createDataFrame([(2, 0.5, 3)],
                                    "id int, acceptance_rate double, num_speculation_rounds bigint")
    rows = {r.id: r for r in res.union_results(plain, drafted).collect()}
    assert rows[1].acceptance_rate is None and rows[2].num_speculation_rounds == 3


@pytest.mark.parametrize("ways", [1, 3])
def test_generation(spark, ways):
    def load(model_id):
        class Model:
            eos_id = 3

            def stream(self, text, temperature, key):
                # the stub runs into its EOS only on long texts
                yield from range(len(text))

            def peak_memory_mb(self):
                return 2.0

        return Model()

    prompts = spark.createDataFrame(
        [("m1", "code_000", "code", 1, "ab"), ("m2", "code_001", "code", 1, "abcdefgh"),
         ("m1", "code_002", "code", 1, "")],
        "model_id string, prompt_id string, domain string, prompt_token_count bigint, "
        "raw_text string")
    out = generate_records(prompts, load, (0.0, 0.6), 5, 6, partitions=4, ways=ways)
    rows = out.collect()
    assert len(rows) == 3 * 2 * 5
    assert len({(r.prompt_id, r.temperature, r.run_idx) for r in rows}) == 30
    want = {"code_000": [0, 1], "code_001": [0, 1, 2, 3], "code_002": []}
    for r in rows:
        assert r.generated_ids == want[r.prompt_id]
        assert len(r.per_token_latencies) == len(r.generated_ids)
        assert all(s > 0 for s in r.per_token_latencies)
        assert r.total_time == pytest.approx(sum(r.per_token_latencies), abs=1e-9)
        if r.generated_ids:
            assert r.time_to_first_token == r.per_token_latencies[0]
