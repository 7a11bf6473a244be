"""Prompt corpora, their files, and row numbering."""

from __future__ import annotations

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from runlens.functions import text as tx
from runlens.operators import indexing as ix, prompts as pr
from runlens.schemas import DOMAINS, SUMMARY_SUFFIX
from runlens.sources import prompt_files as pf, registry as rg, tables as tb
from runlens.sources.model_listing import flatten_listing, read_listing


def sources(spark, n=7):
    text = F.concat(F.lit("word "), F.col("id").cast("string"), F.lit(" é\n\"q\""))
    base = spark.range(n).select((F.lit(100) - F.col("id")).alias("k"), text.alias("t"))
    return {d: pr.TextSource(base, "t", ("k",)) for d in DOMAINS}


def test_build_numbers_in_source_order(spark):
    built = pr.build_prompts(sources(spark), 3)
    rows = pr.in_order(built).collect()
    assert [r.prompt_id for r in rows] == [f"{d}_{i:03d}" for d in DOMAINS for i in range(3)]
    # the highest id has the lowest key
    assert rows[0].raw_text.startswith("word 6")
    assert rows[0].token_count == 4
    assert rows[-1].raw_text.endswith(SUMMARY_SUFFIX) and rows[-1].token_count == 8


def test_all_rows_equal_a_large_n(spark):
    every = pr.build_prompts(sources(spark), None)
    first = pr.build_prompts(sources(spark), 100)
    assert every.exceptAll(first).count() == 0 and first.exceptAll(every).count() == 0


def test_smaller_build_is_a_prefix(spark):
    full = pr.build_prompts(sources(spark), 5)
    tiny = pr.build_prompts(sources(spark), 2)
    assert pr.smaller_build(full, 2).exceptAll(tiny).count() == 0


def test_missing_domain_comes_from_the_bank(spark):
    src = sources(spark)
    del src["code"]
    got = pr.with_fallback(pr.build_prompts(src, 4), pr.default_bank(spark))
    counts = {r.domain: r.n for r in pr.domain_counts(got).collect()}
    assert counts == {"code": 51, "conversation": 4, "summarization": 4}
    bank = pr.default_bank(spark).where("domain = 'summarization'")
    assert bank.where(~F.col("raw_text").endswith(SUMMARY_SUFFIX)).count() == 0


def test_truncation_is_the_joined_prefix(spark, folder):
    docs = tb.table(spark, folder, "documents")
    for n in (1, 5, 512):
        joined = F.array_join(F.slice(tx.tokens(F.col("text")), 1, n), "")
        assert docs.where(tx.truncate_tokens(F.col("text"), n) != joined).count() == 0


def test_own_tokenizer(spark):
    def factory():
        class Letters:
            def encode(self, text):
                return [ord(c) for c in text]

            def decode(self, ids):
                return "".join(map(chr, ids))

        return Letters()

    built = pr.build_prompts(sources(spark), 2, pr.custom_tokenizer(factory))
    for r in built.collect():
        assert r.token_count == len(r.raw_text)


def test_domain_checks(spark):
    df = spark.createDataFrame([("code",), ("poetry",), (None,)], "domain string")
    good, bad = pr.split_by_domain(df)
    assert good.count() == 1 and bad.count() == 2
    with pytest.raises(KeyError, match="poetry"):
        pr.by_domain(df, "poetry")
    with pytest.raises(PySparkException, match="poetry"):
        pr.require_domains(df.where("domain = 'poetry'")).collect()
    with pytest.raises(PySparkException, match="null"):
        pr.require_domains(df.where("domain is null")).collect()


def test_stats(spark):
    df = spark.createDataFrame(
        [("conversation", 7), ("code", 104), ("code", 141), ("conversation", 13)],
        "domain string, token_count bigint")
    rows = pr.token_stats(df).collect()
    assert [(r.domain, r.n, r.min_tokens, r.mean_tokens, r.max_tokens) for r in rows] == [
        ("code", 2, 104, 122.5, 141), ("conversation", 2, 7, 10.0, 13)]
    assert {r.domain: r.n for r in pr.domain_counts(df).collect()}["summarization"] == 0


def test_prompt_files(spark, tmp_path):
    built = pr.build_prompts(sources(spark), 3)
    for fmt in ("json", "parquet"):
        path = str(tmp_path / "new" / fmt)
        pf.save_prompts(built, path, fmt)
        pf.save_prompts(built, path, fmt)  # overwrites
        back = (pf.load_prompts(spark, path) if fmt == "json"
                else pf.load_prompts_parquet(spark, path))
        assert back.exceptAll(built.select(*back.columns)).count() == 0
        assert back.count() == 9


@pytest.mark.parametrize("record, problem", [
    ({"prompt_id": "a", "domain": "code", "raw_text": "x"}, "prompt keys"),
    ({"prompt_id": "a", "domain": "code", "raw_text": "x", "token_count": 1, "more": 2},
     "prompt keys"),
    ({"prompt_id": "a", "domain": "verse", "raw_text": "x", "token_count": 1}, "unknown domain"),
])
def test_array_files_are_read_strictly(spark, tmp_path, record, problem):
    good = {"prompt_id": "b", "domain": "code", "raw_text": "é\n\"", "token_count": 3}
    path = tmp_path / "prompts.json"
    path.write_text(json.dumps([good], ensure_ascii=False, indent=2), encoding="utf-8")
    row = pf.load_prompts(spark, str(path), array_file=True).first()
    assert row.asDict() == good
    path.write_text(json.dumps([good, record]), encoding="utf-8")
    with pytest.raises(PySparkException, match=problem):
        pf.load_prompts(spark, str(path), array_file=True).count()


def test_missing_input_is_reported(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="nowhere"):
        tb.require_path(spark, str(tmp_path / "nowhere"), "json")
    fallback = spark.range(3)
    got = tb.first_available(spark, [str(tmp_path / "nowhere")], "parquet", fallback)
    assert got.count() == 3


def test_registry(spark):
    assert rg.pair_names() == ["gpt2_dev", "tinyllama_llama3", "phi3_llama3", "llama3_self"]
    assert rg.lookup_pair(spark, "llama3_self").first().draft_dtype == "int4"
    with pytest.raises(KeyError, match="gpt2_dev"):
        rg.lookup_pair(spark, "other")
    df = spark.createDataFrame([("gpt2_dev",), ("other",)], "model_pair_name string")
    assert [r.model_pair_name for r in rg.unknown_pairs(df).collect()] == ["other"]
    assert rg.join_registry(df).count() == 2


def test_listing_defaults(spark, tmp_path):
    path = tmp_path / "listing.json"
    path.write_text(json.dumps({"models": [
        {"name": "m", "size": 1024 ** 3, "details": {"parameter_size": "8B",
                                                     "quantization_level": "Q4_0"}},
        {"details": {}}, {}]}) + "\n" + json.dumps({}) + "\n")
    rows = flatten_listing(read_listing(spark, str(path))).collect()
    assert [tuple(r) for r in rows] == [("m", "8B", "Q4_0", 1.0), ("unknown", "?", "?", 0.0),
                                        ("unknown", "?", "?", 0.0)]


def test_row_index_counts_on_a_hot_prefix(spark):
    """A third of the rows share the first key column."""
    n = 30_000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 50).alias("a"),
        F.col("id").alias("b"))
    got = ix.with_row_index(df, ["a", "b"])
    assert got.count() == n
    assert got.select("idx").distinct().count() == n
    ordered = [(r.a, r.b) for r in got.orderBy("idx").collect()]
    assert ordered == sorted(ordered)
    assert got.agg(F.min("idx"), F.max("idx")).first()[:] == (0, n - 1)


@pytest.mark.parametrize("n", [0, 1, 999, 1_500, 10_000])
def test_first_n(spark, n):
    df = spark.range(5_000).select((F.col("id") % 70).alias("a"), F.col("id").alias("b"))
    got = sorted((r.a, r.b) for r in ix.first_n(df, ["a", "b"], n).collect())
    want = sorted((i % 70, i) for i in range(5_000))[:n]
    assert got == want


@pytest.mark.parametrize("limit", [1, 1_000])
@pytest.mark.parametrize("n", [0, 2, 3, 2_000])
def test_first_n_and_positions_on_null_and_tied_keys(spark, monkeypatch, n, limit):
    """Both the one-task way and the distributed one, from the same rows."""
    monkeypatch.setattr(ix, "SINGLE_TASK_ROWS", limit)
    keys = [1, 2, 2, None, None, 3] + list(range(4, 2_400))
    rows = [(k, i % 3 or None, str(i)) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "a int, b int, t string")
    order = sorted((-1 if a is None else a, -1 if b is None else b) for a, b, _ in rows)

    def seen(row):
        return (-1 if row.a is None else row.a, -1 if row.b is None else row.b)
    assert sorted(map(seen, ix.first_n(df, ["a", "b"], n).collect())) == order[:n]
    placed = ix.with_row_index(df, ["a", "b"], at_most=None).collect()
    assert sorted(r.idx for r in placed) == list(range(len(rows)))
    assert [seen(r) for r in sorted(placed, key=lambda r: r.idx)] == order
    assert sorted(r.t for r in placed) == sorted(t for _, _, t in rows)


@pytest.mark.parametrize("slice_seconds", [1, 60, 10_000])
def test_group_index_on_a_hot_group(spark, slice_seconds):
    df = spark.range(6_000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).when(
            F.col("id") % 100 == 1, F.lit(None)).otherwise(
            (F.col("id") % 40).cast("string")).alias("k"),
        F.timestamp_seconds((F.col("id") * 7919) % 500).alias("ts"))
    want, seen = {}, {}
    for r in df.orderBy("ts", "id").collect():
        want[r.id] = seen[r.k] = seen.get(r.k, -1) + 1
    got = ix.with_group_index(df, ["k"], "ts", "id", "i", slice_seconds).collect()
    assert {r.id: r.i for r in got} == want
