"""JSON arrays read in ranges, the bucketed result store, and rows of tokens."""

from __future__ import annotations

import io
import json
import random
import uuid

import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from runlens.operators import token_rows as tr
from runlens.plans import prompt_queries as pq
from runlens.sources import json_array as ja, result_store as rs

TEXTS = ['plain', '},{"prompt_id":"x"', 'ends with {', '{"', '\\', '\\"{"a', '}\n, {\t"domain"', 'é日本"', '',
         'tab\tline\n', '[{"a":1},{"b":2}]', "'{ \"'"]


def prompts(n, seed=0):
    rng = random.Random(seed)
    return [{"prompt_id": f"code_{i:03d}", "domain": "code", "raw_text": rng.choice(TEXTS) * rng.randint(0, 4),
             "token_count": i} for i in range(n)]


@pytest.mark.parametrize("style", [dict(indent=2), dict(), dict(separators=(",", ":"))])
def test_every_cut_finds_every_object_once(style):
    rows = prompts(60)
    data = json.dumps(rows, ensure_ascii=False, **style).encode()
    for width in (1, 7, 64, 1000, len(data)):
        got = []
        for at in range(0, len(data), width):
            got += ja.objects_in_range(io.BytesIO(data), at, min(at + width, len(data)), len(data))
        assert got == rows


def test_objects_longer_than_what_is_read_ahead(monkeypatch):
    monkeypatch.setattr(ja, "_AHEAD", 5000)
    rows = prompts(3) + [{"prompt_id": "b", "domain": "code", "raw_text": '{"' * 20_000, "token_count": 1}] + prompts(2, 1)
    data = json.dumps(rows).encode()
    got = [r for at in range(0, len(data), 900)
           for r in ja.objects_in_range(io.BytesIO(data), at, min(at + 900, len(data)), len(data))]
    assert got == rows


@pytest.mark.parametrize("text", [
    '{"prompt_id":"a"}', '[{"prompt_id":"a"}]', '[{"prompt_id":"a","domain":"code","raw_text":"t","token_count":"1"}]',
    '[{"prompt_id":"a","domain":"code","raw_text":"t","token_count":1,"more":2}]',
    '[{"prompt_id":"a","prompt_id":"b","domain":"code","raw_text":"t","token_count":1}]',
    '[{"prompt_id":"a","domain":"code","raw_text":"t","token_count":1}', '[1]', '', '[{}]',
    '[{"prompt_id":"a","domain":"code","raw_text":"t","token_count":1}, 5]',
    '[{"prompt_id":"a","domain":"code","raw_text":null,"token_count":1}]'])
def test_anything_else_raises(text):
    with pytest.raises(ValueError):
        ja.objects_in_range(io.BytesIO(text.encode()), 0, len(text), len(text))


def test_no_task_writes_all_prompts(spark, folder, monkeypatch):
    """The query's arrays are written by many tasks, and not all rows go through one."""
    sizes, save = [], pq.save_prompt_arrays

    def seen(prompts, path):
        sizes.append([n for n in prompts.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n])
        save(prompts, path)
    monkeypatch.setattr(pq, "save_prompt_arrays", seen)
    total = pq.prompts_array(spark, folder).count()
    assert sum(sizes[0]) == total and max(sizes[0]) < total


def test_empty_array():
    assert ja.objects_in_range(io.BytesIO(b" [ ] ".replace(b" ] ", b"]")), 0, 3, 3) == []


def test_round_trip_over_many_ranges(spark, tmp_path):
    rows = prompts(300)
    df = spark.createDataFrame([tuple(r.values()) for r in rows],
                               "prompt_id string, domain string, raw_text string, token_count long")
    ja.save_prompt_arrays(df.repartition(3), str(tmp_path / "a"))
    back = ja.load_prompt_arrays(spark, str(tmp_path / "a"), 500)
    assert back.rdd.getNumPartitions() > 20
    assert sorted(map(tuple, back.collect())) == sorted(tuple(r.values()) for r in rows)
    one = tmp_path / "one.json"
    one.write_text(json.dumps(rows, indent=2, ensure_ascii=False), encoding="utf-8")
    assert ja.load_prompt_arrays(spark, str(one), 2000).count() == 300
    one.write_text(json.dumps([{**rows[0], "domain": "poetry"}]))
    with pytest.raises(Exception, match="poetry"):
        ja.load_prompt_arrays(spark, str(one)).collect()
    assert pafs.LocalFileSystem().get_file_info(str(one)).size > 0


RESULTS = [(f"h{i % 5}", ("p1", "p2", "p3")[i % 3], f"q{i % 7}", i) for i in range(100)]
SCHEMA = "config_hash string, model_pair_name string, prompt_id string, run_idx long"


@pytest.fixture(params=[("config_hash",), ("config_hash", "prompt_id")])
def store(spark, tmp_path, request):
    name = f"store_{uuid.uuid4().hex}"
    rs.create_store(spark.createDataFrame(RESULTS, SCHEMA).repartition(6), name, str(tmp_path / "store"), 4,
                    request.param)
    yield name, request.param
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning"), plan


def test_store_side_is_not_moved(spark, store):
    name, by = store
    planned = spark.createDataFrame([(f"h{i}", f"q{j}") for i in range(8) for j in range(9)] + [(None, "q0")],
                                    "config_hash string, prompt_id string")
    pending = rs.pending_in_store(planned, name, by)
    n, plan = exchanges(pending)
    assert n == 1 and "Bucketed: true" in plan and "BroadcastHashJoin" not in plan
    done = {(h, q)[:len(by)] for h, _, q, _ in RESULTS}
    every = {(r.config_hash, r.prompt_id) for r in planned.collect()}
    assert {tuple(r) for r in pending.collect()} == {r for r in every if r[:len(by)] not in done}
    assert {tuple(r) for r in rs.planned_in_store(planned, name, by).collect()} \
        == {r for r in every if r[:len(by)] in done}
    groups = rs.results_per_config(spark, name, F.max("run_idx").alias("newest"))
    assert exchanges(groups)[0] == len(by) - 1
    assert {tuple(r) for r in groups.collect()} == {
        (f"h{i}", 20, max(r[3] for r in RESULTS if r[0] == f"h{i}")) for i in range(5)}


def test_a_pair_is_replaced_and_the_others_stay(spark, store):
    name, by = store
    fresh = [("h9", "p2", "q0", 500), ("h1", "p2", "q1", 501)]
    rs.replace_pairs(spark.createDataFrame(fresh, SCHEMA), name, 4, by)
    rows = {(r.config_hash, r.model_pair_name, r.prompt_id, r.run_idx) for r in spark.table(name).collect()}
    assert rows == {r for r in RESULTS if r[1] != "p2"} | set(fresh)


def test_token_rows(spark):
    def letters():
        class Letters:
            def encode(self, text):
                return [ord(c) for c in text]

            def decode(self, ids):
                return "".join(map(chr, ids))
        return Letters()
    rows = [(1, "a", "abc"), (2, None, "日本" * 40_000), (3, "b", None), (4, "b", ""), (1, "a", "abc")]
    df = spark.createDataFrame(rows, "id long, position string, text string")
    got = tr.token_rows(df, ["id", "position"], "text", letters).collect()
    want = [(i, g, p, ord(c)) for i, g, t in rows for p, c in enumerate(t or "")]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    cut = tr.counted_and_cut(df, ["id"], "text", letters, 5).collect()
    assert sorted(map(tuple, cut), key=repr) == sorted(
        [(i, len(t or ""), t[:5] if t else t) for i, _, t in rows], key=repr)
    assert tr.token_rows(df.where("id > 9"), ["id"], "text", letters).count() == 0
