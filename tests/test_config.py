"""Labels, round trips and fingerprints of configs."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from runlens.functions import config as cf
from runlens.operators import matrix as mx
from runlens.schemas import CONFIG, DOMAINS, MODEL_PAIRS

BASE = ("gpt2_dev", None, 0.0, 128, "code", 42)


def configs(spark, *rows):
    return spark.createDataFrame(list(rows), CONFIG)


def python_hash(row):
    text = json.dumps(dict(zip(CONFIG.fieldNames(), row)), sort_keys=True, ensure_ascii=True)
    return hashlib.sha256(text.encode()).hexdigest()[:12]


def test_known_fingerprints(spark):
    rows = [BASE, ("gpt2_dev", 2, 0.0, 128, "code", 42), ("gpt2_dev", 4, 0.0, 128, "code", 42)]
    got = [r.h for r in configs(spark, *rows).select(cf.config_hash().alias("h")).collect()]
    assert got == ["2f056cef3985", "9a5ff566cc30", "a5ae99a9ebb4"]


def test_fingerprints_equal_python(spark):
    rows = [BASE, ("pär \"x\" \\ 😀", 8, 1e-5, 1, "tab\t", -7), ("n", None, 1e7, 0, "", 0),
            ("n", 1, 2.5e20, 64, "d", 1), ("n", 1, 0.1 + 0.2, 64, "d", 1)]
    got = [r.h for r in configs(spark, *rows).select(cf.config_hash().alias("h")).collect()]
    assert got == [python_hash(r) for r in rows]


def test_fingerprint_depends_on_every_field(spark):
    changed = [("phi3_llama3", None, 0.0, 128, "code", 42), ("gpt2_dev", 4, 0.0, 128, "code", 42),
               ("gpt2_dev", None, 0.6, 128, "code", 42), ("gpt2_dev", None, 0.0, 64, "code", 42),
               ("gpt2_dev", None, 0.0, 128, "conversation", 42),
               ("gpt2_dev", None, 0.0, 128, "code", 7)]
    df = configs(spark, BASE, *changed).select(cf.config_hash().alias("h"))
    assert df.distinct().count() == 7
    assert all(len(r.h) == 12 for r in df.collect())


def test_labels_and_display(spark):
    rows = configs(spark, BASE, ("gpt2_dev", 4, 0.6, 128, "code", 42)).select(
        cf.decoder_label(F.col("K")).alias("label"), cf.is_drafted(F.col("K")).alias("d"),
        cf.display().alias("text")).collect()
    assert [(r.label, r.d) for r in rows] == [("AR", False), ("SD-K4", True)]
    assert rows[1].text == ("BenchmarkConfig(pair='gpt2_dev', decoder=SD-K4, domain='code', "
                            "temp=0.6, max_new=128, seed=42)")


def test_json_round_trip_keeps_null_k(spark):
    df = configs(spark, BASE, ("x", 3, 0.25, 1, "code", 0))
    text = df.select(cf.to_json().alias("t"))
    assert '"K":null' in text.first().t
    back = text.select(cf.from_json(F.col("t")).alias("c")).select("c.*")
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_dimension_has_every_combination_once(spark):
    dim = mx.config_dimension(spark, (None, 1, 2, 4, 8))
    assert dim.count() == len(MODEL_PAIRS) * len(DOMAINS) * 5 * 2
    assert dim.select("config_hash").distinct().count() == dim.count()


def test_pending_and_selected(spark):
    planned = spark.createDataFrame([("a",), ("b",), ("c",)], "config_hash string")
    done = spark.createDataFrame([("b", 1), ("b", 2), ("z", 3)], "config_hash string, v int")
    assert {r[0] for r in mx.pending(planned, done).collect()} == {"a", "c"}
    assert sorted(r.v for r in mx.selected(done, planned).collect()) == [1, 2]


@pytest.mark.parametrize("runs, temps", [(5, (0.0, 0.6)), (1, (0.3,))])
def test_run_matrix_size(spark, runs, temps):
    prompts = spark.createDataFrame([("p0",), ("p1",)], "prompt_id string")
    m = mx.run_matrix(prompts, temps, runs)
    assert m.count() == 2 * len(temps) * runs
    assert m.distinct().count() == m.count()
