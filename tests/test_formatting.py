"""Number and string text against Python's own."""

from __future__ import annotations

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from runlens.functions import formatting as fm


def column(spark, values, kind):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def applied(spark, values, kind, fn):
    rows = column(spark, values, kind).select("i", fn(F.col("v")).alias("t")).collect()
    return [r.t for r in sorted(rows, key=lambda r: r.i)]


def numbers():
    rng = random.Random(11)
    ties = [i / 8 for i in range(-40, 40)] + [i / 100 + 0.005 for i in range(300)]
    near = [0.15, 0.25, 0.35, 2.675, 1.005, 0.045, 9.995, 99.95, 0.5, 1.5, 2.5, 0.0]
    wild = [rng.uniform(-1e6, 1e6) for _ in range(300)]
    small = [rng.random() * 10 ** -rng.randint(0, 9) for _ in range(300)]
    return ties + near + wild + small


@pytest.mark.parametrize("digits", [0, 1, 2])
def test_fixed_equals_python(spark, digits):
    values = [v for v in numbers() if v >= 0]
    assert applied(spark, values, "double", lambda c: fm.fixed(c, digits)) == [
        f"{v:.{digits}f}" for v in values]


def test_float_text_equals_python(spark):
    rng = random.Random(5)
    values = [0.0, 0.6, 1.0, 100.0, 1e-3, 1e-4, 1.5e-4, 1e-5, 2.5e-7, 1e7, 12345678.0,
              1234567.5, 12345678.9, 1e15, 123456789012345.6, 1e16, 1.5e16, 1e22, 1e100,
              -0.1, -1e-5, -2e7, -3.25e20, math.inf, -math.inf]
    values += [round(rng.uniform(0, 2), 3) for _ in range(50)]
    assert applied(spark, values, "double", fm.python_float) == [repr(v) for v in values]
    assert applied(spark, values, "double", fm.json_number) == [json.dumps(v) for v in values]


def test_json_strings_equal_python(spark):
    values = ["plain", "", 'quo"te', "back\\slash", "tab\tnew\nline\r", "\b\f\x01\x7f",
              "é", "日本", "😀 mixed é", "a/b", "'single'", " ~!"]
    assert applied(spark, values, "string", fm.json_ascii_string) == [
        json.dumps(v) for v in values]


def test_quotes_equal_python(spark):
    values = ["gpt2_dev", "it's", 'say "x"', "a\\b", "both ' and \""]
    assert applied(spark, values, "string", fm.python_quoted) == [repr(v) for v in values]
