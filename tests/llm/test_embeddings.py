"""The projection forest against all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from runlens.llm import embeddings


def brute(rows, threshold):
    usable = [(i, l, np.array(v, dtype=float)) for i, v, l in rows
              if i is not None and l is not None and v and None not in v
              and np.isfinite(v).all() and np.any(v)]
    links = {i: set() for i, _, _ in rows if i is not None}
    for n, (i, l, v) in enumerate(usable):
        for j, m, w in usable[n + 1:]:
            if l == m and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= threshold:
                links[i].add(j)
                links[j].add(i)
    out = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        out[i] = (len(links[i]), min(seen), min(seen) == i)
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    rows, n = [], 0
    for group in range(40):
        centre = rng.standard_normal(32)
        for _ in range(60 if group == 0 else 8):
            rows.append((n, (centre + rng.standard_normal(32) * rng.choice([0.05, 0.14, 0.5])).tolist(),
                         group % 3))
            n += 1
    rows += [(n + k, rows[k][1], rows[k][2]) for k in range(5)]
    one = rows[0][1]
    rows += [(9000, None, 0), (9001, [], 0), (9002, [0.0] * 32, 0), (9003, [float("nan")] * 32, 0),
             (9004, one, None), (9005, one[:5], 0), (9006, [float("inf"), *one[1:]], 0),
             (9007, [None, *one[1:]], 0)]
    return rows


SCHEMA = "vec_id long, embedding array<double>, label int"


def result(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in df.collect()}


def test_all_links_are_found_and_no_others(spark, vectors):
    assert result(embeddings.near_vectors(spark.createDataFrame(vectors, SCHEMA))) \
        == brute(vectors, 0.98)


def test_leaves_split_and_compared_in_blocks(spark, vectors, monkeypatch):
    monkeypatch.setattr(embeddings, "LEAF", 24)
    monkeypatch.setattr(embeddings, "BLOCK", 10)
    monkeypatch.setattr(embeddings, "SAMPLE", 60)
    got = result(embeddings.near_vectors(spark.createDataFrame(vectors, SCHEMA)))
    want = brute(vectors, 0.98)
    found = sum(n for n, _, _ in got.values())
    assert found >= 0.98 * sum(n for n, _, _ in want.values())
    assert all(got[i][0] <= want[i][0] for i in want)


def test_null_ids_repeats_and_an_empty_table(spark):
    rows = [(1, [1.0, 0.0], 0, 5), (1, [1.0, 0.0], 0, 6), (2, [1.0, 0.01], 0, 7), (None, [1.0, 0.0], 0, 8)]
    df = spark.createDataFrame(rows, SCHEMA + ", n_links int")
    got = sorted((tuple(r) for r in embeddings.near_vectors(df).collect()), key=repr)
    assert got == sorted([(1, 1, 1, True), (2, 1, 1, False), (None, 0, None, True)], key=repr)
    assert embeddings.near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
