"""Document quality by hierarchical empirical Bayes.

A logistic model of the text gives each document a probability of its own.
Hosts, and paths within hosts, get posterior means of these probabilities,
shrunk towards the level above by as much as the spread between sites warrants.
A document's final probability is its own, moved by how far the rest of its
site lies from the global mean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from runlens.llm.hashing import lines, slabs, words
from runlens.session import materialize

#: labelled documents used for the fit, the first by a hash of their id
MAX_LABELLED = 20_000
THRESHOLD = 0.5

#: byte classes counted per text; the rest of ASCII and other bytes stand alone
_GROUPS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789",
           " ", "\n\r\t", ".", ",", "!", "?", "|", "#", "%", "$", "&", "*", "@", "'\"`",
           "()[]{}", "<>=/\\+~^_-", ":;")
_CLASS = np.full(256, len(_GROUPS), dtype=np.int64)
for _n, _group in enumerate(_GROUPS):
    for _c in _group:
        _CLASS[ord(_c)] = _n
_CLASS[128:] = len(_GROUPS) + 1
_CLASSES = len(_GROUPS) + 2
FEATURES = _CLASSES + 9


def features_of(column: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` numbers per text, over its whole length."""
    out = [np.empty((0, FEATURES))]
    for first, last, text, rows in slabs(column):
        n = last - first
        size = np.diff(rows)
        owner = np.repeat(np.arange(n), size)
        counts = np.bincount(owner * _CLASSES + _CLASS[text], minlength=n * _CLASSES) \
            .reshape(n, _CLASSES)
        share = np.log1p(1000 * counts / np.maximum(size, 1)[:, None])
        hashes, starts, ends, at = words(text, rows)
        n_words, long_ = np.diff(at), ends - starts
        capital = (text[starts] >= 65) & (text[starts] <= 90) if len(starts) else starts > 0
        marked = np.array([], dtype=bool)
        if len(starts):
            marked = ~np.isin(_CLASS[text[np.maximum(ends - 1, 0)]], (0, 1, 2, _CLASSES - 1))
        line_hash, line_start, line_end, line_at = lines(text, rows)
        extra = np.zeros((n, 9))
        extra[:, 0] = np.log1p(n_words)
        for column_, values in ((1, long_), (2, capital), (3, marked), (4, long_ > 15)):
            extra[:, column_] = _mean(values, at)
        extra[:, 5] = [len(set(hashes[a:b].tolist())) for a, b in zip(at[:-1], at[1:])] \
            / np.maximum(n_words, 1)
        n_lines = np.diff(line_at)
        extra[:, 6] = np.log1p(n_lines)
        extra[:, 7] = [len(np.unique(line_hash[a:b])) for a, b in zip(line_at[:-1], line_at[1:])] \
            / np.maximum(n_lines, 1)
        extra[:, 8] = np.log1p(_mean(line_end - line_start, line_at))
        out.append(np.concatenate([share, extra], axis=1))
    return np.concatenate(out)


def _mean(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(values.astype(np.float64)))
    return (total[at[1:]] - total[at[:-1]]) / np.maximum(np.diff(at), 1)


def document_features(docs: DataFrame, host: Column, path: Column) -> DataFrame:
    """(doc_id, version, host, path, words, x) for every row of ``docs``.

    ``version`` is a hash of the text, which tells rows of one doc_id apart.
    """
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x = features_of(part.column("text"))
            kept = [part.column(c) for c in ("doc_id", "version", "host", "path")]
            count = np.rint(np.expm1(x[:, _CLASSES])).astype(np.int64)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(0, x.size + 1, FEATURES, dtype=np.int32)),
                pa.array(x.astype(np.float32).reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(count), lists],
                names=["doc_id", "version", "host", "path", "words", "x"])

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"),
        host.cast("string").alias("host"), path.cast("string").alias("path"), "text") \
        .mapInArrow(batches, "doc_id long, version long, host string, path string, "
                             "words long, x array<float>")


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0,
                 rounds: int = 30) -> tuple[np.ndarray, float]:
    """Weights and offset on raw features, by Newton steps on standardised ones.

    With one class only, or no rows, the weights are zero and the offset is the
    log-odds of the smoothed class counts.
    """
    good, bad = float((y > 0.5).sum()), float((y <= 0.5).sum())
    if not good or not bad:
        return np.zeros(FEATURES), float(np.log((good + 1) / (bad + 1)))
    centre, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1
    z = np.column_stack([np.ones(len(x)), (x - centre) / scale])
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-9
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - y) + penalty * w
        hessian = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[1:] / scale, float(w[0] - (w[1:] * centre / scale).sum())


def _sample(features: DataFrame, labels: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``most`` labelled documents."""
    known = labels.where("doc_id is not null and quality is not null") \
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    rows = features.join(known, "doc_id").select("doc_id", "version", "quality", "x") \
        .orderBy(F.xxhash64("doc_id"), "doc_id", "version", "quality").limit(most).collect()
    x = np.array([r["x"] for r in rows], dtype=np.float64).reshape(-1, FEATURES)
    return x, np.array([float(r["quality"] > 0) for r in rows])


def _strength(sums: DataFrame, prior: Column) -> float:
    """Pseudo-count of the prior, from the spread of site means around it.

    Method of moments: the variance of site means is the variance between
    sites plus the sampling variance within. ``sums`` has n, s and q (sum of
    squares) per site; what is collected is one row.
    """
    mean = F.col("s") / F.col("n")
    within = F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))
    row = sums.where("n > 1").select(
        "n", prior.alias("m"), mean.alias("mean"), within.alias("within")).agg(
        F.sum("n").alias("n"),
        F.sum(F.expr("n * pow(mean - m, 2)")).alias("spread"),
        F.sum(F.expr("within * n / (n - 1)")).alias("noise"),
        F.sum(F.expr("n * m * (1 - m)")).alias("whole")).first()
    if not row["n"]:
        return 1e6
    between = (row["spread"] - row["noise"]) / row["n"]
    # no spread beyond chance: the sites tell nothing, the prior outweighs them
    if between <= 1e-9:
        return 1e6
    return float(min(1e6, max(0.1, row["whole"] / row["n"] / between - 1)))


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column,
             threshold: float = THRESHOLD, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Quality of every document of ``docs`` from its text, host and path.

    ``docs`` needs doc_id and text, ``labels`` doc_id and quality (1 is good);
    further columns are ignored except where ``host`` and ``path`` use them.
    A null host or path is a site of its own. The model is fitted on at most
    ``max_labelled`` labelled documents, every document takes part in the site
    statistics. A document without words (null, empty, blank) has probability 0
    and is left out of its site's statistics. Without labels, or with labels of
    one class, texts tell nothing and the smoothed label share is used for all.

    Returns one row per distinct (doc_id, text): doc_id, version (xxhash64 of
    the text), p_document, p_host, p_path, p_quality and kept.
    """
    features = materialize(document_features(docs, host, path), "features")
    weights, offset = fit_logistic(*_sample(features, labels, max_labelled))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x = part.column("x").flatten().to_numpy(zero_copy_only=False) \
                .astype(np.float64).reshape(-1, FEATURES)
            p = 1 / (1 + np.exp(-np.clip(x @ weights + offset, -30, 30)))
            p[part.column("words").to_numpy() == 0] = 0
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ("doc_id", "version", "host", "path", "words")),
                 pa.array(p)], names=["doc_id", "version", "host", "path", "words", "p"])

    scored = materialize(features.mapInArrow(
        batches, "doc_id long, version long, host string, path string, words long, p double")
        .distinct(), "scores")
    return _combined(scored, threshold)


def _combined(scored: DataFrame, threshold: float) -> DataFrame:
    paths = materialize(
        scored.where("words > 0").groupBy("host", "path").agg(
            F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"), F.sum(F.expr("p * p")).alias("q")),
        "path-sums")
    hosts = paths.groupBy("host").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = whole["s"] / whole["n"] if whole["n"] else 0.5
    mean = min(1 - 1e-6, max(1e-6, mean))
    k_host = _strength(hosts, F.lit(mean))
    hosts = hosts.select(
        F.col("host").alias("h"), F.col("n").alias("host_n"), F.col("s").alias("host_s"))
    sites = paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h") \
        .withColumn("host_mean", F.expr(f"(host_s + {k_host!r} * {mean!r}) / (host_n + {k_host!r})"))
    k_path = _strength(sites, F.col("host_mean"))
    sites = sites.select(F.col("host").alias("h"), F.col("path").alias("g"),
                         "n", "s", "host_n", "host_s")
    # a document's own share is taken out of its sites, so it counts once
    site = scored.join(sites, F.col("host").eqNullSafe(F.col("h"))
                       & F.col("path").eqNullSafe(F.col("g")), "left") \
        .withColumn("own", F.expr("if(words > 0, 1, 0)")) \
        .withColumn("p_host", F.expr(
            f"coalesce((host_s - own * p + {k_host!r} * {mean!r}) / (host_n - own + {k_host!r}), {mean!r})")) \
        .withColumn("p_path", F.expr(
            f"coalesce((s - own * p + {k_path!r} * p_host) / (n - own + {k_path!r}), p_host)"))
    odds = "ln(greatest({0}, 1e-9D) / greatest(1 - {0}, 1e-9D))"
    final = F.expr("if(words = 0, 0D, 1 / (1 + exp(-(" + odds.format("p") + " + "
                   + odds.format("p_path") + " - " + odds.format(repr(mean) + "D") + "))))")
    return site.select("doc_id", "version", F.col("p").alias("p_document"), "p_host", "p_path",
                       final.alias("p_quality")) \
        .withColumn("kept", F.col("p_quality") >= threshold)
