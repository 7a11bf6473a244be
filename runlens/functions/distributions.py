"""Probability vectors held as ``array<double>`` (small vocabularies).

Higher-order functions run interpreted, so these suit vectors of up to a few
hundred entries; ``operators.long_form`` has the row-per-token twins for
large vocabularies. Every fold below is linear in the vector length.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def keyed_uniform(seed: int, tag: str, key: Column) -> Column:
    """A uniform in [0, 1) that depends on the key only.

    Unlike ``rand()`` it survives repartitioning, retries and restarts.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:{tag}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(2.0 ** 32)


def vector_sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def argmax(v: Column) -> Column:
    """0-based index of the largest entry; the first one on ties."""
    return F.array_position(v, F.array_max(v)).cast("long") - 1


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def softmax(logits: Column, temperature: Column | float) -> Column:
    """softmax(logits / temperature), shifted by the maximum before exp."""
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    return let(F.array_max(logits), lambda top: let(
        F.transform(logits, lambda z: F.exp((z - top) / t)),
        lambda e: let(vector_sum(e), lambda total: F.transform(e, lambda x: x / total))))


def pick(probs: Column, u: Column) -> Column:
    """Inverse-CDF draw: 0-based index of the first entry with CDF above ``u``.

    Entries of probability zero are never drawn; where rounding leaves the
    last CDF value at or below ``u``, the last possible entry is taken.
    """
    start = F.struct(F.lit(0.0).alias("cdf"), F.lit(0).alias("i"),
                     F.lit(-1).alias("hit"), F.lit(-1).alias("last"))

    def step(acc: Column, x: Column) -> Column:
        cdf = acc["cdf"] + x
        return F.struct(
            cdf.alias("cdf"), (acc["i"] + 1).alias("i"),
            F.when((acc["hit"] < 0) & (x > 0) & (cdf > u), acc["i"])
            .otherwise(acc["hit"]).alias("hit"),
            F.when(x > 0, acc["i"]).otherwise(acc["last"]).alias("last"))

    return F.aggregate(
        probs, start, step,
        lambda a: F.when(a["hit"] >= 0, a["hit"]).otherwise(a["last"])).cast("long")


def sample(logits: Column, temperature: Column, u: Column) -> Column:
    """Greedy at temperature 0, otherwise a draw from the tempered softmax."""
    safe = F.when(temperature == 0, F.lit(1.0)).otherwise(temperature)
    return F.when(temperature == 0, argmax(logits)).otherwise(
        pick(softmax(logits, safe), u))


def accept_probability(p: Column, q: Column, token: Column) -> Column:
    """min(1, p/q) at the drafted token; null where q is 0 (bad input)."""
    pt, qt = F.get(p, token.cast("int")), F.get(q, token.cast("int"))
    return F.when(qt > 0, F.least(F.lit(1.0), pt / qt))


def same_vocabulary(p: Column, q: Column) -> Column:
    """``zip_with`` pads a shorter vector with nulls, so sizes are checked."""
    return F.size(p) == F.size(q)


def positive_part(p: Column, q: Column) -> Column:
    return F.zip_with(p, q, lambda a, b: F.greatest(a - b, F.lit(0.0)))


def residual_mass(p: Column, q: Column) -> Column:
    return vector_sum(positive_part(p, q))


def residual(p: Column, q: Column) -> Column:
    """max(0, p-q) scaled to sum 1; null where p equals q (nothing is left)."""
    return let(positive_part(p, q), lambda d: let(
        vector_sum(d),
        lambda z: F.when(z > 0, F.transform(d, lambda x: x / z))))


def overlap(p: Column, q: Column) -> Column:
    """Sum of min(p, q): the expected acceptance at this position."""
    return vector_sum(F.zip_with(p, q, lambda a, b: F.least(a, b)))


def preserves_target(p: Column, q: Column, tolerance: float = 1e-12) -> Column:
    """min(q,p) + max(0,p-q) gives p back at every token."""
    gap = F.zip_with(p, q, lambda a, b: F.abs(
        F.least(a, b) + F.greatest(a - b, F.lit(0.0)) - a))
    return F.forall(gap, lambda g: g < F.lit(tolerance))


def quantize(logits: Column, levels: int = 7) -> Column:
    """Symmetric uniform rounding to ``levels`` steps on either side of 0."""
    top = F.array_max(F.transform(logits, lambda x: F.abs(x)))
    return let(top, lambda m: F.when(m > 0, F.transform(
        logits, lambda x: F.round(x / m * levels) * m / levels)).otherwise(logits))


def expected_tokens(beta: Column, k: Column) -> Column:
    """Mean tokens per round with per-token acceptance beta and k drafts."""
    return F.when(beta == 1, (k + 1).cast("double")).otherwise(
        (F.lit(1.0) - F.pow(beta, k + 1)) / F.when(beta != 1, F.lit(1.0) - beta))


def modelled_speedup(beta: Column, k: Column, cost_ratio: Column) -> Column:
    return expected_tokens(beta, k) / (F.lit(1.0) + cost_ratio * k)


def break_even_beta(k: Column, cost_ratio: Column) -> Column:
    """The usual approximation ck/(1+ck) of the break-even acceptance."""
    return cost_ratio * k / (F.lit(1.0) + cost_ratio * k)


def optimal_draft_length(beta: Column, epsilon: float = 0.05) -> Column:
    """Smallest k with beta^k below epsilon; null outside 0 < beta < 1."""
    inside = (beta > 0) & (beta < 1)
    return F.when(inside, F.ceil(F.log(F.lit(epsilon)) / F.log(
        F.when(inside, beta))).cast("long"))
