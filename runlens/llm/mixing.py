"""Mixing documents to target domain weights, with soft domain membership.

Everything here is DataFrame work. A Bernoulli word model, fitted on a bounded
sample of a labelled table, gives each document a posterior over domains. Then
rates (expected copies of each document) are fitted by projected gradient: the
gradient of the squared misses of domain token totals needs only one number a
domain, so each step is one aggregation, and each document moves on its own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from runlens.llm.rows import unwrapped, wrapped
from runlens.session import materialize

#: labelled documents the model is fitted on, and words it knows: the most telling
MAX_LABELLED, MAX_WORDS = 5_000, 4_000
#: documents of the sample that a word stands in at least, the squared deviation
#: (in standard errors) from which it counts for a domain, and pseudo-documents
#: at its overall share
LEAST_DOCUMENTS, LEAST_SIGNAL, PRIOR_DOCUMENTS = 4, 25.0, 5.0
STEPS, STEPS_A_TABLE, TOLERANCE = 60, 8, 1e-5

_EVERY = "\\n"  # no word holds a newline, so this marks every document


def tokens(text: Column) -> Column:
    """White-space separated words of the whole text."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), "\n\t\r", "   "), " "),
                    lambda w: w != "")


def _marks(text: Column) -> Column:
    """Coarse shares of capitals and of marks, as words of their own."""
    size = F.greatest(F.char_length(text), F.lit(1))
    capitals = size - F.char_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    marks = size - F.char_length(F.translate(text, "!|#%$&*@", ""))
    return F.array(F.concat(F.lit("\n capitals "), F.floor(10 * capitals / size).cast("string")),
                   F.concat(F.lit("\n marks "), F.floor(40 * marks / size).cast("string")))


def _words(docs: DataFrame) -> DataFrame:
    """One row per document and distinct word, with the document's tokens."""
    text = F.coalesce("text", F.lit(""))
    return docs.withColumn("w", tokens(text)) \
        .withColumn("n_tokens", F.size("w").cast("long")) \
        .withColumn("word", F.explode(F.concat(
            F.array_distinct("w"), _marks(text), F.array(F.lit(_EVERY))))).drop("w", "text")


def fit_words(docs: DataFrame, labelled: DataFrame, domains: list[str],
              max_labelled: int = MAX_LABELLED, max_words: int = MAX_WORDS) -> DataFrame:
    """Evidence of the words that tell domains apart.

    ``labelled`` has doc_id and domain; the ``max_labelled`` first by a hash of
    the id are used, equal texts of a domain once. Returns word and w (array of
    double, by ``domains``): the log of how much more often than overall the
    word stands in a document of the domain, or 0 where its count there is no
    more than chance; where it is more frequent, its absence counts against the
    domain. There are at most ``max_words`` rows, those that deviate
    most, and one more, which stands for every document and holds the smoothed
    log shares of the domains and the evidence of absence.
    """
    chosen = labelled.where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull()) \
        .select(F.col("doc_id").cast("long").alias("doc_id"), "domain").distinct() \
        .orderBy(F.xxhash64("doc_id"), "doc_id", "domain").limit(max_labelled)
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text") \
        .join(F.broadcast(chosen), "doc_id").dropDuplicates(["domain", "text"])
    counts = materialize(_words(sample).groupBy("word").agg(*(
        F.count(F.when(F.col("domain") == d, 1)).cast("double").alias(f"n{i}")
        for i, d in enumerate(domains))), "domain-words")
    whole = counts.where(F.col("word") == _EVERY).first()
    sizes = [float(whole[f"n{i}"]) if whole else 0.0 for i in range(len(domains))]
    total = sum(sizes)
    odds, absent, signals = [], [], []
    for i, size in enumerate(sizes):
        part = size / total if total else 0.0
        spread = F.greatest(F.col("seen") * (part * (1 - part)), F.lit(1e-9))
        signal = F.pow(F.col(f"n{i}") - F.col("seen") * part, 2) / spread
        share = F.col("seen") / (total + 1.0)
        within = (F.col(f"n{i}") + PRIOR_DOCUMENTS * share) / (size + PRIOR_DOCUMENTS + 1.0)
        lack = F.when((signal >= LEAST_SIGNAL) & (within > share),
                      F.log((1 - within) / (1 - share))).otherwise(0.0)
        odds.append(F.when(signal < LEAST_SIGNAL, 0.0).otherwise(F.log(within / share)) - lack)
        absent.append(lack)
        signals.append(signal)
    telling = materialize(counts.where(F.col("word") != _EVERY)
        .withColumn("seen", sum((F.col(f"n{i}") for i in range(len(domains))), F.lit(0.0)))
        .where(F.col("seen") >= LEAST_DOCUMENTS)
        .withColumn("signal", F.greatest(*signals, F.lit(0.0)))
        .where(F.col("signal") >= LEAST_SIGNAL)
        .orderBy(F.desc("signal"), "word").limit(max_words)
        .select("word", F.array(*odds).alias("w"), F.array(*absent).alias("absent")), "telling-words")
    # a document starts as if it held none of the words
    without = telling.agg(*(F.sum(F.col("absent")[i]).alias(f"a{i}")
                            for i in range(len(domains)))).first()
    prior = [math.log((size + 1.0) / (total + len(domains))) + (without[f"a{i}"] or 0.0)
             for i, size in enumerate(sizes)]
    marker = counts.sparkSession.range(1).select(
        F.lit(_EVERY).alias("word"), F.array(*map(F.lit, prior)).alias("w"))
    return telling.select("word", "w").unionByName(marker)


def memberships(docs: DataFrame, words: DataFrame, n_domains: int) -> DataFrame:
    """(doc_id, version, copies, tokens, p): posterior of each distinct document.

    ``version`` is a hash of the text; rows equal in both are one document with
    as many copies. ``words`` is at most as long as ``fit_words`` says, so it
    goes to every task. A text without known words has the domain shares.
    """
    hits = _words(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), "text")) \
        .join(F.broadcast(words), "word")
    # every copy of a row brings its words and the row for every document again
    scores = hits.groupBy("doc_id", "version").agg(
        F.count(F.when(F.col("word") == _EVERY, 1)).alias("copies"),
        F.max("n_tokens").alias("tokens"),
        *(F.sum(F.col("w")[i]).alias(f"s{i}") for i in range(n_domains)))
    logs = F.array(*(F.col(f"s{i}") / F.col("copies") for i in range(n_domains)))
    return scores.withColumn("l", logs).withColumn("top", F.array_max("l")) \
        .withColumn("e", F.expr("transform(l, x -> exp(x - top))")) \
        .withColumn("sum", F.expr("aggregate(e, 0D, (a, x) -> a + x)")) \
        .select("doc_id", "version", "copies", "tokens", F.expr("transform(e, x -> x / sum)").alias("p"))


def _totals(rows: DataFrame, rate: Column, n: int) -> list[float]:
    """Expected tokens of each domain at the given rates; one row is collected."""
    row = rows.agg(*(F.sum(F.col("copies") * F.col("tokens") * rate * F.col("p")[i]).alias(f"t{i}")
                     for i in range(n))).first()
    return [float(row[i] or 0.0) for i in range(n)]


def fit_rates(members: DataFrame, targets: list[float], most: float | None = None,
              steps: int = STEPS) -> DataFrame:
    """Nonnegative document rates whose domain totals come nearest to ``targets``.

    Minimises the sum over domains of (total - target)^2 / target, over rates
    between 0 and ``most``, by projected gradient from the rates that the
    document's domains would need on their own. Documents move in the metric of
    their tokens, so the gradient is the posterior's mean of the relative
    misses; the step is the inverse of the largest eigenvalue of a matrix of
    one entry per pair of domains. ``members`` is a written table and is read
    once a step; only one number per domain reaches the driver.
    """
    n = len(targets)
    weight = [1.0 / max(t, 1.0) for t in targets]
    gram_row = members.agg(*(
        F.sum(F.col("copies") * F.col("tokens") * F.col("p")[i] * F.col("p")[j]).alias(f"g{i}_{j}")
        for i in range(n) for j in range(n))).first()
    gram = [[float(gram_row[i * n + j] or 0.0) * math.sqrt(weight[i] * weight[j])
             for j in range(n)] for i in range(n)]
    step = 1.0 / max(_largest(gram), 1e-12)
    now = _totals(members, F.lit(1.0), n)

    def boxed(rate: Column) -> Column:
        low = F.greatest(rate, F.lit(0.0))
        return low if most is None else F.least(low, F.lit(float(most)))

    needed = [t / s if s > 0 else 0.0 for t, s in zip(targets, now)]
    rates = members.withColumn("rate", boxed(sum(
        (F.col("p")[i] * needed[i] for i in range(n)), F.lit(0.0))))
    last = None
    for k in range(steps):
        if k % STEPS_A_TABLE == 0:
            rates = materialize(rates, "rates")
        totals = _totals(rates, F.col("rate"), n)
        miss = [w * (s - t) for w, s, t in zip(weight, totals, targets)]
        loss = sum(m * (s - t) for m, s, t in zip(miss, totals, targets))
        if last is not None and last - loss <= TOLERANCE * max(last, 1.0):
            break
        last = loss
        move = sum((F.col("p")[i] * (step * miss[i]) for i in range(n)), F.lit(0.0))
        rates = rates.withColumn("rate", boxed(F.col("rate") - move))
    return rates


def _largest(matrix: list[list[float]], rounds: int = 100) -> float:
    """Largest eigenvalue of a symmetric nonnegative matrix, by power iteration."""
    n = len(matrix)
    v, value = [1.0] * n, 0.0
    for _ in range(rounds):
        w = [sum(a * x for a, x in zip(row, v)) for row in matrix]
        value = max(map(abs, w), default=0.0)
        if value == 0.0:
            return 0.0
        v = [x / value for x in w]
    # an upper bound at the end, in case the iteration has not settled
    return min(sum(matrix[i][i] for i in range(n)), value * 1.01)


def mixture(docs: DataFrame, labelled: DataFrame, shares: dict[str, float],
            budget: float | None = None, full: str | None = None,
            most: float | None = None) -> DataFrame:
    """Rates that bring the token shares of domains to ``shares``.

    ``docs`` needs doc_id and text, ``labelled`` doc_id and domain; other
    columns are ignored. Tokens are white-space separated words. Shares are
    scaled to sum to one. The targets add up to ``budget`` tokens; by default
    to all tokens, or, if a domain is named as ``full``, to as many as let that
    domain keep its expected tokens. ``most`` bounds the rates. Labels of other
    domains are ignored; without any label all domains are equally likely. A
    null or empty text has no tokens, so its rate bears on nothing: it follows
    the domain shares. Null ids are documents like others.

    Returns one row per distinct (doc_id, text): doc_id, version (xxhash64 of
    the text), copies (its rows), tokens, p (posteriors in the order of
    ``shares``) and rate. An empty table gives an empty result.
    """
    domains = list(shares)
    words = fit_words(docs, labelled, domains)
    members = materialize(memberships(docs, words, len(domains)), "members")
    totals = _totals(members, F.lit(1.0), len(domains))
    part = [shares[d] / sum(shares.values()) for d in domains]
    if budget is None:
        budget = totals[domains.index(full)] / part[domains.index(full)] if full else sum(totals)
    return fit_rates(members, [budget * x for x in part], most)


def apply_rates(docs: DataFrame, rates: DataFrame, slack: float = 0.0) -> DataFrame:
    """``docs`` with every row repeated, or left out, by its document's rate.

    A rate is rounded up or down by a hash of the document, so that copies come
    out as the rate in the mean, however small it is. Only a rate below one by
    at most ``slack`` counts as one, for a domain that is to stay in full. All
    columns are kept, whatever their names.
    """
    part = "(pmod(xxhash64(doc_id, version, 17), 1000000) / 1000000D)"
    times = rates.select(F.col("doc_id").alias("d"), F.col("version").alias("v"), F.expr(
        f"cast(if(rate < 1 and 1 - rate <= {slack!r}, 1, "
        f"floor(rate + {part})) as int)").alias("times"))
    rows = wrapped(docs)
    # merged at every size; a null id matches itself
    return rows.join(times.hint("merge"), F.col("doc_id").eqNullSafe(F.col("d"))
                     & (F.col("version") == F.col("v"))).where("times > 0") \
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))) \
        .select(*unwrapped(rows, docs.columns))


def label_domains(labels: DataFrame) -> DataFrame:
    """The labelled table as domains: toxic, low (poor quality) and clean."""
    return labels.select("doc_id", F.when(F.col("toxic") > 0, "toxic")
                         .when(F.col("quality") > 0, "clean")
                         .when(F.col("quality") == 0, "low").alias("domain"))
