"""Draft-and-verify rounds held as one row per (round, position).

Positions 0..K-1 carry a drafted token, the draft and target vectors and a
uniform; position K carries only the target vector, for the bonus token.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from runlens.functions import distributions as dist


def score_positions(drafts: DataFrame) -> DataFrame:
    """Acceptance probability and verdict of every drafted token."""
    return (
        drafts.withColumn("accept_prob", dist.accept_probability(
            F.col("p"), F.col("q"), F.col("tok")))
        .withColumn("accepted", F.col("u") <= F.col("accept_prob")))


def split_bad_vectors(positions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose vectors share a vocabulary, and the rejects."""
    ok = F.coalesce(dist.same_vocabulary(F.col("p"), F.col("q")), F.lit(False))
    return positions.where(ok), positions.where(~ok)


def accepted_prefix(scored: DataFrame) -> DataFrame:
    """Tokens before the first rejection of their round.

    A round has K rows by construction, so its window stays small.
    """
    rejected_at = F.min(F.when(~F.col("accepted"), F.col("pos"))).over(
        Window.partitionBy("round_id"))
    return (scored.withColumn("_stop", rejected_at)
            .where(F.col("_stop").isNull() | (F.col("pos") < F.col("_stop")))
            .drop("_stop"))


def round_output(positions: DataFrame, k: int, seed: int) -> DataFrame:
    """The tokens a round puts out: accepted prefix plus one final token.

    The final token comes from the residual at the first rejection, or from
    the target vector at position K if all drafts pass. Draws are made row by
    row, so only scalars are shuffled and not the vectors.
    """
    u_final = dist.keyed_uniform(seed, "final", F.col("round_id"))
    scored = score_positions(positions)
    bonus = F.col("pos") == k
    scored = scored.withColumn(
        "final", F.when(bonus, dist.pick(F.col("p"), u_final))
        .when(~F.col("accepted"), dist.pick(
            dist.residual(F.col("p"), F.col("q")), u_final))
    ).select("round_id", "pos", "tok", "accepted", "final")
    drafted = F.col("pos") < k
    rounds = scored.groupBy("round_id").agg(
        F.min(F.when(drafted & ~F.col("accepted"), F.col("pos"))).alias("_stop"),
        F.min_by("final", F.when(F.col("final").isNotNull(), F.col("pos"))).alias("_final"),
        F.sort_array(F.collect_list(F.when(drafted, F.struct("pos", "tok")))).alias("_toks"))
    n = F.coalesce("_stop", F.lit(k)).cast("int")
    return rounds.select(
        "round_id", n.cast("long").alias("n_accepted"),
        F.when(F.col("_stop").isNull(), F.lit("bonus"))
        .otherwise(F.lit("replacement")).alias("final_kind"),
        F.concat(F.slice(F.transform("_toks", lambda t: t["tok"]), F.lit(1), n),
                 F.array("_final")).alias("tokens"))


def round_offsets(rounds: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
    """Place of each round's first token in the run's output.

    ``keys`` must identify a run, whose number of rounds its token cap bounds.
    """
    w = Window.partitionBy(*keys).orderBy(*order_by).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("accepted") + 1).over(w)
    return (rounds.withColumn("end_offset", end)
            .withColumn("start_offset", F.col("end_offset") - F.col("accepted") - 1))
