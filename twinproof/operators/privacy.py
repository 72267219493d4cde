"""Privacy metrics: anonymity groups, attacker scores and disclosure."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinproof.functions.scalar import attack_score, disclosure_score, ratio
from twinproof.operators.distributions import divergences
from twinproof.operators.running import running_totals


def k_anonymity(synth: DataFrame, quasi_identifiers: Sequence[str], k: int = 5) -> DataFrame:
    """One row: smallest and mean group, violating records, score, passed.

    Rows with a null quasi-identifier belong to no group but stay in the
    denominator of the violation rate.
    """
    qi = [c for c in quasi_identifiers if c in synth.columns]
    if not qi:
        raise ValueError("no valid quasi-identifiers")
    groups = synth.groupBy(*qi).agg(F.count("*").alias("size"))
    known = F.lit(True)
    for c in qi:
        known = known & F.col(c).isNotNull()
    size = F.when(known, F.col("size"))
    return groups.agg(
        F.min(size).alias("min_k"),
        F.avg(size).alias("mean_k"),
        F.coalesce(F.sum(F.when(size < k, size)), F.lit(0)).alias("violating_records"),
        F.sum("size").alias("n_rows"),
    ).select(
        "min_k",
        "mean_k",
        F.lit(k).alias("k_threshold"),
        "violating_records",
        ratio(F.col("violating_records"), F.col("n_rows")).alias("violation_rate"),
        F.least(F.lit(100.0), F.col("min_k") / k * 100).alias("score"),
        (F.col("min_k") >= k).alias("passed"),
    )


def k_anonymity_evaluator(synth: DataFrame, quasi_identifiers: Sequence[str]) -> DataFrame:
    """Evaluator variant: score 10 per achieved k; no identifiers scores 100."""
    qi = [c for c in quasi_identifiers if c in synth.columns]
    if not qi:
        return synth.sparkSession.range(1).select(
            F.lit(None).cast("bigint").alias("achieved_k"),
            F.lit(None).cast("double").alias("avg_group_size"),
            F.lit(0).cast("bigint").alias("num_groups"),
            F.lit(100.0).alias("k_score"),
        )
    groups = synth.dropna(subset=qi).groupBy(*qi).agg(F.count("*").alias("size"))
    return groups.agg(
        F.min("size").alias("achieved_k"), F.avg("size").alias("avg_group_size"), F.count("*").alias("num_groups")
    ).withColumn("k_score", F.least(F.lit(100.0), F.col("achieved_k") * 10.0))


def disclosure(real: DataFrame, synth: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: mean and largest total variation over the sensitive columns."""
    return (
        divergences(real, synth, columns)
        .agg(F.avg("tv_distance").alias("mean_tv"), F.max("tv_distance").alias("max_tv"))
        .select(
            "mean_tv",
            "max_tv",
            disclosure_score(F.col("mean_tv")).alias("score"),
            F.col("mean_tv").between(0.05, 0.3).alias("passed"),
        )
    )


def attack_result(predictions: DataFrame, label: str, predicted: str) -> DataFrame:
    """Score of a membership attacker from its predictions."""
    accuracy = F.col("attack_accuracy")
    hit = F.avg((F.col(label) == F.col(predicted)).cast("double"))
    return predictions.agg(hit.alias("attack_accuracy")).select(
        "attack_accuracy",
        F.lit(0.5).alias("baseline_accuracy"),
        F.abs(accuracy - 0.5).alias("privacy_leakage"),
        attack_score(accuracy).alias("score"),
        (accuracy < 0.6).alias("passed"),
    )


def roc_auc(predictions: DataFrame, label: str, score: str) -> DataFrame:
    """One row: area under the ROC curve as a rank sum, ties counted half.

    Equal scores are counted first and ranks come from bucketed running
    totals, so neither a popular score nor a long tail needs one big task.
    """
    positive = F.col(label).cast("int")
    counts = predictions.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.sum(positive).alias("pos"), F.sum(1 - positive).alias("neg")
    )
    run = running_totals(counts.withColumn("all", F.lit(0)), ["all"], "score", ["neg"])
    wins = F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") + F.col("neg") / 2))
    return run.agg((wins / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auc"))
