"""Summaries of experiment trials."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinproof.functions.scalar import ratio

SINGLE_VERIFIER_TRUST = 0.7


def trial_summary(trials: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean, both deviations, least and largest value per approach or size."""
    return trials.groupBy(*by).agg(
        F.count("*").alias("num_trials"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        F.stddev_samp(value).alias("std_sample"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )


def overhead(trials: DataFrame, trial: str, approach: str, value: str, without: str, with_: str) -> DataFrame:
    """(trial, overhead, overhead_percent) of paired approaches.

    Both sides of a trial meet in one aggregation instead of a join.
    """

    def side(name: str):
        return F.avg(F.when(F.col(approach) == name, F.col(value)))

    paired = trials.where(F.col(approach).isin(without, with_)).groupBy(trial).agg(side(without).alias("_a"), side(with_).alias("_b"))
    return paired.where(F.col("_a").isNotNull() & F.col("_b").isNotNull()).select(
        trial, (F.col("_b") - F.col("_a")).alias("overhead"), (ratio(F.col("_b") - F.col("_a"), F.col("_a")) * 100).alias("overhead_percent")
    )


def trust_comparison(singles: DataFrame, records: DataFrame) -> DataFrame:
    """(approach, verifications, trust): none, one verifier, consensus.

    One verifier's plain mean is reduced by 30 %, consensus keeps its median.
    """
    one = singles.agg(
        F.count("*").alias("verifications"),
        F.avg((F.col("privacy") + F.col("utility") + F.col("fairness")) / 3 * SINGLE_VERIFIER_TRUST).alias("trust"),
    )
    agreed = records.agg(F.count("*").alias("verifications"), F.avg("overall").alias("trust"))
    none = one.select("verifications", F.lit(0.0).alias("trust"))
    rows = [("none", none), ("single", one), ("consensus", agreed)]
    out = None
    for name, frame in rows:
        part = frame.select(F.lit(name).alias("approach"), "verifications", "trust")
        out = part if out is None else out.unionByName(part)
    return out
