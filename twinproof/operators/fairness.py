"""Fairness metrics over protected groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinproof.functions.scalar import clamp, ratio, steep_score
from twinproof.operators.distributions import value_counts, with_shares


def representation(real: DataFrame, synth: DataFrame, protected: Sequence[str]) -> DataFrame:
    """(attribute, max_difference, score, passed): share gaps of groups."""
    shares = with_shares(value_counts(real, synth, protected))
    return (
        shares.groupBy(F.col("column").alias("attribute"))
        .agg(F.max(F.abs(F.col("p_real") - F.col("p_synth"))).alias("max_difference"))
        .select(
            "attribute",
            "max_difference",
            steep_score(F.col("max_difference")).alias("score"),
            (F.col("max_difference") < 0.1).alias("passed"),
        )
    )


def favorable_rates(real: DataFrame, synth: DataFrame, protected: Sequence[str], target: str, favorable) -> DataFrame:
    """(attribute, group, n and favourable rate on both sides).

    Groups are those of the real table; a group absent from the synthetic
    table has rate 0 there.
    """

    def one(df: DataFrame, flag: int) -> DataFrame:
        good = F.coalesce((F.col(target) == F.lit(favorable)).cast("int"), F.lit(0))
        marks = df.select(
            F.lit(flag).alias("is_real"), good.alias("good"), *[F.col(a).cast("string").alias(f"_{a}") for a in protected]
        )
        return marks.unpivot(["is_real", "good"], [f"_{a}" for a in protected], "attribute", "group")

    both = one(real, 1).unionByName(one(synth, 0)).where(F.col("group").isNotNull())
    on_real, on_synth = F.col("is_real"), 1 - F.col("is_real")
    return (
        both.groupBy(F.substring("attribute", 2, 1 << 20).alias("attribute"), "group")
        .agg(
            F.sum(on_real).alias("n_real"),
            F.sum(on_synth).alias("n_synth"),
            F.sum(on_real * F.col("good")).alias("good_real"),
            F.sum(on_synth * F.col("good")).alias("good_synth"),
        )
        .where("n_real > 0")
        .select(
            "attribute",
            "group",
            "n_real",
            "n_synth",
            ratio(F.col("good_real"), F.col("n_real")).alias("rate_real"),
            ratio(F.col("good_synth"), F.col("n_synth")).alias("rate_synth"),
        )
    )


def _per_attribute(rates: DataFrame) -> DataFrame:
    """Rate extremes of attributes with at least two groups."""
    return (
        rates.groupBy("attribute")
        .agg(
            F.count("*").alias("groups"),
            *[f(f"rate_{side}").alias(f"{n}_{side}") for side in ("real", "synth") for n, f in (("lo", F.min), ("hi", F.max))],
        )
        .where("groups >= 2")
    )


def disparate_impact(rates: DataFrame) -> DataFrame:
    """(attribute, min_di_real, min_di_synth, di_change, score, passed).

    The ratio to the best group can only be at most 1, so the smallest ratio
    is the worst rate over the best rate.
    """
    di = F.col("min_di_synth")
    return (
        _per_attribute(rates)
        .select(
            "attribute",
            ratio(F.col("lo_real"), F.col("hi_real")).alias("min_di_real"),
            ratio(F.col("lo_synth"), F.col("hi_synth")).alias("min_di_synth"),
        )
        .select(
            "attribute",
            "min_di_real",
            "min_di_synth",
            F.abs(F.col("min_di_real") - di).alias("di_change"),
            F.when(di >= 0.8, F.lit(100.0)).otherwise(clamp(di / 0.8 * 100)).alias("score"),
            (di >= 0.8).alias("passed"),
        )
    )


def statistical_parity(rates: DataFrame) -> DataFrame:
    """(attribute, max_spd_real, max_spd, score, passed).

    The largest difference over all pairs of groups is the best rate minus
    the worst rate.
    """
    spd = F.col("hi_synth") - F.col("lo_synth")
    return _per_attribute(rates).select(
        "attribute",
        (F.col("hi_real") - F.col("lo_real")).alias("max_spd_real"),
        spd.alias("max_spd"),
        steep_score(spd).alias("score"),
        (spd < 0.1).alias("passed"),
    )


def group_gaps(rates: DataFrame) -> DataFrame:
    """Per group: its largest rate gap to any other group, and its DI ratio.

    Reported per group instead of per pair, so the output stays linear in the
    number of groups.
    """
    edges = _per_attribute(rates)
    cols = {}
    for side in ("real", "synth"):
        rate = F.col(f"rate_{side}")
        cols[f"gap_{side}"] = F.greatest(rate - F.col(f"lo_{side}"), F.col(f"hi_{side}") - rate)
        cols[f"di_{side}"] = ratio(rate, F.col(f"hi_{side}"))
    # One row per protected attribute of the schema.
    return (
        rates.join(F.broadcast(edges), "attribute")
        .withColumns(cols)
        .select("attribute", "group", "gap_real", "gap_synth", F.abs(F.col("gap_real") - F.col("gap_synth")).alias("change"), "di_real", "di_synth")
    )


def true_positive_rates(predictions: DataFrame, attribute: str, label: str, predicted: str, positive) -> DataFrame:
    """(attribute, group, actual positives, tpr) of a prediction table."""
    actual = (F.col(label) == F.lit(positive)).cast("int")
    hit = ((F.col(label) == F.lit(positive)) & (F.col(predicted) == F.lit(positive))).cast("int")
    return (
        predictions.where(F.col(attribute).isNotNull())
        .groupBy(F.col(attribute).cast("string").alias("group"))
        .agg(F.coalesce(F.sum(actual), F.lit(0)).alias("positives"), F.coalesce(F.sum(hit), F.lit(0)).alias("hits"))
        .select(F.lit(attribute).alias("attribute"), "group", "positives", ratio(F.col("hits"), F.col("positives")).alias("tpr"))
    )


def equal_opportunity(tprs: DataFrame) -> DataFrame:
    """(attribute, equal_opportunity_difference, score, passed)."""
    eod = F.col("equal_opportunity_difference")
    return (
        tprs.groupBy("attribute")
        .agg((F.max("tpr") - F.min("tpr")).alias("equal_opportunity_difference"))
        .select("attribute", "equal_opportunity_difference", steep_score(eod).alias("score"), (eod < 0.1).alias("passed"))
    )


def outcome_rates(synth: DataFrame, attribute: str, target: str, positive=None) -> DataFrame:
    """(group, rate): positive rate, or mean outcome when ``positive`` is None."""
    value = (
        F.col(target).cast("double")
        if positive is None
        else F.coalesce((F.col(target) == F.lit(positive)).cast("double"), F.lit(0.0))
    )
    return synth.where(F.col(attribute).isNotNull()).groupBy(F.col(attribute).alias("group")).agg(F.avg(value).alias("rate"))


def evaluator_parity(rates: DataFrame) -> DataFrame:
    """One row: spread of outcome rates and its score."""
    gap = F.when(F.col("groups") < 2, F.lit(0.0)).otherwise(F.col("hi") - F.col("lo"))
    return rates.agg(F.count("*").alias("groups"), F.min("rate").alias("lo"), F.max("rate").alias("hi")).select(
        gap.alias("demographic_parity"), F.greatest(F.lit(0.0), 100 - gap * 100).alias("dp_score")
    )


def evaluator_impact(rates: DataFrame) -> DataFrame:
    """One row: worst over best outcome rate with the 80 % rule."""
    di = F.when((F.col("groups") < 2) | (F.col("hi") == 0), F.lit(1.0)).otherwise(ratio(F.col("lo"), F.col("hi")))
    return rates.agg(F.count("*").alias("groups"), F.min("rate").alias("lo"), F.max("rate").alias("hi")).select(
        di.alias("disparate_impact"),
        (di >= 0.8).alias("passes_80_percent_rule"),
        F.when(di >= 0.8, F.lit(100.0)).otherwise(di * 100 / 0.8).alias("di_score"),
    )
