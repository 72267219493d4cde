"""Distances and curves over empirical distribution functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinproof.functions.scalar import ratio
from twinproof.operators.distributions import long_values, value_counts
from twinproof.operators.running import running_totals
from twinproof.session import settle


def counted_numbers(real: DataFrame, synth: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n_real, n_synth), written: the one scan of both tables that the curves are made of."""
    return settle(value_counts(real, synth, columns, "double"), "value-counts")


def cdf_table(counts: DataFrame) -> DataFrame:
    """(column, value, cdf_real, cdf_synth, next_value, t_real, t_synth) of counted numbers."""
    totals = counts.groupBy("column").agg(F.sum("n_real").alias("t_real"), F.sum("n_synth").alias("t_synth"))
    running = running_totals(counts, ["column"], "value", ["n_real", "n_synth"], written=True)
    # One row of totals per schema column.
    return running.join(F.broadcast(totals), "column").withColumns(
        {
            "cdf_real": ratio(F.col("cum_n_real"), F.col("t_real")),
            "cdf_synth": ratio(F.col("cum_n_synth"), F.col("t_synth")),
        }
    )


def ks_p_value(statistic: Column, n_real: Column, n_synth: Column, terms: int = 40) -> Column:
    """Asymptotic two-sided Kolmogorov-Smirnov p-value as a finite series."""
    n, m = n_real.cast("double"), n_synth.cast("double")
    z2 = statistic * statistic * n * m / (n + m)
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.lit(0.0),
        lambda total, k: total + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * z2),
    )
    # The series does not settle near zero, where the value is 1 anyway.
    return F.when(z2 < 0.04, F.lit(1.0)).otherwise(F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0)))


def numeric_distances(real: DataFrame, synth: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, wasserstein, ks, ks_p_value, n_real, n_synth) per number column.

    Wasserstein-1 is measured in units of the real column's population
    standard deviation; shifting both sides by the mean does not change it.
    A column without values on one side has no distance and is left out.
    """
    gap = F.abs(F.col("cdf_real") - F.col("cdf_synth"))
    width = F.coalesce(F.col("next_value") - F.col("value"), F.lit(0.0))
    counts = counted_numbers(real, synth, columns)
    raw = cdf_table(counts).groupBy("column").agg(
        F.sum(gap * width).alias("area"),
        F.max(gap).alias("ks"),
        F.max("t_real").alias("n_real"),
        F.max("t_synth").alias("n_synth"),
    )
    n = F.col("n_real")
    means = counts.groupBy("column").agg(ratio(F.sum(F.col("value") * n), F.sum(n)).alias("mean"))  # one row per column
    away = F.col("value") - F.col("mean")
    spread = counts.join(F.broadcast(means), "column").groupBy("column").agg(F.sqrt(ratio(F.sum(away * away * n), F.sum(n))).alias("sd"))
    scale = F.when(F.col("sd") == 0, F.lit(1e-10)).otherwise(F.col("sd")) + 1e-10
    return (
        raw.where((F.col("n_real") > 0) & (F.col("n_synth") > 0))
        .join(F.broadcast(spread), "column")
        .select(
            "column",
            (F.col("area") / scale).alias("wasserstein"),
            "ks",
            ks_p_value(F.col("ks"), F.col("n_real"), F.col("n_synth")).alias("ks_p_value"),
            "n_real",
            "n_synth",
        )
    )


def lorenz_curve(real: DataFrame, synth: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, percentile, real_share, synth_share): cumulative share curves.

    At percentile k the share is that of the ceil(k % of n) smallest values.
    """
    counts = counted_numbers(real, synth, columns).withColumns(
        {"v_real": F.col("value") * F.col("n_real"), "v_synth": F.col("value") * F.col("n_synth")}
    )
    running = running_totals(counts, ["column"], "value", ["n_real", "n_synth", "v_real", "v_synth"], written=True)
    totals = counts.groupBy("column").agg(
        *[F.sum(c).alias(f"t_{c}") for c in ("n_real", "n_synth", "v_real", "v_synth")]
    )
    joined = settle(running.join(F.broadcast(totals), "column"), "running-shares")

    def side(name: str) -> DataFrame:
        n, cum, total = F.col(f"n_{name}"), F.col(f"cum_n_{name}"), F.col(f"t_n_{name}")
        # Ranks ceil(k n / 100) that fall into this value's run of equal rows.
        first = F.floor((cum - n) * 100 / total).cast("int") + 1
        last = F.floor(cum * 100 / total).cast("int")
        inside = joined.where((n > 0)).select(
            "column",
            "value",
            (cum - n).alias("before"),
            F.col(f"t_n_{name}").alias("total"),
            (F.col(f"cum_v_{name}") - F.col(f"v_{name}")).alias("sum_before"),
            F.col(f"t_v_{name}").alias("sum_all"),
            F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))).alias("percentile"),
        )
        rank = F.ceil(F.col("percentile") * F.col("total") / 100)
        share = (F.col("sum_before") + (rank - F.col("before")) * F.col("value")) / F.nullif(F.col("sum_all"), F.lit(0.0)) * 100
        curve = inside.select("column", "percentile", share.alias(f"{name}_share"))
        start = totals.select("column", F.lit(0).alias("percentile"), F.lit(0.0).alias(f"{name}_share"))
        return curve.unionByName(start)

    return side("real").join(side("synth"), ["column", "percentile"], "full")


def histogram(real: DataFrame, synth: DataFrame, columns: Sequence[str], bins: int = 30) -> DataFrame:
    """(side, column, bin, n, density) with equal-width bins per side and column."""
    long = long_values(real, synth, columns, "double").select(
        F.when(F.col("is_real") == 1, "real").otherwise("synthetic").alias("side"), "column", "value"
    )
    # Two rows per schema column.
    limits = long.groupBy("side", "column").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("total")
    )
    width = (F.col("hi") - F.col("lo")) / bins
    slot = F.least(F.floor(ratio(F.col("value") - F.col("lo"), width)), F.lit(bins - 1))
    return (
        long.join(F.broadcast(limits), ["side", "column"])
        .groupBy("side", "column", "lo", "hi", "total", slot.cast("int").alias("bin"))
        .agg(F.count("*").alias("n"))
        .select("side", "column", "bin", "n", ratio(F.col("n"), F.col("total") * width).alias("density"))
    )


def summary_statistics(real: DataFrame, synth: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: mean and sample deviation of both tables and their logs."""
    long = long_values(real, synth, columns, "double")
    on_real = F.when(F.col("is_real") == 1, F.col("value"))
    on_synth = F.when(F.col("is_real") == 0, F.col("value"))
    return long.groupBy("column").agg(
        F.avg(on_real).alias("mean_real"),
        F.avg(on_synth).alias("mean_synth"),
        F.stddev_samp(on_real).alias("std_real"),
        F.stddev_samp(on_synth).alias("std_synth"),
    )
