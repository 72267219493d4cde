"""Aligned value distributions of a real and a synthetic table.

Both tables are unpivoted and counted together, so aligning them needs no
join: a value missing on one side simply has a zero count there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinproof.functions.scalar import ratio

EPSILON = 1e-10


def without_nan(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns, with null in place of NaN: both are missing values."""
    floats = {f.name for f in df.schema if f.dataType.simpleString() in ("double", "float")}
    return df.select(*[F.nanvl(F.col(f"`{c}`"), F.lit(None)).alias(c) if c in floats else F.col(f"`{c}`") for c in columns])


def unpivoted(df: DataFrame, columns: Sequence[str], value_type: str = "string", is_real: int = 1) -> DataFrame:
    """(is_real, column, value): the non-null values of one table.

    Values that do not parse as ``value_type`` become null and leave as well,
    as does NaN, a missing number.
    """
    typed = without_nan(df, columns).select(*[F.col(f"`{c}`").try_cast(value_type).alias(c) for c in columns])
    # a text "NaN" becomes one only as a number
    typed = without_nan(typed, columns).withColumn("is_real", F.lit(is_real))
    return typed.unpivot(["is_real"], list(columns), "column", "value").where(F.col("value").isNotNull())


def long_values(
    real: DataFrame, synth: DataFrame, columns: Sequence[str], value_type: str = "string"
) -> DataFrame:
    """(is_real, column, value): non-null values of both tables, unpivoted."""
    return unpivoted(real, columns, value_type, 1).unionByName(unpivoted(synth, columns, value_type, 0))


def value_counts(
    real: DataFrame, synth: DataFrame, columns: Sequence[str], value_type: str = "string"
) -> DataFrame:
    """(column, value, n_real, n_synth); one pass over each table."""
    return (
        long_values(real, synth, columns, value_type)
        .groupBy("column", "value")
        .agg(
            F.sum("is_real").alias("n_real"),
            F.sum(1 - F.col("is_real")).alias("n_synth"),
        )
    )


def full_outer_counts(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Align two already counted frames; a missing side counts zero."""
    l, r = left.withColumnRenamed("n", "n_real"), right.withColumnRenamed("n", "n_synth")
    return l.join(r, list(keys), "full").select(
        *keys,
        F.coalesce("n_real", F.lit(0)).alias("n_real"),
        F.coalesce("n_synth", F.lit(0)).alias("n_synth"),
    )


def with_shares(counts: DataFrame) -> DataFrame:
    """Add totals per column, number of values k and the shares p_real, p_synth.

    The totals hold one row per column of the schema, hence the broadcast.
    """
    totals = counts.groupBy("column").agg(
        F.sum("n_real").alias("t_real"), F.sum("n_synth").alias("t_synth"), F.count("*").alias("k")
    )
    return counts.join(F.broadcast(totals), "column").withColumns(
        {
            "p_real": ratio(F.col("n_real"), F.col("t_real")),
            "p_synth": ratio(F.col("n_synth"), F.col("t_synth")),
        }
    )


def distributions(real: DataFrame, synth: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Normalised, aligned distributions of each column."""
    return with_shares(value_counts(real, synth, columns)).select(
        "column", "value", "n_real", "n_synth", "p_real", "p_synth"
    )


def divergences(real: DataFrame, synth: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, tv_distance, js_distance) per column.

    js_distance is the square root of the Jensen-Shannon divergence in nats,
    after adding a tiny weight to each share and normalising again.
    """
    shares = with_shares(value_counts(real, synth, columns))

    def smooth(p: str, t: str):
        return (F.col(p) + EPSILON) / ((F.col(t) > 0).cast("double") + F.col("k") * EPSILON)

    pq = shares.select("column", "p_real", "p_synth", smooth("p_real", "t_real").alias("p"), smooth("p_synth", "t_synth").alias("q"))
    m = (F.col("p") + F.col("q")) / 2
    term = 0.5 * F.col("p") * F.log(F.col("p") / m) + 0.5 * F.col("q") * F.log(F.col("q") / m)
    return pq.groupBy("column").agg(
        (F.sum(F.abs(F.col("p_real") - F.col("p_synth"))) / 2).alias("tv_distance"),
        F.sqrt(F.greatest(F.sum(term), F.lit(0.0))).alias("js_distance"),
    )


def value_set_differences(real: DataFrame, synth: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: values in both, only real, only synthetic."""
    return value_counts(real, synth, columns).groupBy("column").agg(
        F.count(F.when((F.col("n_real") > 0) & (F.col("n_synth") > 0), 1)).alias("n_both"),
        F.count(F.when(F.col("n_synth") == 0, 1)).alias("n_real_only"),
        F.count(F.when(F.col("n_real") == 0, 1)).alias("n_synth_only"),
    )


def modes(real: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, mode, n): most frequent non-null value, smallest on a tie."""
    counted = unpivoted(real, columns).groupBy("column", "value").agg(F.count("*").alias("n"))
    best = counted.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("neg"), F.col("value"))).alias("m"))
    return best.select("column", F.col("m.value").alias("mode"), (-F.col("m.neg")).alias("n"))
