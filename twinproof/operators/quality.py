"""Quality of a synthetic table on its own, without the real table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinproof.functions.scalar import ratio, weighted_score
from twinproof.operators.distributions import unpivoted
from twinproof.roles import is_number


def completeness(df: DataFrame) -> DataFrame:
    """One row: percent of cells that are not null."""
    filled = F.lit(0)
    for c in df.columns:
        filled = filled + F.count(F.col(f"`{c}`"))
    return df.agg(ratio(filled * 100, F.count("*") * len(df.columns)).alias("completeness"))


def uniqueness(df: DataFrame) -> DataFrame:
    """One row: distinct rows in percent of rows; copies merge before the shuffle."""
    rows = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count("*").alias("_n"))
    return rows.agg(ratio(F.count("*") * 100, F.sum("_n")).alias("uniqueness"))


def column_quality(df: DataFrame, categorical: Sequence[str]) -> DataFrame:
    """(column, n_values, n_distinct, validity, distribution) per column.

    Validity of labels is 100 below one distinct value per two rows, else 50.
    Distribution is 100 for a number that varies, and normalised entropy for
    labels; both are missing for an empty column, whose validity is 0.
    """
    numbers = [f.name for f in df.schema if is_number(f.dataType)]
    texts = [c for c in df.columns if c not in numbers]
    counts = unpivoted(df, df.columns).groupBy("column", "value").agg(F.count("*").alias("n"))
    totals = counts.groupBy("column").agg(F.sum("n").alias("n_values"), F.count("*").alias("n_distinct"))
    p = F.col("n") / F.col("n_values")
    entropy = (
        counts.join(F.broadcast(totals), "column")  # one row per column
        .groupBy("column", "n_values", "n_distinct")
        .agg(F.sum(-p * F.log2(p)).alias("entropy"))
    )
    is_num = F.col("column").isin(numbers) if numbers else F.lit(False)
    is_label = F.col("column").isin([c for c in df.columns if c in set(categorical) | set(texts)])
    evenness = ratio(F.col("entropy"), F.log2("n_distinct")) * 100
    found = entropy.select(
        "column",
        "n_values",
        "n_distinct",
        F.when(is_label, F.when(F.col("n_distinct") / F.col("n_values") < 0.5, 100.0).otherwise(50.0))
        .when(is_num, F.lit(100.0))
        .otherwise(F.lit(50.0))
        .alias("validity"),
        F.when(is_num, F.when(F.col("n_distinct") > 1, 100.0).otherwise(50.0)).otherwise(evenness).alias("distribution"),
    )
    every = df.sparkSession.createDataFrame([(c,) for c in df.columns], "column string")
    return every.join(found, "column", "left").select(
        "column",
        F.coalesce("n_values", F.lit(0)).alias("n_values"),
        F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"),
        F.coalesce("validity", F.lit(0.0)).alias("validity"),
        "distribution",
    )


def synthetic_only(df: DataFrame, categorical: Sequence[str], threshold: float = 70.0) -> DataFrame:
    """One row: quality metrics mapped to privacy, utility, bias and a verdict."""
    columns = column_quality(df, categorical).agg(
        F.coalesce(F.avg("validity"), F.lit(0.0)).alias("validity"),
        F.coalesce(F.avg("distribution"), F.lit(0.0)).alias("distribution"),
    )
    full = completeness(df).scalar()
    unique = uniqueness(df).scalar()
    scores = columns.select(
        full.alias("completeness"),
        unique.alias("uniqueness"),
        "validity",
        "distribution",
        F.least(F.lit(100.0), full * 0.5 + unique * 0.5).alias("privacy_score"),
        F.least(F.lit(100.0), F.col("validity") * 0.5 + F.col("distribution") * 0.5).alias("utility_score"),
        F.least(F.lit(100.0), F.col("distribution")).alias("bias_score"),
    )
    overall = weighted_score(F.col("privacy_score"), F.col("utility_score"), F.col("bias_score"))
    return scores.withColumn("overall_score", overall).withColumn(
        "status", F.when(F.col("overall_score") >= threshold, "approved").otherwise("rejected")
    )
