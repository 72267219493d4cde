"""Label codes, scaling and decoding."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinproof.operators.running import running_totals
from twinproof.session import settle

MISSING_LABEL = "nan"
SMALL_DICTIONARY = 100_000


def label_text(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(MISSING_LABEL))


def dictionary(frames: Sequence[DataFrame], columns: Sequence[str], scope: str = "union") -> DataFrame:
    """(side, column, value, code): code is the rank of the value's text from 0.

    Scope "union" fits one dictionary on all frames (side 0); "separate" fits
    one per frame. The distinct labels are written out and counted first: a
    dictionary of proven small size is ranked by a plain window, a larger one
    by bucketed running totals, so no column is ranked in one big task.
    """
    parts = [
        df.select(F.lit(i if scope == "separate" else 0).alias("side"), *[label_text(c).alias(c) for c in columns]).unpivot(
            ["side"], list(columns), "column", "value"
        )
        for i, df in enumerate(frames)
    ]
    labels = parts[0]
    for p in parts[1:]:
        labels = labels.unionByName(p)
    distinct = settle(labels.distinct(), "labels")
    if distinct.count() <= SMALL_DICTIONARY:
        by_value = Window.partitionBy("side", "column").orderBy("value")
        ranked = distinct.withColumn("code", F.row_number().over(by_value) - 1)
    else:
        run = running_totals(distinct.withColumn("one", F.lit(1)), ["side", "column"], "value", ["one"])
        ranked = run.withColumn("code", (F.col("cum_one") - 1).cast("int"))
    return settle(ranked.select("side", "column", "value", "code"), "dictionary")


def encode(
    df: DataFrame, codes: DataFrame, columns: Sequence[str], unseen: int | None = None, side: str | None = None
) -> DataFrame:
    """Replace labels with codes; ``unseen`` labels get that code (else null).

    ``side`` names a column of ``df`` telling whose dictionary a row uses.
    """
    out = df
    for c in columns:
        part = codes.where(F.col("column") == c).select(
            F.col("value").alias("_label"), F.col("code").alias("_code"), F.col("side").alias("_side")
        )
        match = F.col("_text") == F.col("_label")
        if side is not None:
            match = match & (F.col(side) == F.col("_side"))
        out = out.withColumn("_text", label_text(c)).join(part, match, "left")
        code = F.col("_code") if unseen is None else F.coalesce("_code", F.lit(unseen))
        out = out.withColumn(c, code.cast("double")).drop("_text", "_label", "_code", "_side")
    return out.select(*df.columns)


def decode(df: DataFrame, codes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Codes back to labels: round half to even, clip to the known range."""
    out = df
    for c in columns:
        part = codes.where(F.col("column") == c)
        last = part.agg(F.max("code")).scalar()
        part = part.select(F.col("code").alias("_code"), F.col("value").alias("_label"))
        nearest = F.least(F.greatest(F.bround(F.col(c)).cast("int"), F.lit(0)), last)
        out = out.withColumn("_near", nearest).join(part, F.col("_near") == F.col("_code"), "left")
        out = out.withColumn(c, F.col("_label")).drop("_near", "_code", "_label")
    return out.select(*df.columns)


def scale_stats(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each column, as driver-side numbers."""
    row = df.agg(
        *[F.avg(c).alias(f"mean_{c}") for c in columns], *[F.stddev_pop(c).alias(f"sd_{c}") for c in columns]
    ).first()
    return {c: (row[f"mean_{c}"], row[f"sd_{c}"]) for c in columns}


def standardize(
    df: DataFrame, stats: dict[str, tuple[float, float]], columns: Sequence[str], epsilon: float = 0.0
) -> DataFrame:
    """(x - mean) / (sd + epsilon); with no epsilon a constant column keeps divisor 1."""

    def one(c: str) -> Column:
        mean, sd = stats[c]
        if mean is None:  # no values at all
            return F.lit(None).cast("double")
        divisor = sd + epsilon if epsilon else (sd or 1.0)
        return (F.col(c) - F.lit(mean)) / F.lit(divisor)

    return df.withColumns({c: one(c) for c in columns})


def fill_missing(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.fillna({k: v for k, v in values.items() if v is not None})


def restore_types(df: DataFrame, like: DataFrame) -> DataFrame:
    """Give generated rows the real table's types; values that fail become null."""
    kinds = {f.name: f.dataType for f in like.schema}
    return df.select(*[F.col(c).try_cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in df.columns])
