"""Preparation of a raw table before generation or verification.

Every decision (drop a column, fill value, clip range) is a small fact about
a column. Facts are computed by distributed aggregates, collected as a few
rows per column, and kept in a plan that can be applied to further tables.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinproof.operators.distributions import modes, unpivoted
from twinproof.operators.running import column_quantiles
from twinproof.roles import distinct_profile, is_number
from twinproof.session import settle

# Date layouts tried on text columns.
DATE_FORMATS = (
    "yyyy-MM-dd",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy/MM/dd",
    "MM/dd/yyyy",
    "dd-MM-yyyy",
    "dd.MM.yyyy",
)
DATE_SHAPE = r"^\s*\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}"
DATE_SHARE = 0.8
MAX_NULL_PERCENT = 50
CATEGORY_SHARE = 0.05
CATEGORY_COUNT = 50
CLIP_LOW, CLIP_HIGH = 0.01, 0.99


def normal_names(columns: Sequence[str]) -> dict[str, str]:
    """Old name to new name: trimmed, spaces to underscores."""
    return {c: str(c).strip().replace(" ", "_") for c in columns}


def rename_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*normal_names(df.columns).values())


def parse_date(text: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS])


def date_columns(df: DataFrame) -> list[str]:
    """Text columns of whose non-null values over 80 % parse as dates; all rows count."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not texts:
        return []

    def share(c: Column) -> Column:
        # what has not even the shape of a date is not given to the parsers
        is_date = F.when(c.rlike(DATE_SHAPE), parse_date(c).isNotNull()).otherwise(False)
        return F.avg(F.when(c.isNotNull(), is_date.cast("double")))

    row = df.agg(*[share(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(texts)]).first()
    return [c for i, c in enumerate(texts) if row[i] is not None and row[i] > DATE_SHARE]


def expand_dates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace date columns by year, month, day and weekday (Monday is 0)."""
    out = df
    for c in columns:
        d = parse_date(F.col(c))
        out = out.withColumns(
            {
                f"{c}_year": F.year(d),
                f"{c}_month": F.month(d),
                f"{c}_day": F.dayofmonth(d),
                f"{c}_dayofweek": F.weekday(d),
            }
        ).drop(c)
    return out


def null_shares(df: DataFrame) -> DataFrame:
    """(column, n_null, null_percent, dropped) from one aggregate."""
    row = df.agg(F.count("*").alias("_n"), *[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in df.columns])
    items = [F.struct(F.lit(c).alias("column"), F.col(c).alias("n_null")) for c in df.columns]
    percent = F.col("n_null") * 100 / F.nullif(F.col("_n"), F.lit(0))
    return row.select("_n", F.explode(F.array(*items)).alias("i")).select("_n", "i.*").select(
        "column", "n_null", percent.alias("null_percent"), (percent > MAX_NULL_PERCENT).alias("dropped")
    )


def fill_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, action, number, text): median for numbers, mode for the rest."""
    numbers = [c for c in columns if is_number(df.schema[c].dataType)]
    others = [c for c in columns if c not in numbers]
    parts = []
    if numbers:
        counts = unpivoted(df, numbers, "double").groupBy("column", "value").agg(F.count("*").alias("n"))
        medians = column_quantiles(counts, ["column"], "value", "n", [0.5])
        parts.append(
            medians.select(
                "column",
                F.lit("imputed_median").alias("action"),
                F.col("quantile").alias("number"),
                F.lit(None).cast("string").alias("text"),
            )
        )
    if others:
        parts.append(
            modes(df, others).select(
                "column",
                F.lit("imputed_mode").alias("action"),
                F.lit(None).cast("double").alias("number"),
                F.col("mode").alias("text"),
            )
        )
    if not parts:
        raise ValueError("no columns to fill")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def whole_number_columns(df: DataFrame) -> DataFrame:
    """(column, converted): double columns that are whole and free of nulls."""
    doubles = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    row = df.agg(*[F.bool_and(F.coalesce(F.col(c) == F.floor(F.col(c)), F.lit(False))).alias(c) for c in doubles])
    items = [F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c), F.lit(False)).alias("converted")) for c in doubles]
    return row.select(F.explode(F.array(*items)).alias("i")).select("i.*")


def clip_ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, low, high, clipped): exact 1st and 99th percentiles."""
    counts = settle(unpivoted(df, columns, "double").groupBy("column", "value").agg(F.count("*").alias("n")), "value-counts")
    q = column_quantiles(counts, ["column"], "value", "n", [CLIP_LOW, CLIP_HIGH], written=True)
    ranges = q.groupBy("column").agg(F.min("quantile").alias("low"), F.max("quantile").alias("high"))
    outside = (F.col("value") < F.col("low")) | (F.col("value") > F.col("high"))
    # One range per column of the schema.
    return (
        counts.join(F.broadcast(ranges), "column")
        .groupBy("column", "low", "high")
        .agg(F.coalesce(F.sum(F.when(outside, F.col("n"))), F.lit(0)).alias("clipped"))
    )


@dataclass
class PrepPlan:
    """Facts fitted on one table, applicable to others of the same layout."""

    names: dict[str, str] = field(default_factory=dict)
    dates: list[str] = field(default_factory=list)
    dropped: list[str] = field(default_factory=list)
    fills: dict[str, object] = field(default_factory=dict)
    categories: list[str] = field(default_factory=list)
    whole: list[str] = field(default_factory=list)
    clips: dict[str, tuple[float, float]] = field(default_factory=dict)
    steps: list[tuple[str, str, str, str]] = field(default_factory=list)

    def note(self, step: str, column: str, action: str, detail: str) -> None:
        self.steps.append((step, column, action, detail))

    def apply(self, df: DataFrame) -> DataFrame:
        """The fitted steps on another table of the same layout."""
        return self.finish(expand_dates(rename_columns(df), self.dates).dropDuplicates())

    def finish(self, unique: DataFrame) -> DataFrame:
        """The steps after de-duplication."""
        out = unique.drop(*self.dropped)
        if self.fills:
            out = out.fillna(self.fills)
        out = out.withColumns({c: F.col(c).cast("bigint") for c in self.whole if c in out.columns})
        clipped = {}
        for c, (low, high) in self.clips.items():
            if c in out.columns:
                clipped[c] = F.least(F.greatest(F.col(c), F.lit(low)), F.lit(high))
        return out.withColumns(clipped)

    def report(self, spark) -> DataFrame:
        return spark.createDataFrame(self.steps, "step string, column string, action string, detail string")


def fit(df: DataFrame) -> PrepPlan:
    """Fit the preparation steps on ``df``."""
    return prepare(df)[1]


def prepare(df: DataFrame) -> tuple[DataFrame, PrepPlan]:
    """The prepared table and the plan fitted on it.

    The de-duplicated table is written once; every later step reads that.
    """
    plan = PrepPlan(names=normal_names(df.columns))
    for old, new in plan.names.items():
        if old != new:
            plan.note("column_names", new, "renamed", old)
    now = rename_columns(df)
    plan.dates = date_columns(now)
    for c in plan.dates:
        plan.note("dates", c, "date_expanded", f"{c}_year,{c}_month,{c}_day,{c}_dayofweek")
    unique = settle(expand_dates(now, plan.dates).dropDuplicates(), "unique")
    removed = df.count() - unique.count()
    if removed:
        plan.note("duplicates", "*", "duplicates_removed", str(removed))
    now = unique
    gaps = [r for r in null_shares(now).collect() if r["n_null"]]
    plan.dropped = [r["column"] for r in gaps if r["dropped"]]
    for r in gaps:
        if r["dropped"]:
            plan.note("missing", r["column"], "dropped", f"{r['null_percent']:.1f}% missing values")
    now = now.drop(*plan.dropped)
    to_fill = [r["column"] for r in gaps if not r["dropped"]]
    if to_fill:
        for r in fill_values(now, to_fill).collect():
            plan.fills[r["column"]] = r["number"] if r["number"] is not None else r["text"]
            plan.note("missing", r["column"], r["action"], str(plan.fills[r["column"]]))
        for c in to_fill:
            if c not in plan.fills:
                plan.fills[c] = "Unknown"
                plan.note("missing", c, "imputed_unknown", "Unknown")
        now = now.fillna(plan.fills)
    texts = [f.name for f in now.schema if isinstance(f.dataType, T.StringType)]
    if texts:
        found = {r["column"]: r for r in distinct_profile(now, texts).select("column", "n_distinct", "n_rows").collect()}
        plan.categories = [c for c in texts if c in found and (found[c]["n_distinct"] < CATEGORY_COUNT or found[c]["n_distinct"] < CATEGORY_SHARE * found[c]["n_rows"])]
        for c in plan.categories:
            plan.note("types", c, "converted_to_category", str(found[c]["n_distinct"]))
    if any(isinstance(f.dataType, (T.DoubleType, T.FloatType)) for f in now.schema):
        plan.whole = [r["column"] for r in whole_number_columns(now).collect() if r["converted"]]
    for c in plan.whole:
        plan.note("types", c, "converted_float_to_int", "")
    now = now.withColumns({c: F.col(c).cast("bigint") for c in plan.whole})
    numbers = [f.name for f in now.schema if is_number(f.dataType)]
    if numbers:
        for r in clip_ranges(now, numbers).collect():
            if r["clipped"]:
                plan.clips[r["column"]] = (r["low"], r["high"])
                plan.note("outliers", r["column"], "clipped", f"{r['clipped']} to [{r['low']}, {r['high']}]")
    return plan.finish(unique), plan
