"""Column roles: which columns are categorical, numeric, protected, target."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Name parts that mark a protected attribute.
PROTECTED_TOKENS = ("sex", "gender", "race", "ethnicity", "age", "religion")
# The shorter list the experiments use.
PROTECTED_TOKENS_SHORT = ("sex", "gender", "race", "age")

CATEGORICAL_BELOW = 20
QUASI_UP_TO = 50
TARGET_UP_TO = 10
EXACT_RECHECK_BAND = 0.25


@dataclass(frozen=True)
class ColumnRoles:
    """Roles of the columns of a real / synthetic pair."""

    categorical: tuple[str, ...] = ()
    numeric: tuple[str, ...] = ()
    quasi_identifiers: tuple[str, ...] = ()
    protected: tuple[str, ...] = ()
    target: str | None = None
    favorable: object = None
    sensitive: tuple[str, ...] = ()
    distinct: dict = field(default_factory=dict)

    @property
    def columns(self) -> tuple[str, ...]:
        return self.categorical + tuple(c for c in self.numeric if c not in self.categorical)

    def but(self, **changes) -> ColumnRoles:
        return replace(self, **changes)


def is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def number_columns(df: DataFrame) -> list[str]:
    """Numeric / non-numeric split by data type alone."""
    return [f.name for f in df.schema if is_number(f.dataType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if not is_number(f.dataType)]


def common_columns(real: DataFrame, synth: DataFrame) -> list[str]:
    """Shared columns in the real table's order."""
    have = set(synth.columns)
    return [c for c in real.columns if c in have]


def protected_columns(columns: Sequence[str], tokens: Sequence[str] = PROTECTED_TOKENS) -> list[str]:
    return [c for c in columns if any(t in c.lower() for t in tokens)]


def distinct_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, position, dtype, is_text, n_distinct, n_null, n_rows), exact counts.

    One scan: the columns are unpivoted to text and counted as (column, value)
    pairs, so a heavy value is merged before the shuffle and no column's whole
    value set lands in one task.
    """
    names = list(columns) if columns is not None else df.columns
    texts = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in names])
    pairs = texts.unpivot([], names, "column", "value").groupBy("column", "value").agg(F.count("*").alias("n"))
    per_column = pairs.groupBy("column").agg(
        F.count("value").alias("n_distinct"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("n_null"),
        F.sum("n").alias("n_rows"),
    )
    # The schema facts are literals picked by column name: no join needed.
    position = F.lit(len(names))
    dtype, is_text = F.lit(""), F.lit(False)
    for i, c in enumerate(names):
        here = F.col("column") == c
        kind = df.schema[c].dataType
        position = F.when(here, F.lit(i)).otherwise(position)
        dtype = F.when(here, F.lit(kind.simpleString())).otherwise(dtype)
        is_text = F.when(here, F.lit(not is_number(kind))).otherwise(is_text)
    return per_column.select(
        "column",
        position.cast("int").alias("position"),
        dtype.alias("dtype"),
        is_text.alias("is_text"),
        "n_distinct",
        "n_null",
        "n_rows",
    )


def role_table(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Role flags of each column as a table."""
    return distinct_profile(df, columns).withColumns(
        {
            "is_categorical": F.col("is_text") | (F.col("n_distinct") < CATEGORICAL_BELOW),
            "quasi_candidate": F.col("is_text") | (F.col("n_distinct") <= QUASI_UP_TO),
            "target_candidate": F.col("n_distinct") <= TARGET_UP_TO,
        }
    )


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, int]:
    """Distinct count per column: sketches first, exact only near a threshold.

    Sketches cost one aggregate without a shuffle of values. A column whose
    estimate lies close to a role threshold is counted again exactly.
    """
    names = list(columns) if columns is not None else df.columns
    row = df.agg(*[F.approx_count_distinct(F.col(f"`{c}`"), 0.02).alias(c) for c in names]).first()
    counts = {c: int(row[c]) for c in names}
    edges = (CATEGORICAL_BELOW, QUASI_UP_TO, TARGET_UP_TO)
    close = [c for c in names if any(abs(counts[c] - e) <= max(2, EXACT_RECHECK_BAND * e) for e in edges)]
    if close:
        for r in distinct_profile(df, close).select("column", "n_distinct").collect():
            counts[r["column"]] = int(r["n_distinct"])
    return counts


def quasi_identifiers(columns: Sequence[str], text: set[str], counts: Mapping[str, int], most: int | None = None) -> tuple[str, ...]:
    """Every text or low-cardinality column, or every column where there is none;
    the first ``most`` of them if given."""
    found = [c for c in columns if c in text or counts[c] <= QUASI_UP_TO]
    return tuple((found or list(columns))[:most])


def infer_roles(real: DataFrame, protected_tokens: Sequence[str] = PROTECTED_TOKENS, most_quasi: int | None = None, counts: Mapping[str, int] | None = None) -> ColumnRoles:
    """All roles by name, type and cardinality. The driver sees counts only.

    ``counts`` are distinct counts already known, such as those of a stored profile."""
    counts = dict(counts) if counts is not None else distinct_counts(real)
    text = set(text_columns(real))
    categorical = tuple(c for c in real.columns if c in text or counts[c] < CATEGORICAL_BELOW)
    target = next((c for c in reversed(real.columns) if counts[c] <= TARGET_UP_TO), None)
    return ColumnRoles(
        categorical=categorical,
        numeric=tuple(c for c in real.columns if c not in categorical and c not in text),
        quasi_identifiers=quasi_identifiers(real.columns, text, counts, most_quasi),
        protected=tuple(protected_columns(real.columns, protected_tokens)),
        target=target,
        distinct=counts,
    )


def is_classification(real: DataFrame, target: str, counts: dict[str, int]) -> bool:
    """Few distinct values or text: a class target; otherwise a number target."""
    return counts[target] <= TARGET_UP_TO or not is_number(real.schema[target].dataType)


def dataset_summary(df: DataFrame, categorical: Sequence[str]) -> DataFrame:
    """rows, columns, categorical and numeric counts in one row."""
    return df.agg(F.count("*").alias("n_rows")).select(
        "n_rows",
        F.lit(len(df.columns)).alias("n_columns"),
        F.lit(sum(c in df.columns for c in categorical)).alias("n_categorical"),
        F.lit(len(number_columns(df))).alias("n_numeric"),
    )


def most_common_value(df: DataFrame, column: str, condition=None) -> DataFrame:
    """One row: the most frequent non-null value, the smallest one on a tie."""
    counted = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counted.agg(F.min(F.struct((-F.col("n")).alias("neg"), F.col("value"))).alias("m")).select(
        F.lit(column).alias("column"), F.col("m.value").alias("value"), (-F.col("m.neg")).alias("n")
    )


def favorable_value(df: DataFrame, target: str):
    """Favourable outcome: 1 for a number target, else its most common value."""
    if is_number(df.schema[target].dataType):
        return 1
    row = most_common_value(df, target).first()
    return row["value"]
