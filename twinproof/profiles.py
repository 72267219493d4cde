"""Column profiles that are kept and merged: one small row per column and part of a table.

A part (a file, a day, a load) is scanned once. Its row of a column holds counts, a sketch of
the distinct values and, for numbers, a sketch of their distribution. New parts add
rows; facts of the whole table are merged from the rows alone. Only where an
estimate is close to a role's threshold are the values counted again, exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinproof.operators.distributions import without_nan
from twinproof.roles import CATEGORICAL_BELOW, EXACT_RECHECK_BAND, PROTECTED_TOKENS, QUASI_UP_TO, TARGET_UP_TO, ColumnRoles, distinct_profile, infer_roles, is_number

SCHEMA = "column string, position int, dtype string, is_text boolean, n_rows bigint, n_null bigint, distinct binary, quantiles binary, low double, high double"
PRECISION = 14  # the sketch of distinct values: an error of about 1 % (2 ** 14 registers)
RANK = 400  # the sketch of the distribution: ranks to about 0.6 %


def scan(df: DataFrame) -> DataFrame:
    """The profile rows of one part; a single pass over its values."""
    clean = without_nan(df, df.columns)
    texts = clean.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
    long = texts.unpivot([], df.columns, "column", "value")
    numbers = [f.name for f in df.schema if is_number(f.dataType)]
    number = F.when(F.col("column").isin(numbers), F.col("value").try_cast("double")) if numbers else F.lit(None).cast("double")
    facts = long.withColumn("number", number).groupBy("column").agg(
        F.count("*").alias("n_rows"),
        F.count(F.when(F.col("value").isNull(), 1)).alias("n_null"),
        F.hll_sketch_agg("value", PRECISION).alias("distinct"),
        F.kll_sketch_agg_double("number", RANK).alias("quantiles"),
        F.min("number").alias("low"),
        F.max("number").alias("high"),
    )
    # The schema facts are literals picked by column name: no join needed.
    items = [F.struct(F.lit(i).alias("position"), F.lit(f.dataType.simpleString()).alias("dtype"), F.lit(not is_number(f.dataType)).alias("is_text")) for i, f in enumerate(df.schema)]
    schema = F.create_map(*[x for f, item in zip(df.schema, items) for x in (F.lit(f.name), item)])[F.col("column")]
    return facts.withColumn("s", schema).select("column", "s.position", "s.dtype", "s.is_text", *[c for c in ("n_rows", "n_null", "distinct", "quantiles", "low", "high")])


def add(df: DataFrame, path: str, part: str) -> None:
    """Profile a part of the table; a part sent again replaces its rows."""
    scan(df).coalesce(1).write.mode("overwrite").parquet(f"{path}/part={part}")


def merged(spark: SparkSession, path: str, probabilities: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(column, position, dtype, is_text, n_rows, n_null, n_distinct, low, high, quantiles):
    the whole table's facts, from profile rows only. Distinct counts and quantiles are estimates."""
    rows = spark.read.schema(f"{SCHEMA}, part string").parquet(path)
    points = F.array(*[F.lit(float(p)) for p in probabilities])
    one = rows.groupBy("column").agg(
        *[F.min(c).alias(c) for c in ("position", "dtype")],
        F.bool_or("is_text").alias("is_text"),
        F.sum("n_rows").alias("n_rows"),
        F.sum("n_null").alias("n_null"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("n_distinct"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.kll_merge_agg_double("quantiles").alias("q"),
    )
    quantiles = F.when(F.col("low").isNotNull(), F.kll_sketch_get_quantile_double("q", points))
    return one.withColumn("quantiles", quantiles).drop("q")


def distinct_counts(spark: SparkSession, path: str, table: DataFrame) -> dict[str, int]:
    """Distinct values per column: the merged estimate, or the exact count of ``table`` where a threshold is near."""
    counts = {r["column"]: int(r["n_distinct"]) for r in merged(spark, path).select("column", "n_distinct").collect()}
    edges = (CATEGORICAL_BELOW, QUASI_UP_TO, TARGET_UP_TO)
    close = [c for c in table.columns if c in counts and any(abs(counts[c] - e) <= max(2, EXACT_RECHECK_BAND * e) for e in edges)]
    if close:
        counts.update((r["column"], int(r["n_distinct"])) for r in distinct_profile(table, close).select("column", "n_distinct").collect())
    return counts


def roles(spark: SparkSession, path: str, table: DataFrame, protected_tokens: Sequence[str] = PROTECTED_TOKENS, most_quasi: int | None = None) -> ColumnRoles:
    """The roles ``infer_roles`` gives, from the stored profile of ``table``."""
    return infer_roles(table, protected_tokens, most_quasi, distinct_counts(spark, path, table))
