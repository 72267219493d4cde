"""Order-insensitive fingerprints of whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinproof.functions.scalar import row_sha
from twinproof.session import settle

DIGITS_PER_LEVEL = 2
LEAF_ROWS = 256


def leaf_digits_for(n_rows: int) -> int:
    """Even number of hash digits that leaves about LEAF_ROWS rows per leaf."""
    digits = DIGITS_PER_LEVEL
    while LEAF_ROWS * 16**digits < n_rows:
        digits += DIGITS_PER_LEVEL
    return digits


def fingerprint(df: DataFrame, columns: Sequence[str] | None = None, leaf_digits: int | None = None) -> DataFrame:
    """One row: (n_rows, n_distinct_rows, data_hash) of the table's rows.

    A hash tree over row digests. Equal rows are counted first, so a node
    holds distinct digests only; digests spread evenly over 16^leaf_digits
    leaves, a number that follows the row count, and each level above joins
    at most 256 children. No task ever gathers more than one node, and row
    order does not matter.
    """
    rows = settle(df.select(row_sha(df, columns).alias("h")).groupBy("h").agg(F.count("*").alias("n")), "row-digests")
    leaf_digits = leaf_digits or leaf_digits_for(rows.agg(F.sum("n")).first()[0] or 0)
    item = F.concat_ws(":", "h", F.col("n").cast("string"))
    level = rows.groupBy(F.substring("h", 1, leaf_digits).alias("key")).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(item)), ","), 256).alias("digest"),
        F.sum("n").alias("n_rows"),
        F.count("*").alias("n_distinct_rows"),
    )
    digits = leaf_digits
    while digits > 0:
        digits = max(0, digits - DIGITS_PER_LEVEL)
        item = F.concat_ws(":", "key", "digest")
        parent = F.substring("key", 1, digits) if digits else F.lit("")
        level = level.groupBy(parent.alias("parent")).agg(
            F.sha2(F.array_join(F.array_sort(F.collect_list(item)), ","), 256).alias("digest"),
            F.sum("n_rows").alias("n_rows"),
            F.sum("n_distinct_rows").alias("n_distinct_rows"),
        ).withColumnRenamed("parent", "key")
    return level.select("n_rows", "n_distinct_rows", F.col("digest").alias("data_hash"))


def verify_generation(df: DataFrame, log: DataFrame, generation_id: str, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per log record of that id: does the table match its record?"""
    actual = fingerprint(df, columns).select("data_hash").scalar()
    return log.where(F.col("generation_id") == generation_id).select(
        "generation_id",
        (F.col("output_hash") == actual).alias("verified"),
        F.col("output_hash").alias("expected_hash"),
        actual.alias("actual_hash"),
        "num_rows",
    )
