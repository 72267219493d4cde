"""Which rows or scores differ from their recorded state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinproof.functions.scalar import row_sha
from twinproof.operators.consensus import FINALS, MATCH_TOLERANCE


def changed_rows(recorded: DataFrame, current: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Keys whose rows differ, are missing, or are new.

    Only digests meet in the shuffle. Copies under one key are counted, so a
    changed copy shows as well.
    """
    keys = [key] if isinstance(key, str) else list(key)
    both = recorded.select(*keys, row_sha(recorded).alias("_d"), F.lit(1).alias("_s")).unionByName(
        current.select(*keys, row_sha(current).alias("_d"), F.lit(-1).alias("_s"))
    )
    return both.groupBy(*keys, "_d").agg(F.sum("_s").alias("_s")).where("_s <> 0").select(*keys).distinct()


def changed_scores(recorded: DataFrame, claimed: DataFrame) -> DataFrame:
    """Verification ids whose claimed finals differ from the recorded ones."""
    other = claimed.select("verification_id", *[F.col(s).alias(f"_c_{s}") for s in FINALS])
    differs = F.lit(False)
    for s in FINALS:
        differs = differs | (F.abs(F.col(s) - F.col(f"_c_{s}")) >= MATCH_TOLERANCE)
    return recorded.join(other, "verification_id").where(differs).select("verification_id")
