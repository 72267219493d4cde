"""Fairness post-processing of a synthetic table.

All steps work on the distinct rows and how often each stands in the table
(``_n``), so resampling is arithmetic on counts: a row that fills a third of the table
is one row, nothing is repeated or written in full between the steps, and rows
are multiplied once, at the end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinproof.functions.scalar import ratio, row_md5
from twinproof.operators.distributions import unpivoted
from twinproof.operators.sampling import replicate
from twinproof.roles import favorable_value
from twinproof.session import settle

PREFIX = 4  # hash digits by which the rows of a group are counted


def counted(rows: DataFrame, times: str | None = None) -> DataFrame:
    """Distinct rows with ``_n``, how often each stands there, and ``_h``, its hash."""
    columns = [c for c in rows.columns if c not in (times, "_h")]
    n = F.sum(times) if times else F.count("*")
    distinct = rows.groupBy(*columns).agg(n.cast("bigint").alias("_n"))
    return settle(distinct.withColumn("_h", row_md5(distinct, columns)), "counted-rows")


def _plain(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c not in ("_n", "_h")]


def _listed(rows: DataFrame) -> DataFrame:
    """Each row as often as it counts."""
    return replicate(rows.drop("_h"), "_n")


def pick(rows: DataFrame, attribute: str, quota: DataFrame) -> DataFrame:
    """Rows of the groups of ``quota`` (attribute, quota, ...) with its columns and
    ``_picked``: how many of a row's copies are among the group's first ``quota`` in hash order.

    Groups are counted by the first digits of the uniform hash; only the bucket in which a
    quota ends is put in order.
    """
    keyed = rows.withColumn("_b", F.substring("_h", 1, PREFIX))
    over = Window.partitionBy(attribute).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = keyed.groupBy(attribute, "_b").agg(F.sum("_n").alias("_m")).withColumn("_before", F.coalesce(F.sum("_m").over(over), F.lit(0)))
    met = keyed.join(buckets.join(quota, attribute), [attribute, "_b"])
    left = F.col("quota") - F.col("_before")
    inside = Window.partitionBy(attribute, "_b").orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)
    edge = met.where((left > 0) & (left < F.col("_m"))).withColumn("_upto", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    edge = edge.withColumn("_picked", F.greatest(F.lit(0), F.least(F.col("_n"), left - F.col("_upto")))).drop("_upto")
    rest = met.where((left <= 0) | (left >= F.col("_m"))).withColumn("_picked", F.when(left > 0, F.col("_n")).otherwise(0))
    return rest.unionByName(edge).withColumn("_picked", F.col("_picked").cast("bigint")).drop("_b", "_m", "_before")


def group_targets(real: DataFrame, rows: DataFrame, attribute: str) -> DataFrame:
    """(attribute, size, target, gap) for groups present in both tables.

    ``rows`` are counted; target is the truncated real share of all their copies.
    """
    both = real.select(F.col(attribute), F.lit(1).cast("bigint").alias("r"), F.lit(0).cast("bigint").alias("s")).unionByName(
        rows.select(F.col(attribute), F.lit(0).cast("bigint").alias("r"), F.col("_n").alias("s"))
    )
    sizes = both.groupBy(attribute).agg(F.sum("r").alias("r"), F.sum("s").alias("size"))
    totals = sizes.agg(
        F.struct(
            F.sum(F.when(F.col(attribute).isNotNull(), F.col("r"))).alias("r"),
            F.sum("size").alias("rows"),
            F.sum(F.when(F.col(attribute).isNotNull(), F.col("size"))).alias("s"),
        )
    ).scalar()
    share = ratio(F.col("r"), totals["r"])
    groups = sizes.where(F.col(attribute).isNotNull() & (F.col("r") > 0) & (F.col("size") > 0))
    return groups.select(
        attribute,
        "size",
        F.floor(totals["rows"] * share).cast("bigint").alias("target"),
        F.abs(share - ratio(F.col("size"), totals["s"])).alias("gap"),
    )


def _resample(rows: DataFrame, attribute: str, targets: DataFrame) -> DataFrame:
    """Bring every listed group to its target size; other groups leave.

    Growing groups repeat each row evenly, the remainder going to the rows
    first in hash order; shrinking groups keep the first rows.
    """
    plan = targets.select(attribute, F.expr("target div size").alias("_each"), F.expr("target % size").alias("quota"))
    marked = pick(rows, attribute, plan).withColumn("_n", F.col("_n") * F.col("_each") + F.col("_picked"))
    return settle(marked.where("_n > 0").select(*rows.columns), "resampled")


def _rebalanced(real: DataFrame, rows: DataFrame, protected: Sequence[str]) -> DataFrame:
    for a in protected:
        if a in rows.columns and a in real.columns:
            rows = _resample(rows, a, group_targets(real, rows, a))
    return rows


def rebalance(real: DataFrame, synth: DataFrame, protected: Sequence[str]) -> DataFrame:
    """Match group shares to the real table, one attribute after the other."""
    return _listed(_rebalanced(real, counted(synth), protected))


def _at_parity(real: DataFrame, rows: DataFrame, protected: Sequence[str], tolerance: float) -> DataFrame:
    for a in protected:
        if a not in rows.columns or a not in real.columns:
            continue
        targets = settle(group_targets(real, rows, a), "group-targets")
        worst = targets.agg(F.max("gap")).first()[0]
        if worst is not None and worst > tolerance:
            rows = _resample(rows, a, targets.where("target > 0"))
    return rows


def enforce_parity(real: DataFrame, synth: DataFrame, protected: Sequence[str], tolerance: float = 0.05) -> DataFrame:
    """Rebalance only attributes with a share gap above the tolerance."""
    return _listed(_at_parity(real, counted(synth), protected, tolerance))


def flips_needed(rows: DataFrame, attribute: str, target: str, favorable, target_ratio: float = 0.9) -> DataFrame:
    """(attribute, size, good, rate, to_flip) per group of counted rows."""
    good = F.coalesce((F.col(target) == F.lit(favorable)).cast("int"), F.lit(0))
    groups = (
        rows.where(F.col(attribute).isNotNull())
        .groupBy(attribute)
        .agg(F.sum("_n").alias("size"), F.sum(good * F.col("_n")).alias("good"))
        .withColumn("rate", ratio(F.col("good"), F.col("size")))
    )
    edge = groups.agg(F.struct(F.max("rate").alias("best"), F.count("*").alias("groups"))).scalar()
    short = (edge["best"] > 0) & (edge["groups"] >= 2) & (ratio(F.col("rate"), edge["best"]) < 0.8)
    wanted = F.floor(F.col("size") * (edge["best"] * target_ratio)) - F.col("good")
    return groups.withColumn(
        "to_flip", F.when(short, F.greatest(F.lit(0), wanted)).otherwise(F.lit(0)).cast("bigint")
    )


def _flipped(rows: DataFrame, protected: Sequence[str], target: str, favorable, target_ratio: float) -> DataFrame:
    kind = rows.schema[target].dataType
    for a in protected:
        if a not in rows.columns:
            continue
        good = F.coalesce(F.col(target) == F.lit(favorable), F.lit(False))
        quota = flips_needed(rows, a, target, favorable, target_ratio).where("to_flip > 0").select(a, F.col("to_flip").alias("quota"))
        names = _plain(rows)
        marked = settle(pick(rows.where(~good), a, quota), "flips")
        turned = marked.where("_picked > 0").select(*[F.lit(favorable).cast(kind).alias(c) if c == target else c for c in names], F.col("_picked").alias("_n"))
        # what was turned, less what it was: counts of equal rows add up
        gone = marked.where("_picked > 0").select(*names, (-F.col("_picked")).alias("_n"))
        rows = counted(rows.select(*names, "_n").unionByName(turned).unionByName(gone), "_n").where("_n > 0")
    return rows


def reduce_disparate_impact(
    synth: DataFrame, protected: Sequence[str], target: str, favorable=None, target_ratio: float = 0.9
) -> DataFrame:
    """Turn the first unfavourable rows of short groups to favourable."""
    if favorable is None:
        favorable = favorable_value(synth, target)
    return _listed(_flipped(counted(synth), protected, target, favorable, target_ratio))


def apply_all(real: DataFrame, synth: DataFrame, protected: Sequence[str], target: str | None = None, favorable=None) -> DataFrame:
    """Rebalance, enforce parity, then reduce disparate impact."""
    rows = _at_parity(real, _rebalanced(real, counted(synth), protected), protected, 0.05)
    if target:
        rows = _flipped(rows, protected, target, favorable if favorable is not None else favorable_value(_listed(rows), target), 0.9)
    return _listed(rows)


def improvement(real: DataFrame, original: DataFrame, processed: DataFrame, protected: Sequence[str]) -> DataFrame:
    """Per group: real, original and processed share, gaps, improved flag."""
    three = unpivoted(real, protected, is_real=0).unionByName(unpivoted(original, protected, is_real=1)).unionByName(
        unpivoted(processed, protected, is_real=2)
    ).withColumnRenamed("is_real", "part")

    def part(i: int, name: str):
        return F.sum((F.col("part") == i).cast("int")).alias(name)

    counts = three.groupBy(F.col("column").alias("attribute"), F.col("value").alias("group")).agg(
        part(0, "r"), part(1, "o"), part(2, "p")
    )
    totals = counts.groupBy("attribute").agg(*[F.sum(c).alias(f"t{c}") for c in "rop"])
    shares = counts.join(F.broadcast(totals), "attribute").where("r > 0").select(
        "attribute",
        "group",
        ratio(F.col("r"), F.col("tr")).alias("real_share"),
        ratio(F.col("o"), F.col("to")).alias("original_share"),
        ratio(F.col("p"), F.col("tp")).alias("processed_share"),
    )
    before = F.abs(F.col("real_share") - F.col("original_share"))
    after = F.abs(F.col("real_share") - F.col("processed_share"))
    return shares.withColumns({"original_diff": before, "processed_diff": after, "improved": after < before})


def improvement_summary(report: DataFrame) -> DataFrame:
    """Per attribute: largest gap before and after, and the gain."""
    return report.groupBy("attribute").agg(
        F.max("original_diff").alias("original_max_diff"),
        F.max("processed_diff").alias("processed_max_diff"),
        (F.max("original_diff") - F.max("processed_diff")).alias("improvement"),
    )
