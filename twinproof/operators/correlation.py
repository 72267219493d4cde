"""Correlation matrices and how well they are preserved."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinproof.operators import encoding

FUSED_PAIRS = 120
SUMS_PER_AGGREGATE = 40
PAIRS_PER_AGGREGATE = 8


def _pair_correlations(numbers: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(_s, col_a, col_b, corr) for a <= b in column order, per side ``_s``.

    A first pass takes count, mean and deviation of each column and side. A
    correlation is the mean product of standardised values where nothing is missing
    (plain sums that stay in generated code), else that of the rows that
    have both values; aggregates are kept short enough to be compiled. Of very many
    columns, each batch of rows becomes its matrices of sums. No row is copied for its pairs.
    """
    columns = list(columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    facts = numbers.groupBy("_s").agg(
        F.count("*").alias("n"),
        *[f(c).alias(f"{k}_{c}") for c in columns for k, f in (("n", F.count), ("mean", F.avg), ("sd", F.stddev_pop))],
    ).collect()  # one row per side
    if len(pairs) > FUSED_PAIRS:
        return _matrix_correlations(numbers, columns, facts)
    if all(r[f"n_{c}"] == r["n"] for r in facts for c in columns):
        return _fused_correlations(numbers, columns, pairs, facts)

    def both(a: Column, b: Column) -> Column:  # null, not an error, where either is constant
        spread = F.stddev_pop(F.when(b.isNotNull(), a)) * F.stddev_pop(F.when(a.isNotNull(), b))
        return F.covar_pop(a, b) / F.nullif(spread, F.lit(0.0))

    return _listed(numbers, pairs, both, PAIRS_PER_AGGREGATE)


def _listed(numbers: DataFrame, pairs: Sequence[tuple[str, str]], measure, at_once: int) -> DataFrame:
    """One aggregate for every few pairs, its results as rows."""
    out = None
    for start in range(0, len(pairs), at_once):
        part = pairs[start : start + at_once]
        sums = numbers.groupBy("_s").agg(*[measure(F.col(a), F.col(b)).alias(f"c{i}") for i, (a, b) in enumerate(part)])
        items = [
            F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"c{i}").alias("corr"))
            for i, (a, b) in enumerate(part)
        ]
        rows = sums.select("_s", F.explode(F.array(*items)).alias("p")).select("_s", "p.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def _matrix_correlations(numbers: DataFrame, columns: list[str], facts) -> DataFrame:
    """Sums of products by matrix products per batch, over the rows that have both values.

    Values are centred by the column's mean first. A task hands on one row per side
    and column of the matrix, folded over its batches.
    """
    d = len(columns)
    centre = {r["_s"]: np.array([r[f"mean_{c}"] or 0.0 for c in columns]) for r in facts}
    names = ("n", "a", "b", "aa", "bb", "ab")

    def run(batches):
        total = {}
        for batch in batches:
            sides = batch.column(0).to_numpy(zero_copy_only=False)
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[1:]])
            for s in np.unique(sides):
                own = x[sides == s] - centre[int(s)]
                there = ~np.isnan(own)
                own, there = np.where(there, own, 0.0), there.astype(float)
                parts = [there.T @ there, own.T @ there, there.T @ own, (own * own).T @ there, there.T @ (own * own), own.T @ own]
                total[int(s)] = [p + q for p, q in zip(total[int(s)], parts)] if int(s) in total else parts
        for s, parts in total.items():
            yield pa.RecordBatch.from_pydict({"_s": [s] * d, "i": list(range(d)), **{n: p.tolist() for n, p in zip(names, parts)}}, schema)

    schema = pa.schema([("_s", pa.int32()), ("i", pa.int32()), *[(n, pa.list_(pa.float64())) for n in names]])
    rows = numbers.select(F.col("_s").cast("int").alias("_s"), *columns).mapInArrow(run, "_s int, i int, " + ", ".join(f"{n} array<double>" for n in names))
    cells = rows.select("_s", "i", F.posexplode(F.arrays_zip(*names)).alias("j", "v")).where("j >= i").select("_s", "i", "j", "v.*")
    sums = cells.groupBy("_s", "i", "j").agg(*[F.sum(n).alias(n) for n in names])
    spread = (F.col("aa") - F.col("a") * F.col("a") / F.col("n")) * (F.col("bb") - F.col("b") * F.col("b") / F.col("n"))
    corr = F.when((F.col("n") > 0) & (spread > 0), (F.col("ab") - F.col("a") * F.col("b") / F.col("n")) / F.sqrt(spread))
    label = F.array(*[F.lit(c) for c in columns])
    return sums.select("_s", label[F.col("i")].alias("col_a"), label[F.col("j")].alias("col_b"), corr.alias("corr"))


def _fused_correlations(numbers: DataFrame, columns: Sequence[str], pairs: Sequence[tuple[str, str]], facts) -> DataFrame:
    def standard(c: str) -> Column:
        z = F.lit(None).cast("double")
        for r in facts:
            if r[f"sd_{c}"]:  # a constant column has no correlation
                z = F.when(F.col("_s") == r["_s"], (F.col(c) - r[f"mean_{c}"]) / r[f"sd_{c}"]).otherwise(z)
        return z

    scaled = numbers.select("_s", *[standard(c).alias(c) for c in columns])
    return _listed(scaled, pairs, lambda a, b: F.avg(a * b), SUMS_PER_AGGREGATE)


def _mirrored(half: DataFrame, values: Sequence[str]) -> DataFrame:
    other = half.where("col_a <> col_b").select(F.col("col_b").alias("col_a"), F.col("col_a").alias("col_b"), *values)
    return half.select("col_a", "col_b", *values).unionByName(other)


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(col_a, col_b, corr) of one table of numbers."""
    numbers = df.select(F.lit(0).alias("_s"), *[F.col(c).cast("double").alias(c) for c in columns])
    return _mirrored(_pair_correlations(numbers, columns), ["corr"])


def correlation_pairs(
    real: DataFrame, synth: DataFrame, categorical: Sequence[str], columns: Sequence[str], scope: str = "separate"
) -> DataFrame:
    """(col_a, col_b, corr_real, corr_synth, diff); at most one row per pair.

    Both tables run through one aggregation. Label codes are fitted per table
    ("separate", as the score is defined) or on the union.
    """
    labels = [c for c in columns if c in categorical]
    both = real.select(F.lit(0).alias("_s"), *columns).unionByName(synth.select(F.lit(1).alias("_s"), *columns))
    if labels:
        codes = encoding.dictionary([real, synth], labels, scope)
        both = encoding.encode(both, codes, labels, side="_s" if scope == "separate" else None)
    numbers = both.select("_s", *[F.col(c).cast("double").alias(c) for c in columns])
    sides = _pair_correlations(numbers, columns)
    half = sides.groupBy("col_a", "col_b").agg(
        F.max(F.when(F.col("_s") == 0, F.col("corr"))).alias("corr_real"),
        F.max(F.when(F.col("_s") == 1, F.col("corr"))).alias("corr_synth"),
    )
    out = _mirrored(half, ["corr_real", "corr_synth"])
    return out.withColumn("diff", F.abs(F.col("corr_real") - F.col("corr_synth")))


def preservation(real: DataFrame, synth: DataFrame, categorical: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row: mean and largest difference over the whole matrix, score, passed."""
    mean = F.avg("diff")
    return correlation_pairs(real, synth, categorical, columns).agg(
        mean.alias("mean_diff"), F.max("diff").alias("max_diff")
    ).select(
        "mean_diff",
        "max_diff",
        F.greatest(F.lit(0.0), 100 - F.col("mean_diff") * 500).alias("score"),
        (F.col("mean_diff") < 0.1).alias("passed"),
    )


def column_preservation(
    real: DataFrame, synth: DataFrame, categorical: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """(column, mean_diff) per column of the matrix."""
    pairs = correlation_pairs(real, synth, categorical, columns)
    return pairs.groupBy(F.col("col_a").alias("column")).agg(F.avg("diff").alias("mean_diff"))


def offdiagonal_preservation(real: DataFrame, synth: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """Evaluator variant: number columns only, without the diagonal."""
    if len(numeric) < 2:
        return real.sparkSession.range(1).select(
            F.lit(0.0).alias("correlation_diff"), F.lit(100.0).alias("correlation_score")
        )
    pairs = correlation_pairs(real, synth, [], numeric).where("col_a <> col_b")
    return pairs.agg(F.avg("diff").alias("correlation_diff")).withColumn(
        "correlation_score", F.greatest(F.lit(0.0), 100 - F.col("correlation_diff") * 100)
    )
