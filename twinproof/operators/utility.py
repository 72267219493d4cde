"""Utility metrics over distributions, and scores of model predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinproof.functions.scalar import ratio
from twinproof.operators.cdf import numeric_distances, summary_statistics
from twinproof.operators.correlation import correlation_pairs
from twinproof.operators.distributions import divergences


def statistical_similarity(
    real: DataFrame, synth: DataFrame, numeric: Sequence[str], categorical: Sequence[str]
) -> DataFrame:
    """One row: average Wasserstein and Jensen-Shannon distance, score, passed."""
    parts = []
    if numeric:
        parts.append(numeric_distances(real, synth, numeric).select(F.lit("w").alias("kind"), F.col("wasserstein").alias("d")))
    if categorical:
        parts.append(divergences(real, synth, categorical).select(F.lit("js").alias("kind"), F.col("js_distance").alias("d")))
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    w, js = F.col("avg_wasserstein"), F.col("avg_js_distance")

    def score(d):
        return F.when(d < 0.2, F.greatest(F.lit(0.0), 100 - d * 500)).otherwise(F.lit(0.0))

    combined = score(w) * 0.6 + score(js) * 0.4 if categorical else score(w)
    return both.agg(
        F.coalesce(F.avg(F.when(F.col("kind") == "w", F.col("d"))), F.lit(0.0)).alias("avg_wasserstein"),
        F.coalesce(F.avg(F.when(F.col("kind") == "js", F.col("d"))), F.lit(0.0)).alias("avg_js_distance"),
    ).select(
        "avg_wasserstein", "avg_js_distance", combined.alias("score"), ((w < 0.1) & (js < 0.15)).alias("passed")
    )


def evaluator_similarity(
    real: DataFrame, synth: DataFrame, numeric: Sequence[str], categorical: Sequence[str]
) -> DataFrame:
    """One row: mean and deviation shifts in real deviations, mean TV, score."""
    kinds = []
    if numeric:
        stats = summary_statistics(real, synth, numeric).where("std_real > 0")
        shifts = F.explode(
            F.array(
                F.struct(F.lit("mean").alias("kind"), (F.abs(F.col("mean_real") - F.col("mean_synth")) / F.col("std_real")).alias("d")),
                F.struct(F.lit("std").alias("kind"), (F.abs(F.col("std_real") - F.col("std_synth")) / F.col("std_real")).alias("d")),
            )
        )
        kinds.append(stats.select(shifts.alias("x")).select("x.*"))
    if categorical:
        kinds.append(divergences(real, synth, categorical).select(F.lit("tv").alias("kind"), F.col("tv_distance").alias("d")))
    both = kinds[0] if len(kinds) == 1 else kinds[0].unionByName(kinds[1])

    def mean_of(kind: str):
        return F.avg(F.when(F.col("kind") == kind, F.col("d")))

    out = both.agg(mean_of("mean").alias("mean_diff"), mean_of("std").alias("std_diff"), mean_of("tv").alias("tv_distance"))
    present = F.array_compact(F.array("mean_diff", "std_diff", "tv_distance"))
    penalty = ratio(F.aggregate(present, F.lit(0.0), lambda a, x: a + x), F.size(present))
    return out.withColumn("similarity_score", F.greatest(F.lit(0.0), 100 - penalty * 100))


def quality_report(
    real: DataFrame, synth: DataFrame, numeric: Sequence[str], categorical: Sequence[str]
) -> DataFrame:
    """(property, score): column shapes, column pair trends and their mean.

    Shapes are 1 - KS for numbers and 1 - TV for categories; trends are
    1 - |correlation difference| / 2 over pairs of number columns.
    """
    shapes = numeric_distances(real, synth, numeric).select((1 - F.col("ks")).alias("s"))
    if categorical:
        shapes = shapes.unionByName(divergences(real, synth, categorical).select((1 - F.col("tv_distance")).alias("s")))
    pairs = correlation_pairs(real, synth, [], numeric).where("col_a < col_b")
    parts = shapes.agg(F.avg("s").alias("score")).select(F.lit("column_shapes").alias("property"), "score").unionByName(
        pairs.agg(F.avg(1 - F.col("diff") / 2).alias("score")).select(F.lit("column_pair_trends").alias("property"), "score")
    )
    # Two rows in, three rows out.
    both = parts.select(F.explode(F.array("property", F.lit("overall"))).alias("property"), "score")
    return both.groupBy("property").agg(F.avg("score").alias("score"))


def classification_scores(predictions: DataFrame, label: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy and support-weighted F1 per ``by`` group.

    Built on the confusion counts, whose number is bounded by labels squared.
    """
    cells = predictions.groupBy(*by, F.col(label).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    sides = cells.select(
        *by,
        "n",
        (F.col("t") == F.col("p")).alias("hit"),
        F.explode(F.array(F.struct(F.lit(1).alias("actual"), F.col("t").alias("label")), F.struct(F.lit(0).alias("actual"), F.col("p").alias("label")))).alias("side"),
    )
    per_label = sides.groupBy(*by, "side.label").agg(
        F.sum(F.when(F.col("side.actual") == 1, F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("side.actual") == 0, F.col("n")).otherwise(0)).alias("called"),
        F.sum(F.when((F.col("side.actual") == 1) & F.col("hit"), F.col("n")).otherwise(0)).alias("tp"),
    )
    f1 = ratio(2.0 * F.col("tp"), F.col("support") + F.col("called"))
    return per_label.groupBy(*by).agg(
        ratio(F.sum("tp"), F.sum("support")).alias("accuracy"),
        ratio(F.sum(f1 * F.col("support")), F.sum("support")).alias("weighted_f1"),
    )


def regression_scores(predictions: DataFrame, label: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """R2, RMSE and RMSE relative to the target range per ``by`` group."""
    y, p = F.col(label).cast("double"), F.col(predicted).cast("double")
    return (
        predictions.groupBy(*by)
        .agg(
            F.avg((y - p) * (y - p)).alias("mse"),
            F.var_pop(y).alias("var"),
            (F.max(y) - F.min(y)).alias("range"),
        )
        .select(
            *by,
            ratio(F.col("var") - F.col("mse"), F.col("var")).alias("r2"),
            F.sqrt("mse").alias("rmse"),
            F.coalesce(F.sqrt("mse") / F.nullif(F.col("range"), F.lit(0.0)), F.sqrt("mse")).alias("normalized_rmse"),
        )
    )
