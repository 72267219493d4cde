"""Metric frames combined into axis scores, verdicts and advice."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinproof.functions.scalar import weighted_score
from twinproof.operators import correlation, distance, fairness, models, privacy, utility
from twinproof.operators.distributions import without_nan
from twinproof.roles import ColumnRoles, is_number
from twinproof.session import build_together, settle

# Metric weights of each axis.
WEIGHTS: dict[str, dict[str, float]] = {
    "privacy": {"dcr": 0.3, "k_anonymity": 0.2, "membership_inference": 0.3, "attribute_disclosure": 0.2},
    "utility": {"statistical_similarity": 0.4, "correlation_preservation": 0.3, "ml_efficacy": 0.3},
    "fairness": {"demographic_parity": 0.25, "disparate_impact": 0.25, "equal_opportunity": 0.25, "statistical_parity": 0.25},
}
MODEL_METRICS = {"membership_inference", "ml_efficacy", "equal_opportunity"}
MISSING_SCORE = 70.0

Metric = Callable[[DataFrame, DataFrame, ColumnRoles], DataFrame]
_REGISTRY: dict[str, dict[str, tuple[float, Metric]]] = {axis: {} for axis in WEIGHTS}


def register_metric(axis: str, name: str, weight: float, fn: Metric) -> None:
    """Add a metric: ``fn(real, synth, roles)`` gives one row with score, passed."""
    _REGISTRY.setdefault(axis, {})[name] = (weight, fn)


def registered_weights(axis: str) -> dict[str, float]:
    return {name: weight for name, (weight, _) in _REGISTRY[axis].items()}


def _over_attributes(per_attribute: DataFrame) -> DataFrame:
    """Mean score over attributes; passed if all of them pass.

    Attributes that cannot be judged (fewer than two groups) are not counted;
    with none left the score is 0 and nothing has failed.
    """
    return per_attribute.agg(
        F.coalesce(F.avg("score"), F.lit(0.0)).alias("score"), F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed")
    )


def _encoded_kinds(real: DataFrame, roles: ColumnRoles) -> tuple[list[str], list[str]]:
    """Number and text columns by data type, for distances and models."""
    texts = [f.name for f in real.schema if f.name in roles.columns and not is_number(f.dataType)]
    return [c for c in roles.columns if c not in texts], texts


def working_copy(real: DataFrame, synth: DataFrame, roles: ColumnRoles) -> tuple[DataFrame, DataFrame]:
    """Both tables cut to the columns with a role, written to the shared folder.

    Metrics then scan only these columns, and a pair that is itself the
    result of joins is not joined again for every metric. A NaN is a missing
    value: it becomes null here, once.
    """
    used = {*roles.columns, *roles.quasi_identifiers, *roles.protected, *roles.sensitive, roles.target}
    columns = [c for c in real.columns if c in used]
    both = build_together(
        real.sparkSession, [lambda: settle(without_nan(real, columns), "real"), lambda: settle(without_nan(synth, columns), "synthetic")]
    )
    return both[0], both[1]


def _rates(real: DataFrame, synth: DataFrame, roles: ColumnRoles) -> DataFrame:
    return fairness.favorable_rates(real, synth, roles.protected, roles.target, roles.favorable)


register_metric("privacy", "dcr", 0.3, lambda r, s, ro: distance.dcr_full(r, s, *_encoded_kinds(r, ro)))
register_metric("privacy", "k_anonymity", 0.2, lambda r, s, ro: privacy.k_anonymity(s, ro.quasi_identifiers))
register_metric("privacy", "membership_inference", 0.3, lambda r, s, ro: models.membership_inference(r, s, *_encoded_kinds(r, ro)))
register_metric("privacy", "attribute_disclosure", 0.2, lambda r, s, ro: privacy.disclosure(r, s, ro.sensitive or ro.columns))
register_metric("utility", "statistical_similarity", 0.4, lambda r, s, ro: utility.statistical_similarity(r, s, ro.numeric, ro.categorical))
register_metric("utility", "correlation_preservation", 0.3, lambda r, s, ro: correlation.preservation(r, s, ro.categorical, ro.columns))
register_metric("utility", "ml_efficacy", 0.3, lambda r, s, ro: models.train_on_synthetic(r, s, *_encoded_kinds(r, ro), ro.target))
register_metric("fairness", "demographic_parity", 0.25, lambda r, s, ro: _over_attributes(fairness.representation(r, s, ro.protected)))
register_metric("fairness", "disparate_impact", 0.25, lambda r, s, ro: _over_attributes(fairness.disparate_impact(_rates(r, s, ro))))
register_metric(
    "fairness",
    "equal_opportunity",
    0.25,
    lambda r, s, ro: _over_attributes(models.equal_opportunity(r, s, *_encoded_kinds(r, ro), ro.protected, ro.target)),
)
register_metric("fairness", "statistical_parity", 0.25, lambda r, s, ro: _over_attributes(fairness.statistical_parity(_rates(r, s, ro))))

_NEEDS_TARGET = {"ml_efficacy", "disparate_impact", "equal_opportunity", "statistical_parity"}


def axis_metrics(
    axis: str, real: DataFrame, synth: DataFrame, roles: ColumnRoles, with_models: bool = True, skip: Sequence[str] = ()
) -> DataFrame:
    """(axis, metric, weight, score, passed) of every metric that applies.

    A metric without its target or protected columns is absent, not zero.
    """
    rows = build_together(real.sparkSession, _metric_jobs(axis, real, synth, roles, with_models, skip))
    if not rows:
        return real.sparkSession.createDataFrame([], "axis string, metric string, weight double, score double, passed boolean")
    return _union(rows)


def _metric_jobs(axis: str, real: DataFrame, synth: DataFrame, roles: ColumnRoles, with_models: bool, skip: Sequence[str] = ()):
    """Builders of the metric rows of one axis that apply to this pair."""
    jobs = []
    for name, (weight, fn) in _REGISTRY[axis].items():
        if name in skip or (name in MODEL_METRICS and not with_models):
            continue
        if (name in _NEEDS_TARGET and roles.target is None) or (axis == "fairness" and not roles.protected):
            continue

        def job(name=name, weight=weight, fn=fn) -> DataFrame:
            return fn(real, synth, roles).select(
                F.lit(axis).alias("axis"),
                F.lit(name).alias("metric"),
                F.lit(float(weight)).alias("weight"),
                F.col("score").cast("double").alias("score"),
                "passed",
            )

        jobs.append(job)
    return jobs


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def axis_score(metrics: DataFrame, weights: Mapping[str, float], renormalise: bool = False) -> DataFrame:
    """(axis, score, passed, missing_metrics) of one or more axes.

    A missing metric contributes nothing and, unless ``renormalise`` is set,
    its weight is not redistributed.
    """
    weighed = F.sum(F.col("score") * F.col("weight"))
    score = weighed / F.sum("weight") if renormalise else weighed
    have = F.collect_set("metric")  # at most one item per registered metric
    wanted = F.array(*[F.lit(m) for m in sorted(weights)])
    return metrics.groupBy("axis").agg(
        score.alias("score"), F.bool_and("passed").alias("passed"), F.array_join(F.array_except(wanted, have), ",").alias("missing_metrics")
    )


def scorecard(
    real: DataFrame, synth: DataFrame, roles: ColumnRoles, with_models: bool = False, renormalise: bool = False
) -> DataFrame:
    """(axis, metric, weight, score, passed): metrics, axis totals and trust.

    Axis totals have metric "overall"; the trust row weighs the axes 40/35/25.
    Without protected attributes fairness is 100 and marked as skipped. The
    columns in use are written out once, as every metric reads them.
    """
    real, synth = working_copy(real, synth, roles)
    axes = [a for a in WEIGHTS if a != "fairness" or roles.protected]
    rows = build_together(real.sparkSession, [job for a in axes for job in _metric_jobs(a, real, synth, roles, with_models)])
    # A dozen rows at most, written so that totals and trust do not compute them again.
    metrics = settle(_union(rows), "metrics")
    weights = {m: w for a in axes for m, w in registered_weights(a).items()}
    totals = axis_score(metrics, weights, renormalise).select(
        "axis", F.lit("overall").alias("metric"), F.lit(None).cast("double").alias("weight"), "score", "passed"
    )
    if "fairness" not in axes:
        totals = totals.unionByName(
            real.sparkSession.range(1).select(
                F.lit("fairness").alias("axis"), F.lit("skipped").alias("metric"), F.lit(None).cast("double").alias("weight"), F.lit(100.0).alias("score"), F.lit(True).alias("passed")
            )
        )
    axis_value = {a: F.max(F.when(F.col("axis") == a, F.col("score"))) for a in WEIGHTS}
    trust = totals.agg(
        weighted_score(axis_value["privacy"], axis_value["utility"], axis_value["fairness"]).alias("score"), F.bool_and("passed").alias("passed")
    ).select(F.lit("trust").alias("axis"), F.lit("overall").alias("metric"), F.lit(None).cast("double").alias("weight"), "score", "passed")
    return metrics.unionByName(totals).unionByName(trust)


def verdict(totals: DataFrame, threshold: float = 70.0) -> DataFrame:
    """One row: axis scores, pass flags, plain mean, APPROVED or REJECTED.

    ``totals`` has (axis, score) with one row per axis.
    """

    def value(axis: str):
        return F.max(F.when(F.col("axis") == axis, F.col("score")))

    row = totals.agg(*[value(a).alias(f"{a}_score") for a in WEIGHTS])
    scores = [F.col(f"{a}_score") for a in WEIGHTS]
    passed = [s >= threshold for s in scores]
    return row.select(
        *scores,
        *[p.alias(f"{a}_passed") for a, p in zip(WEIGHTS, passed)],
        ((scores[0] + scores[1] + scores[2]) / 3).alias("overall_score"),
        F.when(passed[0] & passed[1] & passed[2], "APPROVED").otherwise("REJECTED").alias("overall_status"),
    )


def evaluate_all(real: DataFrame, synth: DataFrame, roles: ColumnRoles, with_models: bool = True) -> DataFrame:
    """Evaluator scores: (axis, metric, attribute, score) with plain means per axis.

    Fairness has one row per metric and protected attribute; the other metrics have no attribute.
    """
    real, synth = working_copy(real, synth, roles)
    numbers, texts = _encoded_kinds(real, roles)
    parts = {
        ("privacy", "dcr", None): (lambda: distance.dcr_evaluator_full(real, synth, numbers, texts), "dcr_score"),
        ("privacy", "k_anonymity", None): (lambda: privacy.k_anonymity_evaluator(synth, roles.quasi_identifiers or texts), "k_score"),
        ("utility", "statistical_similarity", None): (lambda: utility.evaluator_similarity(real, synth, numbers, texts), "similarity_score"),
        ("utility", "correlation_preservation", None): (lambda: correlation.offdiagonal_preservation(real, synth, numbers), "correlation_score"),
    }
    if with_models:
        parts[("privacy", "membership_inference", None)] = (
            lambda: models.membership_inference_evaluator(real, synth, numbers, texts),
            "privacy_score",
        )
        if roles.target:
            parts[("utility", "ml_efficacy", None)] = (
                lambda: models.evaluator_efficacy(real, synth, numbers, roles.target, roles.target in texts),
                "ml_efficacy_score",
            )
    for attribute in roles.protected if roles.target else ():
        rates = fairness.outcome_rates(synth, attribute, roles.target, roles.favorable)
        parts[("fairness", "demographic_parity", attribute)] = (lambda rates=rates: fairness.evaluator_parity(rates), "dp_score")
        parts[("fairness", "disparate_impact", attribute)] = (lambda rates=rates: fairness.evaluator_impact(rates), "di_score")

    def job(key: tuple, build: Callable[[], DataFrame], column: str) -> Callable[[], DataFrame]:
        names = [F.lit(k).cast("string").alias(n) for k, n in zip(key, ("axis", "metric", "attribute"))]
        return lambda: build().select(*names, F.col(column).cast("double").alias("score"))

    rows = settle(_union(build_together(real.sparkSession, [job(k, b, c) for k, (b, c) in parts.items()])), "metrics")
    overall = [F.lit("overall").alias("metric"), F.lit(None).cast("string").alias("attribute"), "score"]
    means = rows.groupBy("axis").agg(F.avg("score").alias("score")).select("axis", *overall)
    composite = means.agg(F.avg("score").alias("score")).select(F.lit("composite").alias("axis"), *overall)
    return rows.unionByName(means).unionByName(composite)


def ablation(metrics: DataFrame, weights: Mapping[str, Mapping[str, float]] = WEIGHTS) -> DataFrame:
    """(axis, without, full_score, ablated_score, contribution) per metric.

    The remaining weights are renormalised; a missing metric counts as 70.
    Sums are shared and the left-out part subtracted, so metrics are not
    paired with each other.
    """
    rows = [(a, m, float(w)) for a, ms in weights.items() for m, w in ms.items()]
    catalogue = metrics.sparkSession.createDataFrame(rows, "axis string, metric string, w double")
    # The catalogue is fixed, a dozen rows.
    full = catalogue.join(metrics.select("axis", "metric", "score"), ["axis", "metric"], "left").select(
        "axis", "metric", "w", F.coalesce("score", F.lit(MISSING_SCORE)).alias("score")
    )
    sums = full.groupBy("axis").agg(F.sum(F.col("w") * F.col("score")).alias("ws"), F.sum("w").alias("tw"))
    ablated = (F.col("ws") - F.col("w") * F.col("score")) / (F.col("tw") - F.col("w"))
    return full.join(F.broadcast(sums), "axis").select(
        "axis",
        F.col("metric").alias("without"),
        F.col("ws").alias("full_score"),
        ablated.alias("ablated_score"),
        (F.col("ws") - ablated).alias("contribution"),
    )


# Advice given when a metric fails.
ADVICE = {
    ("privacy", "k_anonymity"): "k-Anonymity violation detected. Minimum k=%d. Consider generalizing quasi-identifiers.",
    ("privacy", "membership_inference"): "High membership inference risk (accuracy=%.2f%%). Consider using differential privacy during training.",
    ("privacy", "attribute_disclosure"): "Attribute disclosure risk detected. Review sensitive column distributions.",
    ("privacy", "dcr_matches"): "WARNING: Exact matches found between synthetic and real data. Consider adding noise or retraining the generator.",
    ("privacy", "dcr"): "DCR is below threshold. Consider increasing generator diversity.",
    ("privacy", ""): "All privacy checks passed. Data is safe for release.",
    ("utility", "statistical_similarity"): "Statistical distributions differ significantly. Consider increasing training epochs or adjusting generator architecture.",
    ("utility", "correlation_preservation"): "Poor correlation preservation for columns: %s. Consider using correlation-aware generators.",
    ("utility", "ml_efficacy"): "ML efficacy ratio is %.2f%%. Synthetic data may not be suitable for downstream ML tasks.",
    ("utility", ""): "All utility checks passed. Data maintains good utility.",
    ("fairness", "demographic_parity"): "Demographic parity violated for: %s. Consider rebalancing the training data.",
    ("fairness", "disparate_impact"): "Disparate impact detected. The 80% rule is violated. Consider using fairness-aware generation techniques.",
    ("fairness", "equal_opportunity"): "Unequal true positive rates across groups detected. This may indicate discriminatory patterns in the synthetic data.",
    ("fairness", "statistical_parity"): "Statistical parity difference is too high. Favorable outcomes are not evenly distributed across groups.",
    ("fairness", ""): "All fairness checks passed. No significant bias detected.",
}


def recommendations(axis: str, findings: Mapping[str, tuple[DataFrame, Callable]]) -> DataFrame:
    """(axis, recommendation) rows.

    ``findings`` maps a metric to its one-row frame and a function giving the
    advice column (null when there is nothing to say).
    """
    rows = None
    for _, (frame, advice) in findings.items():
        one = frame.select(F.lit(axis).alias("axis"), advice().alias("recommendation"))
        rows = one if rows is None else rows.unionByName(one)
    said = rows.where(F.col("recommendation").isNotNull())
    none = said.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(axis).alias("axis"), F.lit(ADVICE[(axis, "")]).alias("recommendation"))
    return said.unionByName(none)


def privacy_recommendations(dcr: DataFrame, k: DataFrame, disclosure: DataFrame, attack: DataFrame | None = None) -> DataFrame:
    bad = ~F.col("passed")
    findings = {
        "dcr": (dcr, lambda: F.when(bad, F.when(F.col("exact_matches") > 0, ADVICE[("privacy", "dcr_matches")]).otherwise(ADVICE[("privacy", "dcr")]))),
        "k_anonymity": (k, lambda: F.when(bad, F.format_string(ADVICE[("privacy", "k_anonymity")], "min_k"))),
        "attribute_disclosure": (disclosure, lambda: F.when(bad, F.lit(ADVICE[("privacy", "attribute_disclosure")]))),
    }
    if attack is not None:
        findings["membership_inference"] = (
            attack,
            lambda: F.when(bad, F.format_string(ADVICE[("privacy", "membership_inference")], F.col("attack_accuracy") * 100)),
        )
    return recommendations("privacy", findings)


def utility_recommendations(similarity: DataFrame, preservation: DataFrame, by_column: DataFrame, order: Sequence[str], efficacy: DataFrame | None = None, most_names: int | None = None) -> DataFrame:
    """The correlation advice names the columns beyond 0.15 in ``order``, ``most_names`` of them if given."""
    place = F.array_position(F.array(*[F.lit(c) for c in order]), F.col("column"))
    found = F.array_sort(F.collect_list(F.struct(place.alias("p"), "column")))  # at most one item per column
    named = F.slice(found, 1, most_names) if most_names else found
    far = by_column.where(F.col("mean_diff") > 0.15).agg(F.array_join(F.transform(named, lambda x: x["column"]), ", ").alias("names"))
    bad = ~F.col("passed")
    named = preservation.withColumn("names", far.scalar())
    findings = {
        "statistical_similarity": (similarity, lambda: F.when(bad, F.lit(ADVICE[("utility", "statistical_similarity")]))),
        "correlation_preservation": (
            named,
            lambda: F.when(bad & (F.col("names") != ""), F.format_string(ADVICE[("utility", "correlation_preservation")], "names")),
        ),
    }
    if efficacy is not None:
        findings["ml_efficacy"] = (efficacy, lambda: F.when(bad, F.format_string(ADVICE[("utility", "ml_efficacy")], F.col("efficacy_ratio") * 100)))
    return recommendations("utility", findings)


def fairness_recommendations(parity: DataFrame, impact: DataFrame, spd: DataFrame, opportunity: DataFrame | None = None) -> DataFrame:
    """Input frames have one row per protected attribute."""
    bad = F.count(F.when(~F.col("passed"), 1)) > 0
    failed = parity.agg(F.array_join(F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("attribute")))), ", ").alias("names"))
    findings = {
        "demographic_parity": (failed, lambda: F.when(F.col("names") != "", F.format_string(ADVICE[("fairness", "demographic_parity")], "names"))),
    }
    for name, frame in (("disparate_impact", impact), ("equal_opportunity", opportunity), ("statistical_parity", spd)):
        if frame is not None:
            text = ADVICE[("fairness", name)]
            findings[name] = (frame.agg(bad.alias("bad")), lambda text=text: F.when(F.col("bad"), F.lit(text)))
    return recommendations("fairness", findings)
