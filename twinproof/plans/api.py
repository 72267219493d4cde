"""One-call functions over a real and a synthetic table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinproof.operators import audit, compliance, fingerprint, generation, mitigation, quality, sampling
from twinproof.plans import scorecard
from twinproof.roles import ColumnRoles
from twinproof.session import settle


def _axis(axis: str, real: DataFrame, synth: DataFrame, roles: ColumnRoles, with_models: bool) -> DataFrame:
    real, synth = scorecard.working_copy(real, synth, roles)
    metrics = settle(scorecard.axis_metrics(axis, real, synth, roles, with_models), "metrics")
    total = scorecard.axis_score(metrics, scorecard.registered_weights(axis)).select(
        "axis", F.lit("overall").alias("metric"), F.lit(None).cast("double").alias("weight"), "score", "passed"
    )
    return metrics.unionByName(total)


def verify_privacy(real: DataFrame, synth: DataFrame, roles: ColumnRoles, with_models: bool = True) -> DataFrame:
    return _axis("privacy", real, synth, roles, with_models)


def verify_utility(real: DataFrame, synth: DataFrame, roles: ColumnRoles, with_models: bool = True) -> DataFrame:
    return _axis("utility", real, synth, roles, with_models)


def detect_bias(real: DataFrame, synth: DataFrame, roles: ColumnRoles, with_models: bool = True) -> DataFrame:
    return _axis("fairness", real, synth, roles, with_models)


def verify_synthetic_data(real: DataFrame, synth: DataFrame, roles: ColumnRoles, with_models: bool = True) -> DataFrame:
    """All metrics, axis totals and the trust score."""
    return scorecard.scorecard(real, synth, roles, with_models)


def evaluate_synthetic_data(real: DataFrame, synth: DataFrame, roles: ColumnRoles, with_models: bool = True) -> DataFrame:
    return scorecard.evaluate_all(real, synth, roles, with_models)


def post_process_for_fairness(real: DataFrame, synth: DataFrame, roles: ColumnRoles) -> DataFrame:
    return mitigation.apply_all(real, synth, roles.protected, roles.target, roles.favorable)


def generate_auditable_data(real: DataFrame, n: int, roles: ColumnRoles, run_ts: str) -> tuple[DataFrame, DataFrame]:
    """Generated rows (stratified bootstrap) and their generation record."""
    strata = [c for c in (*roles.protected, roles.target) if c]
    made = settle(sampling.stratified_bootstrap(real, n, strata), "generated")
    return made, generation.generation_record(real, made, "stratified_bootstrap", run_ts, roles.categorical, rows=n)


def check_compliance(
    real: DataFrame, synth: DataFrame, roles: ColumnRoles, privacy: float | None, utility: float | None, fairness: float | None, has_audit: bool
) -> DataFrame:
    """The rule results of one dataset from its scores and column names."""
    spark = real.sparkSession
    frames = [
        spark.createDataFrame([("dataset", i, c) for i, c in enumerate(df.columns)], "dataset string, position int, column string") for df in (real, synth)
    ]
    scores = spark.createDataFrame([("dataset", privacy, utility, fairness, has_audit)], "dataset string, privacy double, utility double, fairness double, has_audit boolean")
    return compliance.evaluate(compliance.dataset_rows(*frames, scores))


def log_event(log_rows: DataFrame, **spec) -> DataFrame:
    """Audit entries for the given rows; see ``audit.entries``."""
    return audit.entries(log_rows, **spec)


def report(real: DataFrame, synth: DataFrame, metrics: DataFrame, run_ts: str) -> DataFrame:
    """One report row: fingerprint, sizes and the metric rows (a dozen at most)."""
    items = metrics.agg(F.collect_list(F.struct(*metrics.columns)).alias("m")).scalar()
    return fingerprint.fingerprint(synth).select(
        F.lit(run_ts).alias("timestamp"),
        "data_hash",
        real.agg(F.count("*")).scalar().alias("real_rows"),
        F.lit(len(real.columns)).alias("real_columns"),
        F.col("n_rows").alias("synthetic_rows"),
        F.lit(len(synth.columns)).alias("synthetic_columns"),
        items.alias("metrics"),
    )


def verify(mode: str, tables: Mapping[str, DataFrame], roles: ColumnRoles, with_models: bool = True) -> DataFrame:
    """Scores for the three run modes: generate, upload, synthetic_only."""
    if mode == "synthetic_only":
        return quality.synthetic_only(tables["synthetic"], roles.categorical)
    if mode == "generate" and "synthetic" not in tables:
        raise ValueError("generate a synthetic table first")
    if mode not in ("generate", "upload"):
        raise ValueError(f"unknown mode {mode!r}")
    return verify_synthetic_data(tables["real"], tables["synthetic"], roles, with_models)
