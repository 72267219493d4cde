"""Regulatory rules over scores, column names and audit presence."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinproof.functions.scalar import ratio

# The rule catalogue (standard, article, requirement, kind,
# threshold in score points or None, recommendation when failed).
RULES = (
    ("GDPR", "Article 5(1)(c)", "Data Minimization", "minimization", None, "Remove unnecessary columns from synthetic data"),
    ("GDPR", "Article 5(1)(d)", "Accuracy", "utility", 70.0, "Improve synthetic data quality"),
    ("GDPR", "Article 25", "Privacy by Design", "privacy", 70.0, "Improve privacy protection measures"),
    ("GDPR", "Article 35", "Data Protection Impact Assessment", "assessment", None, "Complete privacy and utility assessments"),
    ("GDPR", "Article 5(2)", "Accountability", "audit", None, "Enable audit logging"),
    ("HIPAA", "164.514(a)", "De-identification Standard", "privacy", 70.0, "Improve de-identification measures"),
    ("HIPAA", "164.514(b)(1)", "Expert Determination", "privacy_present", None, "Apply statistical methods for de-identification"),
    ("HIPAA", "164.514(b)(2)", "Safe Harbor", "safe_harbor", None, "Remove or generalize identifier columns"),
    ("HIPAA", "164.312(b)", "Audit Controls", "audit", None, "Implement audit logging"),
    ("HIPAA", "164.530(j)", "Documentation", "audit", None, "Create documentation for data handling procedures"),
    ("EU AI Act", "Article 10", "Data Quality", "utility", 70.0, "Improve data quality"),
    ("EU AI Act", "Article 13", "Transparency", "audit", None, "Document the generation process"),
    ("EU AI Act", "Article 9", "Risk Management", "fairness", 80.0, "Address bias in synthetic data"),
    ("EU AI Act", "Article 11", "Technical Documentation", "audit", None, "Create technical documentation"),
    ("EU AI Act", "Article 14", "Human Oversight", "always", None, ""),
)

# What to do where the score a rule needs is missing.
MISSING_ADVICE = {
    ("GDPR", "Article 5(1)(d)"): "Run utility verification first",
    ("GDPR", "Article 25"): "Run privacy verification first",
    ("HIPAA", "164.514(a)"): "Run privacy verification",
    ("EU AI Act", "Article 10"): "Run utility verification",
    ("EU AI Act", "Article 9"): "Run bias detection",
}

# Identifier tokens looked for in column names.
IDENTIFIER_TOKENS = (
    "name", "names", "first_name", "last_name", "full_name",
    "address", "street", "city", "state", "zip", "zipcode", "zip_code",
    "date", "dates", "birth_date", "dob", "date_of_birth", "admission_date",
    "telephone", "phone", "phone_number", "fax",
    "email", "email_address",
    "ssn", "social_security", "social_security_number",
    "mrn", "medical_record", "medical_record_number",
    "health_plan", "beneficiary",
    "account", "account_number",
    "certificate", "license", "license_number",
    "vehicle", "vin",
    "device", "serial", "serial_number",
    "url", "website",
    "ip", "ip_address",
    "biometric", "fingerprint", "face",
    "photo", "image", "photograph",
)

# Three further rule sets as (standard, check, conditions), each
# condition a score and the least value it must have.
PROFILES: Mapping[str, tuple] = {
    "orchestrator": (
        ("GDPR", "data_minimization", (("privacy", 70.0),)),
        ("GDPR", "privacy_by_design", (("privacy", 80.0),)),
        ("GDPR", "dpia_ready", (("privacy", 70.0), ("fairness", 70.0))),
        ("HIPAA", "safe_harbor", (("privacy", 90.0),)),
    ),
    "pdf": (
        ("GDPR", "overall", (("privacy", 80.0), ("fairness", 70.0))),
        ("HIPAA", "overall", (("privacy", 90.0),)),
        ("CCPA", "overall", (("privacy", 75.0), ("overall", 70.0))),
    ),
    "dashboard": (
        ("GDPR", "overall", (("privacy", 70.0), ("fairness", 70.0))),
        ("HIPAA", "overall", (("privacy", 70.0),)),
        ("EU AI Act", "overall", (("fairness", 80.0), ("overall", 70.0))),
    ),
}


# What each kind of rule asks for.
KIND_TEXT = {
    "minimization": "The synthetic table has no column the real one lacks",
    "utility": "The utility score reaches the threshold",
    "privacy": "The privacy score reaches the threshold",
    "fairness": "The fairness score reaches the threshold",
    "assessment": "Privacy and utility were assessed and an audit log is kept",
    "audit": "An audit log is kept",
    "privacy_present": "Privacy was assessed by statistical methods",
    "safe_harbor": "No column name holds one of the identifier tokens",
    "always": "Holds by the design of the process",
}


def rule_frame(spark: SparkSession) -> DataFrame:
    """The rule catalogue as a table; thresholds are shares of 1."""
    rows = [(s, a, r, KIND_TEXT[k], k, None if t is None else t / 100, advice) for s, a, r, k, t, advice in RULES]
    return spark.createDataFrame(rows, "standard string, article string, requirement string, description string, kind string, threshold double, advice string")


def evaluate(datasets: DataFrame) -> DataFrame:
    """(dataset, standard, article, requirement, passed, score, recommendation).

    ``datasets`` has one row per dataset: privacy, utility, fairness (null when
    not assessed), has_audit, n_extra_columns and n_identifiers, and may have
    identifiers, the names found. The fixed rules are exploded next to each
    row, so there is no join and no shuffle.
    """
    has_audit = F.coalesce(F.col("has_audit"), F.lit(False))

    def at_least(score: str, threshold: float):
        value = F.col(score)
        return F.coalesce(value >= threshold, F.lit(False)), F.coalesce(value, F.lit(0.0))

    def flag(condition: Column, good: float = 100.0, bad: float = 0.0):
        return condition, F.when(condition, good).otherwise(bad)

    def judge(kind: str, threshold: float | None) -> tuple[Column, Column]:
        if kind in ("privacy", "utility", "fairness"):
            return at_least(kind, threshold)
        if kind == "minimization":
            return flag(F.col("n_extra_columns") == 0, 100.0, 50.0)
        if kind == "assessment":
            return flag(has_audit & F.col("privacy").isNotNull() & F.col("utility").isNotNull())
        if kind == "privacy_present":
            return F.col("privacy").isNotNull(), F.coalesce("privacy", F.lit(0.0))
        if kind == "safe_harbor":
            hits = F.col("n_identifiers")
            return hits == 0, F.greatest(F.lit(0.0), 100.0 - hits * 10)
        if kind == "audit":
            return flag(has_audit)
        return flag(F.lit(True))

    def advice_for(standard: str, article: str, kind: str, advice: str) -> Column:
        if (standard, article) in MISSING_ADVICE:
            return F.when(F.col(kind).isNull(), MISSING_ADVICE[standard, article]).otherwise(advice)
        if kind == "safe_harbor" and "identifiers" in datasets.columns:
            return F.concat(F.lit("Remove or generalize: "), F.array_join("identifiers", ", "))
        return F.lit(advice)

    rows = []
    for standard, article, requirement, kind, threshold, advice in RULES:
        passed, score = judge(kind, threshold)
        rows.append(
            F.struct(
                F.lit(standard).alias("standard"),
                F.lit(article).alias("article"),
                F.lit(requirement).alias("requirement"),
                passed.alias("passed"),
                score.cast("double").alias("score"),
                F.when(~passed, advice_for(standard, article, kind, advice)).alias("recommendation"),
            )
        )
    return datasets.select("dataset", F.explode(F.array(*rows)).alias("r")).select("dataset", "r.*")


def roll_up(results: DataFrame) -> DataFrame:
    """(dataset, standard, total, passed, failed, compliance_score, compliant).

    One ROLLUP pass: rows with a null standard are the dataset's totals, whose
    score is the mean over the standards (all have equally many rules).
    """
    passed = F.count(F.when(F.col("passed"), 1))
    return (
        results.rollup("dataset", "standard")
        .agg(F.count("*").alias("total"), passed.alias("passed"))
        .where(F.col("dataset").isNotNull())
        .select(
            "dataset",
            "standard",
            "total",
            "passed",
            (F.col("total") - F.col("passed")).alias("failed"),
            ratio(F.col("passed") * 100, F.col("total")).alias("compliance_score"),
            (F.col("passed") == F.col("total")).alias("compliant"),
        )
    )


def report(results: DataFrame) -> DataFrame:
    """Per dataset: score, distinct recommendations and a signature.

    A dataset has as many rows as the catalogue, so the lists stay short.
    """
    line = F.concat_ws("|", "standard", "article", F.col("passed").cast("string"))
    return results.groupBy("dataset").agg(
        ratio(F.count(F.when(F.col("passed"), 1)) * 100, F.count("*")).alias("overall_compliance_score"),
        F.bool_and("passed").alias("overall_compliant"),
        F.array_join(F.array_sort(F.collect_set("recommendation")), "; ").alias("recommendations"),
        F.sha2(F.array_join(F.array_sort(F.collect_list(line)), ","), 256).alias("signature"),
    )


def evaluate_profile(records: DataFrame, profile: str, key: str = "dataset") -> DataFrame:
    """(key, standard, check, passed) of one of the named rule sets."""
    rows = []
    for standard, check, conditions in PROFILES[profile]:
        ok = F.lit(True)
        for score, least in conditions:
            ok = ok & F.coalesce(F.col(score) >= least, F.lit(False))
        rows.append(F.struct(F.lit(standard).alias("standard"), F.lit(check).alias("check"), ok.alias("passed")))
    return records.select(key, F.explode(F.array(*rows)).alias("r")).select(key, "r.*")


def latest_records(records: DataFrame, key: str, order: str) -> DataFrame:
    """The newest record of each key."""
    rest = [c for c in records.columns if c != key]
    return records.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def identifier_hits(columns: DataFrame, tokens: Sequence[str] = IDENTIFIER_TOKENS) -> DataFrame:
    """(dataset, token, column): the first column whose name contains a token.

    ``columns`` has (dataset, position, column). Every token counts once per
    dataset; a short token also matches inside a longer word.
    """
    lowered = F.lower(F.regexp_replace("column", " ", "_"))
    hits = columns.select("dataset", "position", lowered.alias("column"), F.explode(F.array(*[F.lit(t) for t in tokens])).alias("token"))
    return (
        hits.where(F.contains("column", F.col("token")))
        .groupBy("dataset", "token")
        .agg(F.min_by("column", "position").alias("column"))
    )


def safe_harbor(columns: DataFrame) -> DataFrame:
    """(dataset, columns_checked, n_identifiers, score, passed, identifiers).

    ``identifiers`` names the column each token was found in, in the order of the tokens.
    """
    place = F.array_position(F.array(*[F.lit(t) for t in IDENTIFIER_TOKENS]), F.col("token"))
    found = F.array_sort(F.collect_list(F.struct(place.alias("place"), "column")))  # one item per token at most
    hits = identifier_hits(columns).groupBy("dataset").agg(F.count("*").alias("n_identifiers"), F.transform(found, lambda x: x["column"]).alias("identifiers"))
    n = F.coalesce("n_identifiers", F.lit(0))
    return columns.groupBy("dataset").agg(F.count("*").alias("columns_checked")).join(hits, "dataset", "left").select(
        "dataset",
        "columns_checked",
        n.alias("n_identifiers"),
        F.greatest(F.lit(0.0), 100.0 - n * 10).alias("score"),
        (n == 0).alias("passed"),
        F.coalesce("identifiers", F.array().cast("array<string>")).alias("identifiers"),
    )


def dataset_rows(real_columns: DataFrame, synth_columns: DataFrame, scores: DataFrame) -> DataFrame:
    """What ``evaluate`` takes, from column frames and (dataset, privacy, utility, fairness,
    has_audit): the scan's findings go to the rules with the names of the columns."""
    extra = minimization(real_columns, synth_columns).select("dataset", F.col("n_extra").alias("n_extra_columns"))
    names = safe_harbor(synth_columns).select("dataset", "n_identifiers", "identifiers")
    return scores.join(extra, "dataset").join(names, "dataset")


def column_frame(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(dataset, position, column, n_values): the columns of several tables.

    n_values counts the non-null values a flagged column would expose.
    """
    out = None
    for name, df in tables.items():
        row = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)])
        items = [
            F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.col(f"c{i}").alias("n_values"))
            for i, c in enumerate(df.columns)
        ]
        part = row.select(F.lit(name).alias("dataset"), F.explode(F.array(*items)).alias("x")).select("dataset", "x.*")
        out = part if out is None else out.unionByName(part)
    return out


def minimization(real_columns: DataFrame, synth_columns: DataFrame) -> DataFrame:
    """(dataset, n_real, n_synth, n_extra, score, passed) from column frames."""
    r = real_columns.select("dataset", "column", F.lit(1).alias("r"), F.lit(0).alias("s"))
    s = synth_columns.select("dataset", "column", F.lit(0).alias("r"), F.lit(1).alias("s"))
    names = r.unionByName(s).groupBy("dataset", "column").agg(F.max("r").alias("r"), F.max("s").alias("s"))
    extra = F.count(F.when((F.col("r") == 0), 1))
    return names.groupBy("dataset").agg(F.sum("r").alias("n_real"), F.sum("s").alias("n_synth"), extra.alias("n_extra")).select(
        "dataset",
        "n_real",
        "n_synth",
        "n_extra",
        F.when(F.col("n_extra") == 0, 100.0).otherwise(50.0).alias("score"),
        (F.col("n_extra") == 0).alias("passed"),
    )
