"""Distance, anonymity, attacker and disclosure queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinproof.catalog.pairs import (
    APPLICANT_LABELS,
    APPLICANT_NUMBERS,
    APPLICANT_ROLES,
    APPLICANT_SQL,
    LEAKY_SQL,
    PREDICTION_SQL,
    SPLIT_LABELS,
    SPLIT_NUMBERS,
    SPLIT_ROLES,
    SPLIT_SQL,
    applicants,
    leaky_split,
    lineitem_split,
    predictions,
)
from twinproof.catalog.registry import canon_sql, query
from twinproof.catalog.utility_queries import counts_sql
from twinproof.functions.scalar import round6
from twinproof.operators import distance, distributions, privacy

POINT_NUMBERS = SPLIT_NUMBERS + ("l_linenumber",)
POINT_LABELS = ("l_returnflag", "l_linestatus")


ALL_ROWS = 10**12


def points_sql(numbers=POINT_NUMBERS, labels=POINT_LABELS, n: int = 1000) -> str:
    """CTEs ``xr`` and ``xs``: encoded bounded samples of ``r`` and ``s``."""
    canon = canon_sql(*[c if c == "l_linenumber" else f"d:{c}" for c in numbers], *labels)
    dicts = ", ".join(
        f"d_{c} AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT {c} AS v FROM r UNION SELECT {c} FROM s))"
        for c in labels
    )
    codes = "".join(f", d_{c}.code AS {c}" for c in labels)
    samples = ", ".join(
        f"""k{t} AS (SELECT *, md5({canon}) AS h FROM {t} ORDER BY h LIMIT {n}),
        x{t} AS (SELECT row_number() OVER () AS id, {', '.join(numbers)}{codes}
                 FROM k{t} {' '.join(f'JOIN d_{c} ON k{t}.{c} = d_{c}.v' for c in labels)})"""
        for t in ("r", "s")
    )
    return f"{dicts}, {samples}"


def scaled_sql(columns, fitted_on: str, eps: str, every=POINT_NUMBERS + POINT_LABELS) -> str:
    """CTEs ``zr`` / ``zs`` and ``mind``: nearest distances of scaled samples."""
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) + {eps} AS v_{c}" for c in columns)

    def z(c):
        return f"({c} - m_{c}) / v_{c} AS {c}" if c in columns else c

    zs = ", ".join(f"z{t} AS (SELECT id, {', '.join(z(c) for c in every)} FROM x{t}, fit)" for t in ("r", "s"))
    gap = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in every)
    return f"fit AS (SELECT {stats} FROM {fitted_on}), {zs}, mind AS (SELECT a.id, sqrt(min({gap})) AS d FROM zs a, zr b GROUP BY 1)"


@query(
    "dcr_sampled",
    f"""WITH {LEAKY_SQL}, {points_sql()}, {scaled_sql(POINT_NUMBERS + POINT_LABELS, 'xr', '1e-10')},
    a AS (SELECT avg(d) AS m, median(d) AS md, min(d) AS mn, count(*) FILTER (d < 1e-6) AS x, count(*) AS n FROM mind)
    SELECT round(m, 6) AS mean_dcr, round(md, 6) AS median_dcr, round(mn, 6) AS min_dcr, x AS exact_matches, round(x / n, 6) AS exact_match_rate,
           round(CASE WHEN m < 0.1 THEN least(100, m / 0.1 * 100) ELSE 100 END, 4) AS score, m >= 0.05 AND x = 0 AS passed, n AS n_compared FROM a""",
)
def dcr_sampled(spark, sf):
    out = distance.dcr_sampled(*leaky_split(spark, sf), POINT_NUMBERS, POINT_LABELS)
    return out.select(
        *[round6(F.col(c)).alias(c) for c in ("mean_dcr", "median_dcr", "min_dcr", "exact_match_rate")],
        "exact_matches",
        F.round("score", 4).alias("score"),
        "passed",
        "n_compared",
    )


@query(
    "dcr_evaluator",
    f"""WITH {SPLIT_SQL}, {points_sql()}, u AS (SELECT * FROM r UNION ALL SELECT * FROM s), {scaled_sql(POINT_NUMBERS, 'u', '0')}
    SELECT round(avg(d), 6) AS mean_dcr, round(median(d), 6) AS median_dcr, round(min(d), 6) AS min_dcr, round(max(d), 6) AS max_dcr,
           round(stddev_pop(d), 6) AS std_dcr, round(least(100, avg(d) * 100), 4) AS dcr_score FROM mind""",
)
def dcr_evaluator(spark, sf):
    out = distance.dcr_evaluator(*lineitem_split(spark, sf), POINT_NUMBERS, POINT_LABELS)
    return out.select(
        *[round6(F.col(c)).alias(c) for c in ("mean_dcr", "median_dcr", "min_dcr", "max_dcr", "std_dcr")], F.round("dcr_score", 4).alias("dcr_score")
    )


def _full_sql(pair: str, numbers, labels) -> str:
    every = tuple(numbers) + tuple(labels)
    return f"""WITH {pair}, {points_sql(numbers, labels, n=ALL_ROWS)}, {scaled_sql(every, 'xr', '1e-10', every)},
    a AS (SELECT avg(d) AS m, median(d) AS md, min(d) AS mn, count(*) FILTER (d < 1e-6) AS x, count(*) AS n FROM mind)
    SELECT round(m, 6) AS mean_dcr, round(md, 6) AS median_dcr, round(mn, 6) AS min_dcr, x AS exact_matches, round(x / n, 6) AS exact_match_rate,
           round(CASE WHEN m < 0.1 THEN least(100, m / 0.1 * 100) ELSE 100 END, 4) AS score, m >= 0.05 AND x = 0 AS passed, n AS n_compared FROM a"""


def _rounded_full(out):
    return out.select(
        *[round6(F.col(c)).alias(c) for c in ("mean_dcr", "median_dcr", "min_dcr", "exact_match_rate")],
        F.col("exact_matches").cast("bigint").alias("exact_matches"),
        F.round("score", 4).alias("score"),
        "passed",
        "n_compared",
    )


@query("dcr_full", _full_sql(LEAKY_SQL, POINT_NUMBERS, POINT_LABELS))
def dcr_full(spark, sf):
    """Exact nearest real record of every synthetic row."""
    return _rounded_full(distance.dcr_full(*leaky_split(spark, sf), POINT_NUMBERS, POINT_LABELS))


@query(
    "dcr_evaluator_full",
    f"""WITH {SPLIT_SQL}, {points_sql(n=ALL_ROWS)}, u AS (SELECT * FROM r UNION ALL SELECT * FROM s), {scaled_sql(POINT_NUMBERS, 'u', '0')}
    SELECT round(avg(d), 6) AS mean_dcr, round(median(d), 6) AS median_dcr, round(min(d), 6) AS min_dcr, round(max(d), 6) AS max_dcr,
           round(stddev_pop(d), 6) AS std_dcr, round(least(100, avg(d) * 100), 4) AS dcr_score FROM mind""",
)
def dcr_evaluator_full(spark, sf):
    out = distance.dcr_evaluator_full(*lineitem_split(spark, sf), POINT_NUMBERS, POINT_LABELS)
    return out.select(
        *[round6(F.col(c)).alias(c) for c in ("mean_dcr", "median_dcr", "min_dcr", "max_dcr", "std_dcr")], F.round("dcr_score", 4).alias("dcr_score")
    )


@query("dcr_full_applicants", _full_sql(APPLICANT_SQL, APPLICANT_NUMBERS, APPLICANT_LABELS))
def dcr_full_applicants(spark, sf):
    """Nearest real record of every synthetic applicant, over whole tables."""
    return _rounded_full(distance.dcr_full(*applicants(spark, sf), APPLICANT_NUMBERS, APPLICANT_LABELS))


@query(
    "exact_match_semi",
    f"""WITH {LEAKY_SQL} SELECT (SELECT count(*) FROM s) AS n_synth,
    (SELECT count(*) FROM s WHERE EXISTS (SELECT 1 FROM r WHERE {' AND '.join(f'r.{c} = s.{c}' for c in POINT_NUMBERS + POINT_LABELS)})) AS n_matching,
    (SELECT count(*) FROM (SELECT {', '.join(POINT_NUMBERS + POINT_LABELS)} FROM s INTERSECT SELECT {', '.join(POINT_NUMBERS + POINT_LABELS)} FROM r)) AS n_matching_distinct""",
)
def exact_match_semi(spark, sf):
    return distance.exact_matches(*leaky_split(spark, sf), POINT_NUMBERS + POINT_LABELS)


_QI = SPLIT_ROLES.quasi_identifiers


@query(
    "k_anonymity",
    f"""WITH {SPLIT_SQL}, g AS (SELECT count(*) AS n FROM s GROUP BY {', '.join(_QI)})
    SELECT min(n) AS min_k, round(avg(n), 6) AS mean_k, 5 AS k_threshold, coalesce(CAST(sum(n) FILTER (n < 5) AS BIGINT), 0) AS violating_records,
           round(coalesce(sum(n) FILTER (n < 5), 0) / sum(n), 6) AS violation_rate, round(least(100, min(n) / 5 * 100), 4) AS score, min(n) >= 5 AS passed FROM g""",
)
def k_anonymity(spark, sf):
    out = privacy.k_anonymity(lineitem_split(spark, sf)[1], _QI)
    return out.withColumns({"mean_k": round6(F.col("mean_k")), "violation_rate": round6(F.col("violation_rate")), "score": F.round("score", 4)})


@query(
    "k_anonymity_evaluator",
    f"""WITH {APPLICANT_SQL}, g AS (SELECT count(*) AS n FROM s GROUP BY c_mktsegment, r_name, o_orderpriority)
    SELECT min(n) AS achieved_k, round(avg(n), 6) AS avg_group_size, count(*) AS num_groups, round(CAST(least(100, min(n) * 10) AS DOUBLE), 4) AS k_score FROM g""",
)
def k_anonymity_evaluator(spark, sf):
    out = privacy.k_anonymity_evaluator(applicants(spark, sf)[1], APPLICANT_ROLES.quasi_identifiers)
    return out.withColumns({"avg_group_size": round6(F.col("avg_group_size")), "k_score": F.round("k_score", 4)})


@query(
    "tv_disclosure",
    f"WITH {SPLIT_SQL}, {counts_sql(SPLIT_LABELS + SPLIT_NUMBERS)} "
    'SELECT "column", round(sum(abs(p - q)) / 2, 6) AS tv_distance FROM sh GROUP BY 1',
)
def tv_disclosure(spark, sf):
    out = distributions.divergences(*lineitem_split(spark, sf), SPLIT_LABELS + SPLIT_NUMBERS)
    return out.select("column", round6(F.col("tv_distance")).alias("tv_distance"))


@query(
    "attribute_disclosure_score",
    f"""WITH {APPLICANT_SQL}, {counts_sql(APPLICANT_LABELS)},
    t AS (SELECT sum(abs(p - q)) / 2 AS tv FROM sh GROUP BY "column"), m AS (SELECT avg(tv) AS a, max(tv) AS b FROM t)
    SELECT round(a, 6) AS mean_tv, round(b, 6) AS max_tv,
           round(CASE WHEN a < 0.05 THEN 70 WHEN a > 0.3 THEN greatest(0, 100 - (a - 0.3) * 200) ELSE 100 END, 4) AS score,
           a BETWEEN 0.05 AND 0.3 AS passed FROM m""",
)
def attribute_disclosure_score(spark, sf):
    out = privacy.disclosure(*applicants(spark, sf), APPLICANT_LABELS)
    return out.withColumns({"mean_tv": round6(F.col("mean_tv")), "max_tv": round6(F.col("max_tv")), "score": F.round("score", 4)})


@query(
    "mia_score_formula",
    f"""WITH {PREDICTION_SQL}, a AS (SELECT avg(CAST(y = y_hat AS INTEGER)) AS acc FROM pred)
    SELECT round(acc, 6) AS attack_accuracy, 0.5::DOUBLE AS baseline_accuracy, round(abs(acc - 0.5), 6) AS privacy_leakage,
           round(greatest(0, 100 - abs(acc - 0.5) * 200), 4) AS score, acc < 0.6 AS passed FROM a""",
)
def mia_score_formula(spark, sf):
    out = privacy.attack_result(predictions(spark, sf), "y", "y_hat")
    return out.withColumns(
        {"attack_accuracy": round6(F.col("attack_accuracy")), "privacy_leakage": round6(F.col("privacy_leakage")), "score": F.round("score", 4)}
    )


@query(
    "mia_auc",
    f"""WITH {PREDICTION_SQL}, c AS (SELECT score, sum(y) AS pos, sum(1 - y) AS neg FROM pred GROUP BY 1),
    k AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c)
    SELECT round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 6) AS auc FROM k""",
)
def mia_auc(spark, sf):
    return privacy.roc_auc(predictions(spark, sf), "y", "score").select(round6(F.col("auc")).alias("auc"))
