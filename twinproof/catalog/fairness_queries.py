"""Group fairness and mitigation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinproof.catalog.pairs import (
    APPLICANT_COLUMNS,
    APPLICANT_ROLES,
    APPLICANT_SQL,
    PREDICTION_SQL,
    applicants,
    predictions,
)
from twinproof.catalog.registry import ORACLES, canon_sql, query
from twinproof.catalog.utility_queries import counts_sql
from twinproof.functions.scalar import round6
from twinproof.operators import fairness, mitigation
from twinproof.plans import api

PROTECTED = ("c_mktsegment", "r_name")
TARGET, GOOD = "o_orderstatus", "F"


def rates_sql(target: str = TARGET, good: str = GOOD) -> str:
    """CTEs ``rt`` (favourable rates per attribute and group) and ``ex`` (their extremes)."""
    return f"""
  fr AS ({' UNION ALL '.join(f"SELECT '{a}' AS attribute, {a} AS grp, {flag} AS is_real, CAST({target} = '{good}' AS INTEGER) AS good FROM {t}" for a in PROTECTED for t, flag in (("r", 1), ("s", 0)))}),
  rt AS (SELECT attribute, grp, CAST(sum(is_real) AS BIGINT) AS n_real, CAST(sum(1 - is_real) AS BIGINT) AS n_synth,
                coalesce(sum(is_real * good) / nullif(sum(is_real), 0), 0) AS rate_real,
                coalesce(sum((1 - is_real) * good) / nullif(sum(1 - is_real), 0), 0) AS rate_synth
         FROM fr GROUP BY 1, 2 HAVING sum(is_real) > 0),
  ex AS (SELECT attribute, min(rate_real) AS lr, max(rate_real) AS hr, min(rate_synth) AS ls, max(rate_synth) AS hs
         FROM rt GROUP BY 1 HAVING count(*) >= 2)"""


RATES_SQL = rates_sql()


def _rates(spark, sf):
    return fairness.favorable_rates(*applicants(spark, sf), PROTECTED, TARGET, GOOD)


@query(
    "demographic_parity",
    f"""WITH {APPLICANT_SQL}, {counts_sql(PROTECTED)}, m AS (SELECT "column" AS attribute, max(abs(p - q)) AS d FROM sh GROUP BY 1)
    SELECT attribute, round(d, 6) AS max_difference, round(greatest(0, 100 - d * 500), 4) AS score, d < 0.1 AS passed FROM m""",
)
def demographic_parity(spark, sf):
    out = fairness.representation(*applicants(spark, sf), PROTECTED)
    return out.withColumns({"max_difference": round6(F.col("max_difference")), "score": F.round("score", 4)})


@query(
    "favorable_rates",
    f'WITH {APPLICANT_SQL}, {RATES_SQL} SELECT attribute, grp AS "group", n_real, n_synth, round(rate_real, 6) AS rate_real, round(rate_synth, 6) AS rate_synth FROM rt',
)
def favorable_rates(spark, sf):
    return _rates(spark, sf).withColumns({"rate_real": round6(F.col("rate_real")), "rate_synth": round6(F.col("rate_synth"))})


@query(
    "disparate_impact",
    f"""WITH {APPLICANT_SQL}, {RATES_SQL}, d AS (SELECT attribute, lr / hr AS a, ls / hs AS b FROM ex)
    SELECT attribute, round(a, 6) AS min_di_real, round(b, 6) AS min_di_synth, round(abs(a - b), 6) AS di_change,
           round(CASE WHEN b >= 0.8 THEN 100 ELSE b / 0.8 * 100 END, 4) AS score, b >= 0.8 AS passed FROM d""",
)
def disparate_impact(spark, sf):
    out = fairness.disparate_impact(_rates(spark, sf))
    return out.withColumns(
        {**{c: round6(F.col(c)) for c in ("min_di_real", "min_di_synth", "di_change")}, "score": F.round("score", 4)}
    )


@query(
    "statistical_parity",
    f"""WITH {APPLICANT_SQL}, {RATES_SQL}, pr AS (SELECT a.attribute, max(abs(a.rate_real - b.rate_real)) AS x, max(abs(a.rate_synth - b.rate_synth)) AS y
      FROM rt a JOIN rt b ON a.attribute = b.attribute AND a.grp < b.grp GROUP BY 1)
    SELECT attribute, round(x, 6) AS max_spd_real, round(y, 6) AS max_spd, round(greatest(0, 100 - y * 500), 4) AS score, y < 0.1 AS passed FROM pr""",
)
def statistical_parity(spark, sf):
    out = fairness.statistical_parity(_rates(spark, sf))
    return out.withColumns({"max_spd_real": round6(F.col("max_spd_real")), "max_spd": round6(F.col("max_spd")), "score": F.round("score", 4)})


@query(
    "group_gaps",
    f"""WITH {APPLICANT_SQL}, {RATES_SQL}, g AS (SELECT attribute, grp, greatest(rate_real - lr, hr - rate_real) AS x, greatest(rate_synth - ls, hs - rate_synth) AS y,
      rate_real / hr AS u, rate_synth / hs AS v FROM rt JOIN ex USING (attribute))
    SELECT attribute, grp AS "group", round(x, 6) AS gap_real, round(y, 6) AS gap_synth, round(abs(x - y), 6) AS change, round(u, 6) AS di_real, round(v, 6) AS di_synth FROM g""",
)
def group_gaps(spark, sf):
    out = fairness.group_gaps(_rates(spark, sf))
    return out.withColumns({c: round6(F.col(c)) for c in ("gap_real", "gap_synth", "change", "di_real", "di_synth")})


@query(
    "equal_opportunity",
    f"""WITH {PREDICTION_SQL}, t AS (SELECT grp, count(*) FILTER (y = 1 AND y_hat = 1) / count(*) FILTER (y = 1) AS tpr FROM pred GROUP BY 1),
    e AS (SELECT max(tpr) - min(tpr) AS d FROM t)
    SELECT 'grp' AS attribute, round(d, 6) AS equal_opportunity_difference, round(greatest(0, 100 - d * 500), 4) AS score, d < 0.1 AS passed FROM e""",
)
def equal_opportunity(spark, sf):
    out = fairness.equal_opportunity(fairness.true_positive_rates(predictions(spark, sf), "grp", "y", "y_hat", 1))
    return out.withColumns({"equal_opportunity_difference": round6(F.col("equal_opportunity_difference")), "score": F.round("score", 4)})


_OUTCOME = f"WITH {APPLICANT_SQL}, g AS (SELECT r_name, avg(CAST({TARGET} = '{GOOD}' AS INTEGER)) AS rate FROM s GROUP BY 1)"


@query(
    "dp_evaluator",
    f"{_OUTCOME} SELECT round(max(rate) - min(rate), 6) AS demographic_parity, round(greatest(0, 100 - (max(rate) - min(rate)) * 100), 4) AS dp_score FROM g",
)
def dp_evaluator(spark, sf):
    out = fairness.evaluator_parity(fairness.outcome_rates(applicants(spark, sf)[1], "r_name", TARGET, GOOD))
    return out.select(round6(F.col("demographic_parity")).alias("demographic_parity"), F.round("dp_score", 4).alias("dp_score"))


@query(
    "di_evaluator",
    f"""{_OUTCOME}, d AS (SELECT min(rate) / max(rate) AS di FROM g)
    SELECT round(di, 6) AS disparate_impact, di >= 0.8 AS passes_80_percent_rule, round(CASE WHEN di >= 0.8 THEN 100 ELSE di * 100 / 0.8 END, 4) AS di_score FROM d""",
)
def di_evaluator(spark, sf):
    out = fairness.evaluator_impact(fairness.outcome_rates(applicants(spark, sf)[1], "r_name", TARGET, GOOD))
    return out.withColumns({"disparate_impact": round6(F.col("disparate_impact")), "di_score": F.round("di_score", 4)})


_COLS = ", ".join(APPLICANT_COLUMNS)
_CANON = canon_sql("d:o_totalprice", "d:c_acctbal", *APPLICANT_COLUMNS[2:])


def rebalance_sql(source: str, attribute: str, name: str, gate: float | None = None) -> str:
    """CTE ``name``: ``source`` resampled to the real shares of one attribute.

    With a gate, the source passes through unless some share gap exceeds it.
    """
    w = f"{name}_w"
    resampled = f"""SELECT {_COLS} FROM (SELECT x.*, row_number() OVER (PARTITION BY x.{attribute} ORDER BY md5({_CANON})) AS rk, size, target
        FROM {source} x JOIN {w} ON x.{attribute} = {w}.g) y, range(0, 64) rep(i)
        WHERE rep.i < target // size + CASE WHEN rk <= target % size THEN 1 ELSE 0 END"""
    ctes = f"""{w} AS (SELECT g, size, CAST(floor((SELECT count(*) FROM {source}) * (n / CAST((SELECT count(*) FROM r) AS DOUBLE))) AS BIGINT) AS target,
         abs(n / CAST((SELECT count(*) FROM r) AS DOUBLE) - size / CAST((SELECT count(*) FROM {source}) AS DOUBLE)) AS gap
         FROM (SELECT {attribute} AS g, count(*) AS n FROM r GROUP BY 1) JOIN (SELECT {attribute} AS g, count(*) AS size FROM {source} GROUP BY 1) USING (g)), """
    if gate is None:
        return ctes + f"{name} AS ({resampled})"
    need = f"(SELECT max(gap) > {gate} FROM {w})"
    return ctes + f"{name} AS (SELECT * FROM ({resampled}) WHERE {need} UNION ALL SELECT {_COLS} FROM {source} WHERE NOT {need})"


def flip_sql(source: str, attribute: str, name: str) -> str:
    """CTE ``name``: ``source`` with the first unfavourable rows flipped."""
    return f"""{name}_g AS (SELECT {attribute} AS g, count(*) AS size, count(*) FILTER ({TARGET} = '{GOOD}') AS good FROM {source} GROUP BY 1),
    {name}_q AS (SELECT g, CASE WHEN good / CAST(size AS DOUBLE) / max(good / CAST(size AS DOUBLE)) OVER () < 0.8
                      THEN greatest(0, CAST(floor(size * (max(good / CAST(size AS DOUBLE)) OVER () * CAST(0.9 AS DOUBLE))) AS BIGINT) - good) ELSE 0 END AS q FROM {name}_g),
    {name} AS (SELECT {', '.join(APPLICANT_COLUMNS[:-1])}, CASE WHEN {TARGET} <> '{GOOD}' AND rk <= q THEN '{GOOD}' ELSE {TARGET} END AS {TARGET}
        FROM (SELECT x.*, q, row_number() OVER (PARTITION BY {attribute}, {TARGET} <> '{GOOD}' ORDER BY md5({_CANON})) AS rk FROM {source} x JOIN {name}_q ON {attribute} = g))"""


def rounded_rows(df):
    return df.select(F.round("o_totalprice", 4).alias("o_totalprice"), *APPLICANT_COLUMNS[1:])


_ROUNDED = f"SELECT round(o_totalprice, 4) AS o_totalprice, {', '.join(APPLICANT_COLUMNS[1:])}"
_REBALANCED = f"{rebalance_sql('s', 'c_mktsegment', 'b1')}, {rebalance_sql('b1', 'r_name', 'b2')}"
_PARITY = f"{rebalance_sql('b2', 'c_mktsegment', 'p1', 0.05)}, {rebalance_sql('p1', 'r_name', 'p2', 0.05)}"


@query("rebalance", f"WITH {APPLICANT_SQL}, {_REBALANCED} {_ROUNDED} FROM b2")
def rebalance(spark, sf):
    return rounded_rows(mitigation.rebalance(*applicants(spark, sf), PROTECTED))


@query(
    "enforce_parity",
    f"WITH {APPLICANT_SQL}, {rebalance_sql('s', 'c_mktsegment', 'p1', 0.05)}, {rebalance_sql('p1', 'r_name', 'p2', 0.05)} {_ROUNDED} FROM p2",
)
def enforce_parity(spark, sf):
    return rounded_rows(mitigation.enforce_parity(*applicants(spark, sf), PROTECTED))


# A skewed outcome, so that some groups fall below the 80 % rule.
_SKEWED = f"""skew AS (SELECT {', '.join(APPLICANT_COLUMNS[:-1])},
  CASE WHEN r_name IN ('ASIA', 'EUROPE') AND o_totalprice > 100000 THEN 'P' ELSE {TARGET} END AS {TARGET} FROM s)"""


def skewed(synth):
    low = F.col("r_name").isin("ASIA", "EUROPE") & (F.col("o_totalprice") > 100000)
    return synth.withColumn(TARGET, F.when(low, "P").otherwise(F.col(TARGET)))


@query("reduce_di", f"WITH {APPLICANT_SQL}, {_SKEWED}, {flip_sql('skew', 'c_mktsegment', 'f1')}, {flip_sql('f1', 'r_name', 'f2')} {_ROUNDED} FROM f2")
def reduce_di(spark, sf):
    real, synth = applicants(spark, sf)
    return rounded_rows(mitigation.reduce_disparate_impact(skewed(synth), PROTECTED, TARGET, GOOD))


@query(
    "mitigate_all",
    f"WITH {APPLICANT_SQL}, {_REBALANCED}, {_PARITY}, {flip_sql('p2', 'c_mktsegment', 'f1')}, {flip_sql('f1', 'r_name', 'f2')} {_ROUNDED} FROM f2",
)
def mitigate_all(spark, sf):
    return rounded_rows(mitigation.apply_all(*applicants(spark, sf), PROTECTED, TARGET, GOOD))


@query("post_process", ORACLES["mitigate_all"])
def post_process(spark, sf):
    """The one-call form of all mitigation steps."""
    return rounded_rows(api.post_process_for_fairness(*applicants(spark, sf), APPLICANT_ROLES))


@query(
    "improvement_report",
    f"""WITH {APPLICANT_SQL}, {_REBALANCED},
    x AS ({' UNION ALL '.join(f"SELECT '{a}' AS attribute, {a} AS g, '{k}' AS part FROM {t}" for a in PROTECTED for t, k in (('r', 'r'), ('s', 'o'), ('b2', 'p')))}),
    c AS (SELECT attribute, g, count(*) FILTER (part = 'r') AS r, count(*) FILTER (part = 'o') AS o, count(*) FILTER (part = 'p') AS p FROM x GROUP BY 1, 2),
    h AS (SELECT attribute, g, r / sum(r) OVER w AS a, o / sum(o) OVER w AS b, p / sum(p) OVER w AS c FROM c WINDOW w AS (PARTITION BY attribute))
    SELECT attribute, g AS "group", round(a, 6) AS real_share, round(b, 6) AS original_share, round(c, 6) AS processed_share,
           round(abs(a - b), 6) AS original_diff, round(abs(a - c), 6) AS processed_diff, abs(a - c) < abs(a - b) AS improved FROM h WHERE a > 0""",
)
def improvement_report(spark, sf):
    real, synth = applicants(spark, sf)
    out = mitigation.improvement(real, synth, mitigation.rebalance(real, synth, PROTECTED), PROTECTED)
    shares = ("real_share", "original_share", "processed_share", "original_diff", "processed_diff")
    return out.withColumns({c: round6(F.col(c)) for c in shares})
