"""Scorecards, reports, ablation, trials and model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinproof.catalog.fairness_queries import GOOD, PROTECTED, TARGET, rates_sql
from twinproof.catalog.pairs import (
    APPLICANT_COLUMNS,
    APPLICANT_LABELS,
    APPLICANT_NUMBERS,
    APPLICANT_ROLES,
    APPLICANT_SQL,
    SPLIT_ROLES,
    SUBMISSION_SQL,
    applicants,
    dirty_orders,
    lineitem_split,
    submissions,
    table,
)
from twinproof.catalog.privacy_queries import ALL_ROWS, POINT_LABELS, POINT_NUMBERS, points_sql, scaled_sql
from twinproof.catalog.prepare_queries import SYNTHETIC_ONLY_SQL
from twinproof.catalog.registry import query
from twinproof.catalog.utility_queries import JS_SQL, cdf_sql, corr_sql, counts_sql
from twinproof.functions.scalar import round6
from twinproof.operators import consensus, correlation, distance, fairness, models, prepare, privacy, utility
from twinproof.plans import api, scorecard, trials

_QI = ", ".join(APPLICANT_ROLES.quasi_identifiers)

def metric_sql(pair: str = APPLICANT_SQL, labels=APPLICANT_LABELS, target: str = TARGET, good: str = GOOD, models: str = "") -> str:
    """CTEs ``mt`` (axis, metric, weight, score, passed): every metric without a model and what
    ``models`` adds, and ``ax``, the axis totals."""
    every = APPLICANT_NUMBERS + tuple(labels)
    return f"""{pair},
  {points_sql(APPLICANT_NUMBERS, labels, ALL_ROWS)}, {scaled_sql(every, 'xr', '1e-10', every)},
  dc AS (SELECT avg(d) AS m, count(*) FILTER (d < 1e-6) AS x FROM mind),
  ka AS (SELECT min(n) AS k FROM (SELECT count(*) AS n FROM s GROUP BY {_QI})),
  {counts_sql(labels)}, {JS_SQL}, {cdf_sql(APPLICANT_NUMBERS)},
  tv AS (SELECT avg(t) AS a FROM (SELECT sum(abs(p - q)) / 2 AS t FROM sh GROUP BY "column")),
  sm2 AS (SELECT (SELECT avg(wasserstein) FROM dist) AS w, (SELECT avg(js_distance) FROM js) AS j),
  {corr_sql(every, labels)}, cd2 AS (SELECT avg(abs(c_real - c_synth)) AS d FROM cm),
  {counts_sql(PROTECTED, mark='p')}, {rates_sql(target, good)},
  dp AS (SELECT avg(greatest(0, 100 - d * 500)) AS score, bool_and(d < 0.1) AS passed FROM (SELECT max(abs(p - q)) AS d FROM psh GROUP BY "column")),
  di AS (SELECT avg(CASE WHEN ls / hs >= 0.8 THEN 100 ELSE ls / hs / 0.8 * 100 END) AS score, bool_and(ls / hs >= 0.8) AS passed FROM ex),
  sp AS (SELECT avg(greatest(0, 100 - (hs - ls) * 500)) AS score, bool_and(hs - ls < 0.1) AS passed FROM ex),
  mt AS (SELECT 'privacy' AS axis, 'dcr' AS metric, 0.3::DOUBLE AS weight, CAST(CASE WHEN m < 0.1 THEN least(100, m / 0.1 * 100) ELSE 100 END AS DOUBLE) AS score, m >= 0.05 AND x = 0 AS passed FROM dc
    UNION ALL SELECT 'privacy', 'k_anonymity', 0.2, least(100, k / 5 * 100), k >= 5 FROM ka
    UNION ALL SELECT 'privacy', 'attribute_disclosure', 0.2, CASE WHEN a < 0.05 THEN 70 WHEN a > 0.3 THEN greatest(0, 100 - (a - 0.3) * 200) ELSE 100 END, a BETWEEN 0.05 AND 0.3 FROM tv
    UNION ALL SELECT 'utility', 'statistical_similarity', 0.4, (CASE WHEN w < 0.2 THEN greatest(0.0, 100 - w * 500) ELSE 0.0 END) * CAST(0.6 AS DOUBLE)
        + (CASE WHEN j < 0.2 THEN greatest(0.0, 100 - j * 500) ELSE 0.0 END) * CAST(0.4 AS DOUBLE), w < 0.1 AND j < 0.15 FROM sm2
    UNION ALL SELECT 'utility', 'correlation_preservation', 0.3, greatest(0, 100 - d * 500), d < 0.1 FROM cd2
    UNION ALL SELECT 'fairness', 'demographic_parity', 0.25, score, passed FROM dp
    UNION ALL SELECT 'fairness', 'disparate_impact', 0.25, score, passed FROM di
    UNION ALL SELECT 'fairness', 'statistical_parity', 0.25, score, passed FROM sp{models}),
  ax AS (SELECT axis, sum(score * weight) AS score, bool_and(passed) AS passed FROM mt GROUP BY 1)"""


METRIC_SQL = metric_sql()
def scorecard_sql(metrics: str) -> str:
    return f"""WITH {metrics},
  al AS (SELECT * FROM mt UNION ALL SELECT axis, 'overall', NULL, score, passed FROM ax
    UNION ALL SELECT 'trust', 'overall', NULL, 0.4::DOUBLE * max(score) FILTER (axis = 'privacy') + 0.35::DOUBLE * max(score) FILTER (axis = 'utility')
        + 0.25::DOUBLE * max(score) FILTER (axis = 'fairness'), bool_and(passed) FROM ax)
  SELECT axis, metric, weight, round(score, 4) AS score, passed FROM al"""


SCORECARD_SQL = scorecard_sql(METRIC_SQL)


@query("scorecard", SCORECARD_SQL)
def full_scorecard(spark, sf):
    """Flagship: every deterministic metric, axis totals and the trust score."""
    return scorecard.scorecard(*applicants(spark, sf), APPLICANT_ROLES).withColumn("score", F.round("score", 4))


# A pair whose model metrics are known: the synthetic order status is told from the real one
# by its name, and urgency follows from the order priority, so every attack hits and every model is right.
_URGENT = "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high' ELSE 'low' END AS urgency"
_MARKED_SQL = f"""{APPLICANT_SQL.replace('  r AS (', '  r0 AS (').replace('  s AS (', '  s0 AS (')},
  r AS (SELECT *, {_URGENT} FROM r0), s AS (SELECT * REPLACE ('S-' || o_orderstatus AS o_orderstatus), {_URGENT} FROM s0)"""
_MARKED_LABELS = (*APPLICANT_LABELS, "urgency")
_MARKED_ROLES = APPLICANT_ROLES.but(categorical=_MARKED_LABELS, target="urgency", favorable="high", sensitive=_MARKED_LABELS)
_MODEL_ROWS = """ UNION ALL SELECT 'privacy', 'membership_inference', 0.3, 0.0, false UNION ALL SELECT 'utility', 'ml_efficacy', 0.3, 100.0, true
    UNION ALL SELECT 'fairness', 'equal_opportunity', 0.25, 100.0, true"""


def _marked(spark, sf):
    real, synth = applicants(spark, sf)
    urgent = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "high").otherwise("low")
    return tuple(df.withColumn("urgency", urgent) for df in (real, synth.withColumn("o_orderstatus", F.concat(F.lit("S-"), "o_orderstatus"))))


@query("scorecard_models", scorecard_sql(metric_sql(_MARKED_SQL, _MARKED_LABELS, "urgency", "high", _MODEL_ROWS)))
def scorecard_models(spark, sf):
    """All eleven metrics, three of them by forests, with totals and trust."""
    card = scorecard.scorecard(*_marked(spark, sf), _MARKED_ROLES, with_models=True)
    return card.withColumn("score", F.round("score", 4))


@query(
    "model_facts",
    f"""WITH {_MARKED_SQL}, c AS (SELECT (SELECT count(*) FROM r) AS nr, (SELECT count(*) FROM s) AS ns),
    hv AS (SELECT min(n) AS m FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey % 2)),
    t AS (SELECT least(nr, ns) AS m, CAST(ceil(nr * CAST(0.3 AS DOUBLE)) AS BIGINT) AS held, nr FROM c)
    SELECT 'attack' AS model, 2 * CAST(ceil(m * CAST(0.3 AS DOUBLE)) AS BIGINT) AS n_tested, 1.0::DOUBLE AS hit_rate FROM t
    UNION ALL SELECT 'attack on halves', 2 * CAST(ceil(m * CAST(0.3 AS DOUBLE)) AS BIGINT), 0.5::DOUBLE FROM hv
    UNION ALL SELECT 'trained on synthetic', held, 1.0::DOUBLE FROM t UNION ALL SELECT 'trained on real', held, 1.0::DOUBLE FROM t
    UNION ALL SELECT 'evaluator', nr, 1.0::DOUBLE FROM t UNION ALL SELECT 'evaluator, numbers', nr, 1.0::DOUBLE FROM t""",
)
def model_facts(spark, sf):
    """Rows that the forests judge and their hit rates to one decimal, where both are known: a pair
    told apart by one label, two halves of one table, and a target that one feature decides."""
    real, synth = _marked(spark, sf)
    rows = [
        ("attack", models.attack_predictions(real, synth, APPLICANT_NUMBERS, APPLICANT_LABELS), "is_real", "predicted"),
        ("attack on halves", models.attack_predictions(*lineitem_split(spark, sf), POINT_NUMBERS, POINT_LABELS), "is_real", "predicted"),
    ]
    scored = models.efficacy_predictions(real, synth, APPLICANT_NUMBERS, APPLICANT_LABELS, "urgency")
    rows += [(name, scored.where(F.col("model") == kind), "label", "prediction") for name, kind in (("trained on synthetic", "synthetic"), ("trained on real", "baseline"))]
    coded = [df.withColumn("priority", F.substring("o_orderpriority", 1, 1).cast("double")) for df in (real, synth)]
    rows.append(("evaluator", models.evaluator_predictions(*coded, ("priority", *APPLICANT_NUMBERS), "urgency", True), "label", "prediction"))
    regression = [df.withColumn("tens", F.col("priority") * 10) for df in coded]
    rows.append(("evaluator, numbers", models.evaluator_predictions(*regression, ("tens", *APPLICANT_NUMBERS), "priority", False), "label", "prediction"))
    out = None
    for name, frame, label, guess in rows:
        hit = F.avg((F.abs(F.col(label) - F.col(guess)) < 0.5).cast("double"))
        part = frame.agg(F.count("*").alias("n_tested"), F.round(hit, 1).alias("hit_rate")).select(F.lit(name).alias("model"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def _axis(spark, sf, axis):
    pair = scorecard.working_copy(*applicants(spark, sf), APPLICANT_ROLES)
    metrics = scorecard.axis_metrics(axis, *pair, APPLICANT_ROLES, with_models=False)
    out = scorecard.axis_score(metrics, scorecard.WEIGHTS[axis])
    return out.select(F.round("score", 4).alias("score"), "passed", "missing_metrics")


def _axis_sql(axis: str, missing: str) -> str:
    return f"WITH {METRIC_SQL} SELECT round(score, 4) AS score, passed, '{missing}' AS missing_metrics FROM ax WHERE axis = '{axis}'"


@query("privacy_score", _axis_sql("privacy", "membership_inference"))
def privacy_score(spark, sf):
    return _axis(spark, sf, "privacy")


@query("utility_score", _axis_sql("utility", "ml_efficacy"))
def utility_score(spark, sf):
    return _axis(spark, sf, "utility")


@query("fairness_score", _axis_sql("fairness", "equal_opportunity"))
def fairness_score(spark, sf):
    return _axis(spark, sf, "fairness")


@query(
    "report_scorecard",
    f"""WITH {METRIC_SQL}, v AS (SELECT max(score) FILTER (axis = 'privacy') AS p, max(score) FILTER (axis = 'utility') AS u, max(score) FILTER (axis = 'fairness') AS f FROM ax)
    SELECT round(p, 4) AS privacy_score, round(u, 4) AS utility_score, round(f, 4) AS fairness_score, p >= 70 AS privacy_passed, u >= 70 AS utility_passed, f >= 70 AS fairness_passed,
           round((p + u + f) / 3, 4) AS overall_score, CASE WHEN p >= 70 AND u >= 70 AND f >= 70 THEN 'APPROVED' ELSE 'REJECTED' END AS overall_status FROM v""",
)
def report_scorecard(spark, sf):
    card = scorecard.scorecard(*applicants(spark, sf), APPLICANT_ROLES)
    out = scorecard.verdict(card.where((F.col("metric") == "overall") & (F.col("axis") != "trust")))
    scores = ("privacy_score", "utility_score", "fairness_score", "overall_score")
    return out.withColumns({c: F.round(c, 4) for c in scores})


@query(
    "ablation",
    f"""WITH {METRIC_SQL}, w AS (SELECT * FROM mt UNION ALL SELECT 'privacy', 'membership_inference', 0.3, 70, NULL UNION ALL SELECT 'utility', 'ml_efficacy', 0.3, 70, NULL
      UNION ALL SELECT 'fairness', 'equal_opportunity', 0.25, 70, NULL),
    a AS (SELECT x.axis, x.metric, (SELECT sum(y.score * y.weight) FROM w y WHERE y.axis = x.axis) AS f,
          (SELECT sum(y.score * y.weight) / sum(y.weight) FROM w y WHERE y.axis = x.axis AND y.metric <> x.metric) AS g FROM w x)
    SELECT axis, metric AS without, round(f, 4) AS full_score, round(g, 4) AS ablated_score, round(f - g, 4) AS contribution FROM a""",
)
def ablation(spark, sf):
    pair = scorecard.working_copy(*applicants(spark, sf), APPLICANT_ROLES)
    metrics = None
    for axis in scorecard.WEIGHTS:
        part = scorecard.axis_metrics(axis, *pair, APPLICANT_ROLES, with_models=False)
        metrics = part if metrics is None else metrics.unionByName(part)
    out = scorecard.ablation(metrics)
    return out.withColumns({c: F.round(c, 4) for c in ("full_score", "ablated_score", "contribution")})


@query(
    "evaluator_composite",
    f"""WITH {APPLICANT_SQL}, {points_sql(APPLICANT_NUMBERS, APPLICANT_LABELS, ALL_ROWS)}, u AS (SELECT * FROM r UNION ALL SELECT * FROM s),
    {scaled_sql(APPLICANT_NUMBERS, 'u', '0', APPLICANT_NUMBERS + APPLICANT_LABELS)}, {counts_sql(APPLICANT_LABELS)},
    st AS (SELECT avg(x.o_totalprice) AS a, stddev_samp(x.o_totalprice) AS b, avg(x.c_acctbal) AS c, stddev_samp(x.c_acctbal) AS d FROM r x),
    sy AS (SELECT avg(x.o_totalprice) AS a, stddev_samp(x.o_totalprice) AS b, avg(x.c_acctbal) AS c, stddev_samp(x.c_acctbal) AS d FROM s x),
    df AS (SELECT (abs(st.a - sy.a) / st.b + abs(st.c - sy.c) / st.d) / 2 AS md, (abs(st.b - sy.b) / st.b + abs(st.d - sy.d) / st.d) / 2 AS sd FROM st, sy),
    tv AS (SELECT avg(t) AS tv FROM (SELECT sum(abs(p - q)) / 2 AS t FROM sh GROUP BY "column")), {corr_sql(APPLICANT_NUMBERS)},
    g AS (SELECT attribute, max(rate) AS hi, min(rate) AS lo FROM ({' UNION ALL '.join(f"SELECT '{c}' AS attribute, avg(CAST({TARGET} = '{GOOD}' AS INTEGER)) AS rate FROM s GROUP BY {c}" for c in PROTECTED)}) GROUP BY 1),
    e AS (SELECT 'privacy' AS axis, 'dcr' AS metric, CAST(NULL AS VARCHAR) AS attribute, (SELECT CAST(least(100, avg(d) * 100) AS DOUBLE) FROM mind) AS score
      UNION ALL SELECT 'privacy', 'k_anonymity', NULL, (SELECT least(100, min(n) * 10) FROM (SELECT count(*) AS n FROM s GROUP BY {_QI}))
      UNION ALL SELECT 'utility', 'statistical_similarity', NULL, (SELECT greatest(0, 100 - (md + sd + tv) / 3 * 100) FROM df, tv)
      UNION ALL SELECT 'utility', 'correlation_preservation', NULL, (SELECT greatest(0, 100 - avg(abs(c_real - c_synth)) * 100) FROM cm WHERE col_a <> col_b)
      UNION ALL SELECT 'fairness', 'demographic_parity', attribute, greatest(0, 100 - (hi - lo) * 100) FROM g
      UNION ALL SELECT 'fairness', 'disparate_impact', attribute, CASE WHEN lo / hi >= 0.8 THEN 100 ELSE lo / hi * 100 / 0.8 END FROM g),
    m AS (SELECT axis, avg(score) AS score FROM e GROUP BY 1)
    SELECT axis, metric, attribute, round(score, 4) AS score FROM e UNION ALL SELECT axis, 'overall', NULL, round(score, 4) FROM m UNION ALL SELECT 'composite', 'overall', NULL, round(avg(score), 4) FROM m""",
)
def evaluator_composite(spark, sf):
    out = scorecard.evaluate_all(*applicants(spark, sf), APPLICANT_ROLES, with_models=False)
    return out.withColumn("score", F.round("score", 4))


@query(
    "recommendations",
    f"""WITH {METRIC_SQL}
    SELECT 'privacy' AS axis, CASE WHEN (SELECT x FROM dc) > 0 THEN 'WARNING: Exact matches found between synthetic and real data. Consider adding noise or retraining the generator.'
        ELSE 'DCR is below threshold. Consider increasing generator diversity.' END AS recommendation FROM mt WHERE metric = 'dcr' AND NOT passed
    UNION ALL SELECT 'privacy', 'k-Anonymity violation detected. Minimum k=' || (SELECT k FROM ka) || '. Consider generalizing quasi-identifiers.' FROM mt WHERE metric = 'k_anonymity' AND NOT passed
    UNION ALL SELECT 'privacy', 'Attribute disclosure risk detected. Review sensitive column distributions.' FROM mt WHERE metric = 'attribute_disclosure' AND NOT passed
    UNION ALL SELECT 'privacy', 'All privacy checks passed. Data is safe for release.' FROM ax WHERE axis = 'privacy' AND passed
    UNION ALL SELECT 'utility', 'Statistical distributions differ significantly. Consider increasing training epochs or adjusting generator architecture.' FROM mt WHERE metric = 'statistical_similarity' AND NOT passed
    UNION ALL SELECT 'utility', 'All utility checks passed. Data maintains good utility.' FROM ax WHERE axis = 'utility' AND passed
    UNION ALL SELECT 'fairness', 'Demographic parity violated for: ' || (SELECT string_agg("column", ', ' ORDER BY "column") FROM (SELECT "column" FROM psh GROUP BY 1 HAVING max(abs(p - q)) >= 0.1))
        || '. Consider rebalancing the training data.' FROM mt WHERE metric = 'demographic_parity' AND NOT passed
    UNION ALL SELECT 'fairness', 'Disparate impact detected. The 80% rule is violated. Consider using fairness-aware generation techniques.' FROM mt WHERE metric = 'disparate_impact' AND NOT passed
    UNION ALL SELECT 'fairness', 'Statistical parity difference is too high. Favorable outcomes are not evenly distributed across groups.' FROM mt WHERE metric = 'statistical_parity' AND NOT passed
    UNION ALL SELECT 'fairness', 'All fairness checks passed. No significant bias detected.' FROM ax WHERE axis = 'fairness' AND passed""",
)
def recommendations(spark, sf):
    r, s = scorecard.working_copy(*applicants(spark, sf), APPLICANT_ROLES)
    rates = fairness.favorable_rates(r, s, PROTECTED, TARGET, GOOD)
    a = scorecard.privacy_recommendations(
        distance.dcr_full(r, s, APPLICANT_NUMBERS, APPLICANT_LABELS),
        privacy.k_anonymity(s, APPLICANT_ROLES.quasi_identifiers),
        privacy.disclosure(r, s, APPLICANT_LABELS),
    )
    b = scorecard.utility_recommendations(
        utility.statistical_similarity(r, s, APPLICANT_NUMBERS, APPLICANT_LABELS),
        correlation.preservation(r, s, APPLICANT_LABELS, APPLICANT_COLUMNS),
        correlation.column_preservation(r, s, APPLICANT_LABELS, APPLICANT_COLUMNS),
        APPLICANT_COLUMNS,
    )
    c = scorecard.fairness_recommendations(
        fairness.representation(r, s, PROTECTED), fairness.disparate_impact(rates), fairness.statistical_parity(rates)
    )
    return a.unionByName(b).unionByName(c)


@query(
    "trial_summary",
    """SELECT event_type AS approach, count(*) AS num_trials, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(stddev_samp(value), 6) AS std_sample,
       round(min(value), 6) AS min, round(max(value), 6) AS max FROM events GROUP BY 1""",
)
def trial_summary(spark, sf):
    e = table(spark, sf, "events").withColumnRenamed("event_type", "approach")
    out = trials.trial_summary(e, ["approach"], "value")
    return out.withColumns({c: round6(F.col(c)) for c in ("mean", "std", "std_sample", "min", "max")})


@query(
    "overhead_percent",
    """WITH a AS (SELECT user_id, avg(value) FILTER (event_type = 'click') AS x, avg(value) FILTER (event_type = 'view') AS y FROM events GROUP BY 1)
    SELECT user_id, round(y - x, 6) AS overhead, round((y - x) / x * 100, 4) AS overhead_percent FROM a WHERE x IS NOT NULL AND y IS NOT NULL""",
)
def overhead_percent(spark, sf):
    out = trials.overhead(table(spark, sf, "events"), "user_id", "event_type", "value", "click", "view")
    return out.select("user_id", round6(F.col("overhead")).alias("overhead"), F.round("overhead_percent", 4).alias("overhead_percent"))


@query(
    "trust_comparison",
    f"""WITH {SUBMISSION_SQL}, o AS (SELECT count(*) AS n, avg((privacy + utility + fairness) / 3 * CAST(0.7 AS DOUBLE)) AS t FROM firsts)
    SELECT 'none' AS approach, n AS verifications, 0.0::DOUBLE AS trust FROM o UNION ALL SELECT 'single', n, round(t, 6) FROM o
    UNION ALL SELECT 'consensus', count(*), round(avg(overall), 6) FROM verdict""",
)
def trust_comparison(spark, sf):
    sub = submissions(spark, sf)
    out = trials.trust_comparison(consensus.first_submissions(sub), consensus.consensus(sub))
    return out.withColumn("trust", round6(F.col("trust")))


# --------------------------------------------------------------- model metrics


@query("rf_mia")
def rf_mia(spark, sf):
    return models.membership_inference(*lineitem_split(spark, sf), POINT_NUMBERS, POINT_LABELS)


@query("rf_mia_evaluator")
def rf_mia_evaluator(spark, sf):
    return models.membership_inference_evaluator(*lineitem_split(spark, sf), POINT_NUMBERS, POINT_LABELS)


@query("rf_tstr")
def rf_tstr(spark, sf):
    return models.train_on_synthetic(*applicants(spark, sf), APPLICANT_NUMBERS, APPLICANT_LABELS, TARGET)


@query("rf_tstr_regression")
def rf_tstr_regression(spark, sf):
    return models.train_on_synthetic(*lineitem_split(spark, sf), POINT_NUMBERS, POINT_LABELS, "l_extendedprice", classification=False)


@query("rf_tstr_evaluator")
def rf_tstr_evaluator(spark, sf):
    return models.evaluator_efficacy(*lineitem_split(spark, sf), SPLIT_ROLES.numeric, "l_linestatus", True)


@query("rf_tstr_evaluator_regression")
def rf_tstr_evaluator_regression(spark, sf):
    return models.evaluator_efficacy(*lineitem_split(spark, sf), SPLIT_ROLES.numeric, "l_extendedprice", False)


@query(
    "run_modes",
    f"""WITH {METRIC_SQL}, t AS (SELECT 0.4::DOUBLE * max(score) FILTER (axis = 'privacy') + 0.35::DOUBLE * max(score) FILTER (axis = 'utility') + 0.25::DOUBLE * max(score) FILTER (axis = 'fairness') AS trust FROM ax)
    SELECT unnest(['generate', 'upload']) AS mode, round(trust, 2) AS score FROM t UNION ALL SELECT 'synthetic_only', overall_score FROM ({SYNTHETIC_ONLY_SQL})""",
)
def run_modes(spark, sf):
    """The overall score of the three ways to run a verification."""
    pair = dict(zip(("real", "synthetic"), applicants(spark, sf)))
    out = None
    for mode in ("generate", "upload"):
        card = api.verify(mode, pair, APPLICANT_ROLES, with_models=False).where("axis = 'trust'")
        part = card.select(F.lit(mode).alias("mode"), F.round("score", 2).alias("score"))
        out = part if out is None else out.unionByName(part)
    lone = prepare.rename_columns(dirty_orders(spark, sf))
    alone = api.verify("synthetic_only", {"synthetic": lone}, APPLICANT_ROLES.but(categorical=("priority", "status", "mostly_empty")))
    return out.unionByName(alone.select(F.lit("synthetic_only").alias("mode"), F.round("overall_score", 2).alias("score")))


@query("rf_eod")
def rf_eod(spark, sf):
    return models.equal_opportunity(*applicants(spark, sf), APPLICANT_NUMBERS, APPLICANT_LABELS, PROTECTED, TARGET)
