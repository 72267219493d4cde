"""Distribution, utility and correlation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinproof.catalog.pairs import (
    APPLICANT_COLUMNS,
    APPLICANT_LABELS,
    APPLICANT_SQL,
    PREDICTION_SQL,
    SPLIT_COLUMNS,
    SPLIT_LABELS,
    SPLIT_NUMBERS,
    SPLIT_SQL,
    applicants,
    lineitem_split,
    predictions,
    table,
)
from twinproof.catalog.registry import query
from twinproof.functions.scalar import abs_log, efficacy_score, ratio, round6
from twinproof.operators import cdf, correlation, distributions, utility


def counts_sql(columns, cast="VARCHAR", mark="") -> str:
    """CTEs ``vc`` (column, value, n_real, n_synth) and ``sh`` with shares.

    ``mark`` prefixes their names when two sets appear in one query.
    """
    branches = [
        f"SELECT '{c}' AS \"column\", CAST({c} AS {cast}) AS value, {flag} AS is_real FROM {t}"
        for c in columns
        for t, flag in (("r", 1), ("s", 0))
    ]
    return f"""
  {mark}lv AS ({' UNION ALL '.join(branches)}),
  {mark}vc AS (SELECT "column", value, CAST(sum(is_real) AS BIGINT) AS n_real, CAST(sum(1 - is_real) AS BIGINT) AS n_synth
         FROM {mark}lv WHERE value IS NOT NULL GROUP BY 1, 2),
  {mark}sh AS (SELECT *, n_real / CAST(sum(n_real) OVER w AS DOUBLE) AS p, n_synth / CAST(sum(n_synth) OVER w AS DOUBLE) AS q,
                count(*) OVER w AS k FROM {mark}vc WINDOW w AS (PARTITION BY "column"))"""


@query(
    "pair_distributions",
    f"WITH {SPLIT_SQL}, {counts_sql(SPLIT_LABELS)} "
    'SELECT "column", value, n_real, n_synth, round(p, 6) AS p_real, round(q, 6) AS p_synth FROM sh',
)
def pair_distributions(spark, sf):
    out = distributions.distributions(*lineitem_split(spark, sf), SPLIT_LABELS)
    return out.withColumns({"p_real": round6(F.col("p_real")), "p_synth": round6(F.col("p_synth"))})


@query(
    "category_shares",
    f"WITH {APPLICANT_SQL}, {counts_sql(APPLICANT_LABELS)} "
    'SELECT "column", value, round(p * 100, 4) AS real_pct, round(q * 100, 4) AS synth_pct FROM sh ORDER BY 1, 2',
)
def category_shares(spark, sf):
    out = distributions.distributions(*applicants(spark, sf), APPLICANT_LABELS)
    return out.select(
        "column", "value", F.round(F.col("p_real") * 100, 4).alias("real_pct"), F.round(F.col("p_synth") * 100, 4).alias("synth_pct")
    ).orderBy("column", "value")


@query(
    "value_sets",
    f"""WITH {SPLIT_SQL}, {counts_sql(SPLIT_LABELS + ('l_quantity', 'l_discount'))}
    SELECT "column", count(*) FILTER (n_real > 0 AND n_synth > 0) AS n_both,
           count(*) FILTER (n_synth = 0) AS n_real_only, count(*) FILTER (n_real = 0) AS n_synth_only
    FROM vc GROUP BY 1""",
)
def value_sets(spark, sf):
    return distributions.value_set_differences(*lineitem_split(spark, sf), SPLIT_LABELS + ("l_quantity", "l_discount"))


JS_SQL = """
  sm AS (SELECT "column", (p + 1e-10) / (1 + k * 1e-10) AS a, (q + 1e-10) / (1 + k * 1e-10) AS b FROM sh),
  js AS (SELECT "column", sqrt(greatest(sum(0.5 * a * ln(a / ((a + b) / 2)) + 0.5 * b * ln(b / ((a + b) / 2))), 0))
                AS js_distance FROM sm GROUP BY 1)"""


@query(
    "js_distance",
    f"WITH {APPLICANT_SQL}, {counts_sql(APPLICANT_LABELS)}, {JS_SQL} "
    'SELECT "column", round(js_distance, 6) AS js_distance FROM js',
)
def js_distance(spark, sf):
    out = distributions.divergences(*applicants(spark, sf), APPLICANT_LABELS)
    return out.select("column", round6(F.col("js_distance")).alias("js_distance"))


def cdf_sql(columns) -> str:
    sds = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", stddev_pop({c}) AS sd FROM r" for c in columns)
    return f"""{counts_sql(columns, 'DOUBLE', 'n')},
  cd AS (SELECT "column", value, sum(n_real) OVER w / CAST(sum(n_real) OVER c AS DOUBLE) AS fr,
                sum(n_synth) OVER w / CAST(sum(n_synth) OVER c AS DOUBLE) AS fs, lead(value) OVER w AS nx,
                sum(n_real) OVER c AS tr, sum(n_synth) OVER c AS ts
         FROM nvc WINDOW w AS (PARTITION BY "column" ORDER BY value), c AS (PARTITION BY "column")),
  sd AS ({sds}),
  dist AS (SELECT "column", sum(abs(fr - fs) * coalesce(nx - value, 0)) / (max(sd) + 1e-10) AS wasserstein,
                  max(abs(fr - fs)) AS ks, CAST(max(tr) AS BIGINT) AS n_real, CAST(max(ts) AS BIGINT) AS n_synth
           FROM cd JOIN sd USING ("column") GROUP BY 1)"""


@query(
    "wasserstein",
    f"WITH {SPLIT_SQL}, {cdf_sql(SPLIT_NUMBERS)} "
    'SELECT "column", round(wasserstein, 6) AS wasserstein, n_real, n_synth FROM dist',
)
def wasserstein(spark, sf):
    out = cdf.numeric_distances(*lineitem_split(spark, sf), SPLIT_NUMBERS)
    return out.select("column", round6(F.col("wasserstein")).alias("wasserstein"), "n_real", "n_synth")


_KS_SERIES = " + ".join(
    f"({'2.0' if k % 2 else '-2.0'}) * exp(-2.0 * {k} * {k} * z2)" for k in range(40, 0, -1)
)


@query(
    "distances_with_missing",
    f"""WITH {SPLIT_SQL.replace('l_discount', 'CASE WHEN l_partkey % 3 > 0 AND l_suppkey % 5 > 0 THEN l_discount END AS l_discount')}, {cdf_sql(SPLIT_NUMBERS)}
    SELECT "column", round(wasserstein, 6) AS wasserstein, round(ks, 6) AS ks, n_real, n_synth FROM dist""",
)
def distances_with_missing(spark, sf):
    """Distances of columns that hold NaN and null: both are missing values, neither is counted."""
    discount = F.when(F.col("l_partkey") % 3 == 0, F.lit(float("nan"))).when(F.col("l_suppkey") % 5 > 0, F.col("l_discount")).alias("l_discount")
    items = table(spark, sf, "lineitem").select("l_orderkey", *[discount if c == "l_discount" else c for c in SPLIT_NUMBERS])
    real, synth = items.where("l_orderkey % 2 = 0"), items.where("l_orderkey % 2 = 1")
    out = cdf.numeric_distances(real, synth, SPLIT_NUMBERS)
    return out.select("column", round6(F.col("wasserstein")).alias("wasserstein"), round6(F.col("ks")).alias("ks"), "n_real", "n_synth")


@query(
    "ks",
    f"""WITH {APPLICANT_SQL}, {cdf_sql(('o_totalprice', 'c_acctbal'))},
    z AS (SELECT *, ks * ks * n_real * n_synth / CAST(n_real + n_synth AS DOUBLE) AS z2 FROM dist)
    SELECT "column", round(ks, 6) AS ks, round(CASE WHEN z2 < 0.04 THEN 1.0
           ELSE least(greatest({_KS_SERIES}, 0.0), 1.0) END, 6) AS ks_p_value FROM z""",
)
def ks(spark, sf):
    out = cdf.numeric_distances(*applicants(spark, sf), ("o_totalprice", "c_acctbal"))
    return out.select("column", round6(F.col("ks")).alias("ks"), round6(F.col("ks_p_value")).alias("ks_p_value"))


@query(
    "summary_stats",
    f"WITH {SPLIT_SQL} "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round((SELECT avg({c}) FROM r), 6) AS mean_real, round((SELECT avg({c}) FROM s), 6) AS mean_synth,
        round((SELECT stddev_samp({c}) FROM r), 6) AS std_real, round((SELECT stddev_samp({c}) FROM s), 6) AS std_synth,
        round((SELECT ln(abs(avg({c})) + 1e-10) FROM r), 6) AS log_mean_real, round((SELECT ln(abs(avg({c})) + 1e-10) FROM s), 6) AS log_mean_synth,
        round((SELECT ln(abs(stddev_samp({c})) + 1e-10) FROM r), 6) AS log_std_real, round((SELECT ln(abs(stddev_samp({c})) + 1e-10) FROM s), 6) AS log_std_synth"""
        for c in SPLIT_NUMBERS
    ),
)
def summary_stats(spark, sf):
    out = cdf.summary_statistics(*lineitem_split(spark, sf), SPLIT_NUMBERS)
    names = ("mean_real", "mean_synth", "std_real", "std_synth")
    return out.select(
        "column",
        *[round6(F.col(n)).alias(n) for n in names],
        *[round6(abs_log(F.col(n))).alias(f"log_{n}") for n in names],
    )




@query(
    "lorenz",
    f"""WITH {SPLIT_SQL}, ks AS (SELECT CAST(unnest(range(0, 101)) AS INTEGER) AS k),
    rk AS (SELECT 'l_quantity' AS "column", 'real' AS side, l_quantity AS v FROM r UNION ALL SELECT 'l_quantity', 'synth', l_quantity FROM s
           UNION ALL SELECT 'l_extendedprice', 'real', l_extendedprice FROM r UNION ALL SELECT 'l_extendedprice', 'synth', l_extendedprice FROM s),
    cs AS (SELECT "column", side, sum(v) OVER (PARTITION BY "column", side ORDER BY v ROWS UNBOUNDED PRECEDING) / sum(v) OVER (PARTITION BY "column", side) * 100 AS share,
                  row_number() OVER (PARTITION BY "column", side ORDER BY v) AS i, count(*) OVER (PARTITION BY "column", side) AS n FROM rk),
    pt AS (SELECT "column", side, k AS percentile, share FROM cs JOIN ks ON i = CAST(ceil(k * n / 100.0) AS BIGINT)
           UNION ALL SELECT DISTINCT "column", side, 0, 0.0 FROM rk)
    SELECT "column", percentile, round(max(share) FILTER (side = 'real'), 4) AS real_share,
           round(max(share) FILTER (side = 'synth'), 4) AS synth_share FROM pt GROUP BY 1, 2""",
)
def lorenz(spark, sf):
    out = cdf.lorenz_curve(*lineitem_split(spark, sf), ("l_quantity", "l_extendedprice"))
    return out.select(
        "column", "percentile", F.round("real_share", 4).alias("real_share"), F.round("synth_share", 4).alias("synth_share")
    )


@query(
    "histogram",
    f"""WITH {SPLIT_SQL}, x AS (
      SELECT 'real' AS side, 'l_extendedprice' AS "column", l_extendedprice AS v FROM r UNION ALL SELECT 'synthetic', 'l_extendedprice', l_extendedprice FROM s
      UNION ALL SELECT 'real', 'l_quantity', l_quantity FROM r UNION ALL SELECT 'synthetic', 'l_quantity', l_quantity FROM s),
    b AS (SELECT side, "column", min(v) AS lo, max(v) AS hi, count(*) AS total FROM x GROUP BY 1, 2)
    SELECT side, "column", CAST(least(floor((v - lo) / ((hi - lo) / 30)), 29) AS INTEGER) AS bin, count(*) AS n,
           round(count(*) / (total * ((hi - lo) / 30)), 9) AS density
    FROM x JOIN b USING (side, "column") GROUP BY side, "column", bin, total, lo, hi""",
)
def histogram(spark, sf):
    out = cdf.histogram(*lineitem_split(spark, sf), ("l_extendedprice", "l_quantity"))
    return out.withColumn("density", F.round("density", 9))


def corr_sql(columns, labels=()) -> str:
    """CTE ``cm`` (col_a, col_b, cr, cs) with codes fitted per table."""
    ctes = []
    for t in ("r", "s"):
        cols = ", ".join(
            f"dense_rank() OVER (ORDER BY CAST({c} AS VARCHAR)) - 1 AS {c}" if c in labels else c for c in columns
        )
        ctes.append(f"e{t} AS (SELECT {cols} FROM {t})")
        ctes.append(
            f"c{t} AS ("
            + " UNION ALL ".join(
                f"SELECT '{a}' AS col_a, '{b}' AS col_b, corr({a}, {b}) AS c FROM e{t}" for a in columns for b in columns
            )
            + ")"
        )
    return ", ".join(ctes) + ", cm AS (SELECT col_a, col_b, cr.c AS c_real, cs.c AS c_synth FROM cr JOIN cs USING (col_a, col_b))"


@query(
    "corr_matrix",
    f"WITH {SPLIT_SQL}, {corr_sql(SPLIT_COLUMNS, SPLIT_LABELS)} "
    "SELECT col_a, col_b, round(c_real, 6) AS corr_real, round(c_synth, 6) AS corr_synth FROM cm",
)
def corr_matrix(spark, sf):
    out = correlation.correlation_pairs(*lineitem_split(spark, sf), SPLIT_LABELS, SPLIT_COLUMNS)
    return out.select("col_a", "col_b", round6(F.col("corr_real")).alias("corr_real"), round6(F.col("corr_synth")).alias("corr_synth"))


@query(
    "corr_preservation",
    f"WITH {SPLIT_SQL}, {corr_sql(SPLIT_COLUMNS, SPLIT_LABELS)}, m AS (SELECT avg(abs(c_real - c_synth)) AS d, max(abs(c_real - c_synth)) AS x FROM cm) "
    "SELECT round(d, 6) AS mean_diff, round(x, 6) AS max_diff, round(greatest(0.0, 100 - d * 500), 4) AS score, d < 0.1 AS passed FROM m",
)
def corr_preservation(spark, sf):
    out = correlation.preservation(*lineitem_split(spark, sf), SPLIT_LABELS, SPLIT_COLUMNS)
    return out.select(
        round6(F.col("mean_diff")).alias("mean_diff"), round6(F.col("max_diff")).alias("max_diff"), F.round("score", 4).alias("score"), "passed"
    )


@query(
    "corr_by_column",
    f"WITH {APPLICANT_SQL}, {corr_sql(APPLICANT_COLUMNS, APPLICANT_LABELS)} "
    'SELECT col_a AS "column", round(avg(abs(c_real - c_synth)), 6) AS mean_diff FROM cm GROUP BY 1',
)
def corr_by_column(spark, sf):
    out = correlation.column_preservation(*applicants(spark, sf), APPLICANT_LABELS, APPLICANT_COLUMNS)
    return out.withColumn("mean_diff", round6(F.col("mean_diff")))


@query(
    "corr_offdiag",
    f"WITH {SPLIT_SQL}, {corr_sql(SPLIT_NUMBERS)}, m AS (SELECT avg(abs(c_real - c_synth)) AS d FROM cm WHERE col_a <> col_b) "
    "SELECT round(d, 6) AS correlation_diff, round(greatest(0.0, 100 - d * 100), 4) AS correlation_score FROM m",
)
def corr_offdiag(spark, sf):
    out = correlation.offdiagonal_preservation(*lineitem_split(spark, sf), SPLIT_NUMBERS)
    return out.select(round6(F.col("correlation_diff")).alias("correlation_diff"), F.round("correlation_score", 4).alias("correlation_score"))


@query(
    "stat_similarity",
    f"""WITH {APPLICANT_SQL}, {cdf_sql(('o_totalprice', 'c_acctbal'))},
    {counts_sql(APPLICANT_LABELS)}, {JS_SQL},
    a AS (SELECT (SELECT avg(wasserstein) FROM dist) AS w, (SELECT avg(js_distance) FROM js) AS j)
    SELECT round(w, 6) AS avg_wasserstein, round(j, 6) AS avg_js_distance,
           round((CASE WHEN w < 0.2 THEN greatest(0.0, 100 - w * 500) ELSE 0.0 END) * CAST(0.6 AS DOUBLE)
               + (CASE WHEN j < 0.2 THEN greatest(0.0, 100 - j * 500) ELSE 0.0 END) * CAST(0.4 AS DOUBLE), 4) AS score,
           w < 0.1 AND j < 0.15 AS passed FROM a""",
)
def stat_similarity(spark, sf):
    out = utility.statistical_similarity(*applicants(spark, sf), ("o_totalprice", "c_acctbal"), APPLICANT_LABELS)
    return out.select(
        round6(F.col("avg_wasserstein")).alias("avg_wasserstein"),
        round6(F.col("avg_js_distance")).alias("avg_js_distance"),
        F.round("score", 4).alias("score"),
        "passed",
    )


@query(
    "mean_std_diff",
    f"""WITH {APPLICANT_SQL}, {counts_sql(APPLICANT_LABELS)},
    st AS (SELECT avg(x.o_totalprice) AS a, stddev_samp(x.o_totalprice) AS b, avg(x.c_acctbal) AS c, stddev_samp(x.c_acctbal) AS d FROM r x),
    sy AS (SELECT avg(x.o_totalprice) AS a, stddev_samp(x.o_totalprice) AS b, avg(x.c_acctbal) AS c, stddev_samp(x.c_acctbal) AS d FROM s x),
    df AS (SELECT (abs(st.a - sy.a) / st.b + abs(st.c - sy.c) / st.d) / 2 AS md, (abs(st.b - sy.b) / st.b + abs(st.d - sy.d) / st.d) / 2 AS sd FROM st, sy),
    tv AS (SELECT avg(t) AS tv FROM (SELECT sum(abs(p - q)) / 2 AS t FROM sh GROUP BY "column"))
    SELECT round(md, 6) AS mean_diff, round(sd, 6) AS std_diff, round(tv, 6) AS tv_distance,
           round(greatest(0.0, 100 - (md + sd + tv) / 3 * 100), 4) AS similarity_score FROM df, tv""",
)
def mean_std_diff(spark, sf):
    out = utility.evaluator_similarity(*applicants(spark, sf), ("o_totalprice", "c_acctbal"), APPLICANT_LABELS)
    return out.select(
        *[round6(F.col(c)).alias(c) for c in ("mean_diff", "std_diff", "tv_distance")], F.round("similarity_score", 4).alias("similarity_score")
    )


@query(
    "quality_report",
    f"""WITH {SPLIT_SQL}, {cdf_sql(SPLIT_NUMBERS)},
    {counts_sql(SPLIT_LABELS)}, {corr_sql(SPLIT_NUMBERS)},
    shp AS (SELECT 1 - ks AS v FROM dist UNION ALL SELECT 1 - sum(abs(p - q)) / 2 FROM sh GROUP BY "column"),
    a AS (SELECT avg(v) AS v FROM shp), b AS (SELECT avg(1 - abs(c_real - c_synth) / 2) AS v FROM cm WHERE col_a < col_b)
    SELECT 'column_shapes' AS property, round(v, 6) AS score FROM a UNION ALL SELECT 'column_pair_trends', round(v, 6) FROM b
    UNION ALL SELECT 'overall', round((a.v + b.v) / 2, 6) FROM a, b""",
)
def quality_report(spark, sf):
    out = utility.quality_report(*lineitem_split(spark, sf), SPLIT_NUMBERS, SPLIT_LABELS)
    return out.withColumn("score", round6(F.col("score")))


@query(
    "f1_weighted",
    f"""WITH {PREDICTION_SQL},
    l AS (SELECT DISTINCT grp, y AS label FROM pred UNION SELECT DISTINCT grp, y_hat FROM pred),
    m AS (SELECT l.grp, label, count(*) FILTER (y = label) AS sup, count(*) FILTER (y_hat = label) AS called,
                 count(*) FILTER (y = label AND y_hat = label) AS tp FROM l JOIN pred USING (grp) GROUP BY 1, 2)
    SELECT grp, round(sum(tp) / sum(sup), 6) AS accuracy,
           round(sum(2.0 * tp / (sup + called) * sup) / sum(sup), 6) AS weighted_f1 FROM m GROUP BY 1""",
)
def f1_weighted(spark, sf):
    out = utility.classification_scores(predictions(spark, sf), "y", "y_hat", by=["grp"])
    return out.select("grp", round6(F.col("accuracy")).alias("accuracy"), round6(F.col("weighted_f1")).alias("weighted_f1"))


@query(
    "regression_scores",
    """WITH p AS (SELECT o_orderpriority AS grp, o_totalprice AS y, o_totalprice * 0.9 + o_orderkey % 1000 AS h FROM orders),
    m AS (SELECT grp, avg((y - h) * (y - h)) AS mse, var_pop(y) AS v, max(y) - min(y) AS w FROM p GROUP BY 1)
    SELECT grp, round((v - mse) / v, 6) AS r2, round(sqrt(mse), 4) AS rmse, round(sqrt(mse) / w, 6) AS normalized_rmse FROM m""",
)
def regression_scores(spark, sf):
    o = table(spark, sf, "orders")
    p = o.select(
        F.col("o_orderpriority").alias("grp"), F.col("o_totalprice").alias("y"), (F.col("o_totalprice") * 0.9 + F.col("o_orderkey") % 1000).alias("h")
    )
    out = utility.regression_scores(p, "y", "h", by=["grp"])
    return out.select("grp", round6(F.col("r2")).alias("r2"), F.round("rmse", 4).alias("rmse"), round6(F.col("normalized_rmse")).alias("normalized_rmse"))


@query(
    "efficacy_score",
    f"""WITH {PREDICTION_SQL}, a AS (SELECT grp, avg(CAST(y = y_hat AS INTEGER)) AS synth, greatest(avg(y), 1 - avg(y)) AS base FROM pred GROUP BY 1),
    q AS (SELECT grp, CASE WHEN base > 0 THEN synth / base ELSE 0 END AS ratio FROM a)
    SELECT grp, round(ratio, 6) AS efficacy_ratio, round(CASE WHEN ratio >= 1 THEN 100 ELSE least(100, ratio * 100 / 0.7) END, 4) AS score, ratio >= 0.7 AS passed FROM q""",
)
def efficacy(spark, sf):
    p = predictions(spark, sf)
    rates = p.groupBy("grp").agg(
        F.avg((F.col("y") == F.col("y_hat")).cast("double")).alias("synth"), F.greatest(F.avg("y"), 1 - F.avg("y")).alias("base")
    )
    q = ratio(F.col("synth"), F.col("base"))
    return rates.select(
        "grp", round6(q).alias("efficacy_ratio"), F.round(efficacy_score(q), 4).alias("score"), (q >= 0.7).alias("passed")
    )
