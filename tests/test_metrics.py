"""Closed forms, bounds and invariances of the metrics."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinproof.operators import cdf, correlation, distance, distributions, fairness, privacy, quality, utility
from twinproof.plans import scorecard
from twinproof.roles import ColumnRoles, infer_roles, protected_columns


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(42)
    n = 500
    rows = [
        (
            int(np.clip(rng.normal(45, 15), 18, 90)),
            float(rng.lognormal(10.5, 0.8)),
            str(rng.choice(["M", "F"])),
            str(rng.choice(["HS", "Bachelor", "Master", "PhD"])),
            int(rng.random() < 0.9),
        )
        for _ in range(n)
    ]
    return spark.createDataFrame(rows, "age int, income double, gender string, education string, employed int")


ROLES = ColumnRoles(
    categorical=("gender", "education", "employed"),
    numeric=("age", "income"),
    quasi_identifiers=("gender", "education"),
    protected=("gender",),
    target="employed",
    favorable=1,
)


def test_identical_tables_have_no_distance(people):
    d = cdf.numeric_distances(people, people, ["age", "income"]).collect()
    assert all(r["wasserstein"] == pytest.approx(0) and r["ks"] == 0 and r["ks_p_value"] == pytest.approx(1) for r in d)
    v = distributions.divergences(people, people, ["gender", "education"]).collect()
    assert all(r["tv_distance"] == 0 and r["js_distance"] == pytest.approx(0, abs=1e-6) for r in v)
    assert correlation.preservation(people, people, ROLES.categorical, ROLES.columns).first()["score"] == pytest.approx(100)


def test_shift_is_the_wasserstein_distance(people):
    sd = people.agg(F.stddev_pop("income")).first()[0]
    moved = people.withColumn("income", F.col("income") + 1000)
    w = cdf.numeric_distances(people, moved, ["income"]).first()["wasserstein"]
    assert w == pytest.approx(1000 / sd, rel=1e-9)


def test_distances_are_symmetric_in_ks(people):
    other = people.withColumn("income", F.col("income") * 1.3)
    a = cdf.numeric_distances(people, other, ["income"]).first()["ks"]
    b = cdf.numeric_distances(other, people, ["income"]).first()["ks"]
    assert a == pytest.approx(b) and 0 < a <= 1


def test_constant_and_empty_columns(spark):
    a = spark.createDataFrame([(1.0, None), (1.0, None)], "x double, y double")
    d = cdf.numeric_distances(a, a, ["x", "y"]).collect()
    assert [r["column"] for r in d] == ["x"] and d[0]["wasserstein"] == 0


def test_copies_have_distance_zero(people):
    r = distance.dcr_sampled(people, people, ["age", "income", "employed"], ["gender", "education"]).first()
    assert r["mean_dcr"] == 0 and r["exact_matches"] == 500 and r["score"] == 0 and not r["passed"]


def test_sampled_equals_full_when_everything_fits(people):
    other = people.withColumn("income", F.col("income") * 1.01 + 5)
    args = (["age", "income", "employed"], ["gender", "education"])
    a, b = distance.dcr_sampled(people, other, *args).first(), distance.dcr_full(people, other, *args).first()
    for c in ("mean_dcr", "median_dcr", "min_dcr", "score"):
        assert a[c] == pytest.approx(b[c], rel=1e-9), c
    assert a["exact_matches"] == b["exact_matches"] and a["n_compared"] == b["n_compared"]


def test_k_anonymity_ignores_null_groups_but_counts_their_rows(spark):
    df = spark.createDataFrame([("a",)] * 6 + [("b",)] * 2 + [(None,)] * 2, "q string")
    r = privacy.k_anonymity(df, ["q"]).first()
    assert (r["min_k"], r["mean_k"], r["violating_records"]) == (2, 4.0, 2)
    assert r["violation_rate"] == pytest.approx(0.2) and r["score"] == pytest.approx(40) and not r["passed"]


def test_auc_of_perfect_and_random_scores(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.2), (0, 0.1)], "y int, s double")
    assert privacy.roc_auc(df, "y", "s").first()["auc"] == 1.0
    same = df.withColumn("s", F.lit(0.5))
    assert privacy.roc_auc(same, "y", "s").first()["auc"] == 0.5


def test_histogram_density_sums_to_one(people):
    h = cdf.histogram(people, people, ["income"]).where("side = 'real'").toPandas()
    width = (people.agg(F.max("income") - F.min("income")).first()[0]) / 30
    assert (h["density"] * width).sum() == pytest.approx(1) and h["n"].sum() == 500


def test_correlation_plans_agree(people, monkeypatch):
    def matrix(df):
        return {(r["col_a"], r["col_b"]): r["corr"] for r in correlation.correlation_matrix(df, ["age", "income", "employed"]).collect()}

    want = people.toPandas()[["age", "income", "employed"]].corr()
    fused = matrix(people)
    monkeypatch.setattr(correlation, "SUMS_PER_AGGREGATE", 2)
    chunked = matrix(people)
    monkeypatch.setattr(correlation, "FUSED_PAIRS", 0)
    by_matrix = matrix(people)
    assert len(fused) == 9
    for (a, b), v in fused.items():
        assert v == pytest.approx(want.loc[a, b]) == pytest.approx(chunked[(a, b)]) and v == pytest.approx(by_matrix[(a, b)])


@pytest.mark.parametrize("fused_pairs", [120, 0])
def test_correlation_uses_rows_with_both_values(people, monkeypatch, fused_pairs):
    monkeypatch.setattr(correlation, "FUSED_PAIRS", fused_pairs)
    gaps = people.withColumn("income", F.when(F.col("age") % 7 != 0, F.col("income"))).withColumn("flat", F.lit(3.0))
    want = gaps.toPandas()[["age", "income"]].corr().loc["age", "income"]
    got = {(r["col_a"], r["col_b"]): r["corr"] for r in correlation.correlation_matrix(gaps, ["age", "income", "flat"]).collect()}
    assert got[("age", "income")] == pytest.approx(want) and got[("income", "income")] == pytest.approx(1)
    assert got[("age", "flat")] is None and len(got) == 9


def test_disparate_impact_with_group_missing_in_synthetic(spark):
    real = spark.createDataFrame([("m", 1), ("m", 1), ("f", 1), ("f", 0)], "g string, y int")
    synth = spark.createDataFrame([("m", 1), ("m", 0)], "g string, y int")
    rates = fairness.favorable_rates(real, synth, ["g"], "y", 1)
    r = fairness.disparate_impact(rates).first()
    assert r["min_di_real"] == 0.5 and r["min_di_synth"] == 0 and r["score"] == 0
    assert fairness.statistical_parity(rates).first()["max_spd"] == 0.5


def test_scorecard_has_bounds_and_missing_metrics(people):
    card = {(r["axis"], r["metric"]): r for r in scorecard.scorecard(people, people, ROLES).collect()}
    assert all(0 <= r["score"] <= 100 for r in card.values())
    assert card[("fairness", "overall")]["score"] <= 75 + 1e-9
    trust = 0.4 * card[("privacy", "overall")]["score"] + 0.35 * card[("utility", "overall")]["score"] + 0.25 * card[("fairness", "overall")]["score"]
    assert card[("trust", "overall")]["score"] == pytest.approx(trust)


def test_scorecard_without_protected_columns(people):
    card = {(r["axis"], r["metric"]): r["score"] for r in scorecard.scorecard(people, people, ROLES.but(protected=())).collect()}
    assert card[("fairness", "skipped")] == 100


def test_same_result_for_any_partition_count(spark, people):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    other = people.withColumn("income", F.col("income") * 1.1)
    found = []
    for n in ("1", "4", "32"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(
            (
                round(utility.statistical_similarity(people.repartition(int(n)), other, ["age", "income"], ["gender"]).first()["score"], 6),
                round(distance.dcr_sampled(people.repartition(int(n)), other, ["age", "income"], ["gender"]).first()["mean_dcr"], 6),
            )
        )
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] == found[2]


def test_registered_metric_joins_the_axis(people):
    scorecard.register_metric("utility", "row_ratio", 0.0, lambda r, s, ro: s.agg(F.lit(50.0).alias("score"), F.lit(True).alias("passed")))
    try:
        names = {r["metric"] for r in scorecard.axis_metrics("utility", people, people, ROLES, with_models=False).collect()}
        assert "row_ratio" in names
    finally:
        scorecard._REGISTRY["utility"].pop("row_ratio")


def test_role_inference(people):
    roles = infer_roles(people)
    assert set(roles.categorical) == {"gender", "education", "employed"} and roles.target == "employed"
    assert set(roles.numeric) == {"age", "income"} and set(roles.protected) == {"gender", "age"}
    assert protected_columns(["Sex", "package", "x"]) == ["Sex", "package"]


def test_quality_of_an_empty_column(spark):
    df = spark.createDataFrame([("a", None), ("b", None)], "x string, y string")
    r = {x["column"]: x for x in quality.column_quality(df, ["x"]).collect()}
    assert r["y"]["validity"] == 0 and r["y"]["distribution"] is None and r["x"]["distribution"] == pytest.approx(100)
