"""The paths taken by big and skewed data, forced on small fixtures."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from twinproof import session
from twinproof.catalog import QUERIES
from twinproof.functions.scalar import row_md5
from twinproof.operators import consensus, distance, distributions, encoding, mitigation, models, running, sampling
from twinproof.operators.fingerprint import fingerprint, leaf_digits_for
from twinproof.session import settle


def test_running_totals_bucketed_numbers(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": rng.choice(["a", "b"], 3000, p=[0.9, 0.1]), "x": rng.normal(size=3000).round(3)})
    pdf = pdf.groupby(["k", "x"]).size().reset_index(name="n")
    out = running.running_totals(spark.createDataFrame(pdf), ["k"], "x", ["n"], buckets=16, small_rows=0).toPandas()
    want = pdf.sort_values(["k", "x"])
    want["cum_n"] = want.groupby("k")["n"].cumsum()
    want["next_value"] = want.groupby("k")["x"].shift(-1)
    got = out.sort_values(["k", "x"])[["k", "x", "n", "cum_n", "next_value"]]
    pd.testing.assert_frame_equal(got.reset_index(drop=True), want.reset_index(drop=True), check_dtype=False)


def test_running_totals_bucketed_text(spark):
    values = [f"v{i * 7919 % 1000:04d}" for i in range(1000)]
    df = spark.createDataFrame([("c", v, 1) for v in values], "k string, v string, one int")
    out = running.running_totals(df, ["k"], "v", ["one"], buckets=8, small_rows=0).toPandas().sort_values("v")
    assert out["cum_one"].tolist() == list(range(1, 1001))


def test_text_keys_of_unequal_size_keep_all_rows(spark, monkeypatch):
    df = spark.createDataFrame([("big", f"v{i:05d}", 1) for i in range(3000)] + [("small", "b", 1), ("small", "a", 1)], "k string, v string, one int")
    out = running.running_totals(df, ["k"], "v", ["one"], buckets=4, small_rows=0)
    got = {(r["k"], r["v"]): r["cum_one"] for r in out.collect()}
    assert len(got) == 3002 and got["small", "b"] == 2 and all(got["big", f"v{i:05d}"] == i + 1 for i in range(3000))
    # a sample that comes out empty
    monkeypatch.setattr(running, "_text_edges", lambda values, keys, order, buckets: _edges(values, keys, order, 0))
    assert running.running_totals(df, ["k"], "v", ["one"], buckets=4, small_rows=0).agg(F.max("cum_one")).first()[0] == 3000


_edges = running._text_edges


def test_dictionary_large_path_equals_small(spark, monkeypatch):
    df = spark.createDataFrame([(f"x{i % 300}", None if i % 5 == 0 else f"y{i % 7}") for i in range(2000)], "a string, b string")
    small = {(r["column"], r["value"]): r["code"] for r in encoding.dictionary([df], ["a", "b"]).collect()}
    monkeypatch.setattr(encoding, "SMALL_DICTIONARY", 0)
    monkeypatch.setattr(running, "SMALL_ROWS", 0)
    monkeypatch.setattr(running.running_totals, "__defaults__", (8, 0, False))
    large = {(r["column"], r["value"]): r["code"] for r in encoding.dictionary([df], ["a", "b"]).collect()}
    assert small == large and ("b", "nan") in small


@pytest.mark.parametrize("probs", [[0.5], [0.01, 0.99], [0.0, 0.25, 1.0]])
def test_exact_quantiles_with_a_hot_key_and_value(spark, probs):
    rng = np.random.default_rng(3)
    hot = pd.DataFrame({"k": "hot", "x": np.where(rng.random(30000) < 0.33, 5.0, rng.normal(size=30000))})
    small = pd.DataFrame({"k": np.repeat([f"g{i}" for i in range(40)], range(1, 41)), "x": rng.normal(size=820)})
    pdf = pd.concat([hot, small])
    out = running.exact_quantiles(spark.createDataFrame(pdf), ["k"], "x", probs, accuracy=100).toPandas()
    for (k, p), q in out.set_index(["k", "p"])["quantile"].items():
        assert q == pytest.approx(np.quantile(pdf[pdf["k"] == k]["x"], p), abs=1e-12), (k, p)
    assert len(out) == 41 * len(probs)


def test_exact_quantiles_without_keys(spark):
    xs = np.random.default_rng(4).normal(size=999)
    df = spark.createDataFrame(pd.DataFrame({"x": xs}))
    out = running.exact_quantiles(df, [], "x", [0.5, 0.9], accuracy=50).toPandas().set_index("p")["quantile"]
    assert out[0.5] == pytest.approx(np.median(xs)) and out[0.9] == pytest.approx(np.quantile(xs, 0.9))


def test_group_medians_big_group_path(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": rng.integers(0, 5, 500), "a": rng.normal(size=500), "b": rng.normal(size=500)})
    df = spark.createDataFrame(pdf)
    want = pdf.groupby("k")[["a", "b"]].median()
    for limit in (0, 10**6):
        got = running.group_medians(df, ["k"], ["a", "b"], group_rows=limit).toPandas().set_index("k").sort_index()
        assert np.allclose(got[["a", "b"]], want) and got["n"].sum() == 500


def _copies(spark):
    """A table in which one row makes up a third of all rows."""
    rows = [("hot", 1)] * 400 + [("g" + str(i % 3), i) for i in range(800)]
    return spark.createDataFrame(rows, "g string, v int").repartition(6)


@pytest.mark.parametrize("digits", [(4, 32, 36, 64), (1, 2, 32, 33, 64)])
def test_hash_quota_counts_and_copies(spark, monkeypatch, digits):
    monkeypatch.setattr(sampling, "KEY_DIGITS", digits)
    df = _copies(spark)
    quota = spark.createDataFrame([("hot", 150, 9), ("g0", 0, 8), ("g1", 10**6, 7), ("g2", 100, 6)], "g string, quota long, tag int")
    out = sampling.hash_quota(df, ["g"], quota).toPandas()
    assert len(out) == 1200
    picked = out[out["picked"]].groupby("g").size().to_dict()
    sizes = out.groupby("g").size().to_dict()
    assert picked == {"hot": 150, "g1": sizes["g1"], "g2": 100}
    assert out[out["g"] == "g2"]["tag"].unique().tolist() == [6]
    assert out["v"].value_counts().to_dict() == df.toPandas()["v"].value_counts().to_dict()


def test_hash_quota_takes_the_first_in_hash_order(spark):
    df = _copies(spark)
    quota = df.groupBy("g").agg(F.floor(F.count("*") * 0.4).alias("quota"))
    got = sampling.hash_quota(df, ["g"], quota).where("picked").select("g", "v").toPandas()
    rows = df.withColumn("h", row_md5(df)).toPandas().sort_values("h")
    want = pd.concat([p.head(int(len(p) * 0.4)) for _, p in rows.groupby("g")])[["g", "v"]]
    key = ["g", "v"]
    pd.testing.assert_frame_equal(got.sort_values(key).reset_index(drop=True), want.sort_values(key).reset_index(drop=True))


def test_hash_quota_never_exchanges_unlike_rows_of_one_hash(spark):
    df = spark.createDataFrame([("a", i * 1e-9, i) for i in range(200)], "g string, x double, i int")
    quota = spark.createDataFrame([("a", 50)], "g string, quota int")
    for order in (None, F.md5(F.lit("same").cast("binary"))):
        out = sampling.hash_quota(df, ["g"], quota, order).toPandas()
        assert out["picked"].sum() == 50 and sorted(out["i"]) == list(range(200)) and out["x"].nunique() == 200


def test_hash_quota_with_null_group_and_no_group(spark):
    df = spark.createDataFrame([(None, i) for i in range(10)] + [("a", i) for i in range(10)], "g string, v int")
    quota = spark.createDataFrame([(None, 4), ("a", 3)], "g string, quota int")
    out = sampling.hash_quota(df, ["g"], quota)
    assert out.where("picked").groupBy("g").count().orderBy("g").collect() == [(None, 4), ("a", 3)]
    whole = sampling.hash_quota(df, [], spark.createDataFrame([(7,)], "quota int"))
    assert whole.where("picked").count() == 7
    assert sampling.hash_quota(df.limit(0), ["g"], quota).count() == 0


def test_replicate_small_and_blocked_counts(spark, monkeypatch):
    monkeypatch.setattr(sampling, "REPLICATE_BLOCK", 10)
    df = spark.createDataFrame([("a", 0), ("b", 3), ("c", 10), ("d", 47)], "k string, n long")
    out = sampling.replicate(df, "n", number="i").toPandas()
    assert out.groupby("k").size().to_dict() == {"b": 3, "c": 10, "d": 47}
    assert sorted(out[out["k"] == "d"]["i"]) == list(range(1, 48))


def test_bootstrap_draws_exact_counts_of_known_rows(spark):
    df = _copies(spark)
    targets = spark.createDataFrame([("hot", 500), ("g0", 20)], "g string, n_target long")
    out = sampling.bootstrap(df, targets, ["g"]).toPandas()
    assert out.groupby("g").size().to_dict() == {"hot": 500, "g0": 20}
    known = set(map(tuple, df.toPandas().to_numpy().tolist()))
    assert set(map(tuple, out.to_numpy().tolist())) <= known
    again = sampling.bootstrap(df.repartition(2), targets, ["g"])
    other = sampling.bootstrap(df.repartition(7), targets, ["g"])
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, other.collect())) == sorted(map(tuple, out.to_numpy().tolist()))


def test_places_are_numbers_without_gaps(spark, monkeypatch):
    monkeypatch.setattr(sampling, "BUCKET_ROWS", 5)  # two digits of the hash
    df = _copies(spark).withColumn("h", F.when(F.col("g") != "g2", F.col("g")))
    out = sampling.placed(df, ["h"]).groupBy("_g").agg(F.sort_array(F.collect_list("_place")).alias("p")).collect()
    assert all(list(r["p"]) == list(range(len(r["p"]))) for r in out) and sum(len(r["p"]) for r in out) == df.count()


def test_bootstrap_is_uniform_over_rows(spark):
    df = spark.createDataFrame([(i,) for i in range(50)], "v int")
    one = spark.createDataFrame([(20000,)], "n_target long")
    counts = sampling.bootstrap(df, one, []).groupBy("v").count().toPandas()["count"]
    assert len(counts) == 50 and counts.sum() == 20000 and 300 < counts.min() and counts.max() < 500


@pytest.mark.parametrize("n", [100, 1200, 3000])
def test_stratified_bootstrap_size(spark, n):
    assert sampling.stratified_bootstrap(_copies(spark), n, ["g"]).count() == n


def test_conditional_and_noisy_rows(spark):
    df = _copies(spark)
    assert sampling.conditional_rows(df, "g", "g1", 30).select("g").distinct().collect() == [("g1",)]
    noisy = sampling.gaussian_noise(df.withColumn("x", F.lit(0.0)), ["x"], 0.1).agg(F.stddev("x")).first()[0]
    assert 0.08 < noisy < 0.12
    again = [sampling.gaussian_noise(df.withColumn("x", F.lit(1.0)).repartition(n), ["x"], 0.1, 7).orderBy("x").collect() for n in (2, 7)]
    assert again[0] == again[1] and len({r["x"] for r in again[0]}) == df.count()  # copies differ
    made = sampling.mock_rows(spark, 1000, ["c"], ["x"])
    assert made.count() == 1000 and made.select("c").distinct().count() == 5
    assert made.agg(F.avg("x"), F.stddev("x")).first()[0] == pytest.approx(50, abs=1.5)


@pytest.mark.parametrize("buckets", [3, 64])
def test_marginals_follow_their_columns(spark, buckets):
    rng = np.random.default_rng(3)
    rows = [(float(x) if i % 9 else None, "hot" if i % 3 == 0 else f"v{i % 40}", None) for i, x in enumerate(rng.normal(size=3000).round(2))]
    rows += [(0.5, "hot", None)] * 1500  # one value holds a third
    df = spark.createDataFrame(rows, "x double, c string, nothing string")
    made = [sampling.marginal_rows(df.repartition(n), 4000, ["c", "nothing"], ["x"], buckets=buckets) for n in (2, 5)]
    a, b = (m.toPandas() for m in made)
    assert len(a) == 4000 and sorted(map(str, a.to_numpy().tolist())) == sorted(map(str, b.to_numpy().tolist()))
    assert a["nothing"].isna().all() and a["x"].notna().all()
    real = np.sort([r[0] for r in rows if r[0] is not None])
    gap = np.abs(np.searchsorted(np.sort(a["x"]), real, "right") / 4000 - np.searchsorted(real, real, "right") / len(real)).max()
    assert gap < 1.95 / np.sqrt(4000)  # Kolmogorov bound at one in a thousand
    share = sum(r[1] == "hot" for r in rows) / len(rows)
    assert abs((a["c"] == "hot").mean() - share) < 0.03


def test_nearest_distances_against_brute_force(spark, monkeypatch):
    for name, value in {"BUCKET_ROWS": 20, "BLOCK_ROWS": 16, "PART_ROWS": 5, "CHUNK_ROWS": 8, "PAIRS_AT_ONCE": 64, "WINDOWS": (1, 2, 4), "WINDOW": 3}.items():
        monkeypatch.setattr(distance, name, value)
    rng = np.random.default_rng(7)
    real = np.vstack([rng.normal(size=(300, 3)), rng.integers(0, 3, (300, 3)), np.zeros((200, 3))]).astype(float)
    synth = np.vstack([rng.normal(size=(200, 3)) * 2, real[:50], np.zeros((150, 3)), [[50.0, 50.0, 50.0]]]).astype(float)

    def frame(m):
        return spark.createDataFrame([(r.tolist(),) for r in m], "point array<double>")

    got = distance.nearest_distances(frame(real), frame(synth)).toPandas()
    assert got["n"].sum() == len(synth) and len(got) == len(np.unique(synth, axis=0))
    found = {tuple(p): d for p, d in zip(got["point"], got["distance"])}
    want = np.sqrt(((synth[:, None, :] - real[None, :, :]) ** 2).sum(-1)).min(1)
    for p, d in zip(synth, want):
        assert found[tuple(p)] == pytest.approx(d, abs=1e-12)


def test_matching_rows_is_a_null_safe_semi_join(spark):
    real = spark.createDataFrame([("a", None), ("b", 1)], "x string, y int")
    synth = spark.createDataFrame([("a", None), ("a", None), ("b", 2)], "x string, y int")
    assert distance.matching_rows(real, synth, ["x", "y"]).collect() == [("a", None, 2)]
    assert tuple(distance.exact_matches(real, synth, ["x", "y"]).first()) == (3, 2, 1)


def test_rebalance_reaches_the_real_shares(spark):
    real = spark.createDataFrame([("m",)] * 500 + [("f",)] * 500, "sex string").withColumn("income", F.lit("<=50K"))
    synth = spark.createDataFrame([("m", i % 3) for i in range(700)] + [("f", i % 2) for i in range(300)], "sex string, z int")
    synth = synth.select("sex", F.when(F.col("z") == 0, ">50K").otherwise("<=50K").alias("income"))
    out = mitigation.rebalance(real, synth, ["sex"]).groupBy("sex").count().collect()
    assert {r["sex"]: r["count"] for r in out} == {"m": 500, "f": 500}
    within = mitigation.enforce_parity(real, real, ["sex"])
    assert within.count() == 1000


def test_flipping_reaches_the_wanted_rate(spark):
    rows = [("m", "y")] * 80 + [("m", "n")] * 20 + [("f", "y")] * 20 + [("f", "n")] * 80
    df = spark.createDataFrame(rows, "g string, t string")
    out = mitigation.reduce_disparate_impact(df, ["g"], "t", "y")
    good = {r["g"]: r["c"] for r in out.groupBy("g").agg(F.count(F.when(F.col("t") == "y", 1)).alias("c")).collect()}
    assert good == {"m": 80, "f": 72} and out.count() == 200


def test_fingerprint_ignores_order_and_sees_every_change(spark):
    df = _copies(spark)
    base = fingerprint(df).first()
    assert base == fingerprint(df.orderBy(F.rand(1)).repartition(3)).first()
    assert base["n_rows"] == 1200
    assert fingerprint(df.withColumn("v", F.when(F.col("v") == 17, 18).otherwise(F.col("v")))).first()["data_hash"] != base["data_hash"]
    assert fingerprint(df.union(df.limit(1))).first()["data_hash"] != base["data_hash"]
    assert fingerprint(df, leaf_digits=4).first()["n_distinct_rows"] == base["n_distinct_rows"]
    assert [leaf_digits_for(n) for n in (0, 65536, 65537, 10**8)] == [2, 2, 4, 6]


def test_codes_for_unseen_labels_and_back(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "s string")
    codes = encoding.dictionary([df], ["s"])
    new = spark.createDataFrame([("b",), ("zzz",)], "s string")
    assert sorted(r["s"] for r in encoding.encode(new, codes, ["s"], unseen=0).collect()) == [0.0, 1.0]
    near = spark.createDataFrame([(-3.0,), (0.5,), (1.5,), (9.0,)], "s double")
    assert sorted(r["s"] for r in encoding.decode(near, codes, ["s"]).collect()) == ["a", "a", "c", "c"]


def test_restored_types_and_fills(spark):
    real = spark.createDataFrame([(1, 2.0)], "i int, x double")
    made = spark.createDataFrame([("7", "oops"), ("x", "1.5")], "i string, x string")
    out = encoding.restore_types(made, real)
    assert dict(out.dtypes) == {"i": "int", "x": "double"} and sorted(out.collect(), key=str) == [(7, None), (None, 1.5)]
    assert encoding.fill_missing(out, {"i": 0, "x": None}).where("i = 0").count() == 1


def test_full_outer_alignment_of_counted_frames(spark):
    a = spark.createDataFrame([("x", 2)], "v string, n long")
    b = spark.createDataFrame([("y", 3)], "v string, n long")
    assert sorted(map(tuple, distributions.full_outer_counts(a, b, ["v"]).collect())) == [("x", 2, 0), ("y", 0, 3)]


def test_forest_draw_takes_its_share_of_a_popular_vector(spark):
    """A vector in a third of the rows is neither left out nor taken whole."""
    for hot in range(4):
        rows = spark.range(9000).select(
            F.when(F.col("id") % 3 == 0, F.array(F.lit(float(hot)), F.lit(-1.0))).otherwise(F.array(F.col("id").cast("double"), F.lit(1.0))).alias("x"),
            (F.col("id") % 2).cast("double").alias("label"),
        )
        vectors = rows.select(array_to_vector("x").alias("features"), "label")
        drawn = models.fit_sample(vectors, 900).select("features", "label").collect()
        popular = [r for r in drawn if r["features"][1] == -1]
        assert len(popular) in (299, 300, 301, 302) and abs(len(drawn) - 900) < 120
        assert {sum(r["label"] == v for r in popular) for v in (0.0, 1.0)} <= {149, 150, 151}
    again = models.fit_sample(vectors.repartition(7), 900).select("features", "label").collect()
    assert sorted(map(str, again)) == sorted(map(str, drawn))


def test_forest_scores_batches_like_the_model(spark):
    """Rows judged a batch at a time get the model's own numbers, bit for bit, null labels and all."""
    x = F.array(F.pmod(F.col("id") * 7919, F.lit(1009)).cast("double"), F.pmod(F.col("id") * 31, F.lit(97)) / 7, F.lit(0.0))
    label = F.pmod(F.floor(F.pmod(F.col("id") * 7919, F.lit(1009)) / 300) + F.col("id") % 2, F.lit(3)).cast("double")
    rows = spark.range(3000).select(array_to_vector(x).alias("features"), label.alias("label"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("id"))
    rows = settle(rows, "rows")
    for regression in (False, True):
        model = models.fit(models.forest(trees=7, depth=6, regression=regression), rows)
        own = [] if regression else [vector_to_array("probability")[1].alias("chance")]
        want = model.transform(rows).select("id", "label", "prediction", *own)
        got = models.scored(model, rows, ["id", "label"], None if regression else "chance")
        assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString() and got.dtypes == want.dtypes
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.where(F.lit(False)).count() == 0


def test_missing_numbers_before_models(spark):
    df = spark.createDataFrame([(1.0, "a", 7), (None, "b", 8), (float("nan"), "a", 9), (3.0, "a", 1), (8.0, "b", 2)], "x double, c string, dropped int")
    for fill, value in (("median", 3.0), ("zero", 0.0)):
        made, _ = models.feature_frames(df, df, ["x"], ["c"], fill=fill)
        assert made.columns == ["features"] and sorted(r["features"][0] for r in made.collect()) == sorted([1.0, value, value, 3.0, 8.0])
    with pytest.raises(ValueError):
        models.feature_frames(df, df, ["x"], [], fill="mean")


def test_altered_panels_stay_where_their_request_is(spark):
    """Between the altered panels and their verdicts no row is exchanged: only the counts are."""
    schema = "verification_id long, verifier_id long, privacy double, utility double, fairness double, arrival long"
    rows = [(i % 40, i // 40, 70.0 + i % 9, 65.0, 80.0 - i % 7, i) for i in range(200)]
    grid = consensus.collusion(spark.createDataFrame(rows, schema), panels=(3,))
    above = grid._jdf.queryExecution().executedPlan().toString().split("Generate explode")[0]
    assert above.count("Exchange") == 1
    assert {(r["f"], r["verifications"]) for r in grid.collect()} == {(f, 40) for f in range(4)}


def test_few_quotas_are_met_without_exchanging_rows(spark, monkeypatch):
    plans = []

    def kept(df, label):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return settle(df, label)

    monkeypatch.setattr(sampling, "settle", kept)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        df = spark.createDataFrame([(i, i % 2) for i in range(4000)], "x long, g int")
        quota = df.groupBy("g").agg(F.floor(F.count("*") / 2).alias("quota"))
        assert sampling.hash_quota(df, ["g"], quota).where("picked").count() == 2000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    edges = [plan for label, plan in plans if label == "quota-edge"]
    assert edges and all("BroadcastHashJoin" in p and "SortMergeJoin" not in p for p in edges)


def test_near_cells_alone_are_compared(monkeypatch):
    rng = np.random.default_rng(3)
    real, synth = rng.normal(size=(6000, 3)), rng.normal(size=(5000, 3))
    pairs, nearest = [], distance._nearest

    def counted(asked, others):
        pairs.append(len(asked) * len(others))
        return nearest(asked, others)

    monkeypatch.setattr(distance, "_nearest", counted)
    got = distance._closest(synth, np.full(len(synth), np.inf), real)
    assert sum(pairs) < 0.35 * len(real) * len(synth)
    assert (got == nearest(synth, real)).all()


def test_tasks_of_many_small_groups_follow_the_rows(spark, monkeypatch):
    rows = [(i % 400, i % 3 + 10 * (i % 2), float(i % 11 * 9), 50.0, float(i % 7 * 10), i) for i in range(2400)]
    rows += [(None, 1, 5.0, 5.0, 5.0, 1), (7, 2, None, 5.0, 5.0, 9999)]
    df = spark.createDataFrame(rows, "verification_id int, verifier_id int, privacy double, utility double, fairness double, arrival int")
    monkeypatch.setattr(running, "GROUP_ROWS", 0)
    found = {f: sorted(map(str, f(df).collect())) for f in (consensus.agreement_rate, consensus.contract_consensus)}
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    assert session.deal_count(df, ["verification_id"]) == 25
    for f, want in found.items():
        got = f(df)
        assert sorted(map(str, got.collect())) == want
        assert got.rdd.getNumPartitions() >= 25  # the session has 4 shuffle partitions
    # one key of many tasks' rows is left to folds on the map side
    hot = df.withColumn("verification_id", F.when(F.col("arrival") % 4 > 0, 1).otherwise(F.col("verification_id")))
    assert session.deal_count(hot, ["verification_id"]) is None
    assert consensus.agreement_rate(hot).count() == hot.where("verification_id is not null").select("verification_id").distinct().count()


def test_flat_histories_follow_the_rows(spark, monkeypatch, tmp_path):
    spark.range(300).selectExpr("id as o_orderkey", "timestamp'2024-01-05' as o_orderdate").write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(900).selectExpr("id % 310 as l_orderkey", "cast(id % 7 as int) as l_linenumber").write.parquet(str(tmp_path / "lineitem.parquet"))
    want = sorted(map(str, QUERIES["history_flatten"](spark, str(tmp_path)).collect()))
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    got = QUERIES["history_flatten"](spark, str(tmp_path))
    assert sorted(map(str, got.collect())) == want and len(want) > 1100
    assert got.rdd.getNumPartitions() >= 12
