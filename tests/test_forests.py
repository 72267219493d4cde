"""Forests learn from every row, and from the same rows however large the table."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from twinproof.operators import forests, models


def vectors(spark, n, labels=2):
    x = F.array((F.pmod(F.col("id") * 7919, F.lit(1009)) / 7).cast("double"), F.pmod(F.col("id") * 31, F.lit(5)).cast("double"), F.pmod(F.col("id"), F.lit(97)).cast("double"))
    label = F.pmod(F.floor(F.pmod(F.col("id") * 7919, F.lit(1009)) / 300) + F.col("id") % 5, F.lit(labels)).cast("double")
    return spark.range(n).select(array_to_vector(x).alias("features"), label.alias("label"), "id")


def same(a, b):
    return len(a.trees) == len(b.trees) and all(p.shape == q.shape and np.allclose(p, q) for s, t in zip(a.trees, b.trees) for p, q in zip(s, t))


def test_no_row_is_left_out_of_a_fit(spark, monkeypatch):
    """More rows than any bound a fit had: all of them are coded, copies with their number."""
    kept, settle = [], forests.settle
    monkeypatch.setattr(forests, "settle", lambda df, label: kept.append((label, settle(df, label))) or kept[-1][1])
    monkeypatch.setattr(models, "TREES", 2)
    rows = vectors(spark, 260_000).withColumns({"is_real": F.col("label"), "is_train": F.col("id") % 20 > 0})
    assert models._attack(rows, 2).count() == 13_000
    (coded,) = [df for label, df in kept if label == "coded"]
    assert coded.agg(F.sum("n")).first()[0] == 247_000
    assert not hasattr(models, "FIT_ROWS")


def test_rounds_grow_the_trees_of_one_task(spark, monkeypatch):
    """Small pieces, small blocks and one round a level give the same forest as a task that holds all rows."""
    for labels, regression in ((2, False), (3, False), (5, True)):
        rows = vectors(spark, 4000, labels)
        whole = forests.grow(rows, "label", 6, 5, 64, 42, regression)
        with monkeypatch.context() as m:
            m.setattr(forests, "LOCAL_ROWS", 0)
            m.setattr(forests, "PIECE_ROWS", 300)
            m.setattr(forests, "CELLS", 700)
            blocks = forests.grow(rows.repartition(5), "label", 6, 5, 64, 42, regression)
        assert same(whole, blocks) and max(len(t[0]) for t in whole.trees) > 20
        assert not same(whole, forests.grow(rows, "label", 6, 5, 64, 43, regression))


def test_forest_finds_what_decides(spark):
    rows = vectors(spark, 6000, 3)
    found = models.scored(models.grown(rows, trees=15), rows, ["label"])
    assert found.where(F.col("label") != F.col("prediction")).count() < 120
    numbers = models.scored(models.grown(rows.withColumn("label", F.col("label") * 1e6 + 7e8), trees=15, regression=True), rows, ["label"])
    assert numbers.agg(F.avg(F.abs(F.col("prediction") - F.col("label") * 1e6 - 7e8))).first()[0] < 4e5


def test_a_cut_is_the_best_of_all(spark):
    rng = np.random.default_rng(5)
    codes, label = rng.integers(0, 9, 400), rng.integers(0, 3, 400)
    counters = np.zeros((1, 1, 9, 3))
    np.add.at(counters[0, 0], (codes, label), 1)

    def gini(y):
        return len(y) - sum((y == k).sum() ** 2 for k in range(3)) / max(len(y), 1)

    place, code, low, high = forests.best(counters, False)
    assert place[0] == 0 and code[0] == min(range(8), key=lambda c: gini(label[codes <= c]) + gini(label[codes > c]))
    assert (low[0] == np.bincount(label[codes <= code[0]], minlength=3)).all() and low[0].sum() + high[0].sum() == 400
    assert forests.best(np.array([[[[3.0, 0.0], [4.0, 0.0]]]]), False)[0][0] == -1


def test_draws_are_those_of_a_bootstrap():
    draws = forests.Draws()
    h = np.random.default_rng(1).integers(0, 2**63, 40_000).astype(np.uint64)
    for n in (1, 7, 5000):
        got = draws(h, np.full(len(h), n), 42, 3)
        assert abs(got.mean() - n) < 5 * (n / len(h)) ** 0.5 and 0.95 < got.var() / n < 1.05
        assert (got == draws(h, np.full(len(h), n), 42, 3)).all() and (got != draws(h, np.full(len(h), n), 42, 4)).any()


def test_edges_come_from_all_values(spark):
    """A feature of few values is cut between all of them, one of many into parts of equally many rows."""
    x = F.when(F.col("id") == 7, 5.0).otherwise((F.col("id") % 2).cast("double"))
    rows = spark.range(20_000).select(array_to_vector(F.array(x, F.col("id").cast("double"), F.lit(3.0))).alias("features"))
    few, many, one = forests.bin_edges(rows, 3, 64)
    assert few.tolist() == [0.5, 3.0] and len(one) == 0
    assert len(many) == 63 and abs(np.diff(many) - 20_000 / 64).max() <= 1
    with pytest.raises(ValueError):
        forests.grow(rows.withColumn("label", F.lit(None).cast("double")), "label", 2, 2, 64, 1)
    with pytest.raises(ValueError):
        forests.grow(rows.withColumn("label", F.lit(1.0)).where("false"), "label", 2, 2, 64, 1)
