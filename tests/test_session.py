"""Durable intermediate tables."""

import os

import pytest

from twinproof import session


def test_settled_tables_are_known_by_size_and_can_be_released(spark):
    df = session.settle(spark.range(1000).withColumnRenamed("id", "x"), "probe")
    big = spark.range(10**7).withColumnRenamed("id", "x")
    plan = big.join(df, "x")._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 1000 and "BroadcastHashJoin" in plan
    folder = session.shared_dir(spark)
    before = [d for d in os.listdir(folder) if d.startswith("probe-")]
    assert before
    assert session.release(spark) >= 1
    assert not [d for d in os.listdir(folder) if d.startswith("probe-")]


def test_shared_dir_follows_the_setting(spark):
    assert session.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_build_together_keeps_order_and_raises(spark):
    frames = session.build_together(spark, [lambda i=i: spark.range(i) for i in range(1, 5)])
    assert [f.count() for f in frames] == [1, 2, 3, 4]
    with pytest.raises(ZeroDivisionError):
        session.build_together(spark, [lambda: 1 / 0, lambda: spark.range(1)])
