"""Stored profiles give what a scan of the whole table gives."""

import pytest
from pyspark.sql import functions as F

from twinproof import profiles
from twinproof.roles import infer_roles


@pytest.fixture(scope="module")
def table(spark):
    return spark.range(6000).select(
        F.col("id"),
        (F.col("id") % 19).alias("below"),
        (F.col("id") % 21).alias("above"),
        (F.col("id") % 51).cast("string").alias("label"),
        F.when(F.col("id") % 4 > 0, F.sin(F.col("id").cast("double"))).otherwise(F.lit(float("nan"))).alias("x"),
        (F.col("id") % 9).alias("age_band"),
        F.lit(None).cast("double").alias("empty"),
    )


def test_roles_from_parts_that_came_one_by_one(spark, table, tmp_path):
    path = str(tmp_path / "profile")
    for part in (0, 1, 1, 2):
        profiles.add(table.where(F.col("id") % 3 == part), path, str(part))
    stored, direct = profiles.roles(spark, path, table), infer_roles(table)
    assert stored.but(distinct={}) == direct.but(distinct={})
    assert (stored.distinct["below"], stored.distinct["above"]) == (19, 21)  # counted exactly: a threshold is near
    rows = {r["column"]: r for r in profiles.merged(spark, path).collect()}
    assert rows["id"]["n_rows"] == 6000 and rows["x"]["n_null"] == 1500 and rows["empty"]["n_null"] == 6000
    assert rows["id"]["n_distinct"] == pytest.approx(6000, rel=0.03) and (rows["id"]["low"], rows["id"]["high"]) == (0, 5999)
    assert [q / 6000 for q in rows["id"]["quantiles"]] == pytest.approx([0.25, 0.5, 0.75], abs=0.02)
    assert rows["label"]["quantiles"] is None and rows["label"]["is_text"] and rows["empty"]["quantiles"] is None
    assert [rows[c]["position"] for c in table.columns] == list(range(7))


def test_quasi_identifiers_are_all_or_as_many_as_asked(table):
    assert infer_roles(table).quasi_identifiers == ("below", "above", "label", "age_band", "empty")
    assert infer_roles(table, most_quasi=2).quasi_identifiers == ("below", "above")
    assert infer_roles(table.select("id", F.col("x").alias("y"))).quasi_identifiers == ("id", "y")
