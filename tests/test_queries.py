"""Every query with a SQL twin gives the same rows as that SQL."""

import glob
import os

import duckdb
import pytest

from tools.check import plain
from twinproof.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, data, con, name):
    got = QUERIES[name](spark, data).toPandas()
    want = con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got).equals(plain(want))


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
