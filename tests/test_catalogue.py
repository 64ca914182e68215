"""Each query against its DuckDB counterpart, on the smallest data."""

from pathlib import Path

import duckdb
import pytest

from keelvault.plans.catalogue import QUERIES
from keelvault.plans.oracles import SQL

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test data")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for file in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def test_every_query_has_a_counterpart():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(map(str, (tuple(r) for r in df.select(*columns).collect())))
    want = sorted(map(str, oracle.execute(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall()))
    assert got == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
