"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry  # conftest puts the root on the path
from inkveil.plans.registry import TABLES

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def as_rows(frame, columns):
    frame = frame[columns].astype(object)
    return sorted(map(repr, frame.where(frame.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, tables, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = as_rows(df.toPandas(), columns)
    if name in ORACLES:
        want = tables.execute(ORACLES[name]).df()
        assert sorted(want.columns) == columns
        assert got == as_rows(want, columns)
    else:
        assert got


def test_entry(spark):
    rows = {r.pii_type: r.replaced for r in entry.entry(spark).collect()}
    assert rows == {"email": 5, "phone": 6, "financial": 7}
