"""Every query of the catalogue against DuckDB on a small table set."""

import os

import duckdb
import pytest

import __spark_entry__
from lexistore.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(frame):
    """Rows by column name; pandas makes doubles of integer columns that hold nulls."""
    frame = frame[sorted(frame.columns)].astype(object)
    value = lambda x: float(x) if hasattr(x, "__float__") and not isinstance(x, bool) else x
    return sorted(repr([value(x) for x in row]) for row in frame.where(frame.notna(), None).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query(spark, name):
    got = catalogue.queries()[name](spark, SF).toPandas()
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    con = duckdb.connect()
    for t in [*TABLES, "pages"]:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    wanted = con.sql(sql).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert plain(got) == plain(wanted)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["user_id", "value"]
    assert set(catalogue.queries()) <= set(__spark_entry__.queries())
