"""Every query against its SQL in DuckDB, on the smallest tables."""

import decimal
import math

import duckdb
import pytest

from loomspec.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "NULL"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, int | float | decimal.Decimal):
        return repr(float(x))
    return str(x)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(name, spark, duck, small):
    df = catalogue.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in catalogue.ORACLE_SQL:
        assert got
        return
    wanted = duck.sql(catalogue.ORACLE_SQL[name])
    assert columns == sorted(wanted.columns)
    at = [wanted.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in wanted.fetchall())


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["c_acctbal", "c_name", "o_custkey", "o_orderkey"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
