"""Registered queries against their SQL counterparts."""

import math

import duckdb
import pytest

import __spark_entry__
from quorumstat.plans.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels".split()


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    return round(float(v), 4) + 0.0 if not math.isnan(float(v)) else "nan"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sql, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = sql.execute(ORACLE_SQL[name])
    at = {d[0]: i for i, d in enumerate(cur.description)}
    assert sorted(at) == cols
    assert got == sorted((tuple(plain(r[at[c]]) for c in cols) for r in cur.fetchall()), key=repr)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_argument_errors_are_reported_together(spark):
    from quorumstat.plans.catalog import aggregate_query, change_query

    with pytest.raises(ValueError, match="unknown stat.*three"):
        aggregate_query(spark, SF, stat="mode", by=("a", "b", "c", "d"))
    with pytest.raises(ValueError):
        change_query(spark, SF, waves=("Y2", "Y1"))
