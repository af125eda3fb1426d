import os

import duckdb
import pytest

import __spark_entry__ as entry
from weir import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(v):
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_against_sql(spark, oracle, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cursor = oracle.execute(queries.SQL[name])
    found = [d[0] for d in cursor.description]
    assert sorted(found) == columns
    at = [found.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[k]) for k in at) for r in cursor.fetchall())


def test_queries_without_sql(spark):
    for name in set(queries.QUERIES) - set(queries.SQL):
        assert queries.QUERIES[name](spark, SF).count() >= 1


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 200 and df.columns == ["object_id", "kind", "error_kind", "hit_count", "verdict"]
    assert set(queries.QUERIES) <= set(entry.queries()) and set(queries.SQL) <= set(entry.oracle_sql())


def test_scans_read_only_what_they_need(spark):
    plan = queries.QUERIES["url_extension"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "html" not in plan.split("ReadSchema")[-1]
