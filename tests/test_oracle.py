"""Every query with SQL gives the rows that DuckDB gives, values and column names alike."""

import math

import duckdb
import pytest

from keyloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events embeddings".split()
SF = "/root/testdata/sf0.001"


def norm(v):
    return None if isinstance(v, float) and math.isnan(v) else v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, name, function, sql, sf=SF, tables=TABLES):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = con.execute(sql)
    names = [x[0] for x in want.description]
    got = function(spark, sf)
    assert sorted(names) == sorted(got.columns)
    a, b = rows_of(got.columns, [tuple(r) for r in got.collect()]), rows_of(names, want.fetchall())
    assert len(a) == len(b), (name, len(a), len(b))
    for x, y in zip(a, b, strict=True):
        assert x == y, (name, x, y)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, name):
    compare(spark, name, catalog.QUERIES[name], catalog.SQL[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 150
