"""Every query with SQL gives what DuckDB gives on the same small tables."""

import os

import duckdb
import pytest

from quern.plans.queries import QUERIES, SQL

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def rows(all_):
    return sorted(all_, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    if name not in SQL:
        assert got
        return
    result = duck.execute(SQL[name])
    at = [d[0] for d in result.description]
    assert sorted(at) == columns
    assert rows(got) == rows(tuple(r[at.index(c)] for c in columns) for r in result.fetchall())
