"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from folioloom.queries import catalogue

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    found = duckdb.connect()
    for t in TABLES:
        found.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return found


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", [n for n, query in catalogue().items() if query.sql])
def test_matches_sql(spark, duck, name):
    query = catalogue()[name]
    got = query.run(spark, FOLDER)
    want = duck.sql(query.sql)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    plain = lambda rows: sorted(repr([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rows)
    place = [want.columns.index(c) for c in columns]
    assert plain(tuple(r) for r in got.select(columns).collect()) == plain([r[i] for i in place] for r in want.fetchall())
