"""Every core query with an oracle against DuckDB, on the smallest tables."""

import duckdb
import pytest

from passant.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_duckdb(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    columns = sorted(got.columns)
    ours = sorted(tuple(map(str, (r[c] for c in columns))) for r in got.collect())
    result = duck.execute(catalog.oracle_sql()[name])
    theirs_columns = [c[0] for c in result.description]
    assert sorted(theirs_columns) == columns
    theirs = sorted(tuple(map(str, (r[theirs_columns.index(c)] for c in columns))) for r in result.fetchall())
    assert ours == theirs
