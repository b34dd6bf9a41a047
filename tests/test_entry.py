"""Every query on sequences against its SQL twin, on the smallest tables."""

import duckdb
import pytest

from strandwise import queries as Q

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DIR}/{name}.parquet'")
    return con


def rows(frame):
    return sorted(tuple(map(repr, r)) for r in frame[sorted(frame.columns)].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_twin(spark, duck, name):
    ours, theirs = Q.QUERIES[name](spark, DIR).toPandas(), duck.execute(Q.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_entry_points_import():
    import __spark_entry__ as entry

    assert set(Q.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
