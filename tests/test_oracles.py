"""Every registered query against its SQL in DuckDB."""

import duckdb
import pytest

from __spark_entry__ import entry
from catalog.queries import QUERIES
from catalog.sql import SQL

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    ours = QUERIES[name](spark, SF).toPandas()
    theirs = con.execute(SQL[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    assert len(ours) > 0

    def lines(frame):
        plain = frame[columns].astype(object)
        return sorted("|".join(map(repr, row)) for row in plain.where(plain.notna(), None).to_numpy())

    assert lines(ours) == lines(theirs)


def test_entry(spark):
    found = entry(spark)
    assert found.columns == ["market", "phase", "metric", "k", "value"]
    assert found.count() == 30
