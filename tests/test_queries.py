"""Every query of the document operators gives the rows of its SQL, and the entry module works."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from quire import queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return db


def rows(frame: pd.DataFrame) -> list[str]:
    columns = sorted(frame.columns)
    frame = frame[columns].astype(object)
    return sorted(map(repr, frame.where(frame.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, sql, name):
    got, expected = queries.QUERIES[name](spark, DATA).toPandas(), sql.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert len(got) and rows(got) == rows(expected)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
