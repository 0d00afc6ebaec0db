"""Every registered query against its SQL in DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from tracklake.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def rows_of(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted((tuple(None if pd.isna(v) else float(v) if isinstance(v, float) else v for v in r) for r in df.itertuples(index=False)), key=lambda r: tuple((v is not None, v) for v in r))


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n in catalog.ORACLE_SQL])
def test_query(spark, db, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    want = db.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in catalog.ORACLE_SQL])
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).limit(5).count() >= 0
