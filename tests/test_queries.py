"""Every query of the library against its SQL, over the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from clausework.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df, columns):
    return sorted(tuple("" if pd.isna(v) else str(v).removesuffix(".0") for v in r) for r in df[columns].itertuples(index=False))


def test_every_query_has_sql():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
    assert registry.FLAGSHIP in registry.QUERIES


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, db, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), db.execute(registry.ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert rows(got, columns) == rows(want, columns)
