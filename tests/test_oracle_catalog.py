"""Every SQL-backed catalog query equals its DuckDB oracle on sf0.001."""

import duckdb
import pytest

import __spark_entry__ as E
from gatewatch.sources.tables import TABLES
from scripts.oracle_check import digest
from tests.conftest import SF_SMALL

SQLS = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(SQLS))
def test_matches_oracle(spark, con, name):
    sp = E.queries()[name](spark, SF_SMALL).toPandas()
    dk = con.execute(SQLS[name]).df()
    assert sorted(sp.columns) == sorted(dk.columns)
    assert len(sp) == len(dk)
    assert digest(sp) == digest(dk)


def test_every_query_registered_has_builder():
    qs = E.queries()
    assert set(SQLS) <= set(qs)
    assert len(qs) >= 90


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 9
    assert {"detector", "precision", "recall", "f1", "accuracy"} <= set(df.columns)
