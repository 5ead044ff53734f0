"""The driver contract and the DuckDB oracle on the smallest scale factor."""
import os

import duckdb
import pytest

import __spark_entry__ as E
from check_oracle import TABLES, digest
from tests.conftest import SF_SMALL


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["block_id", "event_sequence", "sequence_length", "label"]


def test_oracle_keys_are_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SF_SMALL, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    # as the driver does: every statement must hold as a view
    duck.execute(f"CREATE OR REPLACE VIEW o AS {E.oracle_sql()[name]}")
    rel = duck.sql("SELECT * FROM o")
    drows = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    assert len(rows) == len(drows)
    assert digest(df.columns, rows)[0] == digest(rel.columns, drows)[0]
