"""Every query with SQL gives the rows that DuckDB gives for it; the others give some."""

import os
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from scriptorium.plans import ORACLE_SQL, QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tables():
    out = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        out.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return out


def shown(value):
    if value is None or value is pd.NA or value is pd.NaT or isinstance(value, float) and value != value:
        return "null"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return f"{float(value):.9g}"
    return str(value)


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(shown, row)) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    found = QUERIES[name](spark, FOLDER).toPandas()
    assert len(found)
    if name in ORACLE_SQL:
        wanted = tables.sql(ORACLE_SQL[name]).df()
        assert sorted(found.columns) == sorted(wanted.columns)
        assert rows_of(found) == rows_of(wanted)
