"""One local session for all tests, and DuckDB views over the smallest tables."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from sylvameter.session import local_session

    session = local_session(4, "4g", spark__sql__shuffle__partitions="4")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    from sylvameter.sources.tables import TABLES

    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


@pytest.fixture(scope="session")
def data():
    return DATA


def plain(value):
    """Values as both engines can give them."""
    if isinstance(value, float):
        return None if value != value else round(value, 9) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


@pytest.fixture(scope="session")
def same_rows(duck):
    """Whether a DataFrame has the columns and rows of a SQL text."""

    def compare(df, sql: str) -> None:
        columns = sorted(df.columns)
        got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
        relation = duck.sql(sql)
        assert sorted(relation.columns) == columns
        places = [relation.columns.index(c) for c in columns]
        wanted = sorted((tuple(plain(r[i]) for i in places) for r in relation.fetchall()), key=repr)
        assert got == wanted

    return compare
