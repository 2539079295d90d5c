"""Every registered query of the base library against its SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import foliant.plans  # noqa: F401  registers all queries
from foliant.plans.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DIR).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(DIR).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if x != x else round(x, 5)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return round(float(x), 5) if type(x).__name__ == "Decimal" else x


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, db, name):
    got, want = QUERIES[name](spark, DIR), db.sql(SQL[name])
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    """Queries that SQL does not express run as a whole; their results are held in test_functions and test_operators."""
    got = QUERIES[name](spark, DIR)
    assert all(len(r) == len(got.columns) for r in got.collect())
