"""Every registered query against its SQL, on the smallest driver tables."""

import importlib.util
import math
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no driver tables")

spec = importlib.util.spec_from_file_location("entry", Path(__file__).resolve().parent.parent / "__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)


@pytest.fixture(scope="module")
def engine():
    connection = duckdb.connect()
    for file in FOLDER.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


TEXT_QUERIES = set(entry._text_queries()[0])  # they have tests of their own


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6f}"
    return f"{value:.6f}" if isinstance(value, int) and not isinstance(value, bool) else repr(value)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(entry.queries()) - TEXT_QUERIES <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - TEXT_QUERIES))
def test_query(spark, engine, name):
    result = entry.queries()[name](spark, str(FOLDER))
    columns = sorted(result.columns)
    rows = sorted(tuple(normal(r[c]) for c in columns) for r in result.collect())
    cursor = engine.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    expected = sorted(tuple(normal(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert rows == expected
