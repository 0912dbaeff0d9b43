"""Every registered query against the same result in SQL."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import __spark_entry__ as entry  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def canonical(rows, columns: list[str]) -> list[str]:
    """Rows as text with their columns by name; NaN counts as null."""
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr(tuple(None if row[k] != row[k] else row[k] for k in order)) for row in rows)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    got = df.collect()
    assert len(df.columns) > 0
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
        return
    kinds = {row[0]: row[1] for row in duck.execute(f"DESCRIBE {sql}").fetchall()}
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema.fields} == kinds
    assert canonical(got, df.columns) == canonical(duck.execute(sql).fetchall(), list(kinds))


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    base = {k for k in entry.queries() if not k.startswith("op") and k != "pipeline"}
    assert base <= set(entry.oracle_sql())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["frame_id", "y", "x", "r", "g", "b"]
    assert df.count() > 0
