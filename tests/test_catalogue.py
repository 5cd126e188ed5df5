"""Every registered query against its SQL, on the small tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from echotide.plans import catalogue

DIR = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    held = duckdb.connect()
    for file in DIR.glob("*.parquet"):
        held.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return held


def cell(v):
    if v is None or v != v:
        return ""
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    try:
        return f"{float(v):.4f}".replace("-0.0000", "0.0000")
    except (TypeError, ValueError):
        return str(v)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_equals_sql(spark, db, name):
    got = catalogue.QUERIES[name](spark, str(DIR))
    want = db.sql(catalogue.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted(tuple(cell(r[c]) for c in columns) for r in got.collect())
    place = [want.columns.index(c) for c in columns]
    assert rows == sorted(tuple(cell(r[k]) for k in place) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() >= 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
