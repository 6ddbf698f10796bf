"""Every query runs; those with SQL agree with DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from foliospark.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(x: object) -> object:
    return round(x, 6) if isinstance(x, float) and not math.isnan(x) else x


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name in catalogue.ORACLES:
        got = duck.execute(catalogue.ORACLES[name])
        names = [d[0] for d in got.description]
        assert sorted(names) == cols
        assert rows == sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in got.fetchall()), key=repr)
    else:
        assert rows


def test_entry_imports_without_a_session():
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
