"""Every panel query with SQL gives what DuckDB gives, over the smallest tables."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import pytest

from quantloom import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (int, float, decimal.Decimal)):
        x = float(x)
        return None if math.isnan(x) else round(x, 5)
    if isinstance(x, datetime.datetime) and x.time() == datetime.time():
        return str(x.date())
    return str(x)


def test_import_needs_no_session():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, duck, name):
    frame = catalog.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in frame.collect())
    rows = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in rows.description]
    assert sorted(names) == columns
    want = sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in rows.fetchall())
    assert len(got) == len(want)
    # a value may fall to either side of its last place
    assert sum(a != b for a, b in zip(got, want, strict=True)) <= len(got) // 1000
