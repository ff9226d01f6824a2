"""Queries of monthly sums give the SQL's rows to the last bit, however the rows are dealt to files and tasks."""

from __future__ import annotations

import shutil

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quantloom import catalog
from quantloom.queries import sources
from quantloom.sources import panels
from quantloom.views import Views, with_views

SF = "/root/testdata/sf0.001"
QUERIES = ["base_factors", "canonical_upsert", "batch_qcut", "compose_dynamic", "compose_score", "composite_score", "evaluate_panel", "exposure_table", "feature_coverage", "fill_by_industry", "fill_median", "ic_by_date", "ic_stats"]


@pytest.fixture(scope="module")
def dealt(tmp_path_factory):
    """The tables with their line items in five files; discounts and quantities whose means fall on the queries' bounds."""
    root, rng = tmp_path_factory.mktemp("dealt"), np.random.default_rng(7)
    for name in ("region", "nation", "supplier"):
        shutil.copy(f"{SF}/{name}.parquet", root)
    rows = pq.read_table(f"{SF}/lineitem.parquet")
    centre = np.where(rows["l_suppkey"].to_numpy() % 2, 2, 4)
    discount = np.round((centre + rng.integers(-1, 2, len(rows))) / 100, 2)
    quantity = rng.choice([16.0, 32.0, 48.0], len(rows))
    for name, values in (("l_discount", discount), ("l_quantity", quantity)):
        rows = rows.set_column(rows.column_names.index(name), name, pa.array(values))
    (root / "lineitem.parquet").mkdir()
    for i in range(5):
        a, b = len(rows) * i // 5, len(rows) * (i + 1) // 5
        pq.write_table(rows.slice(a, b - a), root / "lineitem.parquet" / f"part-{i}.parquet")
    return str(root)


@pytest.fixture(scope="module")
def duck(dealt):
    import duckdb

    con = duckdb.connect(config={"threads": 1})
    for name in ("region", "nation", "supplier", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{dealt}/{name}.parquet{'/*' if name == 'lineitem' else ''}')")
    return con


def rows_of(con, sql, columns):
    picked = ", ".join(columns)
    return sorted(map(repr, con.execute(f"SELECT {picked} FROM ({sql}) q").fetchall()))


def test_monthly_sums_are_those_of_the_rows_in_order(spark, dealt, duck):
    columns = ["ts_code", "trade_date", "close", "amount", "vol", "turnover_rate", "industry", "total_mv"]
    got = sorted(repr(tuple(r)) for r in Views(spark, dealt).v_month.select(*columns).collect())
    assert got == rows_of(duck, with_views("SELECT * FROM v_month"), columns)


def test_monthly_sums_leave_nulls_out(spark, tmp_path):
    for name in ("nation", "supplier"):
        shutil.copy(f"{SF}/{name}.parquet", tmp_path)
    some = "SELECT 1L AS l_suppkey, TIMESTAMP '1997-01-05' AS l_shipdate, CAST(p AS DOUBLE) AS l_extendedprice, CAST(q AS DOUBLE) AS l_quantity, CAST(d AS DOUBLE) AS l_discount FROM VALUES (NULL, 2, 0.01), (6, 1, NULL), (3, NULL, 0.03) t(p, q, d)"
    none = "SELECT 2L, TIMESTAMP '1997-01-05', CAST(5 AS DOUBLE), CAST(2 AS DOUBLE), CAST(NULL AS DOUBLE)"
    spark.sql(f"{some} UNION ALL {none}").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r["ts_code"]: (r["close"], r["amount"], r["vol"], r["turnover_rate"]) for r in Views(spark, str(tmp_path)).v_month.collect()}
    assert got == {"S00001": (3.0, 9.0, 3.0, 2.0), "S00002": (2.5, 5.0, 2.0, None)}


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, dealt, duck, name):
    frame = catalog.queries()[name](spark, dealt)
    got = sorted(repr(tuple(r)) for r in frame.collect())
    assert got == rows_of(duck, catalog.oracle_sql()[name], frame.columns)


def test_each_published_set_is_computed(spark, dealt, monkeypatch):
    calls, tables = [], sources._tables

    def count(v):
        calls.append(tables(v))
        return calls[-1]

    monkeypatch.setattr(sources, "_tables", count)
    got = {r["name"]: r["is_first"] for r in catalog.queries()["publish_research_inputs"](spark, dealt).collect()}
    assert got == {"first": True, "again": True, "changed": False}
    assert len(calls) == 3
    assert calls[0]["factors"].columns == ["trade_date", "ts_code", "factor_a", "factor_b"]


def test_a_published_id_does_not_depend_on_tasks(spark, dealt):
    def published():
        return panels.identity(sources._tables(Views(spark, dealt)))

    first = published()
    spark.conf.set("spark.sql.files.openCostInBytes", "1")  # files share a task
    try:
        assert published() == first
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
