"""Fixed steps of the reports, at and beside every bound, and what fails closed."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from quantloom.operators import backtest, composition, evaluation, joins, learning, reports
from quantloom.sources import panels

D = [datetime.date(2024, 1, 1) + datetime.timedelta(days=i) for i in range(60)]


def values(spark, make, rows, n=1):
    schema = ", ".join(f"x{i} double" for i in range(n))
    table = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)
    return [r[0] for r in table.select(make(*[F.col(f"x{i}") for i in range(n)])).collect()]


def test_parts_of_the_score(spark):
    assert values(spark, reports.momentum_part, [(None, None), (1.0, 1.0), (0.5, 0.5), (0.0, 0.0), (-0.5, -0.5), (-0.51, -0.51), (None, 0.99), (2.0, float("nan"))], 2) == [12.5, 25, 20, 15, 10, 5, 20, 25]
    assert values(spark, reports.volatility_part, [None, -1.0, -0.99, -0.5, 0.5, 1.0, 1.01]) == [7.5, 15, 12, 12, 8, 5, 2]
    assert values(spark, reports.valuation_part, [(None,) * 3, (0.5, 0.5, 0.5), (0.0, None, None), (-0.5, -0.5, -0.5), (-0.6, None, -0.6)], 3) == [5, 10, 7, 5, 3]


def test_labels_at_their_bounds(spark):
    assert values(spark, reports.rating_label, [None, 80.0, 79.9, 65.0, 45.0, 30.0, 29.9]) == ["N/A", "偏积极", "中性偏积极", "中性偏积极", "中性", "中性偏谨慎", "偏谨慎"]
    assert values(spark, reports.trend_label, [80.0, 65.0, 45.0, 30.0, 0.0]) == ["趋势参考偏强", "趋势参考略偏强", "趋势参考中性", "趋势参考略偏弱", "趋势参考偏弱"]
    assert values(spark, reports.percentile_label, [0.8, 0.6, 0.4, 0.2, 0.1, None]) == ["样本前 20%", "样本前 40%", "样本中位附近", "样本后 40%", "样本后 20%", "N/A"]
    assert values(spark, reports.volatility_label, [-0.5, -0.49, 0.49, 0.5]) == ["低波动", "中等波动", "中等波动", "高波动"]
    assert values(spark, reports.momentum_label, [(0.5, None), (0.0, 0.0), (-0.5, -0.5), (-0.6, None), (None, None)], 2) == ["动量较强", "动量偏强", "动量偏弱", "动量较弱", "N/A"]
    assert values(spark, reports.return_label, [0.2, 0.05, 0.0, -0.05, -0.2, None]) == ["历史阶段涨幅较高", "历史阶段表现偏强", "历史阶段表现中性", "历史阶段表现偏弱", "历史阶段跌幅较大", "N/A"]
    assert values(spark, reports.recent_volatility_label, [0.05, 0.1, 0.11]) == ["历史波动较低", "历史波动中等", "历史波动较高"]
    assert values(spark, reports.exposure_label, [0.5, 0.0, -0.49, -0.5]) == ["显著高于样本均值", "略高于样本均值", "略低于样本均值", "显著低于样本均值"]
    assert values(spark, reports.ic_label, [(0.05, 0.6), (-0.05, 0.6), (0.05, 0.59), (0.03, 0.5), (0.03, 0.49), (None, 0.5)], 2) == ["历史 IC 表现较强", "历史 IC 表现较强", "历史 IC 表现中等", "历史 IC 表现中等", "历史 IC 表现较弱", "N/A"]


def test_recent_returns_skip_what_is_missing(spark):
    rows = [("A", D[i], 10.0 + i, None if i == 6 else 0.1 * i) for i in range(8)] + [("B", D[0], 1.0, 0.5)]
    got = {r["ts_code"]: r for r in reports.recent_returns(spark.createDataFrame(rows, "ts_code string, trade_date date, close double, ret double")).collect()}
    a = got["A"]
    assert (a["latest_date"], a["latest_close"], a["available_months"]) == (D[7], 17.0, 7)
    assert a["recent_3m_return"] == pytest.approx(1.7 * 1.5 * 1.4 - 1)
    assert a["recent_6m_return"] == pytest.approx(1.7 * 1.5 * 1.4 * 1.3 * 1.2 * 1.1 - 1)
    assert got["B"]["recent_3m_return"] is None and got["B"]["available_months"] == 1


def test_simple_backtest(spark):
    rows = [(D[0], "A", 0.1), (D[0], "B", None), (D[1], "A", -0.5), (D[1], "C", 0.1)]
    selected = spark.createDataFrame(rows, "trade_date date, ts_code string, forward_return double")
    assert sorted((r["ts_code"], r["weight"]) for r in backtest.simple_holdings(selected).collect()) == [("A", 0.5), ("A", 1.0), ("C", 0.5)]
    m = backtest.simple_backtest(selected, 0.0).first()
    assert m["cumulative_return"] == pytest.approx(1.1 * 0.8 - 1) and m["max_drawdown"] == pytest.approx(-0.2)
    assert m["sharpe_ratio"] == pytest.approx(m["annual_return"] / m["annual_volatility"]) and m["average_turnover"] == 0.75


def test_composite_of_missing_factors(spark):
    rows = spark.createDataFrame([(D[0], "A", 1.0, None), (D[0], "B", None, None), (D[0], "C", 0.0, 4.0)], "trade_date date, ts_code string, a double, b double")
    got = {r["ts_code"]: (r["score"], r["rank"]) for r in composition.composite_score(rows, ["a", "b"]).collect()}
    assert got == {"A": (0.5, 2), "B": (None, None), "C": (2.0, 1)}


def test_constant_section_has_no_groups(spark):
    long = spark.createDataFrame([(D[0], f"c{i}", "f", 1.0) for i in range(9)], "trade_date date, ts_code string, factor_name string, value double")
    labels = spark.createDataFrame([(D[0], f"c{i}", float(i)) for i in range(9)], "trade_date date, ts_code string, forward_return double")
    got = evaluation.quantile_returns(evaluation.paired(long, labels)).collect()
    assert len(got) == 5 and all(r["group_count"] == 0 and r["group_return"] is None and r["n_obs"] == 9 for r in got)


@pytest.mark.parametrize("lag", [1, 2, 3])
def test_folds_have_the_dates_that_are_asked_for(spark, lag):
    dates = spark.createDataFrame([(D[i], D[i + lag]) for i in range(40)], "trade_date date, max_exit date")
    plan = learning.walk_forward_plan(dates, 10, 3, 2, 5).collect()
    first = 10 + 3 + 2 + 2 * lag  # labels take `lag` dates to be known, before validation and before prediction
    for k in {r["fold_id"] for r in plan}:
        role = lambda name, k=k: sorted(D.index(r["trade_date"]) for r in plan if r["fold_id"] == k and r["role"] == name)
        start = first + 5 * k
        held_out = start - lag - 2
        assert role("prediction") == list(range(start, min(start + 5, 40)))
        assert role("validation") == list(range(held_out - 3, held_out))
        assert role("train") == list(range(held_out - 3 - lag - 10, held_out - 3 - lag))
    assert min(r["trade_date"] for r in plan if r["role"] == "prediction") == D[first]


def test_conflicting_evidence_fails(spark):
    codes = spark.createDataFrame([("A", D[1], D[5])], "ts_code string, list_date date, delist_date date")
    dates = spark.createDataFrame([(d,) for d in D[:8]], "trade_date date")
    pause = lambda *days: spark.createDataFrame([(D[i], "A", "S", None) for i in days], "trade_date date, ts_code string, suspend_type string, suspend_timing string")
    traded = lambda *days: spark.createDataFrame([(D[i], "A", 0.1) for i in days], "trade_date date, ts_code string, ret double")
    got = {D.index(r["trade_date"]): r["status"] for r in joins.security_status(dates, codes, pause(2), traded(3, 5)).collect()}
    assert got == {0: "PRE_LISTING", 1: "UNKNOWN_MISSING", 2: "SUSPENDED", 3: "AVAILABLE", 4: "UNKNOWN_MISSING", 5: "DELIST_DATE", 6: "POST_DELIST", 7: "POST_DELIST"}
    for days, returns in (((2,), (2,)), ((0,), (3,)), ((2,), (6,))):
        with pytest.raises(Exception, match="return on a suspended day|data outside the listing"):
            joins.security_status(dates, codes, pause(*days), traded(*returns)).collect()
    status = spark.createDataFrame([(D[1], "A", "SUSPENDED"), (D[2], "A", "AVAILABLE"), (D[3], "A", "UNKNOWN_MISSING")], "trade_date date, ts_code string, status string")
    assert [r["ret"] for r in backtest.resolve_return(status, traded(2), robust=True).orderBy("trade_date").collect()] == [0.0, 0.1, 0.0]
    for returns, robust in ((traded(2), False), (traded(1, 2), True), (traded(2, 3), True), (traded(2).withColumn("ret", F.lit(float("inf"))), True)):
        with pytest.raises(Exception, match="return"):
            backtest.resolve_return(status, returns, robust).collect()


def test_partitions_are_merged(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    rows = lambda *x: spark.createDataFrame(list(x), "ts_code string, trade_date date, vol double")
    panels.write_partitioned(rows(("A", D[0], 1.0), ("A", D[3], None), ("A", D[40], 3.0)), path)
    panels.write_partitioned(rows(("B", D[0], 5.0), ("A", D[3], 2.0), ("A", D[0], 1.0)), path, fillable=("vol",))
    want = [("A", D[0], 1.0), ("A", D[3], 2.0), ("A", D[40], 3.0), ("B", D[0], 5.0)]
    read = lambda: sorted(tuple(r) for r in spark.read.parquet(path).select("ts_code", "trade_date", "vol").collect())
    assert read() == want
    for wrong in (rows(("A", D[0], 9.0)), rows(("C", D[0], 1.0), ("C", D[0], 1.0))):
        with pytest.raises(ValueError):
            panels.write_partitioned(wrong, path)
    assert read() == want


def test_industries_of_every_portfolio(spark):
    held = [(D[0], "A", "x", 0.5), (D[0], "B", None, 0.25), (D[0], "C", None, 0.25), (D[1], "A", "x", 0.75), (D[1], "B", "x", 0.25)]
    got = reports.industry_distribution(spark.createDataFrame(held, "trade_date date, ts_code string, industry string, target_weight double"))
    assert sorted(map(tuple, got.select("trade_date", "industry", "count", "weight").collect())) == [(D[0], "x", 1, 0.5), (D[0], reports.UNKNOWN_INDUSTRY, 2, 0.5), (D[1], "x", 2, 1.0)]


def test_the_query_of_industries_has_every_date(spark):
    from quantloom import catalog

    sf = "/root/testdata/sf0.001"
    dates = lambda name: {r[0] for r in catalog.queries()[name](spark, sf).select("trade_date").distinct().collect()}
    assert dates("industry_distribution") == dates("weight_distribution")


def test_published_inputs_are_computed_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    path = panels.publish_inputs({"a": spark.range(50).mapInArrow(count, "id long")}, f"file://{tmp_path}")
    assert seen.value == 50
    assert path.endswith(panels.identity({"a": spark.read.parquet(f"{path}/a")}))
