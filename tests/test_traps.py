"""Semantic traps: nulls, ties, constants and frames that aren't full."""

from __future__ import annotations

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.functions.math import average_rank, correlation, steps
from quantloom.operators import composition, cross_section, factors, joins, quality, risk, signals


def day(n: int) -> datetime.date:
    return datetime.date(2020, 1, 1) + datetime.timedelta(days=n)


def test_rank_of_ties_is_averaged_and_null_has_none(spark):
    rows = spark.createDataFrame([(1, 5.0), (1, 5.0), (1, 7.0), (1, None)], "g int, x double")
    from pyspark.sql import Window

    got = [r[0] for r in rows.select(average_rank(F.col("x"), Window.partitionBy("g")).alias("r")).collect()]
    assert sorted(x for x in got if x is not None) == [1.5, 1.5, 3.0]
    assert got.count(None) == 1


def test_correlation_of_a_constant_is_null(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, None)], "x double, y double")
    assert rows.agg(correlation(F.col("x"), F.col("y"))).first()[0] is None


def test_steps_name_what_is_missing(spark):
    rows = spark.createDataFrame([(None,), (float("nan"),), (0.5,), (0.0,), (-1.0,)], "x double")
    assert [r[0] for r in rows.select(steps(F.col("x"), [(">", 0.0, "up"), (">=", 0.0, "flat")], "down", "none")).collect()] == ["none", "none", "up", "flat", "down"]


def test_rolling_factor_needs_a_full_frame(spark):
    rows = spark.createDataFrame([("A", day(i), 10.0 + i, None if i == 3 else 1.0) for i in range(30)], "ts_code string, trade_date date, close double, turnover_rate double")
    got = {r[1]: r[2] for r in factors.factor_panel(rows, ["turnover_mean_20d"]).collect()}
    assert got[day(18)] is None and got[day(22)] is None and got[day(23)] == 1.0


def test_zero_deviation_does_not_clip_and_small_sections_are_null(spark):
    rows = spark.createDataFrame([(day(0), f"c{i}", "f", 1.0 if i < 6 else 99.0) for i in range(8)] + [(day(1), "c0", "f", 1.0)], "trade_date date, ts_code string, factor_name string, value double")
    assert cross_section.winsorize(rows).where("value = 99").count() == 2
    assert cross_section.standardize(rows).where("trade_date = '2020-01-02' AND value IS NOT NULL").count() == 0


def test_asof_takes_the_latest_of_one_effective_row(spark):
    panel = spark.createDataFrame([("A", day(i)) for i in (0, 5, 10)], "ts_code string, trade_date date")
    records = spark.createDataFrame([("A", day(1), day(-30), 1.0), ("A", day(4), day(-60), 2.0), ("B", day(1), day(0), 9.0)], "ts_code string, ann_date date, end_date date, value double")
    got = {r[0]: r[4] for r in joins.asof_financials(panel, records, ["value"], lag=0).collect()}
    assert got == {day(0): None, day(5): 2.0, day(10): 2.0}


def test_bad_dates_are_null(spark):
    rows = spark.createDataFrame([("20200131",), ("2020-01-31",), ("20201331",), ("x",), (None,)], "d string")
    assert [r[0] for r in rows.select(quality.canonical_date(F.col("d"))).collect()] == [day(30), day(30), None, None, None]


def test_least_variance_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(40):
        n = int(rng.integers(2, 12))
        x = rng.normal(size=(n + 5, n))
        c, cap = np.cov(x, rowvar=False), float(rng.uniform(1.2 / n, 1.0))
        w = signals.min_variance_weights(c, cap)
        assert abs(w.sum() - 1) < 1e-9 and w.min() >= 0 and w.max() <= cap + 1e-9
        best = w @ c @ w
        for _ in range(300):  # no feasible step is better
            i, j = rng.integers(0, n, 2)
            t = min(w[i], cap - w[j]) * rng.uniform()
            v = w.copy()
            v[i] -= t
            v[j] += t
            assert v @ c @ v >= best - 1e-9


def test_least_variance_of_a_thousand_assets():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 1000)) * rng.uniform(0.5, 2, 1000) + rng.normal(size=(60, 1))
    root = (x - x.mean(0)) / 59**0.5
    for cap in (1.0, 0.05, 0.001):
        w = signals.least_variance(root, cap)
        assert abs(w.sum() - 1) < 1e-9 and w.min() >= 0 and w.max() <= cap + 1e-9
        gradient = root.T @ (root @ w)
        free = (w > 1e-12) & (w < cap - 1e-12)
        level = gradient[free].mean() if free.any() else gradient[w > 1e-12].max()
        assert np.allclose(gradient[free], level, atol=1e-9)
        assert (gradient[w <= 1e-12] >= level - 1e-9).all() and (gradient[w >= cap - 1e-12] <= level + 1e-9).all()


def test_least_variance_by_date_takes_complete_cases(spark):
    x = np.random.default_rng(5).normal(size=(9, 4))
    rows = [(day(d), f"c{j}", day(-i), None if (d, i, j) == (1, 3, 2) else float(x[i, j])) for d in (0, 1, 2) for i in range(9) for j in range(4) if d < 2 or i < 3]
    got = signals.weight_min_variance(spark.createDataFrame(rows, "trade_date date, ts_code string, return_date date, ret double"), 0.6, 5).collect()
    found = {d: np.array([r["target_weight"] for r in sorted(got, key=lambda r: r["ts_code"]) if r["trade_date"] == d]) for d in (day(0), day(1), day(2))}
    assert np.allclose(found[day(0)], signals.min_variance_weights(np.cov(x, rowvar=False), 0.6), atol=1e-8)
    assert np.allclose(found[day(1)], signals.min_variance_weights(np.cov(np.delete(x, 3, 0), rowvar=False), 0.6), atol=1e-8)
    assert len(found[day(2)]) == 0  # three dates are too few
    few = spark.createDataFrame([r for r in rows if r[1] == "c0"], "trade_date date, ts_code string, return_date date, ret double")
    assert signals.weight_min_variance(few, 0.6, 5).count() == 0  # one asset at most 0.6


def test_moments_do_not_depend_on_blocks(spark):
    x = np.random.default_rng(3).normal(size=(9, 12))
    rows = spark.createDataFrame([(day(0), f"c{i}", day(j), float(x[i, j])) for i in range(9) for j in range(12)], "trade_date date, ts_code string, return_date date, ret double")
    centred = x - x.mean(axis=1, keepdims=True)
    for block in (2, 4, 512):
        got = {(r["i"], r["j"]): (r["s"], r["q"], r["n"]) for r in risk._moments(rows, block).collect()}
        assert len(got) == 81 == risk._moments(rows, block).count()
        for i in range(9):
            for j in range(9):
                want = (centred[i] @ centred[j] / 12, centred[i] ** 2 @ centred[j] ** 2 / 12, 12.0)
                assert np.allclose(got[f"c{i}", f"c{j}"], want)


def test_absent_fields_are_named(spark):
    with pytest.raises(ValueError, match="absent"):
        quality.require_fields(spark.range(1), ["id", "absent"])


def test_weights_know_only_earlier_dates(spark):
    dates = spark.createDataFrame([(day(i),) for i in range(5)], "trade_date date")
    ic = spark.createDataFrame([(day(i), f, v) for i, (a, b) in enumerate([(0.3, -0.1), (0.1, 0.2), (None, 0.4), (0.5, 0.0)]) for f, v in (("a", a), ("b", b))], "trade_date date, factor_name string, rank_ic double")
    got = {(r["trade_date"], r["factor_name"]): r for r in composition.rolling_ic_weights(dates, ic, ["a", "b"], lookback=2, least=2).collect()}
    assert [got[day(i), "a"]["fallback"] for i in range(5)] == [True, True, False, False, False]
    # day 3: a has days 0 and 1, b has days 1 and 2; day 4: a has days 1 and 3, b days 2 and 3
    wanted = [0.5, 0.5, 0.2 / 0.25, 0.2 / 0.5, 0.3 / 0.5]
    assert np.allclose([got[day(i), "a"]["weight"] for i in range(5)], wanted)
