"""What must fail does: accounting, calendars, identifiers, requirements; and comparisons that join no more than they need."""

from __future__ import annotations

import datetime
import math

import pytest
from pyspark.sql import functions as F

from quantloom import catalog
from quantloom.operators import backtest, calendars, coverage, quality, signals, universes


def day(n: int) -> datetime.date:
    return datetime.date(2020, 1, 1) + datetime.timedelta(days=n)


def days(spark, n):
    return spark.createDataFrame([(day(i), i + 1) for i in range(n)], "cal_date date, pos int")


TARGETS = "effective_date date, ts_code string, target_weight double"
RETURNS = "trade_date date, ts_code string, ret double"


def test_net_value_compounds_cost_and_cash_keeps_its_value(spark):
    targets = spark.createDataFrame([(day(0), "A", 0.6), (day(0), "B", 0.2), (day(2), "A", 0.5)], TARGETS)
    returns = spark.createDataFrame([(day(1), "A", 0.1), (day(1), "B", 0.0), (day(2), "A", -0.05), (day(2), "B", 0.2), (day(3), "A", 0.02)], RETURNS)
    drift = backtest.drifted(targets, returns, days(spark, 4))
    nav = {r["trade_date"]: r for r in backtest.daily_nav(drift, backtest.rebalance_ledger(targets, drift), 0.01).collect()}
    # by stepping through the days
    weights, cash, gross_nav, net_nav = {}, 1.0, 1.0, 1.0
    moves, goals = {1: {"A": 0.1, "B": 0.0}, 2: {"A": -0.05, "B": 0.2}, 3: {"A": 0.02}}, {0: {"A": 0.6, "B": 0.2}, 2: {"A": 0.5}}
    for d in range(4):
        gross = sum(w * moves[d][c] for c, w in weights.items())
        weights, cash = {c: w * (1 + moves[d][c]) / (1 + gross) for c, w in weights.items()}, cash / (1 + gross)
        cost = 0.0
        if d in goals:
            cost = 0.01 * sum(abs(goals[d].get(c, 0) - weights.get(c, 0)) for c in {*goals[d], *weights})
            weights, cash = dict(goals[d]), 1 - sum(goals[d].values())
        gross_nav, net_nav = gross_nav * (1 + gross), net_nav * (1 + gross) * (1 - cost)
        r = nav[day(d)]
        assert (r["gross_return"], r["cost"], r["net_return"]) == (pytest.approx(gross), pytest.approx(cost), pytest.approx((1 + gross) * (1 - cost) - 1))
        assert (r["gross_nav"], r["net_nav"]) == (pytest.approx(gross_nav), pytest.approx(net_nav))


def test_a_held_code_without_a_return_fails(spark):
    targets = spark.createDataFrame([(day(0), "A", 0.6), (day(0), "B", 0.0)], TARGETS)
    there = spark.createDataFrame([(day(1), "A", 0.1)], RETURNS)
    assert backtest.drifted(targets, there, days(spark, 2)).count() == 2  # B isn't held
    for returns in ([(day(1), "B", 0.1)], [(day(1), "A", -1.5)]):
        with pytest.raises(Exception, match="held code"):
            backtest.drifted(targets, spark.createDataFrame(returns, RETURNS), days(spark, 2)).collect()
    drift = backtest.drifted(targets, there, days(spark, 2))
    with pytest.raises(Exception, match="out of range"):
        backtest.daily_nav(drift, backtest.rebalance_ledger(targets, drift), 2.0).collect()


def test_calendars_that_prove_nothing_fail(spark):
    def calendar(rows):
        return spark.createDataFrame(rows, "cal_date date, is_open int")

    assert calendars.proven(calendar([(day(0), 1), (day(1), 0), (day(2), 1)])).count() == 3
    for rows, told in (([(day(0), 1), (day(2), 1)], "missing day"), ([(day(0), 1), (day(0), 1)], "repeated day"), ([(day(0), 2)], "neither 0 nor 1")):
        with pytest.raises(Exception, match=told):
            calendars.proven(calendar(rows)).collect()
    units = spark.createDataFrame([(str(day(0)), "COMPLETE"), (str(day(1)), "FAILED")], "unit string, status string")
    rows = calendar([(day(0), 1), (day(1), 1)])
    assert calendars.open_dates_from_coverage(rows, units, day(0), day(0)).count() == 1
    with pytest.raises(Exception, match="not complete"):
        calendars.open_dates_from_coverage(rows, units, day(0), day(1)).collect()


def test_history_that_is_too_short_fails(spark):
    some = spark.createDataFrame([(day(5),)], "formation_date date")
    assert calendars.history_window(some, days(spark, 10), "DAYS", 6).first()["first_date"] == day(0)
    for call in (lambda: calendars.history_window(some, days(spark, 10), "DAYS", 7), lambda: calendars.history_window(some, days(spark, 10), "MONTHS", 2), lambda: calendars.open_window(some, days(spark, 10), 7), lambda: calendars.history_window(spark.createDataFrame([(day(40),)], "formation_date date"), days(spark, 10), "DAY")):
        with pytest.raises(Exception, match="not enough calendar history"):
            call().collect()
    with pytest.raises(Exception, match="no open day"):
        calendars.shift_open(some.withColumnRenamed("formation_date", "cal_date"), days(spark, 10), 5).collect()
    assert calendars.history_window(some, days(spark, 10), "DAYS", 7, fail=False).first()["first_date"] is None


def test_only_overlapping_requirements_are_one(spark):
    shape = "dataset_id string, scope_key string, kind string, start_date date, end_date date, fields array<string>, cutoff date, reasons array<string>"
    rows = [("d", "s", "DAYS", day(0), day(3), ["b", "a"], None, ["x"]), ("d", "s", "DAYS", day(3), day(5), ["a", "b"], None, ["y"]), ("d", "s", "DAYS", day(6), day(7), ["a", "b"], None, ["z"]), ("d", "s", "DAYS", day(1), day(2), ["a"], None, ["x"])]
    got = sorted((r["start_date"], r["end_date"], r["fields"], r["reasons"]) for r in coverage.coalesce_requirements(spark.createDataFrame(rows, shape)).collect())
    assert got == [(day(0), day(5), ["a", "b"], ["x", "y"]), (day(1), day(2), ["a"], ["x"]), (day(6), day(7), ["a", "b"], ["z"])]


REFERENCE = "ts_code string, list_status string, list_date date, delist_date date"


def test_a_reference_code_that_cannot_be_mapped_fails(spark):
    good = [("600000.SH", "L", day(0), None), ("T1", "D", day(-900), day(-400)), ("T2", "D", day(500), day(600))]
    kept = quality.tradable_reference(spark.createDataFrame(good, REFERENCE), day(0), day(100))
    assert [r["ts_code"] for r in kept.collect()] == ["600000.SH"]
    inside, listed, undated, turned = ("T3", "D", day(-9), day(9)), ("T4", "L", day(-900), day(-400)), ("T5", "D", None, day(-400)), ("T6", "D", day(-400), day(-900))
    classed = {r["ts_code"]: r["rule_id"] for r in quality.classify_identifier(spark.createDataFrame([inside, listed, undated, turned, (None, "D", None, None)], REFERENCE), day(0), day(100)).collect()}
    assert classed == {"T3": quality.UNSUPPORTED_RULE, **{c: quality.UNPROVEN_RULE for c in ("T4", "T5", "T6", None)}}
    for bad in (inside, listed):
        with pytest.raises(Exception, match="cannot be mapped"):
            quality.tradable_reference(spark.createDataFrame([*good, bad], REFERENCE), day(0), day(100)).collect()


def test_samples_are_bounded_and_the_smallest(spark):
    rows = [(f"T{i:05d}", "L", None, None) for i in range(3000)] + [(f"{i:06d}.SZ", "L", None, None) for i in range(3000)]
    found = {r["identifier_class"]: r for r in quality.identifier_evidence(quality.classify_identifier(spark.createDataFrame(rows, REFERENCE).repartition(5))).collect()}
    assert (found["INVALID"]["rows"], found["INVALID"]["samples"]) == (3000, ",".join(f"T{i:05d}" for i in range(20)))
    assert (found["CANONICAL_TRADABLE"]["rows"], found["CANONICAL_TRADABLE"]["samples"]) == (3000, "")


def test_equal_tables_join_no_rows(spark):
    rows = [(i, float(i) if i % 5 else math.nan, None if i % 7 else f"t{i}") for i in range(2000)]
    table = spark.createDataFrame(rows, "k long, x double, note string")
    other = spark.createDataFrame([(k, None if x != x else x, n) for k, x, n in reversed(rows)], "k long, x double, note string").repartition(7)

    def compared(a, b):
        return sorted(tuple(r) for r in quality.compare_tables(a, b, ["k"], ["x", "note"]).collect())

    assert compared(table, other) == []
    assert [x.count() for x in quality.differing_ranges(table, other, ["k"], ["x", "note"])] == [0, 0]
    changed = other.withColumn("x", F.when(F.col("k") == 3, F.col("x") + 1e-9).when(F.col("k") == 4, F.col("x") + 1e-7).otherwise(F.col("x"))).withColumn("note", F.when(F.col("k") == 7, "T7").otherwise(F.col("note"))).where("k <> 9")
    assert compared(table, changed) == [(4, "x", "value"), (7, "note", "value"), (9, "*", "left_only")]


def test_unequal_ranges_alone_are_joined(spark):
    table = spark.range(4000).select(F.col("id").alias("k"), F.col("id").cast("double").alias("x"))
    other = table.withColumn("x", F.when(F.col("k") == 5, -1.0).otherwise(F.col("x")))
    assert [tuple(r) for r in quality.compare_tables(table, other, ["k"], ["x"]).collect()] == [(5, "x", "value")]
    pruned = [x.count() for x in quality.differing_ranges(table, other, ["k"], ["x"])]
    assert pruned[0] == pruned[1] and 1 <= pruned[0] <= 20


def test_aliases_of_pools(spark):
    rows = spark.createDataFrame([("hs300",), (" All ",), ("000905.sh",)], "p string")
    assert [tuple(r[0]) for r in rows.select(universes.universe_from_alias(F.col("p"))).collect()] == [("INDEX", "000300.SH"), ("ALL_A_SHARES", None), ("INDEX", "000905.SH")]
    for unknown in ("zz500", None):
        with pytest.raises(Exception, match="unsupported pool"):
            spark.createDataFrame([(unknown,)], "p string").select(universes.universe_from_alias(F.col("p")).alias("u")).select("u.kind").collect()


def test_blank_queries_find_nothing(spark):
    lookup = spark.createDataFrame([("600000.SH", "Bank", "x"), ("000001.SZ", None, None)], "ts_code string, name string, industry string")
    assert quality.search_security(lookup, " 　 ").count() == 0
    assert [r["ts_code"] for r in quality.search_security(lookup, "600000").collect()] == ["600000.SH"]
    assert [r["ts_code"] for r in quality.search_security(lookup, "ban").collect()] == ["600000.SH"]


def test_shrinkage_without_pairs_is_that_of_all_pairs(spark):
    import numpy as np

    from quantloom.operators import risk

    r = np.random.default_rng(4)
    rows, want = [], {}
    for k, (assets, dates) in enumerate(((30, 8), (3, 12), (1, 5))):
        x = r.normal(0, 1, (assets, dates)) + r.normal(0, 2, dates)
        rows += [(day(k), f"A{i:03d}", day(100 + t), float(x[i, t]), dates) for i in range(assets) for t in range(dates)]
        x = x - x.mean(1, keepdims=True)
        s, q = x @ x.T / dates, (x**2) @ (x**2).T / dates
        mean = np.trace(s) / assets
        spread, noise = (s**2).sum() / assets - mean**2, (q - s**2).sum() / dates / assets
        want[day(k)] = (assets, dates, mean, min(noise, spread) / spread if assets > 1 else None)
    frame = spark.createDataFrame(rows, "trade_date date, ts_code string, return_date date, ret double, observations int").repartition(4)
    for f in risk.shrinkage_facts(frame).collect():
        assets, dates, mean, shrinkage = want[f["trade_date"]]
        assert (f["assets"], f["observations"], f["mean"]) == (assets, dates, pytest.approx(mean))
        assert shrinkage is None or f["shrinkage"] == pytest.approx(shrinkage)
    assert len(want) == risk.shrinkage_facts(frame).count()


def test_neutralization_needs_a_size_that_varies(spark):
    from quantloom.operators import cross_section

    rows = [(day(d), f"c{i}", f, float(i * i % 7) if i else math.nan) for d in (0, 1) for i in range(12) for f in ("x", "log_total_mv")]
    sizes = [(day(d), f"c{i}", "a" if i < 6 else "b", None if i == 1 else float(i) if d else 5.0) for d in (0, 1) for i in range(12)]
    long = spark.createDataFrame(rows, "trade_date date, ts_code string, factor_name string, value double")
    exposures = spark.createDataFrame(sizes, "trade_date date, ts_code string, industry string, log_total_mv double")
    got = {(r["trade_date"], r["factor_name"]): r["n_values"] for r in cross_section.neutralize(long, exposures, 5).groupBy("trade_date", "factor_name").agg(F.count("value").alias("n_values")).collect()}
    # NaN is no value; without a size a row lacks only where size is regressed on; a constant size has no residuals
    assert got == {(day(0), "x"): 0, (day(1), "x"): 10, (day(0), "log_total_mv"): 11, (day(1), "log_total_mv"): 11}


def test_compositions_divide_by_the_valid_weight(spark):
    from quantloom.operators import composition

    long = spark.createDataFrame([(day(0), "A", "f", 1.0), (day(0), "A", "g", 2.0), (day(0), "A", "h", 9.0), (day(0), "B", "f", 4.0), (day(0), "B", "g", math.nan), (day(0), "B", "h", 1.0)], "trade_date date, ts_code string, factor_name string, value double")
    weights = spark.createDataFrame([(day(0), "f", 0.75), (day(0), "g", 2.25), (day(0), "h", 0.0)], "trade_date date, factor_name string, weight double")
    got = {r["ts_code"]: tuple(r)[2:] for r in composition.compose(long, weights).collect()}
    assert got == {"A": (1.75, 2, 1.0), "B": (4.0, 1, 0.25)}
    whole = {r["ts_code"]: r["score"] for r in composition.compose(long, weights, renormalize=False).collect()}
    assert whole == {"A": 5.25, "B": None}
    few = {r["ts_code"]: r["score"] for r in composition.compose(long, weights, least=2).collect()}
    assert few == {"A": 1.75, "B": None}


def test_covered_dates_prune_partitions(spark, tmp_path):
    from quantloom.sources import panels

    rows = spark.createDataFrame([(day(i), f"c{k}", float(i)) for i in range(0, 400, 3) for k in range(3)], "trade_date date, ts_code string, close double")
    panels.write_partitioned(rows, str(tmp_path / "daily"))
    dates = spark.createDataFrame([(day(3),), (day(6),), (None,)], "trade_date date")
    coverage = spark.createDataFrame([("d", "ALL", str(day(i)), "COMPLETE") for i in (3, 6)], "dataset_id string, scope_key string, unit string, status string")
    got = panels.read_covered(spark.read.parquet(str(tmp_path / "daily")), dates.where("trade_date IS NOT NULL"), coverage)
    assert sorted((r["trade_date"], r["ts_code"]) for r in got.collect()) == [(day(i), f"c{k}") for i in (3, 6) for k in range(3)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    with pytest.raises(ValueError, match="not all requested"):
        panels.read_covered(rows, rows.select("trade_date"), coverage)


@pytest.mark.parametrize("chunk", [1, 2, 7, 1000])
def test_user_factors_in_chunks_are_those_of_whole_histories(spark, chunk):
    from quantloom.operators import factors

    panel = spark.createDataFrame([(c, day(i), float((i * 7) % 11)) for c in "AB" for i in range(23)], "ts_code string, trade_date date, x double").repartition(4)
    function = lambda rows: rows["x"].rolling(4).sum()
    values = lambda frame: {(r[0], r[1]): None if r[2] is None or r[2] != r[2] else r[2] for r in frame.collect()}
    whole = values(factors.user_factor(panel, "f", function, ["x"]))
    assert len(whole) == 46 and values(factors.user_factor(panel, "f", function, ["x"], lookback=3, chunk=chunk)) == whole


def test_universes_that_prove_nothing_fail(spark):
    reference = "ts_code string, list_date date, delist_date date"
    good = [("A", day(0), None), ("B", day(5), day(20))]
    forms = spark.createDataFrame([(day(10),)], "formation_date date")
    frame = spark.createDataFrame(good, reference)
    assert {r["ts_code"] for r in universes.active(frame, forms).collect()} == {"A", "B"}
    for bad in (("C", None, None), ("D", day(5), day(4))):
        with pytest.raises(Exception, match="prove no lifecycle"):
            universes.active(spark.createDataFrame([*good, bad], reference), forms).collect()
    assert [tuple(r) for r in universes.universe_custom(["B", "A"], frame, forms).orderBy("position").collect()] == [(day(10), "B", 0), (day(10), "A", 1)]
    with pytest.raises(Exception, match="not one reference row"):
        universes.universe_custom(["B", "Z"], frame, forms).collect()
    shape = "index_code string, con_code string, trade_date date, weight double"
    assert universes.universe_index(spark.createDataFrame([("I", "A", day(9), 1.0)], shape), "I", frame, forms).count() == 1
    for weights, told in (([("I", "A", day(9), 0.5), ("I", "A", day(9), 0.5)], "twice"), ([("I", "Z", day(9), 1.0)], "without a reference row"), ([("I", "A", day(11), 1.0)], "no index snapshot")):
        with pytest.raises(Exception, match=told):
            universes.universe_index(spark.createDataFrame(weights, shape), "I", frame, forms).collect()


def test_return_windows_are_resolved_and_full(spark):
    from quantloom.operators import signals

    chosen = spark.createDataFrame([(day(4), "A"), (day(4), "B")], "trade_date date, ts_code string")
    status = [(day(i), "A", "SUSPENDED" if i == 3 else "AVAILABLE") for i in range(5)] + [(day(i), "B", "PRE_LISTING" if i < 4 else "AVAILABLE") for i in range(5)]
    returns = [(day(i), "A", i / 10) for i in (0, 1, 2, 4)] + [(day(4), "B", 0.7)]
    frames = lambda s, r: signals.resolved_returns(spark.createDataFrame(s, "trade_date date, ts_code string, status string"), spark.createDataFrame(r, RETURNS))
    got = sorted((r["ts_code"], r["return_date"], r["ret"]) for r in signals.return_window(chosen, frames(status, returns), days(spark, 5), 3).collect())
    assert got == [("A", day(2), 0.2), ("A", day(3), 0.0), ("A", day(4), 0.4), ("B", day(4), 0.7)]
    with pytest.raises(Exception, match="not enough calendar history"):
        signals.return_window(chosen, frames(status, returns), days(spark, 5), 6).collect()
    with pytest.raises(Exception, match="return is missing"):
        signals.return_window(chosen, frames(status, returns[1:]), days(spark, 5), 5).collect()
    with pytest.raises(Exception, match="no status"):
        signals.return_window(chosen, frames(status[1:], returns[1:]), days(spark, 5), 5).collect()


def test_a_code_without_a_volatility_fails(spark):
    chosen = spark.createDataFrame([(day(d), c) for d in (0, 1) for c in "ABC"], "trade_date date, ts_code string")
    vols = [(day(0), "A", 1.0), (day(0), "B", 2.0), (day(0), "C", 4.0), (day(1), "A", 1.0), (day(1), "B", 0.0)]
    for more in ([], [(day(1), "C", None)], [(day(1), "C", math.inf)], [(day(1), "C", math.nan)]):
        volatility = spark.createDataFrame(vols + more, "trade_date date, ts_code string, volatility double")
        with pytest.raises(Exception, match="no finite, positive volatility"):
            signals.weight_inverse_volatility(chosen, volatility).collect()
        got = {(r["trade_date"], r["ts_code"]): r["target_weight"] for r in signals.weight_inverse_volatility(chosen, volatility, fail=False).collect()}
        assert [got[day(0), c] for c in "ABC"] == pytest.approx([4 / 7, 2 / 7, 1 / 7])
        assert [got[day(1), c] for c in "ABC"] == [None] * 3


def test_an_unknown_market_fails(spark):
    shape = "ts_code string, market string, exchange string, curr_type string, list_date date, delist_date date"
    rows = [("A", "MAIN", "X", "C", day(0), None), ("B", "OTHER", "X", "C", day(0), None), ("C", None, "X", "C", day(0), None), ("D", "MAIN", "Y", "C", day(0), None)]
    formed = spark.createDataFrame([(day(3),)], "formation_date date")
    got = universes.universe_all(spark.createDataFrame(rows, shape), formed, ["MAIN"], ["X"], ["C"], ["OTHER"]).collect()
    assert [r["ts_code"] for r in got] == ["A"]
    with pytest.raises(Exception, match="unknown market"):
        universes.universe_all(spark.createDataFrame([*rows, ("E", "NEW", "Y", "Z", day(0), None)], shape), formed, ["MAIN"], ["X"], ["C"], ["OTHER"]).collect()


@pytest.mark.parametrize("name", ["complete_case_window", "covariance", "ledoit_wolf", "weight_min_variance"])
def test_windows_where_no_table_is_broadcast(spark, name):
    # a union of listed and unlisted days had twice the partitions that the join above it was planned for
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert catalog.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_days_before_a_listing_have_no_return(spark):
    status = spark.createDataFrame([(day(0), c, s) for c, s in (("A", "PRE_LISTING"), ("B", "PRE_LISTING"), ("C", "SUSPENDED"), ("D", "AVAILABLE"), ("E", None))], "trade_date date, ts_code string, status string")
    got = signals.resolved_returns(status, spark.createDataFrame([(day(0), "A", 0.5), (day(0), "D", 0.25)], RETURNS))
    assert {r["ts_code"]: r["ret"] for r in got.collect()} == {"A": None, "B": None, "C": 0.0, "D": 0.25}
