"""Accounting of a backtest in closed form.

Between two rebalances weights are the targets times each security's growth, over their
sum; so drift, ledger and net asset value are windows and joins, without stepping through days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.math import finite, number, ratio

WEIGHT_TOLERANCE = 1e-12


def pct_to_decimal(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c / 100)


def security_returns(bars: DataFrame, column: str = "pct_chg") -> DataFrame:
    """Returns, and how many rows share each key."""
    return bars.select("trade_date", "ts_code", pct_to_decimal(F.col(column)).alias("ret")).withColumn("key_rows", F.count(F.lit(1)).over(Window.partitionBy("trade_date", "ts_code")))


def benchmark_returns(bars: DataFrame, code: str) -> DataFrame:
    return bars.where(F.col("benchmark_code") == code).select("trade_date", "benchmark_code", pct_to_decimal(F.col("pct_chg")).alias("ret"))


def lifecycle_reconcile(rows: DataFrame) -> DataFrame:
    """One pair of dates for each code, and whether its rows disagree."""
    out = rows.groupBy("ts_code").agg(F.min("list_date").alias("list_date"), F.max("delist_date").alias("delist_date"), F.countDistinct("list_date").alias("_l"), F.countDistinct("delist_date").alias("_d"))
    return out.select("ts_code", "list_date", "delist_date", ((F.col("_l") > 1) | (F.col("_d") > 1)).alias("conflict"))


def suspension_events(rows: DataFrame) -> DataFrame:
    """Upper-case types, blank timings as null, each event once."""
    timing = F.trim("suspend_timing")
    return rows.select("trade_date", F.trim("ts_code").alias("ts_code"), F.upper(F.trim("suspend_type")).alias("suspend_type"), F.when(timing != "", timing).alias("suspend_timing")).distinct()


def resolve_return(status: DataFrame, returns: DataFrame, robust: bool = False, fail: bool = True, early: bool = False) -> DataFrame:
    """Observed returns, 0 on a proven suspension (if robust, on unknown gaps too).

    A return that isn't finite or stands on any other status than AVAILABLE or DELIST_DATE, and a
    gap without resolution, are conflicts: the query fails on them, or names them in `conflict`
    if not to `fail`. A null return is a gap. If `early`, days before the listing have no return, whatever
    `returns` says of them, and are no conflict.
    """
    joined = status.join(returns.select("trade_date", "ts_code", "ret"), ["trade_date", "ts_code"], "left")
    there = F.col("ret").isNotNull()
    zero = F.col("status").isin("SUSPENDED", *(["UNKNOWN_MISSING"] if robust else []))
    before = F.col("status") == "PRE_LISTING" if early else F.lit(False)
    conflict = (
        F.when(before, F.lit(None).cast("string"))
        .when(there & finite(F.col("ret")).isNull(), "return is not finite")
        .when(there & ~F.col("status").isin("AVAILABLE", "DELIST_DATE"), "return conflicts with status")
        .when(~there & ~zero, "return is missing")
    )
    value = F.when(conflict.isNull() & ~before, F.coalesce("ret", F.lit(0.0)))
    if not fail:
        return joined.select("trade_date", "ts_code", "status", value.alias("ret"), conflict.alias("conflict"))
    told = F.concat_ws(" ", conflict, "trade_date", "ts_code", "status")
    return joined.select("trade_date", "ts_code", "status", F.when(conflict.isNull(), value).otherwise(F.raise_error(told).cast("double")).alias("ret"))


def missing_fraction_gate(status: DataFrame, limit: float) -> DataFrame:
    out = status.groupBy("trade_date").agg(F.avg((F.col("status") == "UNKNOWN_MISSING").cast("double")).alias("missing"))
    return out.withColumn("fails", F.col("missing") > limit)


def segments(targets: DataFrame, days: DataFrame) -> DataFrame:
    """(trade_date, event): the latest rebalance before each open day. Both are tables of dates."""
    events = targets.select(F.col("effective_date").alias("trade_date"), F.col("effective_date").alias("e")).distinct()
    rows = days.select(F.col("cal_date").alias("trade_date")).join(events, "trade_date", "left")
    before = Window.orderBy("trade_date").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("event", F.last("e", ignorenulls=True).over(before)).where("event IS NOT NULL").select("trade_date", "event")


def held_days(targets: DataFrame, days: DataFrame) -> DataFrame:
    """event, trade_date, ts_code and target_weight: each holding's codes on the open days until, and on, the next rebalance."""
    held = targets.select(F.col("effective_date").alias("event"), "ts_code", "target_weight")
    return held.join(F.broadcast(segments(targets, days)), "event")  # a row for each date


def drifted(targets: DataFrame, returns: DataFrame, days: DataFrame) -> DataFrame:
    """event, trade_date, ts_code, value (of 1 at the event), cash and weight at the close of each day of a
    holding, and the value `before` the day and its `gain`.

    What the targets leave of 1 is cash, which keeps its value and so drifts in weight. `returns`
    are resolved ones (`resolve_return`): a code held with a positive weight fails on a day without
    one, and on one below -1.
    """
    rows = held_days(targets, days).join(returns.select("trade_date", "ts_code", "ret"), ["trade_date", "ts_code"], "left")
    told = F.concat_ws(" ", F.lit("no resolved return, or one below -1, of a held code:"), "trade_date", "ts_code", F.col("ret").cast("string"))
    wrong = F.col("ret").isNull() | (F.col("ret") < -1)
    ret = F.when(F.col("target_weight") <= WEIGHT_TOLERANCE, 0.0).when(wrong, F.raise_error(told).cast("double")).otherwise(F.col("ret"))
    growth = F.product(1 + ret).over(Window.partitionBy("event", "ts_code").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0))
    day = Window.partitionBy("event", "trade_date")
    valued = rows.withColumns({"value": F.col("target_weight") * growth, "cash": 1 - F.sum("target_weight").over(day), "_ret": ret})
    before = F.coalesce(F.lag("value").over(Window.partitionBy("event", "ts_code").orderBy("trade_date")), F.col("target_weight"))
    valued = valued.withColumn("before", before).withColumn("gain", F.col("before") * F.col("_ret"))
    return valued.select("event", "trade_date", "ts_code", "value", "cash", ratio(F.col("value"), F.sum("value").over(day) + F.col("cash")).alias("weight"), "before", "gain")


def rebalance_ledger(targets: DataFrame, drift: DataFrame) -> DataFrame:
    """Weights before and after each rebalance, the change, and the date's cash and half-L1 turnover (before the first event all is cash)."""
    pre = drift.select(F.col("trade_date").alias("effective_date"), "ts_code", F.col("weight").alias("pre_weight"))
    pre = pre.join(F.broadcast(targets.select("effective_date").distinct()), "effective_date")
    both = pre.join(targets.select("effective_date", "ts_code", "target_weight"), ["effective_date", "ts_code"], "full")
    day = Window.partitionBy("effective_date")
    rows = both.select("effective_date", "ts_code", F.coalesce("pre_weight", F.lit(0.0)).alias("pre_weight"), F.coalesce("target_weight", F.lit(0.0)).alias("target_weight"))
    rows = rows.withColumn("weight_change", F.col("target_weight") - F.col("pre_weight")).withColumn("pre_cash", 1 - F.sum("pre_weight").over(day)).withColumn("target_cash", 1 - F.sum("target_weight").over(day))
    notional = F.sum(F.abs("weight_change")).over(day)
    return rows.withColumn("turnover", (notional + F.abs(F.col("target_cash") - F.col("pre_cash"))) / 2).withColumn("notional", notional)


def daily_nav(drift: DataFrame, ledger: DataFrame, cost_rate: float) -> DataFrame:
    """Gross and net return and value of each day from the first rebalance on.

    The gross return is of all that is held, cash included. A rebalance takes notional times the rate
    from the day's closing value, so a net factor is the gross factor times 1 less the cost. Fails where
    a cost isn't in [0, 1) or a factor isn't positive.
    """
    value = drift.groupBy("event", "trade_date").agg(F.sum("gain").alias("gain"), (F.sum("before") + F.max("cash")).alias("before"))
    gross = ratio(F.col("gain"), F.col("before"))
    events = ledger.groupBy("effective_date").agg(F.max("turnover").alias("turnover"), F.max("notional").alias("notional")).withColumnRenamed("effective_date", "trade_date")
    days = value.select("trade_date", gross.alias("gross_return")).join(events, "trade_date", "full")
    cost = F.coalesce("notional", F.lit(0.0)) * cost_rate
    out = days.select("trade_date", F.coalesce("gross_return", F.lit(0.0)).alias("gross_return"), cost.alias("cost"), F.col("notional").isNotNull().alias("is_rebalance"), F.coalesce("turnover", F.lit(0.0)).alias("turnover"), F.coalesce("notional", F.lit(0.0)).alias("notional"))
    fits = (F.col("cost") >= 0) & (F.col("cost") < 1) & (F.col("gross_return") > -1) & finite(F.col("gross_return")).isNotNull()
    told = F.raise_error(F.concat_ws(" ", F.lit("cost or return out of range:"), "trade_date", "cost", "gross_return")).cast("double")
    out = out.withColumn("net_return", F.when(fits, (1 + F.col("gross_return")) * (1 - F.col("cost")) - 1).otherwise(told))
    path = Window.orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)  # a row for each day
    return out.withColumn("gross_nav", F.product(1 + F.col("gross_return")).over(path)).withColumn("net_nav", F.product(1 + F.col("net_return")).over(path))


def benchmark_nav(returns: DataFrame) -> DataFrame:
    """The first day's return is 0."""
    order = Window.orderBy("trade_date")
    r = F.when(F.row_number().over(order) == 1, 0.0).otherwise(F.col("ret"))
    out = returns.select("trade_date", r.alias("ret"))
    return out.withColumn("nav", F.product(1 + F.col("ret")).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def drawdown(nav: DataFrame, column: str = "nav", order: str = "trade_date") -> DataFrame:
    """Value over its running maximum, of at least the initial 1, less 1."""
    peak = F.greatest(F.max(column).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0))
    return nav.withColumn("drawdown", F.col(column) / peak - 1)


def annualize(total: Column, n: Column, periods: float) -> Column:
    return F.when(1 + total > 0, F.pow(1 + total, periods / n) - 1)


def performance(nav: DataFrame, benchmark: DataFrame, periods: float = 252, risk_free: float = 0.0) -> DataFrame:
    """One row of metrics of a daily table against a benchmark's."""
    rows = drawdown(nav, "net_nav").join(benchmark.select("trade_date", F.col("ret").alias("bench"), F.col("nav").alias("bench_nav")), "trade_date", "left")
    rows = drawdown(rows.withColumnRenamed("drawdown", "net_drawdown"), "bench_nav").withColumn("active", F.col("net_return") - F.col("bench"))
    n = F.count(F.lit(1))
    year = periods**0.5
    out = rows.agg(
        n.alias("days"), F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"),
        (F.max_by("gross_nav", "trade_date") - 1).alias("gross_total"), (F.max_by("net_nav", "trade_date") - 1).alias("net_total"), (F.max_by("bench_nav", "trade_date") - 1).alias("bench_total"),
        (F.stddev_samp("net_return") * year).alias("volatility"), (F.stddev_samp("bench") * year).alias("bench_volatility"),
        ratio(F.avg("net_return") - risk_free / periods, F.stddev_samp("net_return")).alias("_sharpe"),
        F.min("net_drawdown").alias("max_drawdown"), F.min("drawdown").alias("bench_max_drawdown"),
        (F.stddev_samp("active") * year).alias("tracking_error"), ratio(F.avg("active"), F.stddev_samp("active")).alias("_ir"),
        F.avg((F.col("net_return") > 0).cast("double")).alias("win_rate"), F.max("net_return").alias("best_day"), F.min("net_return").alias("worst_day"),
        F.sum("turnover").alias("turnover"), F.sum("cost").alias("cost"), F.count_if("is_rebalance").alias("rebalances"),
        F.avg(F.when(F.col("is_rebalance"), F.col("turnover"))).alias("average_turnover"), F.sum("notional").alias("traded_notional"),
    )
    out = out.withColumns({"sharpe": F.col("_sharpe") * year, "information_ratio": F.col("_ir") * year}).drop("_sharpe", "_ir")
    out = out.withColumns({f"{c}_annual": annualize(F.col(f"{c}_total"), F.col("days"), periods) for c in ("gross", "net", "bench")})
    return out.withColumns({"excess_total": F.col("net_total") - F.col("bench_total"), "excess_annual": F.col("net_annual") - F.col("bench_annual"), "cost_drag": F.col("gross_total") - F.col("net_total")})


def _violations(frame: DataFrame, rules: dict) -> DataFrame:
    counted = frame.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])
    return counted.unpivot([], list(rules), "rule", "violations")


def holdings_rules(targets: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    days = targets.groupBy("effective_date").agg(F.sum("target_weight").alias("s"), F.min("target_weight").alias("m"), F.count(F.lit(1)).alias("n"), F.countDistinct("ts_code").alias("d"))
    return _violations(days, {"negative_weight": F.col("m") < 0, "duplicate_key": F.col("n") > F.col("d"), "sum_not_one": F.abs(F.col("s") - 1) > tolerance})


def ledger_rules(ledger: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    c = F.col
    days = ledger.groupBy("effective_date").agg(
        (F.sum("pre_weight") + F.max("pre_cash")).alias("pre"), (F.sum("target_weight") + F.max("target_cash")).alias("post"), F.max("turnover").alias("t"),
        ((F.sum(F.abs("weight_change")) + F.abs(F.max("target_cash") - F.max("pre_cash"))) / 2).alias("again"), F.max(F.abs(c("weight_change") - (c("target_weight") - c("pre_weight")))).alias("off"),
    )
    return _violations(days, {"pre_not_one": F.abs(c("pre") - 1) > tolerance, "target_not_one": F.abs(c("post") - 1) > tolerance, "change_differs": c("off") > tolerance, "turnover_differs": F.abs(c("t") - c("again")) > tolerance})


def pre_state_check(drift: DataFrame, ledger: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Keys whose drifted weight isn't the ledger's weight before the rebalance."""
    a = drift.select(F.col("trade_date").alias("effective_date"), "ts_code", "weight").join(F.broadcast(ledger.select("effective_date").distinct()), "effective_date")
    both = a.join(ledger.select("effective_date", "ts_code", "pre_weight"), ["effective_date", "ts_code"], "full")
    gap = F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("pre_weight", F.lit(0.0)))
    return both.groupBy("effective_date").agg(F.count(F.lit(1)).alias("keys"), F.count_if(gap > tolerance).alias("different"))


def daily_rules(nav: DataFrame) -> DataFrame:
    c = F.col
    quiet = ~c("is_rebalance")
    return _violations(nav, {"cost_on_quiet_day": quiet & (c("cost") != 0), "turnover_on_quiet_day": quiet & (c("turnover") != 0), "notional_on_quiet_day": quiet & (c("notional") != 0), "nav_not_positive": (c("net_nav") <= 0) | (c("gross_nav") <= 0)})


def simple_holdings(selected: DataFrame, column: str = "forward_return") -> DataFrame:
    """Equal weights of each period's selected codes that have a next return, each code once (of rows that share a key, the smallest return)."""
    rows = selected.select("trade_date", "ts_code", number(F.col(column)).alias(column)).dropna().groupBy("trade_date", "ts_code").agg(F.min(column).alias(column))
    return rows.withColumn("weight", 1.0 / F.count(F.lit(1)).over(Window.partitionBy("trade_date")))


def simple_turnover(held: DataFrame) -> DataFrame:
    """Half the absolute change of weights from the period before; the first period's is all."""
    dates = held.select("trade_date").distinct().withColumn("p", F.row_number().over(Window.orderBy("trade_date")))
    now = held.join(F.broadcast(dates), "trade_date").select("p", "ts_code", "weight")
    before = now.select((F.col("p") + 1).alias("p"), "ts_code", F.col("weight").alias("old"))
    both = now.join(before, ["p", "ts_code"], "full").join(F.broadcast(dates), "p")
    change = F.sum(F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("old", F.lit(0.0)))) / 2
    return both.groupBy("trade_date", "p").agg(change.alias("c")).select("trade_date", F.when(F.col("p") == 1, 1.0).otherwise(F.col("c")).alias("turnover"))


def simple_returns(held: DataFrame, turnover: DataFrame, cost_rate: float, column: str = "forward_return") -> DataFrame:
    """Gross return, turnover, cost and net return of each period of `simple_holdings`."""
    gross = held.groupBy("trade_date").agg(F.sum(F.col("weight") * F.col(column)).alias("gross_return"))
    rows = gross.join(turnover, "trade_date", "left").withColumn("turnover", F.coalesce("turnover", F.lit(0.0))).withColumn("cost", F.col("turnover") * cost_rate)
    return rows.withColumn("net_return", F.col("gross_return") - F.col("cost"))


def simple_nav(returns: DataFrame) -> DataFrame:
    return returns.withColumn("nav", F.product(1 + F.col("net_return")).over(Window.orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)))


def simple_metrics(nav: DataFrame, periods: float = 12) -> DataFrame:
    """One row of metrics; the drawdown is against the running peak, the Sharpe ratio annual return over annual volatility."""
    peak = F.max("nav").over(Window.orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0))  # a row for each period
    rows = nav.withColumn("_d", F.col("nav") / F.nullif(peak, F.lit(0.0)) - 1)
    last = F.max_by("nav", "trade_date")
    out = rows.agg(
        F.min("trade_date").alias("start_date"), F.max("trade_date").alias("end_date"), F.count(F.lit(1)).alias("n_periods"), (last - 1).alias("cumulative_return"),
        F.when(last >= 0, F.pow(last, periods / F.nullif(F.count(F.lit(1)), F.lit(0))) - 1).alias("annual_return"), (F.stddev_samp("net_return") * periods**0.5).alias("annual_volatility"),
        F.min("_d").alias("max_drawdown"), F.avg("net_return").alias("mean_monthly_return"), F.avg((F.col("net_return") > 0).cast("double")).alias("win_rate"), F.avg("turnover").alias("average_turnover"),
    )
    return out.withColumn("sharpe_ratio", ratio(F.col("annual_return"), F.col("annual_volatility")))


def simple_backtest(selected: DataFrame, cost_rate: float, column: str = "forward_return") -> DataFrame:
    held = simple_holdings(selected, column)
    return simple_metrics(simple_nav(simple_returns(held, simple_turnover(held), cost_rate, column)))
