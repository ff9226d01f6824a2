"""Report tables over all securities at once: scores, labels, latest states, histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.math import number, ratio, steps

# Steps and labels that reports are read by.
NONE = "N/A"
UNKNOWN_INDUSTRY = "未知行业"
PERCENTILE_STEPS = [(">=", 0.8, "样本前 20%"), (">=", 0.6, "样本前 40%"), (">=", 0.4, "样本中位附近"), (">=", 0.2, "样本后 40%")]
VOLATILITY_STEPS = [("<=", -0.5, "低波动"), ("<", 0.5, "中等波动")]
MOMENTUM_STEPS = [(">=", 0.5, "动量较强"), (">=", 0.0, "动量偏强"), (">=", -0.5, "动量偏弱")]
RATING_STEPS = [(">=", 80.0, "偏积极"), (">=", 65.0, "中性偏积极"), (">=", 45.0, "中性"), (">=", 30.0, "中性偏谨慎")]
TREND_STEPS = [(">=", 80.0, "趋势参考偏强"), (">=", 65.0, "趋势参考略偏强"), (">=", 45.0, "趋势参考中性"), (">=", 30.0, "趋势参考略偏弱")]
RETURN_STEPS = [(">=", 0.20, "历史阶段涨幅较高"), (">=", 0.05, "历史阶段表现偏强"), (">", -0.05, "历史阶段表现中性"), (">", -0.20, "历史阶段表现偏弱")]
RECENT_VOLATILITY_STEPS = [("<=", 0.05, "历史波动较低"), ("<=", 0.10, "历史波动中等")]
EXPOSURE_STEPS = [(">=", 0.5, "显著高于样本均值"), (">=", 0.0, "略高于样本均值"), (">", -0.5, "略低于样本均值")]
TOTAL_STEPS = [(">=", 0.30, "历史累计收益较高"), (">=", 0.10, "历史累计收益偏强"), (">", -0.10, "历史累计收益中性"), (">", -0.30, "历史累计收益偏弱")]
DRAWDOWN_STEPS = [(">=", -0.05, "历史回撤较低"), (">=", -0.15, "历史回撤中等")]
SHARPE_STEPS = [(">=", 1.5, "历史夏普较高"), (">=", 0.8, "历史夏普中等偏高"), (">=", 0.0, "历史夏普一般")]
WIN_STEPS = [(">=", 0.6, "历史胜率较高"), (">=", 0.45, "历史胜率中等")]
MOMENTUM_POINTS = [(">=", 1.0, 25.0), (">=", 0.5, 20.0), (">=", 0.0, 15.0), (">=", -0.5, 10.0)]
VOLATILITY_POINTS = [("<=", -1.0, 15.0), ("<=", -0.5, 12.0), ("<=", 0.5, 8.0), ("<=", 1.0, 5.0)]
VALUATION_POINTS = [(">=", 0.5, 10.0), (">=", 0.0, 7.0), (">=", -0.5, 5.0)]


def mean_of(*values: Column) -> Column:
    """The mean of the values that are there; null if none is."""
    there = F.filter(F.array(*map(number, values)), lambda x: x.isNotNull())
    return F.when(F.size(there) > 0, F.aggregate(there, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(there), F.lit(0)))


def momentum_part(momentum_1m: Column, momentum_3m: Column) -> Column:
    """0 to 25 by the mean of two standardized momentums."""
    return steps(mean_of(momentum_1m, momentum_3m), MOMENTUM_POINTS, 5.0, 12.5)


def volatility_part(volatility_6m: Column) -> Column:
    """0 to 15, the more the calmer."""
    return steps(volatility_6m, VOLATILITY_POINTS, 2.0, 7.5)


def valuation_part(ep: Column, bp: Column, ps_inverse: Column) -> Column:
    """0 to 10 by the mean of three standardized valuations."""
    return steps(mean_of(ep, bp, ps_inverse), VALUATION_POINTS, 3.0, 5.0)


def rating_label(score: Column) -> Column:
    return steps(score, RATING_STEPS, "偏谨慎", NONE)


def trend_label(score: Column) -> Column:
    return steps(score, TREND_STEPS, "趋势参考偏弱", NONE)


def percentile_label(p: Column) -> Column:
    return steps(p, PERCENTILE_STEPS, "样本后 20%", NONE)


def volatility_label(volatility_6m: Column) -> Column:
    return steps(volatility_6m, VOLATILITY_STEPS, "高波动", NONE)


def momentum_label(momentum_1m: Column, momentum_3m: Column) -> Column:
    return steps(mean_of(momentum_1m, momentum_3m), MOMENTUM_STEPS, "动量较弱", NONE)


def return_label(x: Column) -> Column:
    return steps(x, RETURN_STEPS, "历史阶段跌幅较大", NONE)


def recent_volatility_label(x: Column) -> Column:
    return steps(x, RECENT_VOLATILITY_STEPS, "历史波动较高", NONE)


def exposure_label(value: Column) -> Column:
    return steps(value, EXPOSURE_STEPS, "显著低于样本均值", NONE)


def ic_label(mean: Column, share: Column) -> Column:
    """By the size of the mean coefficient and the share of positive ones."""
    m, s = F.abs(number(mean)), number(share)
    return F.when(m.isNull() | s.isNull(), NONE).when((m >= 0.05) & (s >= 0.6), "历史 IC 表现较强").when((m >= 0.03) & (s >= 0.5), "历史 IC 表现中等").otherwise("历史 IC 表现较弱")


def research_score(panel: DataFrame) -> DataFrame:
    """0-100 of a standardized panel: half the percentile of its score, momentum, volatility and valuation.

    A percentile that isn't there counts 25, and the other parts have a middle value too."""
    c = F.col
    parts = {
        "score_component": F.coalesce(number(c("score_pct_rank")) * 50.0, F.lit(25.0)),
        "momentum_component": momentum_part(c("momentum_1m"), c("momentum_3m")),
        "volatility_component": volatility_part(c("volatility_6m")),
        "valuation_component": valuation_part(c("ep"), c("bp"), c("ps_inverse")),
    }
    labels = {"percentile_label": percentile_label(c("score_pct_rank")), "momentum_label": momentum_label(c("momentum_1m"), c("momentum_3m")), "volatility_label": volatility_label(c("volatility_6m"))}
    return panel.withColumns(parts | labels).withColumn("research_score", c("score_component") + c("momentum_component") + c("volatility_component") + c("valuation_component"))


def rating_report(scored: DataFrame) -> DataFrame:
    """Score, rating, trend and labels of the latest row of each code."""
    score = F.col("research_score")
    return latest_rows(scored).select("ts_code", "trade_date", "research_score", rating_label(score).alias("rating"), trend_label(score).alias("trend"), "percentile_label", "momentum_label", "volatility_label")


def latest_rows(panel: DataFrame) -> DataFrame:
    """The last row of each code."""
    columns = [c for c in panel.columns if c != "ts_code"]
    return panel.groupBy("ts_code").agg(F.max_by(F.struct(*columns), "trade_date").alias("_r")).select("ts_code", "_r.*")


def latest_snapshot(panel: DataFrame, selected: DataFrame) -> DataFrame:
    """Last rows, and whether the code is selected at its last date."""
    flag = selected.select("ts_code", "trade_date").distinct().withColumn("_s", F.lit(True))
    return latest_rows(panel).join(flag, ["ts_code", "trade_date"], "left").withColumn("selected", F.coalesce("_s", F.lit(False))).drop("_s")


def exposure_table(panel: DataFrame, hints: dict[str, str]) -> DataFrame:
    """(ts_code, factor, value, direction_hint, exposure_label) of the latest standardized values that are there; `hints` names the factors."""
    rows = latest_rows(panel.select("ts_code", "trade_date", *[number(F.col(f)).alias(f) for f in hints])).unpivot(["ts_code", "trade_date"], list(hints), "factor", "value")
    hint = F.create_map(*[F.lit(x) for pair in hints.items() for x in pair])[F.col("factor")]
    return rows.where("value IS NOT NULL").select("ts_code", "trade_date", "factor", "value", hint.alias("direction_hint"), exposure_label(F.col("value")).alias("exposure_label"))


def history(panel: DataFrame, code: str) -> DataFrame:
    """All rows of a code by date."""
    return panel.where(F.col("ts_code") == code).orderBy("trade_date")


def score_trends(panel: DataFrame, columns: list[str]) -> DataFrame:
    """The chosen columns by code and date, without rows that have none of them."""
    return panel.select("ts_code", "trade_date", *columns).dropna(how="all", subset=columns).orderBy("ts_code", "trade_date")


def recent_returns(panel: DataFrame, column: str = "ret") -> DataFrame:
    """Latest date, close and return of each code, compound return of its last 3 and 6 returns that are
    there, the deviation of the last 6, and how many there are."""
    r = number(F.col(column))
    from_last = Window.partitionBy("ts_code").orderBy(F.desc("trade_date")).rowsBetween(Window.unboundedPreceding, 0)
    rows = panel.where("trade_date IS NOT NULL").withColumn("_r", r).withColumn("_k", F.count("_r").over(from_last))
    months = F.count("_r")
    last = lambda n: F.when(F.col("_k") <= n, F.col("_r"))
    compound = lambda n: F.when(months >= n, F.product(1 + last(n)) - 1)
    return rows.groupBy("ts_code").agg(
        F.max("trade_date").alias("latest_date"), F.max_by("close", "trade_date").alias("latest_close"), F.max_by("_r", "trade_date").alias("latest_monthly_return"), compound(3).alias("recent_3m_return"),
        compound(6).alias("recent_6m_return"), F.when(months >= 6, F.stddev_samp(last(6))).alias("recent_6m_volatility"), months.alias("available_months"),
    )


def price_summary(panel: DataFrame) -> DataFrame:
    labels = {"recent_3m_label": return_label(F.col("recent_3m_return")), "recent_6m_label": return_label(F.col("recent_6m_return")), "volatility_label": recent_volatility_label(F.col("recent_6m_volatility"))}
    return recent_returns(panel).withColumns(labels)


def selection_frequency(panel: DataFrame, selected: DataFrame) -> DataFrame:
    """Selected over observed periods of each code."""
    seen = panel.groupBy("ts_code").agg(F.countDistinct("trade_date").alias("observed"))
    hits = selected.groupBy("ts_code").agg(F.countDistinct("trade_date").alias("n"))
    out = seen.join(hits, "ts_code", "left").withColumn("selected", F.coalesce("n", F.lit(0)))
    return out.select("ts_code", "observed", "selected", (F.col("selected") / F.col("observed")).alias("frequency"))


def latest_portfolio(held: DataFrame, by: str = "rank") -> DataFrame:
    """The rows of the last date, by rank, or by descending score; a null industry gets its label."""
    last = held.agg(F.max("trade_date").alias("trade_date"))
    rows = held.join(F.broadcast(last), "trade_date", "left_semi").withColumn("industry", F.coalesce("industry", F.lit(UNKNOWN_INDUSTRY)))
    return rows.orderBy("rank" if by == "rank" else F.desc("score"))


def latest_portfolio_date(dates: Column) -> Column:
    """The last of texts that are dates."""
    return F.max(F.try_to_date(dates, "yyyy-MM-dd"))


def industry_distribution(held: DataFrame) -> DataFrame:
    """Codes and weight of each industry of the portfolio of each date, with null as unknown."""
    name = F.coalesce("industry", F.lit(UNKNOWN_INDUSTRY))
    return held.groupBy("trade_date", name.alias("industry")).agg(F.count("ts_code").alias("count"), F.coalesce(F.sum("target_weight"), F.lit(0.0)).alias("weight")).orderBy("trade_date", F.desc("weight"))


def weight_distribution(held: DataFrame) -> DataFrame:
    return held.select("trade_date", "ts_code", "target_weight", "rank").orderBy("trade_date", F.desc("target_weight"), "rank")


def portfolio_summary(latest: DataFrame) -> DataFrame:
    """One row of a portfolio: its date, size and industries (null is one), the code of most weight (then of
    first rank) and of best score (then of first rank) by name, if it has one, and mean score and percentile."""
    label = F.coalesce("name", "ts_code")
    return latest.agg(
        F.max("trade_date").alias("latest_date"), F.count(F.lit(1)).alias("holding_count"), F.countDistinct(F.coalesce("industry", F.lit(UNKNOWN_INDUSTRY))).alias("industry_count"),
        F.max_by(label, F.struct("target_weight", -F.col("rank"))).alias("top_weight_stock"), F.max_by(label, F.when(F.col("score").isNotNull(), F.struct("score", -F.col("rank")))).alias("top_score_stock"),
        F.avg("score").alias("average_score"), F.avg("score_pct_rank").alias("average_score_pct_rank"),
    )


def ic_ranking(summary: DataFrame) -> DataFrame:
    """Factors by the size of their mean coefficient, with labels."""
    place = F.row_number().over(Window.orderBy(F.abs("ic_mean").desc_nulls_last(), "factor_name"))  # a row for each factor
    return summary.select("factor_name", "ic_mean", "ic_positive", F.abs("ic_mean").alias("abs_ic_mean"), place.alias("place"), ic_label(F.col("ic_mean"), F.col("ic_positive")).alias("effectiveness_label"))


def top_factors(ranked: DataFrame, n: int) -> DataFrame:
    return ranked.orderBy("place").limit(n)


def group_return_report(quantiles: DataFrame) -> DataFrame:
    return quantiles.groupBy("factor_name", "quantile").agg(F.avg("group_return").alias("mean_return"), F.count("group_return").alias("n"))


def backtest_labels(metrics: DataFrame) -> DataFrame:
    c = F.col
    return metrics.select(
        "cumulative_return", "max_drawdown", "sharpe_ratio", "win_rate",
        steps(c("cumulative_return"), TOTAL_STEPS, "历史累计收益较弱", NONE).alias("cumulative_return_label"), steps(c("max_drawdown"), DRAWDOWN_STEPS, "历史回撤较高", NONE).alias("max_drawdown_label"),
        steps(c("sharpe_ratio"), SHARPE_STEPS, "历史夏普较弱", NONE).alias("sharpe_label"), steps(c("win_rate"), WIN_STEPS, "历史胜率偏低", NONE).alias("win_rate_label"),
    )


def series(table: DataFrame, columns: list[str], order: str = "trade_date", complete: bool = False) -> DataFrame:
    """Chosen columns in date order, without rows that lack the date (or, if complete, any of them)."""
    rows = table.select(order, *columns)
    return rows.dropna(subset=[order, *columns] if complete else [order]).orderBy(order)


def nav_curve(nav: DataFrame) -> DataFrame:
    """gross_return, cost, net_return, nav, drawdown and turnover by date; the drawdown is against the highest value so far."""
    peak = F.max("net_nav").over(Window.orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0))  # a row for each day
    rows = nav.select("trade_date", "gross_return", "cost", "net_return", F.col("net_nav").alias("nav"), (F.col("net_nav") / peak - 1).alias("drawdown"), "turnover")
    return rows.dropna(subset=["trade_date"]).orderBy("trade_date")


def long_short_report(spreads: DataFrame) -> DataFrame:
    """Mean, deviation and ratio of each factor's spreads; a date without a spread counts as not positive."""
    x = F.col("spread")
    positive = F.avg(F.coalesce((x > 0).cast("double"), F.lit(0.0)))
    return spreads.groupBy("factor_name").agg(F.avg(x).alias("spread_mean"), F.stddev_samp(x).alias("spread_std"), ratio(F.avg(x), F.stddev_samp(x)).alias("spread_ir"), positive.alias("spread_positive"), F.count(x).alias("n_dates"))


def nav_vs_benchmark(nav: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Values, drawdown and the running return within the month."""
    both = nav.select("trade_date", "net_nav", "net_return").join(benchmark.select("trade_date", F.col("nav").alias("benchmark_nav")), "trade_date")
    peak = F.greatest(F.lit(1.0), F.max("net_nav").over(Window.orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)))
    month = Window.partitionBy(F.trunc("trade_date", "month")).orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("drawdown", F.col("net_nav") / peak - 1).withColumn("month_return", F.product(1 + F.col("net_return")).over(month) - 1)
