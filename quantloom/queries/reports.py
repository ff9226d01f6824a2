"""Queries of the report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import backtest as bt
from ..operators import evaluation as ev
from ..operators import reports as op
from ..registry import query
from .evaluations import _IC, _QUANTILES, _SPREADS
from .portfolios import _BNAV, _CHOSEN, _NAV, _SMETRICS, _bench, _chosen, _nav, _sret

_MOMENTUM = "coalesce((momentum_1m + momentum_3m) / 2, momentum_1m, momentum_3m)"
_VALUATION = "(coalesce(ep, 0) + coalesce(bp, 0) + coalesce(ps_inverse, 0)) / nullif(CASE WHEN ep IS NULL THEN 0 ELSE 1 END + CASE WHEN bp IS NULL THEN 0 ELSE 1 END + CASE WHEN ps_inverse IS NULL THEN 0 ELSE 1 END, 0)"
_MOMENTUM_PART = "CASE WHEN {0} IS NULL THEN 12.5 WHEN {0} >= 1 THEN 25 WHEN {0} >= 0.5 THEN 20 WHEN {0} >= 0 THEN 15 WHEN {0} >= -0.5 THEN 10 ELSE 5 END".format(_MOMENTUM)
_VOLATILITY_PART = "CASE WHEN volatility_6m IS NULL THEN 7.5 WHEN volatility_6m <= -1 THEN 15 WHEN volatility_6m <= -0.5 THEN 12 WHEN volatility_6m <= 0.5 THEN 8 WHEN volatility_6m <= 1 THEN 5 ELSE 2 END"
_VALUATION_PART = "CASE WHEN {0} IS NULL THEN 5 WHEN {0} >= 0.5 THEN 10 WHEN {0} >= 0 THEN 7 WHEN {0} >= -0.5 THEN 5 ELSE 3 END".format(_VALUATION)
_PERCENTILE_LABEL = "CASE WHEN score_pct_rank IS NULL THEN 'N/A' WHEN score_pct_rank >= 0.8 THEN '样本前 20%' WHEN score_pct_rank >= 0.6 THEN '样本前 40%' WHEN score_pct_rank >= 0.4 THEN '样本中位附近' WHEN score_pct_rank >= 0.2 THEN '样本后 40%' ELSE '样本后 20%' END"
_VOLATILITY_LABEL = "CASE WHEN volatility_6m IS NULL THEN 'N/A' WHEN volatility_6m <= -0.5 THEN '低波动' WHEN volatility_6m < 0.5 THEN '中等波动' ELSE '高波动' END"
_MOMENTUM_LABEL = "CASE WHEN {0} IS NULL THEN 'N/A' WHEN {0} >= 0.5 THEN '动量较强' WHEN {0} >= 0 THEN '动量偏强' WHEN {0} >= -0.5 THEN '动量偏弱' ELSE '动量较弱' END".format(_MOMENTUM)
_RETURN_LABEL = "CASE WHEN {0} IS NULL THEN 'N/A' WHEN {0} >= 0.2 THEN '历史阶段涨幅较高' WHEN {0} >= 0.05 THEN '历史阶段表现偏强' WHEN {0} > -0.05 THEN '历史阶段表现中性' WHEN {0} > -0.2 THEN '历史阶段表现偏弱' ELSE '历史阶段跌幅较大' END"
_RECENT_VOLATILITY_LABEL = "CASE WHEN {0} IS NULL THEN 'N/A' WHEN {0} <= 0.05 THEN '历史波动较低' WHEN {0} <= 0.1 THEN '历史波动中等' ELSE '历史波动较高' END"
_RATING = "CASE WHEN research_score >= 80 THEN '偏积极' WHEN research_score >= 65 THEN '中性偏积极' WHEN research_score >= 45 THEN '中性' WHEN research_score >= 30 THEN '中性偏谨慎' WHEN research_score IS NULL THEN 'N/A' ELSE '偏谨慎' END"
_TREND = "CASE WHEN research_score >= 80 THEN '趋势参考偏强' WHEN research_score >= 65 THEN '趋势参考略偏强' WHEN research_score >= 45 THEN '趋势参考中性' WHEN research_score >= 30 THEN '趋势参考略偏弱' WHEN research_score IS NULL THEN 'N/A' ELSE '趋势参考偏弱' END"
_EXPOSURE_LABEL = "CASE WHEN value IS NULL THEN 'N/A' WHEN value >= 0.5 THEN '显著高于样本均值' WHEN value >= 0 THEN '略高于样本均值' WHEN value > -0.5 THEN '略低于样本均值' ELSE '显著低于样本均值' END"
_KEYS = "ts_code, trade_date"
c = F.col


@query("momentum_part", f"SELECT {_KEYS}, {_MOMENTUM_PART} AS value FROM v_scored", "value")
def momentum_part(v):
    return v.v_scored.select("ts_code", "trade_date", op.momentum_part(c("momentum_1m"), c("momentum_3m")).alias("value"))


@query("volatility_part", f"SELECT {_KEYS}, {_VOLATILITY_PART} AS value FROM v_scored", "value")
def volatility_part(v):
    return v.v_scored.select("ts_code", "trade_date", op.volatility_part(c("volatility_6m")).alias("value"))


@query("valuation_part", f"SELECT {_KEYS}, {_VALUATION_PART} AS value FROM v_scored", "value")
def valuation_part(v):
    return v.v_scored.select("ts_code", "trade_date", op.valuation_part(c("ep"), c("bp"), c("ps_inverse")).alias("value"))


@query("percentile_label", f"SELECT {_KEYS}, {_PERCENTILE_LABEL} AS value FROM v_scored")
def percentile_label(v):
    return v.v_scored.select("ts_code", "trade_date", op.percentile_label(c("score_pct_rank")).alias("value"))


@query("volatility_label", f"SELECT {_KEYS}, {_VOLATILITY_LABEL} AS value FROM v_scored")
def volatility_label(v):
    return v.v_scored.select("ts_code", "trade_date", op.volatility_label(c("volatility_6m")).alias("value"))


@query("momentum_label", f"SELECT {_KEYS}, {_MOMENTUM_LABEL} AS value FROM v_scored")
def momentum_label(v):
    return v.v_scored.select("ts_code", "trade_date", op.momentum_label(c("momentum_1m"), c("momentum_3m")).alias("value"))


@query("recent_return_label", f"SELECT {_KEYS}, {_RETURN_LABEL.format('round(ret, 9)')} AS value FROM v_ret")
def recent_return_label(v):
    return v.v_ret.select("ts_code", "trade_date", op.return_label(F.round("ret", 9)).alias("value"))


_SPREAD6 = "SELECT ts_code, trade_date, 0.2E0 * stddev_samp(ret) OVER (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS spread FROM v_ret"


@query("recent_vol_label", f"SELECT {_KEYS}, {_RECENT_VOLATILITY_LABEL.format('round(spread, 9)')} AS value FROM ({_SPREAD6}) s")
def recent_vol_label(v):
    return v.sql(_SPREAD6).select("ts_code", "trade_date", op.recent_volatility_label(F.round("spread", 9)).alias("value"))


_SCORED = f"""SELECT *, score_component + momentum_component + volatility_component + valuation_component AS research_score FROM (
    SELECT *, coalesce(score_pct_rank * 50, 25) AS score_component, {_MOMENTUM_PART} AS momentum_component, {_VOLATILITY_PART} AS volatility_component, {_VALUATION_PART} AS valuation_component,
    {_PERCENTILE_LABEL} AS percentile_label, {_MOMENTUM_LABEL} AS momentum_label, {_VOLATILITY_LABEL} AS volatility_label FROM v_scored) q"""


@query("research_score", _SCORED, "momentum_1m momentum_3m volatility_6m ep bp ps_inverse size_factor score_pct_rank score_component momentum_component volatility_component valuation_component research_score")
def research_score(v):
    return op.research_score(v.v_scored)


@query("rating_label", f"SELECT {_KEYS}, {_RATING} AS value FROM (SELECT {_KEYS}, round(research_score, 6) AS research_score FROM ({_SCORED}) s) r")
def rating_label(v):
    return op.research_score(v.v_scored).select("ts_code", "trade_date", op.rating_label(F.round("research_score", 6)).alias("value"))


@query("trend_label", f"SELECT {_KEYS}, {_TREND} AS value FROM (SELECT {_KEYS}, round(research_score, 6) AS research_score FROM ({_SCORED}) s) r")
def trend_label(v):
    return op.research_score(v.v_scored).select("ts_code", "trade_date", op.trend_label(F.round("research_score", 6)).alias("value"))


_LAST = "SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY ts_code ORDER BY trade_date DESC) AS n FROM ({0}) x) y WHERE n = 1"


@query("rating_report", f"SELECT {_KEYS}, research_score, {_RATING} AS rating, {_TREND} AS trend, percentile_label, momentum_label, volatility_label FROM ({_LAST.format(_SCORED)}) l", "research_score")
def rating_report(v):
    return op.rating_report(op.research_score(v.v_scored))


_HINTS = {"ep": "up", "size_factor": "up", "momentum_3m": "up", "volatility_6m": "down"}
_EXPOSED = f"SELECT {_KEYS}, factor, value, CASE factor WHEN 'volatility_6m' THEN 'down' ELSE 'up' END AS direction_hint, {_EXPOSURE_LABEL} AS exposure_label FROM (" + " UNION ALL ".join(f"SELECT {_KEYS}, '{f}' AS factor, {f} AS value FROM ({_LAST.format('SELECT * FROM v_scored')}) l WHERE {f} IS NOT NULL" for f in ("ep", "size_factor", "momentum_3m", "volatility_6m")) + ") e"


@query("exposure_table", _EXPOSED, "value")
def exposure_table(v):
    return op.exposure_table(v.v_scored, _HINTS)


@query("exposure_label", f"SELECT {_KEYS}, {_EXPOSURE_LABEL} AS label FROM (SELECT {_KEYS}, size_factor AS value FROM v_scored) s")
def exposure_label(v):
    return v.v_scored.select("ts_code", "trade_date", op.exposure_label(c("size_factor")).alias("label"))


@query("score_trends", f"SELECT {_KEYS}, momentum_3m, volatility_6m FROM v_scored WHERE momentum_3m IS NOT NULL OR volatility_6m IS NOT NULL", "momentum_3m volatility_6m")
def score_trends(v):
    return op.score_trends(v.v_scored, ["momentum_3m", "volatility_6m"])


# every seventh row has no return, so the last three are not the last three rows
_GAPS = "SELECT ts_code, trade_date, sqrt(close) AS close, CASE WHEN (year(trade_date) * 12 + month(trade_date)) % 7 <> 3 THEN 0.2E0 * ret END AS ret FROM v_ret"
_BACK = f"SELECT *, row_number() OVER (PARTITION BY ts_code ORDER BY trade_date DESC) AS n FROM ({_GAPS}) g WHERE ret IS NOT NULL"
_RECENT = f"""SELECT l.ts_code, l.trade_date AS latest_date, l.close AS latest_close, l.ret AS latest_monthly_return, recent_3m_return, recent_6m_return, recent_6m_volatility, coalesce(months, 0) AS available_months FROM ({_LAST.format(_GAPS)}) l LEFT JOIN (
    SELECT ts_code, CASE WHEN count(*) >= 3 THEN product(CASE WHEN n <= 3 THEN 1 + ret END) - 1 END AS recent_3m_return, CASE WHEN count(*) >= 6 THEN product(CASE WHEN n <= 6 THEN 1 + ret END) - 1 END AS recent_6m_return,
    CASE WHEN count(*) >= 6 THEN stddev_samp(CASE WHEN n <= 6 THEN ret END) END AS recent_6m_volatility, count(*) AS months FROM ({_BACK}) b GROUP BY ts_code) r USING (ts_code)"""
_RECENT_DOUBLES = "latest_close latest_monthly_return recent_3m_return recent_6m_return recent_6m_volatility"


@query("recent_returns", _RECENT, _RECENT_DOUBLES)
def recent_returns(v):
    return op.recent_returns(v.sql(_GAPS))


@query("price_summary", f"SELECT *, {_RETURN_LABEL.format('recent_3m_return')} AS recent_3m_label, {_RETURN_LABEL.format('recent_6m_return')} AS recent_6m_label, {_RECENT_VOLATILITY_LABEL.format('recent_6m_volatility')} AS volatility_label FROM ({_RECENT}) r", _RECENT_DOUBLES)
def price_summary(v):
    return op.price_summary(v.sql(_GAPS))


@query("factor_history", "SELECT * FROM v_factor WHERE ts_code = 'S00003'", "factor_a factor_b")
def factor_history(v):
    return op.history(v.v_factor, "S00003")


@query("selection_history", f"SELECT trade_date, ts_code, score, rank FROM ({_CHOSEN}) c WHERE ts_code = 'S00003'", "score")
def selection_history(v):
    return op.history(_chosen(v).select("trade_date", "ts_code", "score", "rank"), "S00003")


@query("latest_snapshot", f"SELECT l.*, c.ts_code IS NOT NULL AS selected FROM ({_LAST.format('SELECT * FROM v_factor')}) l LEFT JOIN ({_CHOSEN}) c ON c.ts_code = l.ts_code AND c.trade_date = l.trade_date", "factor_a factor_b")
def latest_snapshot(v):
    return op.latest_snapshot(v.v_factor, _chosen(v))


@query("selection_frequency", f"SELECT ts_code, observed, selected, selected / observed AS frequency FROM (SELECT p.ts_code, count(DISTINCT p.trade_date) AS observed, count(DISTINCT c.trade_date) AS selected FROM v_pred p LEFT JOIN ({_CHOSEN}) c ON c.ts_code = p.ts_code AND c.trade_date = p.trade_date GROUP BY p.ts_code) f", "frequency")
def selection_frequency(v):
    return op.selection_frequency(v.v_pred, _chosen(v))


_HELD = """SELECT h.effective_date AS trade_date, h.ts_code, CASE WHEN rank = 2 THEN concat('name ', h.ts_code) END AS name, CASE WHEN rank < 3 THEN 0.3E0 ELSE target_weight END AS target_weight, score, rank,
    CASE WHEN rank = 1 THEN NULL ELSE 1 - rank / 10.0E0 END AS score_pct_rank, CASE WHEN rank = 4 THEN ' ' WHEN rank = 5 THEN NULL ELSE h.ts_code END AS industry FROM v_hold h"""
_LATEST = f"SELECT * REPLACE (coalesce(industry, '未知行业') AS industry) FROM ({_HELD}) h WHERE trade_date = (SELECT max(effective_date) FROM v_hold)"


def _latest(v):
    return op.latest_portfolio(v.sql(_HELD))


@query("latest_portfolio", _LATEST, "target_weight score score_pct_rank")
def latest_portfolio(v):
    return _latest(v)


@query("latest_portfolio_date", f"SELECT ts_code, max(try_cast(d AS DATE)) AS last_date FROM (SELECT ts_code, CASE WHEN rank = 1 THEN 'none' ELSE CAST(trade_date AS STRING) END AS d FROM ({_HELD}) h) t GROUP BY ts_code")
def latest_portfolio_date(v):
    return v.sql(f"SELECT ts_code, CASE WHEN rank = 1 THEN 'none' ELSE CAST(trade_date AS STRING) END AS d FROM ({_HELD}) h").groupBy("ts_code").agg(op.latest_portfolio_date(F.col("d")).alias("last_date"))


@query("industry_distribution", f"SELECT trade_date, coalesce(industry, '未知行业') AS industry, count(ts_code) AS count, sum(target_weight) AS weight FROM ({_HELD}) h GROUP BY 1, 2", "weight")
def industry_distribution(v):
    return op.industry_distribution(v.sql(_HELD))


@query("weight_distribution", f"SELECT trade_date, ts_code, target_weight, rank FROM ({_HELD}) h", "target_weight")
def weight_distribution(v):
    return op.weight_distribution(v.sql(_HELD))


@query(
    "portfolio_summary",
    f"""SELECT max(trade_date) AS latest_date, count(*) AS holding_count, count(DISTINCT industry) AS industry_count, max(CASE WHEN heavy = 1 THEN coalesce(name, ts_code) END) AS top_weight_stock, max(CASE WHEN good = 1 THEN coalesce(name, ts_code) END) AS top_score_stock,
        avg(score) AS average_score, avg(score_pct_rank) AS average_score_pct_rank FROM (SELECT *, row_number() OVER (ORDER BY target_weight DESC, rank) AS heavy, row_number() OVER (ORDER BY score DESC, rank) AS good FROM ({_LATEST}) l) o""",
    "average_score average_score_pct_rank",
)
def portfolio_summary(v):
    return op.portfolio_summary(_latest(v))


def _pairs(v):
    return ev.paired(v.v_long, v.v_label)


_IC_LABEL = "CASE WHEN ic_mean IS NULL OR ic_positive IS NULL THEN 'N/A' WHEN abs(ic_mean) >= 0.05 AND ic_positive >= 0.6 THEN '历史 IC 表现较强' WHEN abs(ic_mean) >= 0.03 AND ic_positive >= 0.5 THEN '历史 IC 表现中等' ELSE '历史 IC 表现较弱' END"
_MEAN_IC = "avg(ic) AS ic_mean, avg(CASE WHEN ic > 0 THEN 1.0 WHEN ic IS NOT NULL THEN 0.0 END) AS ic_positive"
_RANKED = f"SELECT factor_name, ic_mean, ic_positive, abs(ic_mean) AS abs_ic_mean, row_number() OVER (ORDER BY abs(ic_mean) DESC NULLS LAST, factor_name) AS place, {_IC_LABEL} AS effectiveness_label FROM (SELECT factor_name, {_MEAN_IC} FROM ({_IC}) i GROUP BY factor_name) s"


@query("ic_ranking", _RANKED, "ic_mean ic_positive abs_ic_mean")
def ic_ranking(v):
    return op.ic_ranking(ev.ic_summary(ev.ic_by_date(_pairs(v), 5)))


@query("top_factors", f"SELECT * FROM ({_RANKED}) r WHERE place = 1", "ic_mean ic_positive abs_ic_mean")
def top_factors(v):
    return op.top_factors(op.ic_ranking(ev.ic_summary(ev.ic_by_date(_pairs(v), 5))), 1)


@query("ic_label", f"SELECT factor_name, year, {_IC_LABEL} AS label FROM (SELECT factor_name, year(trade_date) AS year, {_MEAN_IC} FROM ({_IC}) i GROUP BY 1, 2) s")
def ic_label(v):
    yearly = ev.ic_by_date(_pairs(v), 5).groupBy("factor_name", F.year("trade_date").alias("year")).agg(F.avg("ic").alias("m"), F.avg((c("ic") > 0).cast("double")).alias("s"))
    return yearly.select("factor_name", "year", op.ic_label(c("m"), c("s")).alias("label"))


# a month of each year without a spread
_HOLED = f"SELECT factor_name, trade_date, CASE WHEN month(trade_date) <> 6 THEN spread END AS spread FROM ({_SPREADS}) x"


@query("long_short_report", f"SELECT factor_name, avg(spread) AS spread_mean, stddev_samp(spread) AS spread_std, avg(spread) / nullif(stddev_samp(spread), 0) AS spread_ir, avg(CASE WHEN spread > 0 THEN 1.0 ELSE 0.0 END) AS spread_positive, count(spread) AS n_dates FROM ({_HOLED}) s GROUP BY factor_name", "spread_mean spread_std spread_ir spread_positive")
def long_short_report(v):
    spreads = ev.long_short(ev.quantile_returns(_pairs(v), least=5))
    return op.long_short_report(spreads.withColumn("spread", F.when(F.month("trade_date") != 6, F.col("spread"))))


@query("group_return_report", f"SELECT factor_name, quantile, avg(group_return) AS mean_return, count(group_return) AS n FROM ({_QUANTILES}) q GROUP BY factor_name, quantile", "mean_return")
def group_return_report(v):
    return op.group_return_report(ev.quantile_returns(_pairs(v), least=5))


@query(
    "backtest_labels",
    f"""SELECT cumulative_return, max_drawdown, sharpe_ratio, win_rate,
        CASE WHEN cumulative_return IS NULL THEN 'N/A' WHEN cumulative_return >= 0.3 THEN '历史累计收益较高' WHEN cumulative_return >= 0.1 THEN '历史累计收益偏强' WHEN cumulative_return > -0.1 THEN '历史累计收益中性' WHEN cumulative_return > -0.3 THEN '历史累计收益偏弱' ELSE '历史累计收益较弱' END AS cumulative_return_label,
        CASE WHEN max_drawdown IS NULL THEN 'N/A' WHEN max_drawdown >= -0.05 THEN '历史回撤较低' WHEN max_drawdown >= -0.15 THEN '历史回撤中等' ELSE '历史回撤较高' END AS max_drawdown_label,
        CASE WHEN sharpe_ratio IS NULL THEN 'N/A' WHEN sharpe_ratio >= 1.5 THEN '历史夏普较高' WHEN sharpe_ratio >= 0.8 THEN '历史夏普中等偏高' WHEN sharpe_ratio >= 0 THEN '历史夏普一般' ELSE '历史夏普较弱' END AS sharpe_label,
        CASE WHEN win_rate IS NULL THEN 'N/A' WHEN win_rate >= 0.6 THEN '历史胜率较高' WHEN win_rate >= 0.45 THEN '历史胜率中等' ELSE '历史胜率偏低' END AS win_rate_label FROM ({_SMETRICS}) m""",
    "cumulative_return max_drawdown sharpe_ratio win_rate",
)
def backtest_labels(v):
    return op.backtest_labels(bt.simple_metrics(bt.simple_nav(_sret(v))))


_CURVE = f"SELECT trade_date, gross_return, cost, net_return, net_nav AS nav, net_nav / max(net_nav) OVER (ORDER BY trade_date ROWS UNBOUNDED PRECEDING) - 1 AS drawdown, turnover FROM ({_NAV}) n"


@query("nav_curve", _CURVE, "gross_return cost net_return nav drawdown turnover")
def nav_curve(v):
    return op.nav_curve(_nav(v))


@query("turnover_series", f"SELECT trade_date, turnover FROM ({_NAV}) n", "turnover")
def turnover_series(v):
    return op.series(_nav(v), ["turnover"])


@query("month_return_series", f"SELECT trade_date, net_return FROM ({_NAV}) n", "net_return")
def month_return_series(v):
    return op.series(_nav(v), ["net_return"])


@query("drawdown_series", f"SELECT trade_date, drawdown FROM ({_CURVE}) c", "drawdown")
def drawdown_series(v):
    return op.series(op.nav_curve(_nav(v)), ["drawdown"])


@query(
    "nav_vs_benchmark",
    f"SELECT n.trade_date, net_nav, net_return, b.nav AS benchmark_nav, net_nav / greatest(1, max(net_nav) OVER (ORDER BY n.trade_date ROWS UNBOUNDED PRECEDING)) - 1 AS drawdown, product(1 + net_return) OVER (PARTITION BY year(n.trade_date), month(n.trade_date) ORDER BY n.trade_date ROWS UNBOUNDED PRECEDING) - 1 AS month_return FROM ({_NAV}) n JOIN ({_BNAV}) b ON b.trade_date = n.trade_date",
    "net_nav net_return benchmark_nav drawdown month_return",
)
def nav_vs_benchmark(v):
    return op.nav_vs_benchmark(_nav(v), _bench(v))


@query("price_history", "SELECT trade_date, ts_code, close, ret FROM v_ret", "close ret")
def price_history(v):
    return op.series(v.v_ret, ["ts_code", "close", "ret"])


@query("close_trend", "SELECT trade_date, ts_code, close FROM v_day WHERE close IS NOT NULL", "close")
def close_trend(v):
    return op.series(v.v_day, ["ts_code", "close"], complete=True)


@query("month_return_trend", "SELECT trade_date, ts_code, ret FROM v_ret WHERE ret IS NOT NULL", "ret")
def month_return_trend(v):
    return op.series(v.v_ret, ["ts_code", "ret"], complete=True)


