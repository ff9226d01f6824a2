"""Queries of the time-series factors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import factors as op
from ..registry import query

_W = "OVER (PARTITION BY ts_code ORDER BY trade_date)"
_RET = f"(SELECT *, close / nullif(lag(close) {_W}, 0) - 1 AS ret FROM v_day)"


def _frame(aggregate: str, x: str, n: int) -> str:
    w = f"OVER (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {w} = {n} THEN {aggregate}({x}) {w} END"


#: name -> (view, SQL of the factor over it)
_SQL = {
    "momentum_20d": (f"close / nullif(lag(close, 20) {_W}, 0) - 1", "v_day"),
    "momentum_60d": (f"close / nullif(lag(close, 60) {_W}, 0) - 1", "v_day"),
    "momentum_120d": (f"close / nullif(lag(close, 120) {_W}, 0) - 1", "v_day"),
    "momentum_252_20d": (f"lag(close, 20) {_W} / nullif(lag(close, 252) {_W}, 0) - 1", "v_day"),
    "reversal_5d": (f"-(close / nullif(lag(close, 5) {_W}, 0) - 1)", "v_day"),
    "high_52w": (f"close / nullif({_frame('max', 'close', 252)}, 0)", "v_day"),
    "volatility_20d": (_frame("stddev_samp", "ret", 20), _RET),
    "volatility_60d": (_frame("stddev_samp", "ret", 60), _RET),
    "turnover_mean_20d": (_frame("avg", "turnover_rate", 20), "v_day"),
    "amihud_20d": (_frame("avg", "x", 20), f"(SELECT *, abs(ret) / nullif(amount, 0) AS x FROM {_RET} r)"),
    "ep_ttm": ("CASE WHEN pe_ttm > 0 THEN 1 / pe_ttm END", "v_valuation"),
    "bp": ("CASE WHEN pb > 0 THEN 1 / pb END", "v_valuation"),
    "sp_ttm": ("CASE WHEN ps_ttm > 0 THEN 1 / ps_ttm END", "v_valuation"),
    "dividend_yield_ttm": ("CASE WHEN dv_ttm >= 0 THEN dv_ttm END", "v_valuation"),
    "log_total_mv": ("CASE WHEN total_mv > 0 THEN ln(total_mv) END", "v_valuation"),
    "log_circ_mv": ("CASE WHEN circ_mv > 0 THEN ln(circ_mv) END", "v_valuation"),
}


def _register(name: str, expression: str, source: str) -> None:
    view = "v_valuation" if source == "v_valuation" else "v_day"

    @query(name, f"SELECT ts_code, trade_date, {expression} AS {name} FROM {source} AS panel", name)
    def run(v):
        return op.factor_panel(getattr(v, view), [name])


for _name, (_expression, _source) in _SQL.items():
    _register(_name, _expression, _source)

# financial factors: the announced value of the code, with infinities and NaN among the rows
_FIN = "SELECT ts_code, ann_date AS trade_date, CASE WHEN value > 400000 THEN CAST('Infinity' AS DOUBLE) WHEN value < 20000 THEN CAST('NaN' AS DOUBLE) ELSE value / 1000000 END AS raw FROM v_financial"


def _register_financial(name: str) -> None:
    @query(name, f"SELECT ts_code, trade_date, CASE WHEN NOT isnan(raw) AND NOT isinf(raw) THEN raw END AS {name} FROM ({_FIN}) f", name)
    def run(v):
        return op.factor_panel(v.sql(_FIN).withColumnRenamed("raw", name), [name])


for _name in op.FINANCIAL:
    _register_financial(_name)

_PANEL = ["momentum_20d", "volatility_20d", "turnover_mean_20d", "high_52w"]


@query(
    "factor_panel",
    f"SELECT ts_code, trade_date, {', '.join(f'{_SQL[n][0]} AS {n}' for n in _PANEL)} FROM {_RET} r",
    " ".join(_PANEL),
)
def factor_panel(v):
    return op.factor_panel(v.v_day, _PANEL)


_BARS = f"SELECT ts_code, trade_date, close, amount, lag(close) {_W} AS pre_close FROM v_month"


@query(
    "monthly_return",
    f"SELECT ts_code, last_day(trade_date) AS trade_date, close, amount, CASE WHEN pre_close > 0 THEN close / pre_close - 1 END AS monthly_return FROM ({_BARS}) b",
    "close amount monthly_return",
)
def monthly_return(v):
    return op.monthly_return(v.sql(_BARS))


@query(
    "month_end_basics",
    "SELECT ts_code, last_day(trade_date) AS trade_date, close, turnover_rate FROM (SELECT *, row_number() OVER (PARTITION BY ts_code, year(trade_date), month(trade_date) ORDER BY trade_date DESC) AS n FROM v_day) d WHERE n = 1",
    "close turnover_rate",
)
def month_end_basics(v):
    return op.month_end(v.v_day.select("ts_code", "trade_date", "close", "turnover_rate"))


_PREV3 = "OVER (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)"


@query(
    "compound_return_lagged",
    f"SELECT ts_code, trade_date, CASE WHEN count(ret) {_PREV3} = 3 THEN product(1 + ret) {_PREV3} - 1 END AS compound FROM v_ret",
    "compound",
)
def compound_return_lagged(v):
    return v.v_ret.select("ts_code", "trade_date", op.compound_lagged("ret", 3).alias("compound"))


_BASE = "SELECT ts_code, trade_date, (turnover_rate - 4) * 10 AS pe, close / 1000 - 0.5 AS pb, CASE WHEN amount > 30000 THEN amount END AS ps, total_mv, turnover_rate, amount, ret AS monthly_return FROM v_ret"


def _prev(n: int) -> str:
    return f"OVER (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


@query(
    "base_factors",
    f"""SELECT ts_code, trade_date, CASE WHEN pe > 0 THEN 1 / pe END AS ep, CASE WHEN pb > 0 THEN 1 / pb END AS bp, CASE WHEN ps > 0 THEN 1 / ps END AS ps_inverse,
        CASE WHEN total_mv > 0 THEN -ln(total_mv) END AS size, turnover_rate AS turnover, CASE WHEN amount > 0 THEN ln(amount) END AS amount,
        CASE WHEN count(monthly_return) {_prev(1)} = 1 THEN product(1 + monthly_return) {_prev(1)} - 1 END AS momentum_1m,
        CASE WHEN count(monthly_return) {_prev(3)} = 3 THEN product(1 + monthly_return) {_prev(3)} - 1 END AS momentum_3m,
        CASE WHEN count(monthly_return) {_prev(6)} = 6 THEN stddev_samp(monthly_return) {_prev(6)} END AS volatility_6m FROM ({_BASE}) p""",
    "ep bp ps_inverse size turnover amount momentum_1m momentum_3m volatility_6m",
)
def base_factors(v):
    return op.base_factors(v.sql(_BASE))


@query("next_return", f"SELECT ts_code, trade_date, ret, lead(ret) {_W} AS next_return FROM v_ret", "ret next_return")
def next_return(v):
    return op.next_return(v.v_ret.select("ts_code", "trade_date", "ret"), "ret")


@query("user_factor", "SELECT ts_code, trade_date, CASE WHEN count(*) OVER w = 5 THEN avg(sqrt(amount / vol)) OVER w END AS mean_price FROM v_day WINDOW w AS (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)", "mean_price")
def user_factor(v):
    return op.user_factor(v.v_day, "mean_price", lambda rows: ((rows["amount"] / rows["vol"]) ** 0.5).rolling(5).mean(), ["amount", "vol"], lookback=4, chunk=500)


@query(
    "factors_by_category",
    "SELECT ts_code, trade_date, CASE WHEN pe_ttm > 0 THEN 1 / pe_ttm END AS ep_ttm, CASE WHEN pb > 0 THEN 1 / pb END AS bp, CASE WHEN ps_ttm > 0 THEN 1 / ps_ttm END AS sp_ttm, CASE WHEN dv_ttm >= 0 THEN dv_ttm END AS dividend_yield_ttm FROM v_valuation",
    "ep_ttm bp sp_ttm dividend_yield_ttm",
)
def factors_by_category(v):
    names = [r[0] for r in op.factors_by_category(op.factor_metadata(v.spark), "valuation").select("factor_name").collect()]
    return op.factor_panel(v.v_valuation, names)


@query(
    "factor_describe",
    "SELECT ts_code, CAST(252 AS INT) AS lookback, CAST(0 AS INT) AS lag, count(*) > 252 AS enough FROM v_day GROUP BY ts_code",
)
def factor_describe(v):
    need = op.describe_requirements(op.factor_metadata(v.spark), _PANEL + ["momentum_252_20d"])
    return v.v_day.groupBy("ts_code").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(need)).select("ts_code", "lookback", "lag", (F.col("n") > F.col("lookback")).alias("enough"))
