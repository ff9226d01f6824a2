"""Queries of the cross-sectional transforms, over the monthly study."""

from __future__ import annotations


from ..operators import cross_section as op
from ..registry import query

_P = "PARTITION BY trade_date, factor_name"
_KEYS = "trade_date, ts_code, factor_name"
_FILL = f"SELECT {_KEYS}, coalesce(value, median(value) OVER ({_P})) AS value FROM v_long"


def _mad(source: str) -> str:
    return f"""SELECT {_KEYS}, CASE WHEN d > 0 AND value IS NOT NULL THEN greatest(m - 3 * 1.4826 * d, least(m + 3 * 1.4826 * d, value)) ELSE value END AS value
        FROM (SELECT *, median(abs(value - m)) OVER ({_P}) AS d FROM (SELECT *, median(value) OVER ({_P}) AS m FROM ({source}) a) b) c"""


def _z(source: str, least: int = 5) -> str:
    return f"""SELECT {_KEYS}, CASE WHEN value IS NOT NULL AND count(value) OVER ({_P}) >= {least} AND stddev_pop(value) OVER ({_P}) > 1e-12
        THEN (value - avg(value) OVER ({_P})) / nullif(stddev_pop(value) OVER ({_P}), 0) END AS value FROM ({source}) z"""


@query("fill_median", _FILL, "value")
def fill_median(v):
    return op.fill_median(v.v_long)


@query(
    "winsorize",
    f"""SELECT q.*, m.value AS by_mad FROM (SELECT {_KEYS}, CASE WHEN value IS NOT NULL THEN greatest(quantile_cont(value, 0.01) OVER ({_P}), least(quantile_cont(value, 0.99) OVER ({_P}), value)) END AS by_quantile FROM v_long) q
        JOIN ({_mad("SELECT * FROM v_long")}) m USING (trade_date, ts_code, factor_name)""",
    "by_quantile by_mad",
)
def winsorize(v):
    mad = op.winsorize(v.v_long).withColumnRenamed("value", "by_mad")
    return op.winsorize(v.v_long, "quantile").withColumnRenamed("value", "by_quantile").join(mad, ["trade_date", "ts_code", "factor_name"])


_RANK = f"rank() OVER ({_P} ORDER BY value NULLS LAST) + (count(*) OVER ({_P} ORDER BY value NULLS LAST RANGE BETWEEN CURRENT ROW AND CURRENT ROW) - 1) / 2.0"


@query(
    "standardize",
    f"""SELECT z.*, r.value AS by_rank FROM (SELECT {_KEYS}, value AS by_zscore FROM ({_z("SELECT * FROM v_long")}) a) z JOIN (
        SELECT {_KEYS}, CASE WHEN value IS NOT NULL AND count(value) OVER ({_P}) >= 5 THEN CASE WHEN min(value) OVER ({_P}) = max(value) OVER ({_P}) THEN 0 ELSE 2 * (({_RANK}) - 1) / nullif(count(value) OVER ({_P}) - 1, 0) - 1 END END AS value FROM v_long) r
        USING (trade_date, ts_code, factor_name)""",
    "by_zscore by_rank",
)
def standardize(v):
    ranks = op.standardize(v.v_long, "rank", 5).withColumnRenamed("value", "by_rank")
    return op.standardize(v.v_long, least=5).withColumnRenamed("value", "by_zscore").join(ranks, ["trade_date", "ts_code", "factor_name"])


_PREPARED = _z(f"SELECT {_KEYS}, CASE WHEN factor_name = 'factor_b' THEN -value ELSE value END AS value FROM ({_mad(_FILL)}) w")


@query("preprocess_factors", _PREPARED, "value")
def preprocess_factors(v):
    return op.preprocess(v.v_long, {"factor_b": -1}, least=5)


# size is lacking for some rows, the same for all of a section in April, and a third factor is a size itself
_EXPOSURE = "SELECT trade_date, ts_code, industry, CASE WHEN month(trade_date) = 4 THEN 8.0E0 WHEN turnover_rate > 6 THEN NULL ELSE ln(total_mv) END AS log_total_mv FROM v_month"
_LONG = "SELECT trade_date, ts_code, factor_name, value FROM v_long UNION ALL SELECT trade_date, ts_code, 'log_circ_mv', ln(total_mv) + turnover_rate FROM v_month"
_I = "PARTITION BY trade_date, factor_name, industry"
_NEUTRAL = f"""
    SELECT trade_date, ts_code, factor_name, CASE WHEN ok AND n >= 5 AND NOT flat AND n > design_rank THEN y - CASE WHEN xx > 1e-12 THEN xy / nullif(xx, 0) ELSE 0 END * x END AS value, n, design_rank, flat FROM (
    SELECT *, g + CASE WHEN xx > 1e-12 THEN 1 ELSE 0 END AS design_rank FROM (
    SELECT *, sum(x * x) OVER ({_P}) AS xx, sum(x * y) OVER ({_P}) AS xy, count(y) OVER ({_P}) AS n, count(DISTINCT CASE WHEN ok THEN industry END) OVER ({_P}) AS g FROM (
    SELECT *, z - avg(z) OVER ({_I}) AS x FROM (
    SELECT *, CASE WHEN ok THEN value - avg(CASE WHEN ok THEN value END) OVER ({_I}) END AS y, sized AND coalesce(spread <= 1e-12, TRUE) AS flat,
           CASE WHEN ok AND sized THEN (log_total_mv - avg(CASE WHEN ok THEN log_total_mv END) OVER ({_P})) / nullif(spread, 0) WHEN ok THEN 0 END AS z FROM (
    SELECT *, stddev_pop(CASE WHEN ok AND sized THEN log_total_mv END) OVER ({_P}) AS spread FROM (
    SELECT *, fit AND count(CASE WHEN fit THEN 1 END) OVER ({_I}) >= 2 AS ok FROM (
    SELECT l.*, e.industry, e.log_total_mv, factor_name <> 'log_circ_mv' AS sized, value IS NOT NULL AND e.industry IS NOT NULL AND (factor_name = 'log_circ_mv' OR e.log_total_mv IS NOT NULL) AS fit
    FROM ({_LONG}) l LEFT JOIN ({_EXPOSURE}) e ON l.trade_date = e.trade_date AND l.ts_code = e.ts_code) a0) a1) a) b) c) d) f"""


@query("neutralize", f"SELECT trade_date, ts_code, factor_name, value FROM ({_NEUTRAL}) r", "value")
def neutralize(v):
    return op.neutralize(v.sql(_LONG), v.sql(_EXPOSURE), 5).drop("n", "design_rank", "flat_size")


@query(
    "neutralize_section",
    f"""SELECT trade_date, factor_name, max(n) AS n, CAST(max(design_rank) AS BIGINT) AS design_rank,
        CASE WHEN max(n) < 5 THEN 'too few rows' WHEN bool_or(flat) THEN 'size is constant' WHEN max(n) <= max(design_rank) THEN 'no degree of freedom' ELSE 'neutralized' END AS status FROM ({_NEUTRAL}) r GROUP BY trade_date, factor_name""",
)
def neutralize_section(v):
    return op.neutralize_sections(op.neutralize(v.sql(_LONG), v.sql(_EXPOSURE), 5), 5)


_WIDE = "SELECT trade_date, ts_code, industry, forward_return, CASE WHEN turnover_rate > 2 THEN turnover_rate END AS x FROM v_ret"


def _fill(source: str) -> str:
    return f"SELECT * REPLACE (coalesce(x, median(x) OVER (PARTITION BY trade_date, industry), median(x) OVER (PARTITION BY trade_date)) AS x) FROM ({source}) a"


def _clip(source: str) -> str:
    return f"SELECT * REPLACE (CASE WHEN x IS NOT NULL THEN greatest(quantile_cont(x, 0.01) OVER (PARTITION BY trade_date), least(quantile_cont(x, 0.99) OVER (PARTITION BY trade_date), x)) END AS x) FROM ({source}) b"


def _score(source: str) -> str:
    return f"SELECT * REPLACE (CASE WHEN stddev_samp(x) OVER (PARTITION BY trade_date) > 1e-12 THEN (x - avg(x) OVER (PARTITION BY trade_date)) / nullif(stddev_samp(x) OVER (PARTITION BY trade_date), 0) END AS x) FROM ({source}) c"


@query("fill_by_industry", _fill(_WIDE), "x forward_return")
def fill_by_industry(v):
    return op.fill_by_industry(v.sql(_WIDE), "x")


@query("winsorize_simple", _clip(_WIDE), "x forward_return")
def winsorize_simple(v):
    return op.winsorize_simple(v.sql(_WIDE), "x")


@query("standardize_simple", _score(_WIDE), "x forward_return")
def standardize_simple(v):
    return op.standardize_simple(v.sql(_WIDE), "x")


@query("preprocess_simple", _score(_clip(_fill(f"{_WIDE} WHERE forward_return IS NOT NULL"))), "x forward_return")
def preprocess_simple(v):
    return op.preprocess_simple(v.sql(_WIDE), ["x"], "forward_return")


