"""Queries of factor evaluation and composition, over the monthly study."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import composition, cross_section
from ..operators import evaluation as op
from ..registry import query
from ..sources.panels import work_dir
from .cross_sections import _PREPARED

_S = "PARTITION BY trade_date, factor_name"


def _rank(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN rank() OVER ({_S} ORDER BY {x} NULLS LAST) + (count(*) OVER ({_S} ORDER BY {x} NULLS LAST RANGE BETWEEN CURRENT ROW AND CURRENT ROW) - 1) / 2.0 END"


def _corr(x: str, y: str) -> str:
    a, b = f"CASE WHEN {y} IS NOT NULL THEN {x} END", f"CASE WHEN {x} IS NOT NULL THEN {y} END"
    spread = f"stddev_pop({a}) * stddev_pop({b})"
    return f"CASE WHEN {spread} > 1e-15 THEN greatest(-1, least(1, covar_pop({a}, {b}) / nullif({spread}, 0))) END"


_PAIRS = f"""SELECT *, {_rank("x")} AS rx, {_rank("y")} AS ry FROM (
    SELECT l.trade_date, l.ts_code, l.factor_name, value, forward_return, CASE WHEN forward_return IS NOT NULL THEN value END AS x, CASE WHEN value IS NOT NULL THEN forward_return END AS y
    FROM v_long l LEFT JOIN v_label r ON l.trade_date = r.trade_date AND l.ts_code = r.ts_code) j"""
_IC = f"""SELECT trade_date, factor_name, CASE WHEN count(x) >= 5 THEN {_corr("x", "y")} END AS ic, CASE WHEN count(x) >= 5 THEN {_corr("rx", "ry")} END AS rank_ic,
    count(x) / count(*) AS coverage, count(x) AS n FROM ({_PAIRS}) p GROUP BY trade_date, factor_name"""


def _pairs(v):
    return op.paired(v.v_long, v.v_label)


@query("ic_by_date", _IC, "ic rank_ic coverage")
def ic_by_date(v):
    return op.ic_by_date(_pairs(v), 5)


def _moments(c: str) -> str:
    return f"avg({c}) AS {c}_mean, stddev_samp({c}) AS {c}_std, avg({c}) / nullif(stddev_samp({c}), 0) AS {c}_ir, avg(CASE WHEN {c} > 0 THEN 1.0 WHEN {c} IS NOT NULL THEN 0.0 END) AS {c}_positive"


@query("ic_summary", f"SELECT factor_name, {_moments('ic')}, {_moments('rank_ic')}, count(DISTINCT trade_date) AS periods, count(ic) AS n_dates, count(rank_ic) AS n_rank_dates, avg(coverage) AS coverage_mean, avg(n) AS n_mean FROM ({_IC}) i GROUP BY factor_name", "ic_mean ic_std ic_ir ic_positive rank_ic_mean rank_ic_std rank_ic_ir rank_ic_positive coverage_mean n_mean")
def ic_summary(v):
    return op.ic_summary(op.ic_by_date(_pairs(v), 5))


_PLACED = f"""SELECT *, CASE WHEN n >= 5 AND lo < hi AND x IS NOT NULL THEN CAST(least(floor((rx - 1) / nullif(n - 1, 0) * 5) + 1, 5) AS INT) END AS quantile FROM (SELECT *, count(x) OVER ({_S}) AS n, min(x) OVER ({_S}) AS lo, max(x) OVER ({_S}) AS hi FROM ({_PAIRS}) p) q"""
_QUANTILES = f"""SELECT e.trade_date, e.factor_name, e.quantile, universe_count, n_obs, n_obs / universe_count AS coverage, count(y) AS group_count, avg(y) AS group_return FROM (
    SELECT trade_date, factor_name, CAST(u.q AS INT) AS quantile, count(*) AS universe_count, count(x) AS n_obs FROM ({_PAIRS}) a, (SELECT unnest(range(1, 6)) AS q) u GROUP BY trade_date, factor_name, u.q) e
    LEFT JOIN ({_PLACED}) p ON e.trade_date = p.trade_date AND e.factor_name = p.factor_name AND e.quantile = p.quantile GROUP BY e.trade_date, e.factor_name, e.quantile, universe_count, n_obs"""


@query("quantile_returns", _QUANTILES, "group_return coverage")
def quantile_returns(v):
    return op.quantile_returns(_pairs(v), least=5)


_SPREADS = f"""SELECT trade_date, factor_name, max(CASE WHEN quantile = 1 THEN group_return END) AS low_return, max(CASE WHEN quantile = 5 THEN group_return END) AS high_return,
    max(CASE WHEN quantile = 5 THEN group_return END) - max(CASE WHEN quantile = 1 THEN group_return END) AS spread, count(group_return) AS nonempty_groups, {_corr("rq", "rr")} AS monotonicity, max(coverage) AS coverage, max(n_obs) AS n_obs FROM (
    SELECT *, {_rank("q")} AS rq, {_rank("group_return")} AS rr FROM (SELECT *, CASE WHEN group_return IS NOT NULL THEN quantile END AS q FROM ({_QUANTILES}) a) b) c GROUP BY trade_date, factor_name"""


@query("long_short", _SPREADS, "low_return high_return spread monotonicity coverage")
def long_short(v):
    return op.long_short(op.quantile_returns(_pairs(v), least=5))


def _stats(c: str, p: str) -> str:
    return f"avg({c}) AS {p}_mean, stddev_samp({c}) AS {p}_std, CASE WHEN stddev_samp({c}) > 1e-12 THEN avg({c}) / nullif(stddev_samp({c}), 0) END AS {p}_ir, avg(CASE WHEN {c} > 0 THEN 1.0 WHEN {c} IS NOT NULL THEN 0.0 END) AS {p}_positive"


@query("quantile_summary", f"SELECT factor_name, quantile, {_stats('group_return', 'return')}, avg(group_count) AS size_mean, count(group_return) AS n_dates FROM ({_QUANTILES}) q GROUP BY factor_name, quantile", "return_mean return_std return_ir return_positive size_mean")
def quantile_summary(v):
    return op.quantile_summary(op.quantile_returns(_pairs(v), least=5))


_LS_SUMMARY = f"""SELECT factor_name, {_stats('spread', 'spread')}, count(DISTINCT trade_date) AS periods, count(spread) AS n_dates, count(monotonicity) AS n_monotonicity, avg(monotonicity) AS monotonicity_mean,
    avg(CASE WHEN monotonicity > 0 THEN 1.0 WHEN monotonicity IS NOT NULL THEN 0.0 END) AS monotonicity_positive, avg(coverage) AS coverage_mean, avg(n_obs) AS n_mean FROM ({_SPREADS}) s GROUP BY factor_name"""


@query("long_short_summary", _LS_SUMMARY, "spread_mean spread_std spread_ir spread_positive monotonicity_mean monotonicity_positive coverage_mean n_mean")
def long_short_summary(v):
    return op.long_short_summary(op.long_short(op.quantile_returns(_pairs(v), least=5)))


@query("evaluate_panel", f"SELECT s.*, i.rank_ic_mean FROM ({_LS_SUMMARY}) s JOIN (SELECT factor_name, avg(rank_ic) AS rank_ic_mean FROM ({_IC}) i GROUP BY factor_name) i USING (factor_name)", "spread_mean spread_std spread_ir spread_positive monotonicity_mean monotonicity_positive coverage_mean n_mean rank_ic_mean")
def evaluate_panel(v):
    tables = op.evaluate(v.v_long, v.v_label, least=5)
    return tables["long_short_summary"].join(tables["ic_summary"].select("factor_name", "rank_ic_mean"), "factor_name")


_RANK_IC = f"SELECT trade_date, factor_name, {_corr('rx', 'ry')} AS rank_ic FROM ({_PAIRS}) p GROUP BY trade_date, factor_name HAVING count(x) >= 3 AND {_corr('rx', 'ry')} IS NOT NULL"


@query("monthly_rank_ic", f"SELECT * FROM ({_RANK_IC}) r WHERE factor_name = 'factor_a'", "rank_ic")
def monthly_rank_ic(v):
    return op.rank_ic(op.paired(v.v_long.where("factor_name = 'factor_a'"), v.v_label))


@query(
    "ic_stats",
    f"SELECT factor_name, avg(rank_ic) AS mean, stddev_samp(rank_ic) AS std, avg(rank_ic) / nullif(stddev_samp(rank_ic), 0) AS ir, avg(rank_ic) / nullif(stddev_samp(rank_ic) / sqrt(count(rank_ic)), 0) AS t_stat, avg(CASE WHEN rank_ic > 0 THEN 1.0 ELSE 0.0 END) AS positive, count(rank_ic) AS n FROM ({_RANK_IC}) r GROUP BY factor_name",
    "mean std ir t_stat positive",
)
def ic_stats(v):
    return op.ic_stats(op.rank_ic(_pairs(v)))


@query("batch_ic", f"SELECT trade_date, max(CASE WHEN factor_name = 'factor_a' THEN rank_ic END) AS factor_a, max(CASE WHEN factor_name = 'factor_b' THEN rank_ic END) AS factor_b FROM ({_RANK_IC}) r GROUP BY trade_date", "factor_a factor_b")
def batch_ic(v):
    return op.wide_ic(op.rank_ic(_pairs(v)), ["factor_a", "factor_b"])


_QCUT = f"""SELECT trade_date, factor_name, quantile, avg(y) AS group_return, count(*) AS group_count FROM (
    SELECT *, CAST(CASE WHEN len(list_distinct(list_transform(e, lambda z: round(z, 9)))) = 6 THEN greatest(1, len(list_filter(e, lambda z: round(z, 9) < round(x, 9)))) ELSE least(greatest(1, ceil((f - 1) / nullif((n - 1) / 5, 0))), 5) END AS INT) AS quantile FROM (
    SELECT *, count(x) OVER ({_S}) AS n, row_number() OVER ({_S} ORDER BY x, ts_code) AS f, quantile_cont(x, [0, 0.2, 0.4, 0.6, 0.8, 1.0]) OVER ({_S}) AS e FROM ({_PAIRS}) p WHERE x IS NOT NULL) q WHERE n >= 5) g GROUP BY trade_date, factor_name, quantile"""


@query("qcut_returns", f"SELECT * FROM ({_QCUT}) q WHERE factor_name = 'factor_a'", "group_return")
def qcut_returns(v):
    return op.qcut_returns(op.paired(v.v_long.where("factor_name = 'factor_a'"), v.v_label))


@query("batch_qcut", _QCUT, "group_return")
def batch_qcut(v):
    return op.qcut_returns(_pairs(v))


@query("q5_minus_q1", f"SELECT trade_date, factor_name, max(CASE WHEN quantile = 5 THEN group_return END) - max(CASE WHEN quantile = 1 THEN group_return END) AS spread FROM ({_QCUT}) q GROUP BY trade_date, factor_name HAVING max(CASE WHEN quantile = 5 THEN group_return END) - max(CASE WHEN quantile = 1 THEN group_return END) IS NOT NULL", "spread")
def q5_minus_q1(v):
    return op.high_minus_low(op.qcut_returns(_pairs(v)))


_W = "(SELECT 'factor_a' AS factor_name, 0.75E0 AS weight UNION ALL SELECT 'factor_b', 0.25E0)"


@query("resolve_weights", f"SELECT factor_name, weight, count(value) AS n_values FROM v_long JOIN {_W} w USING (factor_name) GROUP BY factor_name, weight", "weight")
def resolve_weights(v):
    weights = composition.resolve_weights(v.spark, ["factor_a", "factor_b"], {"factor_a": 3.0, "factor_b": 1.0})
    return v.v_long.groupBy("factor_name").agg({"value": "count"}).withColumnRenamed("count(value)", "n_values").join(weights, "factor_name").select("factor_name", "weight", "n_values")


# weights that don't sum to 1, so that a score divided by the valid weight shows
_RAW_W = "(SELECT 'factor_a' AS factor_name, 3E0 AS weight UNION ALL SELECT 'factor_b', 1E0)"


def _composed(weights: str, key: str, used: str) -> str:
    valid = f"value IS NOT NULL AND {used}"
    return f"""SELECT trade_date, ts_code, sum(CASE WHEN {valid} THEN weight * value END) / nullif(sum(CASE WHEN {valid} THEN weight ELSE 0 END), 0) AS score, count(CASE WHEN {valid} THEN 1 END) AS valid_count,
        sum(CASE WHEN {valid} THEN weight ELSE 0 END) / nullif(sum(CASE WHEN {used} THEN weight END), 0) AS weight_coverage FROM ({_PREPARED}) l JOIN ({weights}) w USING ({key}) GROUP BY trade_date, ts_code"""


_ALL_OR_NONE = f"SELECT trade_date, ts_code, CASE WHEN count(value) = count(*) THEN sum(weight * value) END AS complete_score FROM ({_PREPARED}) l JOIN {_RAW_W} w USING (factor_name) GROUP BY trade_date, ts_code"


@query("compose_score", f"SELECT c.*, complete_score FROM ({_composed(f'SELECT * FROM {_RAW_W} x', 'factor_name', 'TRUE')}) c JOIN ({_ALL_OR_NONE}) a USING (trade_date, ts_code)", "score weight_coverage complete_score")
def compose_score(v):
    weights = composition.resolve_weights(v.spark, ["factor_a", "factor_b"], {"factor_a": 3.0, "factor_b": 1.0}, normalize=False)
    prepared = _prepared(v)
    complete = composition.compose(prepared, weights, renormalize=False).select("trade_date", "ts_code", F.col("score").alias("complete_score"))
    return composition.compose(prepared, weights).join(complete, ["trade_date", "ts_code"])


_HISTORY = f"""SELECT e.trade_date, e.factor_name, count(rank_ic) AS history_periods, min(p.known) AS history_start, max(p.known) AS history_end, avg(rank_ic) AS historical_mean, CASE WHEN count(rank_ic) >= 3 THEN greatest(avg(rank_ic), 0) END AS raw
    FROM (SELECT DISTINCT trade_date, factor_name FROM v_long) e LEFT JOIN (
    SELECT d.trade_date, i.factor_name, i.trade_date AS known, i.rank_ic, row_number() OVER (PARTITION BY d.trade_date, i.factor_name ORDER BY i.trade_date DESC) AS n FROM (SELECT DISTINCT trade_date FROM v_long) d JOIN ({_IC}) i ON i.trade_date < d.trade_date AND i.rank_ic IS NOT NULL) p
    ON e.trade_date = p.trade_date AND e.factor_name = p.factor_name AND n <= 6 GROUP BY e.trade_date, e.factor_name"""
_ROLLING = f"SELECT trade_date, factor_name, history_periods, history_start, history_end, historical_mean, raw, CASE WHEN total > 0 THEN coalesce(raw / total, 0) ELSE 0.5 END AS weight, total <= 0 AS fallback FROM (SELECT *, coalesce(sum(raw) OVER (PARTITION BY trade_date), 0) AS total FROM ({_HISTORY}) r) t"


def _prepared(v):
    """The prepared factors as a table, as scores and coefficients both read them."""
    prepared = cross_section.preprocess(v.v_long, {"factor_b": -1}, least=5)
    path = work_dir(v.spark, "prepared-factors")
    prepared.write.parquet(path)
    return v.spark.read.schema(prepared.schema).parquet(path)


def _rolling(v):
    return composition.rolling_ic_weights(v.v_long, op.ic_by_date(_pairs(v), 5), ["factor_a", "factor_b"], 6, 3)


@query("rolling_ic_weights", _ROLLING, "historical_mean raw weight")
def rolling_ic_weights(v):
    return _rolling(v)


@query("compose_dynamic", _composed(f"SELECT trade_date, factor_name, weight FROM ({_ROLLING}) x", "trade_date, factor_name", "weight > 0"), "score weight_coverage")
def compose_dynamic(v):
    return composition.compose(_prepared(v), _rolling(v).select("trade_date", "factor_name", "weight"))


_SCORED = """SELECT *, CASE WHEN score IS NOT NULL THEN row_number() OVER (PARTITION BY trade_date ORDER BY score DESC NULLS LAST, ts_code) END AS rank,
    CASE WHEN score IS NOT NULL THEN rank() OVER (PARTITION BY trade_date ORDER BY score NULLS LAST) + (count(*) OVER (PARTITION BY trade_date ORDER BY score NULLS LAST RANGE BETWEEN CURRENT ROW AND CURRENT ROW) - 1) / 2.0 END / nullif(count(score) OVER (PARTITION BY trade_date), 0) AS percentile
    FROM (SELECT trade_date, ts_code, factor_a, factor_b, CASE WHEN factor_a IS NOT NULL OR factor_b IS NOT NULL THEN coalesce(factor_a, 0) * 0.5 - coalesce(factor_b, 0) * 0.5 END AS score FROM v_factor) f"""


@query("composite_score", _SCORED, "factor_a factor_b score percentile")
def composite_score(v):
    return composition.composite_score(v.v_factor.select("trade_date", "ts_code", "factor_a", "factor_b"), ["factor_a", "factor_b"], {"factor_b": -1})


@query("top_n", "SELECT trade_date, ts_code, factor_a AS score, n AS selected_rank FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY factor_a DESC NULLS LAST, ts_code) AS n FROM v_factor) f WHERE n <= 5 AND factor_a IS NOT NULL", "score")
def top_n(v):
    return composition.top_n(v.v_factor.selectExpr("trade_date", "ts_code", "factor_a AS score"), 5)


@query("scoring_run", f"SELECT *, rank AS selected_rank FROM ({_SCORED}) s WHERE rank <= 5", "factor_a factor_b score percentile")
def scoring_run(v):
    return composition.scoring_run(v.v_factor.select("trade_date", "ts_code", "factor_a", "factor_b"), ["factor_a", "factor_b"], 5, {"factor_b": -1})
