"""Queries of whole studies."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..operators import calendars as cal
from ..operators import composition, learning
from ..operators import studies as op
from ..registry import query
from ..operators import universes
from .cross_sections import _PREPARED
from .evaluations import _IC, _moments
from .learning import _COEF, _FEATURES, _METRICS, _OOS, _kept, _panel, _plan, _prepared, _ridge, _shuffled

_STUDY = _IC.replace("FROM v_long l", f"FROM ({_PREPARED}) l")


@query("factor_study", f"SELECT factor_name, {_moments('ic')}, {_moments('rank_ic')}, count(DISTINCT trade_date) AS periods, count(ic) AS n_dates, count(rank_ic) AS n_rank_dates, avg(coverage) AS coverage_mean, avg(n) AS n_mean FROM ({_STUDY}) i GROUP BY factor_name", "ic_mean ic_std ic_ir ic_positive rank_ic_mean rank_ic_std rank_ic_ir rank_ic_positive coverage_mean n_mean")
def factor_study(v):
    weights = composition.resolve_weights(v.spark, ["factor_a", "factor_b"])
    return op.factor_study(v.v_long, v.v_label, {"factor_b": -1}, weights, 5)["ic_summary"]


@query("research_plan", "SELECT 'daily' AS dataset_id, s.cal_date AS start_date, e.cal_date AS end_date FROM v_open s, v_open e WHERE s.pos = (SELECT min(pos) - 251 FROM v_open WHERE cal_date >= DATE '1998-01-01') AND e.pos = (SELECT max(pos) + 21 FROM v_open WHERE cal_date <= DATE '1999-12-31')")
def research_plan(v):
    return op.research_plan(v.spark, ["momentum_20d", "high_52w"], cal.open_days(v.v_calendar), datetime.date(1998, 1, 1), datetime.date(1999, 12, 31), 1, 20)


@query("portfolio_requirements", "SELECT s.cal_date AS start_date, f.last AS end_date FROM (SELECT min(d) AS first, max(d) AS last FROM (SELECT max(cal_date) AS d FROM v_open GROUP BY year(cal_date), month(cal_date)) m WHERE d >= DATE '1995-06-01') f JOIN v_open o ON o.cal_date = f.first JOIN v_open s ON s.pos = o.pos - 59")
def portfolio_requirements(v):
    days = cal.open_days(v.v_calendar)
    return op.portfolio_requirements(cal.formation_dates(days).where("formation_date >= DATE '1995-06-01'"), days, 60)


@query("ml_history_need", "SELECT ts_code, count(*) AS periods, count(*) >= 45 AS enough FROM v_month GROUP BY ts_code")
def ml_history_need(v):
    need = op.history_need(36, 6, 1, 1, 1)
    return v.v_month.groupBy("ts_code").agg(F.count(F.lit(1)).alias("periods")).withColumn("enough", F.col("periods") >= need)


# a pool's name for every customer, in mixed case, of which an index by its code is one
_POOLS = "SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN ' hs300 ' WHEN 1 THEN 'CSI300' WHEN 2 THEN 'all' WHEN 3 THEN 'All_A_Shares' WHEN 4 THEN '000905.sh' ELSE concat(CAST(c_nationkey AS STRING), '.SZ') END AS pool FROM customer"


@query(
    "universe_alias",
    f"""SELECT c_custkey, CASE WHEN p IN ('ALL', 'ALL_A_SHARES') THEN 'ALL_A_SHARES' ELSE 'INDEX' END AS kind, CASE WHEN p IN ('HS300', 'CSI300') THEN '000300.SH' WHEN p NOT IN ('ALL', 'ALL_A_SHARES') THEN p END AS code FROM (SELECT c_custkey, upper(trim(pool)) AS p FROM ({_POOLS}) q) u""",
)
def universe_alias(v):
    return v.sql(_POOLS).select("c_custkey", universes.universe_from_alias(F.col("pool")).alias("u")).select("c_custkey", "u.kind", "u.code")


@query("train_table_experiment", f"SELECT m.*, i.feature AS top_feature FROM (SELECT fold_id, {_METRICS} FROM ({_OOS}) o GROUP BY fold_id) m JOIN (SELECT *, row_number() OVER (PARTITION BY fold_id ORDER BY abs(coefficient) DESC, feature) AS place FROM ({_COEF}) c WHERE feature <> 'intercept') i ON i.fold_id = m.fold_id AND place = 1", "mae rmse r2")
def train_table_experiment(v):
    tables = op.train_table_experiment(_kept(v, _panel(v), "panel"), _plan(v), _FEATURES, "forward_return", 1.0)
    top = tables["importances"].where("place = 1").select("fold_id", F.col("feature").alias("top_feature"))
    return tables["folds"].select("fold_id", "n", "mae", "rmse", "r2", "r2_reason").join(top, "fold_id")


@query("permutation_loss", f"SELECT fold_id, {_METRICS} FROM (SELECT fold_id, y AS target, w0 + moved_a * wa + factor_b * wb AS prediction FROM ({_shuffled('[0]')}) s) o GROUP BY fold_id", "mae rmse r2")
def permutation_loss(v):
    shuffled = learning.permute_in_date(_prepared(v).where("role = 'prediction'"), "factor_a", 7, ["fold_id"])
    return learning.regression_metrics(learning.predict(shuffled, _ridge(v), _FEATURES, "forward_return"), ["fold_id"])
