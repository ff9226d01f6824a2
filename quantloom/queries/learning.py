"""Queries of walk-forward learning, over the monthly study."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.math import correlation
from ..operators import boosting
from ..operators import learning as op
from ..registry import query
from ..sources.panels import work_dir

_PANEL = "SELECT r.trade_date, r.ts_code, ret AS factor_a, CASE WHEN turnover_rate > 2 THEN turnover_rate END AS factor_b, forward_return, lead(trade_date) OVER (PARTITION BY ts_code ORDER BY trade_date) AS exit_date FROM v_ret r"
_DATES = f"SELECT trade_date, max(exit_date) AS max_exit FROM ({_PANEL}) p GROUP BY trade_date"
_FEATURES = ["factor_a", "factor_b"]
_BOOSTING = boosting.Boosting(trees=10, depth=3, rate=0.2, bins=32, least_rows=10, patience=3)


def _panel(v):
    return v.sql(_PANEL)


def _kept(v, frame, name: str):
    """The rows as a table, as several steps read them."""
    path = work_dir(v.spark, name)
    frame.write.parquet(path)
    return v.spark.read.schema(frame.schema).parquet(path)


def _plan(v):
    dates = _kept(v, v.sql(_DATES), "dates")
    return _kept(v, op.walk_forward_plan(dates, 36, 6, 1, 12), "plan")


_PLACED = f"SELECT trade_date, max_exit, row_number() OVER (ORDER BY trade_date) - 1 AS pos FROM ({_DATES}) d"
_VALID = f"SELECT * FROM (SELECT s.pos AS start, d.trade_date, row_number() OVER (PARTITION BY s.pos ORDER BY d.trade_date DESC) AS n FROM ({_PLACED}) s JOIN ({_PLACED}) d ON d.trade_date < s.trade_date AND d.max_exit < s.trade_date) k WHERE n BETWEEN 2 AND 7"
_TRAIN = f"SELECT o.start, d.trade_date, row_number() OVER (PARTITION BY o.start ORDER BY d.trade_date DESC) AS n FROM (SELECT start, min(trade_date) AS opening FROM ({_VALID}) v GROUP BY start HAVING count(*) = 6) o JOIN ({_PLACED}) d ON d.trade_date < o.opening AND d.max_exit < o.opening"
_BLOCKS = f"SELECT start, CAST((start - first) // 12 AS INT) AS fold_id FROM (SELECT start, min(start) OVER () AS first FROM ({_TRAIN}) t WHERE n = 36) f WHERE (start - first) % 12 = 0"
_PLAN = f"""SELECT fold_id, 'train' AS role, trade_date FROM ({_TRAIN}) t JOIN ({_BLOCKS}) b USING (start) WHERE n <= 36
    UNION ALL SELECT fold_id, 'validation', trade_date FROM ({_VALID}) v JOIN ({_BLOCKS}) b USING (start)
    UNION ALL SELECT fold_id, 'prediction', trade_date FROM ({_PLACED}) p JOIN ({_BLOCKS}) b ON p.pos BETWEEN b.start AND b.start + 11"""


@query("walk_forward_plan", _PLAN)
def walk_forward_plan(v):
    return _plan(v)


@query("walk_forward_window", f"SELECT fold_id, role, min(trade_date) AS first_date, max(trade_date) AS last_date, count(*) AS dates FROM ({_PLAN}) p GROUP BY fold_id, role")
def walk_forward_window(v):
    return op.walk_forward_window(_plan(v))


_SPLIT = f"SELECT p.*, fold_id, role FROM ({_PANEL}) p JOIN ({_PLAN}) q ON q.trade_date = p.trade_date"


def _split(v):
    return op.materialize_split(_panel(v), _plan(v))


@query("materialize_split", _SPLIT, "factor_a factor_b forward_return")
def materialize_split(v):
    return _split(v)


@query("leakage_rules", " UNION ALL ".join(f"SELECT '{n}' AS rule, count(CASE WHEN {c} THEN 1 END) AS violations FROM (SELECT min(CASE WHEN role = 'validation' THEN trade_date END) AS v, min(CASE WHEN role = 'prediction' THEN trade_date END) AS p, max(CASE WHEN role = 'train' THEN exit_date END) AS te, max(CASE WHEN role = 'validation' THEN exit_date END) AS ve, max(CASE WHEN role = 'train' THEN trade_date END) AS t, max(CASE WHEN role = 'validation' THEN trade_date END) AS vl FROM ({_SPLIT}) s GROUP BY fold_id) f" for n, c in {"train_exit_reaches_validation": "te >= v", "validation_exit_reaches_prediction": "ve >= p", "roles_out_of_order": "t >= v OR vl >= p"}.items()))
def leakage_rules(v):
    return op.leakage_rules(_split(v))


def _each(t: str) -> str:
    return ", ".join(t.format(f=f) for f in _FEATURES)


_FILLED = f"SELECT * REPLACE ({_each('coalesce({f}, median(CASE WHEN role = ' + chr(39) + 'train' + chr(39) + ' THEN {f} END) OVER (PARTITION BY fold_id)) AS {f}')}) FROM ({_SPLIT}) s"
_TRAIN = "CASE WHEN role = 'train' THEN {f} END"
_PREPARED = f"SELECT * REPLACE ({_each('coalesce(({f} - avg(' + _TRAIN + ') OVER (PARTITION BY fold_id)) / nullif(stddev_pop(' + _TRAIN + ') OVER (PARTITION BY fold_id), 0), 0) AS {f}')}) FROM ({_FILLED}) f"


def _prepared(v):
    return op.prepare(_split(v), _FEATURES)


def _written(v):
    return _kept(v, _prepared(v), "prepared")


@query("ml_prepare", _PREPARED, "factor_a factor_b forward_return")
def ml_prepare(v):
    return _prepared(v)


# the 2 x 2 equations of centred features, alpha 1 (features have mean 0 on training rows, but labels that are null drop rows)
_SUMS = f"SELECT fold_id, count(*) AS n, avg(factor_a) AS ma, avg(factor_b) AS mb, avg(forward_return) AS my, covar_pop(factor_a, factor_a) * count(*) + 1 AS aa, covar_pop(factor_b, factor_b) * count(*) + 1 AS bb, covar_pop(factor_a, factor_b) * count(*) AS ab, covar_pop(factor_a, forward_return) * count(*) AS ay, covar_pop(factor_b, forward_return) * count(*) AS wy FROM ({_PREPARED}) p WHERE role = 'train' AND forward_return IS NOT NULL GROUP BY fold_id"
_WEIGHTS = f"SELECT *, my - wa * ma - wb * mb AS w0 FROM (SELECT *, (ay * bb - wy * ab) / (aa * bb - ab * ab) AS wa, (wy * aa - ay * ab) / (aa * bb - ab * ab) AS wb FROM ({_SUMS}) s) t"
_COEF = f"SELECT fold_id, 'intercept' AS feature, w0 AS coefficient FROM ({_WEIGHTS}) w UNION ALL SELECT fold_id, 'factor_a', wa FROM ({_WEIGHTS}) w UNION ALL SELECT fold_id, 'factor_b', wb FROM ({_WEIGHTS}) w"


def _ridge(v):
    return op.ridge(_prepared(v), _FEATURES, "forward_return", 1.0)


@query("ridge", _COEF, "coefficient")
def ridge(v):
    return _ridge(v)


_OOS = f"SELECT p.trade_date, p.ts_code, p.forward_return AS target, w0 + factor_a * wa + factor_b * wb AS prediction, p.fold_id FROM ({_PREPARED}) p JOIN ({_WEIGHTS}) w ON w.fold_id = p.fold_id WHERE role = 'prediction'"


def _oos(v):
    prepared = _written(v)
    return op.predict(prepared, op.ridge(prepared, _FEATURES, "forward_return", 1.0), _FEATURES, "forward_return")


@query("predict", _OOS, "target prediction")
def predict(v):
    return _oos(v)


# coordinate descent by a recursive query on the centred equations: alpha 0.02, l1_ratio 0.5, 60 sweeps of two coefficients
_NET_SUMS = f"SELECT fold_id, ma, mb, my, (aa - 1) / n AS aa, (bb - 1) / n AS bb, ab / n AS ab, ay / n AS ay, wy / n AS wy FROM ({_SUMS}) s"
_SOFT = "sign({0}) * greatest(abs({0}) - 0.01, 0) / ({1} + 0.01)".format
_NET = f"""WITH RECURSIVE net_sums AS ({_NET_SUMS}), net AS (
    SELECT *, 0 AS sweep, CAST(0 AS DOUBLE) AS wa, CAST(0 AS DOUBLE) AS wb FROM net_sums
    UNION ALL
    SELECT fold_id, ma, mb, my, aa, bb, ab, ay, wy, sweep + 1, na, {_SOFT("(wy - ab * na)", "bb")} FROM (SELECT *, {_SOFT("(ay - ab * wb)", "aa")} AS na FROM net) s WHERE sweep < 60)
    SELECT *, my - wa * ma - wb * mb AS w0 FROM net WHERE sweep = 60"""
_NET_OOS = f"SELECT p.trade_date, p.ts_code, p.forward_return AS target, w0 + factor_a * wa + factor_b * wb AS prediction, p.fold_id FROM ({_PREPARED}) p JOIN ({_NET}) w ON w.fold_id = p.fold_id WHERE role = 'prediction'"


def _net(prepared, features, label):
    return op.elastic_net(prepared, features, label, 0.02, 0.5)


@query("elastic_net", _NET_OOS, "target prediction")
def elastic_net(v):
    prepared = _written(v)
    return op.predict(prepared, _net(prepared, _FEATURES, "forward_return"), _FEATURES, "forward_return")


_MODELS = {"ridge": lambda p, f, y: op.ridge(p, f, y, 1.0), "elastic_net": _net}


@query("train_predict_oos", f"SELECT 'ridge' AS model, * FROM ({_OOS}) r UNION ALL SELECT 'elastic_net', * FROM ({_NET_OOS}) e", "target prediction")
def train_predict_oos(v):
    return op.train_predict(_written(v), _FEATURES, "forward_return", _MODELS)


@query(
    "importances",
    f"SELECT fold_id, feature, coefficient, CAST(CASE feature WHEN 'factor_a' THEN 0 ELSE 1 END AS BIGINT) AS position, abs(coefficient) AS importance, CASE WHEN coefficient > 0 THEN 'positive' WHEN coefficient < 0 THEN 'negative' ELSE 'zero' END AS direction, row_number() OVER (PARTITION BY fold_id ORDER BY abs(coefficient) DESC, feature) AS place FROM ({_COEF}) c WHERE feature <> 'intercept'",
    "coefficient importance",
)
def importances(v):
    return op.importances(_ridge(v), _FEATURES)


_THERE = "CASE WHEN prediction IS NOT NULL THEN target END"
_R2_REASON = f"CASE WHEN count(prediction - target) < 2 THEN 'insufficient_observations' WHEN min({_THERE}) = max({_THERE}) THEN 'constant_target' END"
_METRICS = f"count(prediction - target) AS n, avg(abs(prediction - target)) AS mae, sqrt(avg((prediction - target) * (prediction - target))) AS rmse, CASE WHEN {_R2_REASON} IS NULL THEN 1 - sum((prediction - target) * (prediction - target)) / nullif(var_pop({_THERE}) * count(prediction - target), 0) END AS r2, {_R2_REASON} AS r2_reason"
# rows of some dates that have no coefficient: one row, a constant target, a constant prediction, and both
_ODD = """SELECT trade_date, ts_code, CASE WHEN month(trade_date) IN (3, 5) THEN 0.5E0 ELSE target END AS target, CASE WHEN month(trade_date) IN (4, 5) THEN 0.25E0 ELSE prediction END AS prediction, fold_id
    FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY ts_code) AS k FROM {0}) r WHERE month(trade_date) <> 6 OR k <= 2"""
_ODD_OOS = _ODD.format(f"({_OOS})")


def _odd(v):
    return _kept(v, v.spark.sql(_ODD.format("{oos}"), oos=_kept(v, _oos(v), "oos")), "odd-oos")


@query("oos_regression", f"SELECT {_METRICS} FROM ({_ODD_OOS}) o UNION ALL SELECT {_METRICS} FROM ({_ODD_OOS}) o WHERE month(trade_date) = 3", "mae rmse r2")
def oos_regression(v):
    oos = _odd(v)
    return op.regression_metrics(oos).unionByName(op.regression_metrics(oos.where("month(trade_date) = 3")))


def _rank(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY trade_date ORDER BY {x} NULLS LAST) + (count(*) OVER (PARTITION BY trade_date ORDER BY {x} NULLS LAST RANGE BETWEEN CURRENT ROW AND CURRENT ROW) - 1) / 2.0 END"


def _reason(x: str, y: str) -> str:
    return f"CASE WHEN count({x}) < 3 THEN 'insufficient_cross_section' WHEN min({x}) = max({x}) AND min({y}) = max({y}) THEN 'constant_target_and_prediction' WHEN min({y}) = max({y}) THEN 'constant_target' WHEN min({x}) = max({x}) THEN 'constant_prediction' END"


def _corr(x: str, y: str) -> str:
    return f"CASE WHEN {_reason(x, y)} IS NULL AND stddev_pop({x}) * stddev_pop({y}) > 1e-15 THEN covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0) END"


_DATE_IC = f"""SELECT trade_date, fold_id, count(x) AS n, {_corr("x", "y")} AS ic, {_reason("x", "y")} AS ic_reason, {_corr("rx", "ry")} AS rank_ic, {_reason("rx", "ry")} AS rank_ic_reason FROM (
    SELECT *, {_rank("x")} AS rx, {_rank("y")} AS ry FROM (SELECT *, CASE WHEN target IS NOT NULL THEN prediction END AS x, CASE WHEN prediction IS NOT NULL THEN target END AS y FROM ({_ODD_OOS}) o) p) q GROUP BY trade_date, fold_id"""


@query("oos_date_ic", _DATE_IC, "ic rank_ic")
def oos_date_ic(v):
    return op.date_ic(_odd(v))


def _facts(c: str) -> str:
    return f"avg({c}) AS {c}_mean, stddev_samp({c}) AS {c}_std, avg({c}) / nullif(stddev_samp({c}), 0) AS {c}_ir, count({c}) AS {c}_valid_dates, count(*) - count({c}) AS {c}_invalid_dates"


_FOLDS = f"""SELECT * FROM (SELECT fold_id, min(trade_date) AS start_date, max(trade_date) AS end_date, count(*) AS n_rows, count(DISTINCT trade_date) AS n_dates, {_METRICS} FROM ({_ODD_OOS}) o GROUP BY fold_id) a
    JOIN (SELECT fold_id, {_facts("ic")}, {_facts("rank_ic")} FROM ({_DATE_IC}) i GROUP BY fold_id) b USING (fold_id)"""
_IC_DOUBLES = "ic_mean ic_std ic_ir rank_ic_mean rank_ic_std rank_ic_ir"


@query("oos_fold_metrics", _FOLDS, f"mae rmse r2 {_IC_DOUBLES}")
def oos_fold_metrics(v):
    oos = _odd(v)
    return op.fold_metrics(oos, op.date_ic(oos))


# per industry-like group of dates: a constant, a short and a full sample of each year's rows
_SAMPLES = "SELECT year(trade_date) AS year, kind, CASE WHEN kind = 'constant' THEN 1E0 ELSE factor_a END AS x, factor_b AS y FROM v_factor, (SELECT unnest(['full', 'constant']) AS kind) k"


@query(
    "safe_pearson",
    f"SELECT year, kind, count(x) AS n, CASE WHEN {_reason('x', 'y')} IS NULL THEN corr(x, y) END AS pearson, {_reason('x', 'y')} AS reason FROM (SELECT year, kind, CASE WHEN y IS NOT NULL THEN x END AS x, CASE WHEN x IS NOT NULL THEN y END AS y FROM ({_SAMPLES}) r) s GROUP BY year, kind",
    "pearson",
)
def safe_pearson(v):
    rows = v.v_factor.select(F.year("trade_date").alias("year"), F.explode(F.array(F.lit("full"), F.lit("constant"))).alias("kind"), "factor_a", "factor_b")
    x, y = F.when(F.col("kind") == "constant", 1.0).otherwise(F.col("factor_a")), F.col("factor_b")
    reason = op.pearson_reason(x, y, 3)
    pairs = F.count(F.when(x.isNotNull() & y.isNotNull(), 1))
    return rows.groupBy("year", "kind").agg(pairs.alias("n"), F.when(reason.isNull(), correlation(x, y)).alias("pearson"), reason.alias("reason"))


_IC_FACTS = f"count(*) AS dates, {_facts('ic')}, {_facts('rank_ic')}"


@query("oos_ic_summary", f"SELECT {_IC_FACTS} FROM ({_DATE_IC}) i", _IC_DOUBLES)
def oos_ic_summary(v):
    return op.ic_summary(op.date_ic(_odd(v)))


def _long_facts(scope: str, source: str, names: str) -> str:
    return " UNION ALL ".join(f"SELECT {scope}, '{n}' AS metric, CAST({n} AS DOUBLE) AS value FROM {source} t" for n in names.split())


_COUNTS = "ic_valid_dates ic_invalid_dates rank_ic_valid_dates rank_ic_invalid_dates"
_EVALUATED = " UNION ALL ".join(
    [
        _long_facts("'all' AS scope", f"(SELECT {_METRICS} FROM ({_ODD_OOS}) o)", "n mae rmse r2"),
        _long_facts("concat('fold ', fold_id)", f"({_FOLDS})", f"n_rows n_dates n mae rmse r2 {_IC_DOUBLES} {_COUNTS}"),
        _long_facts("CAST(trade_date AS STRING)", f"({_DATE_IC})", "n ic rank_ic"),
        _long_facts("'dates'", f"(SELECT {_IC_FACTS} FROM ({_DATE_IC}) i)", f"dates {_IC_DOUBLES} {_COUNTS}"),
    ]
)


@query("oos_evaluate", _EVALUATED, "value")
def oos_evaluate(v):
    return op.evaluate_oos(_odd(v))


def _place(keys: str, seed: str, k: int) -> str:
    return f"row_number() OVER (PARTITION BY {keys} ORDER BY md5(concat_ws('|', ts_code, {seed}, {k})), ts_code)"


_MOVED = f"SELECT *, {_place('trade_date', '7', 1)} AS a, {_place('trade_date', '7', 2)} AS b FROM v_ret"


@query("permute_in_date", f"SELECT x.trade_date, x.ts_code, y.ret AS factor_a, x.total_mv FROM ({_MOVED}) x JOIN ({_MOVED}) y ON x.trade_date = y.trade_date AND x.a = y.b", "factor_a total_mv")
def permute_in_date(v):
    return op.permute_in_date(v.v_ret.select("trade_date", "ts_code", F.col("ret").alias("factor_a"), "total_mv"), "factor_a", 7)


def _shuffled(repeats: str) -> str:
    """Prediction rows with their fold's weights, both features' shuffled values and the repeat."""
    keys, seed = "fold_id, trade_date, r", "1000 * r + 7"
    rows = f"SELECT p.*, r, {_place(keys, seed, 1)} AS a, {_place(keys, seed, 2)} AS b FROM ({_PREPARED}) p, (SELECT unnest({repeats}) AS r) u WHERE role = 'prediction'"
    return f"SELECT x.fold_id, x.r, x.trade_date, x.ts_code, x.forward_return AS y, x.factor_a, x.factor_b, z.factor_a AS moved_a, z.factor_b AS moved_b, w0, wa, wb FROM ({rows}) x JOIN ({rows}) z ON z.fold_id = x.fold_id AND z.trade_date = x.trade_date AND z.r = x.r AND z.b = x.a JOIN ({_WEIGHTS}) w ON w.fold_id = x.fold_id"


def _loss_sql(error: str) -> str:
    e = lambda a, b: error.format(f"(w0 + {a} * wa + {b} * wb - y)")
    base = e("factor_a", "factor_b")
    sums = f"SELECT fold_id, r, {e('moved_a', 'factor_b')} - {base} AS la, {e('factor_a', 'moved_b')} - {base} AS lb FROM ({_shuffled('[0, 1]')}) s GROUP BY fold_id, r"
    return f"SELECT fold_id, 'factor_a' AS feature, CAST(r AS INT) AS repeat, la AS loss FROM ({sums}) t UNION ALL SELECT fold_id, 'factor_b', CAST(r AS INT), lb FROM ({sums}) t"


_RMSE, _MAE = _loss_sql("sqrt(avg({0} * {0}))"), _loss_sql("avg(abs({0}))")
_SUMMED = "avg(loss) AS mean, stddev_samp(loss) AS std, min(loss) AS min, max(loss) AS max, median(loss) AS median, avg(CASE WHEN loss > 0 THEN 1.0 ELSE 0.0 END) AS positive"


def _losses(v, scoring: str = "rmse"):
    prepared = _written(v)
    return op.permutation_importance(prepared, op.ridge(prepared, _FEATURES, "forward_return", 1.0), _FEATURES, "forward_return", 2, scoring)


@query("permutation_importance", f"SELECT 'rmse' AS scoring, * FROM ({_RMSE}) a UNION ALL SELECT 'mae', * FROM ({_MAE}) b", "loss")
def permutation_importance(v):
    return _losses(v).select(F.lit("rmse").alias("scoring"), "*").unionByName(_losses(v, "mae").select(F.lit("mae").alias("scoring"), "*"))


@query("importance_fold_agg", f"SELECT *, row_number() OVER (PARTITION BY fold_id ORDER BY mean DESC, feature) AS place FROM (SELECT fold_id, feature, {_SUMMED} FROM ({_RMSE}) l GROUP BY fold_id, feature) s", "mean std min max median positive")
def importance_fold_agg(v):
    return op.importance_summary(_losses(v), ["fold_id", "feature"])


@query("importance_feature_agg", f"SELECT *, row_number() OVER (ORDER BY mean DESC, feature) AS place FROM (SELECT feature, {_SUMMED} FROM ({_RMSE}) l GROUP BY feature) s", "mean std min max median positive")
def importance_feature_agg(v):
    return op.importance_summary(_losses(v), ["feature"])


@query("gbt")
def gbt(v):
    split = _kept(v, _split(v), "split")  # not prepared: nulls have bins of their own
    forest = boosting.fit_forest(split, _FEATURES, "forward_return", _BOOSTING)
    return boosting.predict_forest(split, forest, _FEATURES, "forward_return")
