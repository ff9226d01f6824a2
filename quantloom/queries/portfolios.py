"""Queries of signals, holdings, weights, risk and backtest accounting."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import backtest as bt
from ..operators import calendars as cal
from ..operators import risk
from ..operators import signals as op
from ..registry import query
from .learning import _kept

_SIGNALS = "SELECT trade_date, ts_code, prediction AS score, row_number() OVER (PARTITION BY trade_date ORDER BY prediction DESC, ts_code) AS rank FROM v_pred"


@query("signals", f"SELECT s.*, row_number() OVER (PARTITION BY trade_date ORDER BY score, ts_code) AS rank_ascending FROM ({_SIGNALS}) s", "score")
def signals(v):
    up = op.signals(v.v_pred, False).select("trade_date", "ts_code", F.col("rank").alias("rank_ascending"))
    return op.signals(v.v_pred).join(up, ["trade_date", "ts_code"])


@query("predictions_source", "SELECT trade_date, ts_code, prediction, target FROM v_pred WHERE target IS NOT NULL", "prediction target")
def predictions_source(v):
    return v.v_pred.where("target IS NOT NULL").select("trade_date", "ts_code", "prediction", "target")


_BENT = f"SELECT trade_date, ts_code, score, CASE WHEN month(trade_date) = 4 AND rank = 3 THEN 4 ELSE rank END AS rank FROM ({_SIGNALS}) s"


@query("signal_rules", f"SELECT trade_date, count(*) AS n, min(rank) = 1 AND max(rank) = count(*) AND count(DISTINCT rank) = count(*) AND sum(down) = 0 AS valid FROM (SELECT *, CASE WHEN score > lag(score) OVER (PARTITION BY trade_date ORDER BY rank) THEN 1 ELSE 0 END AS down FROM ({_BENT}) b) c GROUP BY trade_date")
def signal_rules(v):
    rank = F.when((F.month("trade_date") == 4) & (F.col("rank") == 3), 4).otherwise(F.col("rank"))
    return op.signal_rules(op.signals(v.v_pred).withColumn("rank", rank))


_CHOSEN = f"SELECT *, count(*) OVER (PARTITION BY trade_date) AS selected FROM ({_SIGNALS}) s WHERE rank <= 8"


def _chosen(v):
    return op.holdings(op.signals(v.v_pred), 8)


for _name in ("holdings", "weight_equal"):

    @query(_name, f"SELECT *, 1.0 / selected AS target_weight FROM ({_CHOSEN}) c", "score target_weight")
    def holdings(v):
        return _chosen(v)


@query("weight_rank", f"SELECT *, (selected - rank + 1) / (selected * (selected + 1) / 2) AS target_weight FROM ({_CHOSEN}) c", "score target_weight")
def weight_rank(v):
    return op.weight_rank(_chosen(v))


_DATES = "SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS pos FROM (SELECT DISTINCT trade_date FROM v_ret) d"
# up to a code's first row it isn't listed; later gaps are suspensions
_MONTHLY = "SELECT d.trade_date, c.ts_code, CASE WHEN d.trade_date <= c.first THEN 'PRE_LISTING' WHEN r.ret IS NULL THEN 'SUSPENDED' ELSE 'AVAILABLE' END AS status FROM (SELECT DISTINCT trade_date FROM v_ret) d CROSS JOIN (SELECT ts_code, min(trade_date) AS first FROM v_ret GROUP BY ts_code) c LEFT JOIN v_ret r ON r.ts_code = c.ts_code AND r.trade_date = d.trade_date"
_ASKED = f"SELECT c.* FROM ({_CHOSEN}) c JOIN ({_DATES}) d ON d.trade_date = c.trade_date WHERE d.pos >= 12"
_WINDOW = f"SELECT c.trade_date, c.ts_code, w.trade_date AS return_date, coalesce(r.ret, 0) AS ret FROM ({_ASKED}) c JOIN ({_DATES}) d ON d.trade_date = c.trade_date JOIN ({_DATES}) w ON w.pos BETWEEN d.pos - 11 AND d.pos JOIN ({_MONTHLY}) s ON s.ts_code = c.ts_code AND s.trade_date = w.trade_date AND s.status <> 'PRE_LISTING' LEFT JOIN v_ret r ON r.ts_code = c.ts_code AND r.trade_date = w.trade_date"


def _asked(v, days):
    return _chosen(v).join(F.broadcast(days.where("pos >= 12").select(F.col("cal_date").alias("trade_date"))), "trade_date", "left_semi")


def _window(v):
    days = v.sql(_DATES).withColumnRenamed("trade_date", "cal_date")
    resolved = op.resolved_returns(v.sql(_MONTHLY), v.v_ret.where("ret IS NOT NULL").select("trade_date", "ts_code", "ret"))
    return op.return_window(_asked(v, days), resolved, days, 12)


@query("return_window", _WINDOW, "ret")
def return_window(v):
    return _window(v)


_VOL = f"SELECT trade_date, ts_code, CASE WHEN count(ret) >= 6 THEN stddev_samp(ret) END AS volatility FROM ({_WINDOW}) w GROUP BY trade_date, ts_code"


@query("sample_vol", _VOL, "volatility")
def sample_vol(v):
    return op.sample_volatility(_window(v), 6)


# a date with a code that has no positive volatility has no weights
_INVERSE = f"SELECT *, CASE WHEN count(inverse) OVER (PARTITION BY trade_date) = count(*) OVER (PARTITION BY trade_date) THEN inverse / sum(inverse) OVER (PARTITION BY trade_date) END AS target_weight FROM (SELECT c.trade_date, c.ts_code, c.rank, CASE WHEN volatility > 0 THEN 1 / volatility END AS inverse FROM ({_ASKED}) c LEFT JOIN ({_VOL}) s ON s.trade_date = c.trade_date AND s.ts_code = c.ts_code) i"


@query("weight_inverse_vol", f"SELECT trade_date, ts_code, rank, target_weight FROM ({_INVERSE}) i", "target_weight")
def weight_inverse_vol(v):
    asked = _asked(v, v.sql(_DATES).withColumnRenamed("trade_date", "cal_date"))
    return op.weight_inverse_volatility(asked, op.sample_volatility(_window(v), 6), fail=False).select("trade_date", "ts_code", "rank", "target_weight")


_BASE = f"SELECT p.trade_date, p.ts_code, p.total_mv FROM v_pred p JOIN ({_CHOSEN}) c ON c.trade_date = p.trade_date AND c.ts_code = p.ts_code WHERE total_mv > 0"


def _base(v):
    return v.v_pred.join(_chosen(v).select("trade_date", "ts_code"), ["trade_date", "ts_code"]).where("total_mv > 0").select("trade_date", "ts_code", "total_mv")


@query("proportional_weights", f"SELECT *, total_mv / sum(total_mv) OVER (PARTITION BY trade_date) AS target_weight FROM ({_BASE}) b", "total_mv target_weight")
def proportional_weights(v):
    return op.proportional(_base(v), "total_mv")


# step by step: at most eight names, so eight rounds of capping settle it
_CAPPED = f"""WITH b AS (SELECT *, 0.2 AS cap FROM ({_BASE}) b), r AS (
    SELECT trade_date, list(total_mv ORDER BY total_mv DESC, ts_code) AS x, list(ts_code ORDER BY total_mv DESC, ts_code) AS c, count(*) AS n FROM b GROUP BY trade_date),
    k AS (SELECT *, list_min(list_filter(range(0, n), lambda i: (1 - i * 0.2) * x[i + 1] / list_sum(x[i + 1:n]) <= 0.2 + 1e-15)) AS k FROM r)
    SELECT trade_date, c[i] AS ts_code, x[i] AS total_mv, CASE WHEN n * 0.2 >= 1 - 1e-12 THEN CASE WHEN i <= k THEN 0.2 ELSE (1 - k * 0.2) * x[i] / list_sum(x[k + 1:n]) END END AS target_weight FROM k, unnest(range(1, n + 1)) AS u(i)"""


@query("capped_allocation", _CAPPED, "total_mv target_weight")
def capped_allocation(v):
    return op.capped_allocation(_base(v), "total_mv", 0.2)


@query("max_weight_rule", f"SELECT trade_date, count(*) * 0.2 >= 1 - 1e-12 AS feasible, max(w) <= 0.2 + 1e-12 AS kept FROM (SELECT *, total_mv / sum(total_mv) OVER (PARTITION BY trade_date) AS w FROM ({_BASE}) b) c GROUP BY trade_date")
def max_weight_rule(v):
    return op.max_weight_rule(op.proportional(_base(v), "total_mv"), 0.2)


_WEIGHED = f"SELECT trade_date, ts_code, CASE WHEN month(trade_date) = 2 THEN -target_weight ELSE target_weight END AS target_weight FROM (SELECT *, 1.0 / selected AS target_weight FROM ({_CHOSEN}) c) w WHERE NOT (month(trade_date) = 3 AND rank = 2)"
_CHECKED = f"""SELECT trade_date, count(CASE WHEN c.a IS NULL OR w IS NULL THEN 1 END) = 0 AS same_keys, count(CASE WHEN w < 0 THEN 1 END) = 0 AS not_negative, abs(sum(w) - 1) <= 1e-9 AS sums_to_one FROM (
    SELECT coalesce(a.trade_date, b.trade_date) AS trade_date, a.ts_code AS a, b.target_weight AS w FROM ({_CHOSEN}) a FULL JOIN ({_WEIGHED}) b ON a.trade_date = b.trade_date AND a.ts_code = b.ts_code) c GROUP BY trade_date"""


def _checked(v):
    weighted = _chosen(v).where("NOT (month(trade_date) = 3 AND rank = 2)").withColumn("target_weight", F.when(F.month("trade_date") == 2, -F.col("target_weight")).otherwise(F.col("target_weight")))
    return op.weight_rules(_chosen(v), weighted)


for _name in ("weight_rules", "weights_engine"):

    @query(_name, f"SELECT *, same_keys AND not_negative AND coalesce(sums_to_one, FALSE) AS valid FROM ({_CHECKED}) c")
    def weight_rules(v):
        return _checked(v)


@query("weight_min_variance")
def weight_min_variance(v):
    return op.weight_min_variance(_window(v), 0.5, 6)


_COMPLETE = f"""SELECT trade_date, ts_code, return_date, ret, observations FROM (SELECT *, count(DISTINCT return_date) OVER (PARTITION BY trade_date) AS observations FROM (
    SELECT *, count(ret) OVER (PARTITION BY trade_date, return_date) AS n, count(DISTINCT ts_code) OVER (PARTITION BY trade_date) AS assets FROM ({_WINDOW}) w) a WHERE n = assets) b WHERE observations >= 6"""


def _complete(v):
    return risk.complete_cases(_window(v), 6)


@query("complete_case_window", _COMPLETE, "ret")
def complete_case_window(v):
    return _complete(v)


@query("covariance", f"SELECT a.trade_date, a.ts_code AS i, b.ts_code AS j, covar_samp(a.ret, b.ret) AS covariance FROM ({_COMPLETE}) a JOIN ({_COMPLETE}) b ON a.trade_date = b.trade_date AND a.return_date = b.return_date GROUP BY a.trade_date, a.ts_code, b.ts_code", "covariance")
def covariance(v):
    return risk.covariance(_complete(v))


_CENTRED = f"SELECT *, ret - avg(ret) OVER (PARTITION BY trade_date, ts_code) AS x FROM ({_COMPLETE}) c"
_PAIRS = f"SELECT a.trade_date, a.ts_code AS i, b.ts_code AS j, avg(a.x * b.x) AS s, avg(a.x * a.x * b.x * b.x) AS q, count(*) AS n FROM ({_CENTRED}) a JOIN ({_CENTRED}) b ON a.trade_date = b.trade_date AND a.return_date = b.return_date GROUP BY a.trade_date, a.ts_code, b.ts_code"


@query(
    "ledoit_wolf",
    f"""SELECT p.trade_date, i, j, (1 - shrinkage) * s + shrinkage * CASE WHEN i = j THEN m ELSE 0 END AS covariance, shrinkage FROM ({_PAIRS}) p JOIN (
        SELECT trade_date, m, coalesce(least(noise, spread) / nullif(spread, 0), 0) AS shrinkage FROM (
        SELECT trade_date, sum(CASE WHEN i = j THEN s END) / sqrt(count(*)) AS m, sum(s * s) / sqrt(count(*)) - (sum(CASE WHEN i = j THEN s END) / sqrt(count(*))) ** 2 AS spread, (sum(q) - sum(s * s)) / (max(n) * sqrt(count(*))) AS noise FROM ({_PAIRS}) p GROUP BY trade_date) a) f ON f.trade_date = p.trade_date""",
    "covariance shrinkage",
)
def ledoit_wolf(v):
    return risk.ledoit_wolf(_complete(v))


# backtest
_BARS = "SELECT trade_date, ts_code, 100 * ret AS pct_chg FROM v_dret UNION ALL SELECT trade_date, ts_code, 1.5E0 FROM v_dret WHERE day(trade_date) = 30"


@query("security_returns", f"SELECT trade_date, ts_code, pct_chg / 100 AS ret, count(*) OVER (PARTITION BY trade_date, ts_code) AS key_rows FROM ({_BARS}) b", "ret")
def security_returns(v):
    return bt.security_returns(v.sql(_BARS))


@query("pct_to_decimal", "SELECT trade_date, pct_chg / 100 AS value FROM v_bench", "value")
def pct_to_decimal(v):
    return v.v_bench.select("trade_date", bt.pct_to_decimal(F.col("pct_chg")).alias("value"))


@query("benchmark_returns", "SELECT trade_date, benchmark_code, pct_chg / 100 AS ret FROM v_bench WHERE benchmark_code = 'BENCH'", "ret")
def benchmark_returns(v):
    return bt.benchmark_returns(v.v_bench, "BENCH")


_LIVES = "SELECT ts_code, list_date, delist_date FROM v_reference UNION ALL SELECT ts_code, list_date, NULL FROM v_reference UNION ALL SELECT ts_code, {add_days(list_date, 1)}, delist_date FROM v_reference WHERE market = 'STAR'"


@query("lifecycle_reconcile", f"SELECT ts_code, min(list_date) AS list_date, max(delist_date) AS delist_date, count(DISTINCT list_date) > 1 OR count(DISTINCT delist_date) > 1 AS conflict FROM ({_LIVES}) l GROUP BY ts_code")
def lifecycle_reconcile(v):
    return bt.lifecycle_reconcile(v.sql(_LIVES))


_PAUSES = "SELECT trade_date, concat(' ', ts_code) AS ts_code, CASE WHEN n > 1 THEN 's' ELSE ' S ' END AS suspend_type, CASE WHEN n > 1 THEN '09:30' ELSE '  ' END AS suspend_timing FROM v_activity WHERE errors > 0"


@query("suspension_events", f"SELECT DISTINCT trade_date, trim(ts_code) AS ts_code, upper(trim(suspend_type)) AS suspend_type, nullif(trim(suspend_timing), '') AS suspend_timing FROM ({_PAUSES}) p")
def suspension_events(v):
    return bt.suspension_events(v.sql(_PAUSES))


_STATUS = "SELECT o.cal_date AS trade_date, c.ts_code, CASE WHEN day(o.cal_date) = 17 THEN 'SUSPENDED' WHEN r.ret IS NOT NULL THEN 'AVAILABLE' WHEN day(o.cal_date) % 3 = 0 THEN 'SUSPENDED' ELSE 'UNKNOWN_MISSING' END AS status FROM v_open o CROSS JOIN (SELECT DISTINCT ts_code FROM v_dret) c LEFT JOIN v_dret r ON r.ts_code = c.ts_code AND r.trade_date = o.cal_date"


@query(
    "resolve_return",
    f"""SELECT s.trade_date, s.ts_code, status, CASE WHEN ret IS NOT NULL AND status = 'AVAILABLE' THEN ret WHEN ret IS NULL AND status = 'SUSPENDED' THEN 0 END AS ret,
        CASE WHEN ret IS NOT NULL AND status <> 'AVAILABLE' THEN 'return conflicts with status' WHEN ret IS NULL AND status <> 'SUSPENDED' THEN 'return is missing' END AS conflict
        FROM ({_STATUS}) s LEFT JOIN v_dret r ON r.ts_code = s.ts_code AND r.trade_date = s.trade_date""",
    "ret",
)
def resolve_return(v):
    return bt.resolve_return(v.sql(_STATUS), v.v_dret, fail=False)


@query("missing_fraction_gate", f"SELECT trade_date, avg(CASE WHEN status = 'UNKNOWN_MISSING' THEN 1.0 ELSE 0.0 END) AS missing, avg(CASE WHEN status = 'UNKNOWN_MISSING' THEN 1.0 ELSE 0.0 END) > 0.3 AS fails FROM ({_STATUS}) s GROUP BY trade_date", "missing")
def missing_fraction_gate(v):
    return bt.missing_fraction_gate(v.sql(_STATUS), 0.3)


# a tenth stays cash in some months; a code without a row on an open day is suspended there
_CASHED = "SELECT effective_date, ts_code, CASE WHEN month(effective_date) % 4 = 1 THEN 0.9E0 * target_weight ELSE target_weight END AS target_weight FROM v_hold"
_DRIFT = f"""SELECT event, trade_date, ts_code, value, cash, value / (sum(value) OVER (PARTITION BY event, trade_date) + cash) AS weight, before, before * ret AS gain FROM (
    SELECT *, coalesce(lag(value) OVER (PARTITION BY event, ts_code ORDER BY trade_date), target_weight) AS before FROM (
    SELECT h.effective_date AS event, s.trade_date, h.ts_code, target_weight, 1 - sum(target_weight) OVER (PARTITION BY h.effective_date, s.trade_date) AS cash, CASE WHEN r.ts_code IS NULL THEN 0 ELSE ret END AS ret,
           target_weight * product(1 + CASE WHEN r.ts_code IS NULL THEN 0 ELSE ret END) OVER (PARTITION BY h.effective_date, h.ts_code ORDER BY s.trade_date ROWS UNBOUNDED PRECEDING) AS value
    FROM ({_CASHED}) h JOIN (SELECT o.cal_date AS trade_date, max(e.effective_date) AS event FROM v_open o JOIN (SELECT DISTINCT effective_date FROM v_hold) e ON e.effective_date < o.cal_date GROUP BY o.cal_date) s ON s.event = h.effective_date
    LEFT JOIN v_dret r ON r.ts_code = h.ts_code AND r.trade_date = s.trade_date) d) b"""


def _cashed(v):
    return v.sql(_CASHED)


def _drift(v):
    """Drifted holdings as a table, as the ledger and the values of days both read them."""
    held, days, returns = _cashed(v), cal.open_days(v.v_calendar), _kept(v, v.v_dret, "daily-returns")
    traded = returns.select("trade_date", "ts_code", F.lit("AVAILABLE").alias("traded"))
    status = bt.held_days(held, days).join(traded, ["trade_date", "ts_code"], "left").select("trade_date", "ts_code", F.coalesce("traded", F.lit("SUSPENDED")).alias("status"))
    return _kept(v, bt.drifted(held, bt.resolve_return(status, returns), days), "drift")


@query("weight_drift", _DRIFT, "value cash weight before gain")
def weight_drift(v):
    return _drift(v)


_LEDGER = f"""SELECT *, (sum(abs(weight_change)) OVER (PARTITION BY effective_date) + abs(target_cash - pre_cash)) / 2 AS turnover, sum(abs(weight_change)) OVER (PARTITION BY effective_date) AS notional FROM (
    SELECT *, target_weight - pre_weight AS weight_change, 1 - sum(pre_weight) OVER (PARTITION BY effective_date) AS pre_cash, 1 - sum(target_weight) OVER (PARTITION BY effective_date) AS target_cash FROM (
    SELECT coalesce(p.trade_date, h.effective_date) AS effective_date, coalesce(p.ts_code, h.ts_code) AS ts_code, coalesce(p.weight, 0) AS pre_weight, coalesce(h.target_weight, 0) AS target_weight
    FROM (SELECT * FROM ({_DRIFT}) d WHERE trade_date IN (SELECT effective_date FROM v_hold)) p FULL JOIN ({_CASHED}) h ON h.effective_date = p.trade_date AND h.ts_code = p.ts_code) a) b"""


def _ledger(v, drift=None):
    return bt.rebalance_ledger(_cashed(v), _drift(v) if drift is None else drift)


@query("rebalance_ledger", _LEDGER, "pre_weight target_weight weight_change pre_cash target_cash turnover notional")
def rebalance_ledger(v):
    return _ledger(v)


_NAV = f"""SELECT *, product(1 + gross_return) OVER (ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS gross_nav, product(1 + net_return) OVER (ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS net_nav FROM (
    SELECT coalesce(g.trade_date, e.effective_date) AS trade_date, coalesce(gross_return, 0) AS gross_return, coalesce(notional, 0) * 0.001 AS cost, notional IS NOT NULL AS is_rebalance, coalesce(turnover, 0) AS turnover, coalesce(notional, 0) AS notional, (1 + coalesce(gross_return, 0)) * (1 - coalesce(notional, 0) * 0.001) - 1 AS net_return
    FROM (SELECT trade_date, sum(gain) / (sum(before) + max(cash)) AS gross_return FROM ({_DRIFT}) d GROUP BY trade_date) g
    FULL JOIN (SELECT effective_date, max(turnover) AS turnover, max(notional) AS notional FROM ({_LEDGER}) l GROUP BY effective_date) e ON e.effective_date = g.trade_date) n"""
_NAV_DOUBLES = "gross_return cost turnover notional net_return gross_nav net_nav"


def _nav(v):
    drift = _drift(v)
    return bt.daily_nav(drift, _ledger(v, drift), 0.001)


@query("daily_nav", _NAV, _NAV_DOUBLES)
def daily_nav(v):
    return _nav(v)


_BNAV = "SELECT trade_date, ret, product(1 + ret) OVER (ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS nav FROM (SELECT trade_date, CASE WHEN row_number() OVER (ORDER BY trade_date) = 1 THEN 0 ELSE pct_chg / 100 END AS ret FROM v_bench) b"


def _bench(v):
    return bt.benchmark_nav(bt.benchmark_returns(v.v_bench, "BENCH"))


@query("benchmark_nav", _BNAV, "ret nav")
def benchmark_nav(v):
    return _bench(v)


@query("drawdown", f"SELECT *, nav / greatest(max(nav) OVER (ORDER BY trade_date ROWS UNBOUNDED PRECEDING), 1) - 1 AS drawdown FROM ({_BNAV}) b", "ret nav drawdown")
def drawdown(v):
    return bt.drawdown(_bench(v))


_ROWS = f"SELECT n.*, b.ret AS bench, b.nav AS bench_nav, net_return - b.ret AS active, net_nav / greatest(max(net_nav) OVER (ORDER BY n.trade_date ROWS UNBOUNDED PRECEDING), 1) - 1 AS dd, b.nav / greatest(max(b.nav) OVER (ORDER BY n.trade_date ROWS UNBOUNDED PRECEDING), 1) - 1 AS bdd FROM ({_NAV}) n LEFT JOIN ({_BNAV}) b ON b.trade_date = n.trade_date"
_METRICS = f"""SELECT count(*) AS days, min(trade_date) AS first_date, max(trade_date) AS last_date, arg_max(gross_nav, trade_date) - 1 AS gross_total, arg_max(net_nav, trade_date) - 1 AS net_total, arg_max(bench_nav, trade_date) - 1 AS bench_total,
    stddev_samp(net_return) * sqrt(252) AS volatility, stddev_samp(bench) * sqrt(252) AS bench_volatility, min(dd) AS max_drawdown, min(bdd) AS bench_max_drawdown, stddev_samp(active) * sqrt(252) AS tracking_error,
    avg(CASE WHEN net_return > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, max(net_return) AS best_day, min(net_return) AS worst_day, sum(turnover) AS turnover, sum(cost) AS cost, count(CASE WHEN is_rebalance THEN 1 END) AS rebalances, avg(CASE WHEN is_rebalance THEN turnover END) AS average_turnover, sum(notional) AS traded_notional,
    avg(net_return) / nullif(stddev_samp(net_return), 0) * sqrt(252) AS sharpe, avg(active) / nullif(stddev_samp(active), 0) * sqrt(252) AS information_ratio FROM ({_ROWS}) r"""
_ANNUAL = "CASE WHEN 1 + {0} > 0 THEN pow(1 + {0}, 252.0 / days) - 1 END"


@query(
    "performance",
    f"SELECT *, net_annual - bench_annual AS excess_annual FROM (SELECT *, {_ANNUAL.format('gross_total')} AS gross_annual, {_ANNUAL.format('net_total')} AS net_annual, {_ANNUAL.format('bench_total')} AS bench_annual, net_total - bench_total AS excess_total, gross_total - net_total AS cost_drag FROM ({_METRICS}) m) a",
    "gross_total net_total bench_total volatility bench_volatility max_drawdown bench_max_drawdown tracking_error win_rate best_day worst_day turnover cost average_turnover traded_notional sharpe information_ratio gross_annual net_annual bench_annual excess_total excess_annual cost_drag",
)
def performance(v):
    return bt.performance(_nav(v), _bench(v))


@query("annualize", f"SELECT year(trade_date) AS year, CASE WHEN product(1 + ret) > 0 THEN pow(product(1 + ret), 252.0 / count(*)) - 1 END AS annual FROM ({_BNAV}) b GROUP BY year(trade_date)", "annual")
def annualize(v):
    out = _bench(v).groupBy(F.year("trade_date").alias("year")).agg((F.product(1 + F.col("ret")) - 1).alias("total"), F.count(F.lit(1)).alias("n"))
    return out.select("year", bt.annualize(F.col("total"), F.col("n"), 252).alias("annual"))


_OFF = "SELECT effective_date, ts_code, CASE WHEN month(effective_date) = 5 AND rank = 1 THEN -target_weight ELSE target_weight END AS target_weight FROM v_hold UNION ALL SELECT effective_date, ts_code, target_weight FROM v_hold WHERE month(effective_date) = 6 AND rank = 2"


@query("holdings_rules", " UNION ALL ".join(f"SELECT '{n}' AS rule, count(CASE WHEN {c} THEN 1 END) AS violations FROM (SELECT sum(target_weight) AS s, min(target_weight) AS m, count(*) AS n, count(DISTINCT ts_code) AS d FROM ({_OFF}) o GROUP BY effective_date) x" for n, c in {"negative_weight": "m < 0", "duplicate_key": "n > d", "sum_not_one": "abs(s - 1) > 1e-9"}.items()))
def holdings_rules(v):
    return bt.holdings_rules(v.sql(_OFF))


# of two codes the ledger is changed, so that every rule is broken somewhere
_WRONG = "CASE WHEN ts_code = 'Brand#11' AND month(effective_date) = 4 THEN 0.5E0 ELSE 0E0 END"
_TAMPERED = f"SELECT effective_date, ts_code, pre_weight + {_WRONG} AS pre_weight, target_weight + 2 * {_WRONG} AS target_weight, weight_change, pre_cash, target_cash, turnover + CASE WHEN month(effective_date) = 7 THEN 0.25E0 ELSE 0E0 END AS turnover FROM ledger"


def _rules(rules: dict[str, str], rows: str) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS rule, count(CASE WHEN {x} THEN 1 END) AS violations FROM ({rows}) r" for n, x in rules.items())


@query(
    "ledger_rules",
    _rules(
        {"pre_not_one": "abs(pre - 1) > 1e-9", "target_not_one": "abs(post - 1) > 1e-9", "change_differs": "off > 1e-9", "turnover_differs": "abs(t - again) > 1e-9"},
        f"SELECT sum(pre_weight) + max(pre_cash) AS pre, sum(target_weight) + max(target_cash) AS post, max(abs(weight_change - (target_weight - pre_weight))) AS off, max(turnover) AS t, (sum(abs(weight_change)) + abs(max(target_cash) - max(pre_cash))) / 2 AS again FROM ({_TAMPERED.replace('ledger', f'({_LEDGER}) x')}) l GROUP BY effective_date",
    ),
)
def ledger_rules(v):
    return bt.ledger_rules(v.spark.sql(_TAMPERED.replace("ledger", "{ledger}"), ledger=_ledger(v)))


@query("pre_state_check", f"SELECT effective_date, count(*) AS keys, count(CASE WHEN ts_code = 'Brand#11' AND month(effective_date) = 4 THEN 1 END) AS different FROM ({_LEDGER}) l GROUP BY effective_date")
def pre_state_check(v):
    drift = _drift(v)
    return bt.pre_state_check(drift, v.spark.sql(_TAMPERED.replace("ledger", "{ledger}"), ledger=_ledger(v, drift)))


_ODD = "SELECT trade_date, is_rebalance, CASE WHEN day(trade_date) = 3 THEN 0.01E0 ELSE cost END AS cost, CASE WHEN day(trade_date) = 4 THEN 0.1E0 ELSE turnover END AS turnover, CASE WHEN day(trade_date) IN (4, 5) THEN 0.1E0 ELSE notional END AS notional, CASE WHEN day(trade_date) = 6 THEN 0E0 ELSE net_nav END AS net_nav, gross_nav FROM nav"


@query("daily_rules", _rules({"cost_on_quiet_day": "NOT is_rebalance AND cost <> 0", "turnover_on_quiet_day": "NOT is_rebalance AND turnover <> 0", "notional_on_quiet_day": "NOT is_rebalance AND notional <> 0", "nav_not_positive": "net_nav <= 0 OR gross_nav <= 0"}, _ODD.replace("FROM nav", f"FROM ({_NAV}) n")))
def daily_rules(v):
    return bt.daily_rules(v.spark.sql(_ODD.replace("FROM nav", "FROM {nav}"), nav=_nav(v)))


_PICKED = f"SELECT c.trade_date, c.ts_code, l.forward_return FROM ({_CHOSEN}) c JOIN v_label l ON l.trade_date = c.trade_date AND l.ts_code = c.ts_code"
_HELD = f"SELECT trade_date, ts_code, forward_return, 1.0 / count(*) OVER (PARTITION BY trade_date) AS weight FROM (SELECT trade_date, ts_code, min(forward_return) AS forward_return FROM ({_PICKED}) p WHERE forward_return IS NOT NULL GROUP BY trade_date, ts_code) d"


def _picked(v):
    return _chosen(v).select("trade_date", "ts_code").join(v.v_label, ["trade_date", "ts_code"])


def _held(v):
    return bt.simple_holdings(_picked(v))


@query("simple_holdings", _HELD, "forward_return weight")
def simple_holdings(v):
    return _held(v)


_PERIOD = f"SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS p FROM (SELECT DISTINCT trade_date FROM ({_HELD}) h) d"
_TURN = f"""SELECT d.trade_date, CASE WHEN d.p = 1 THEN 1.0 ELSE sum(abs(coalesce(weight, 0) - coalesce(old, 0))) / 2 END AS turnover FROM (
    SELECT coalesce(a.p, b.p) AS p, weight, old FROM (SELECT d.p, h.ts_code, weight FROM ({_HELD}) h JOIN ({_PERIOD}) d ON d.trade_date = h.trade_date) a
    FULL JOIN (SELECT d.p + 1 AS p, h.ts_code, weight AS old FROM ({_HELD}) h JOIN ({_PERIOD}) d ON d.trade_date = h.trade_date) b ON a.p = b.p AND a.ts_code = b.ts_code) c JOIN ({_PERIOD}) d ON d.p = c.p GROUP BY d.trade_date, d.p"""


@query("simple_turnover", _TURN, "turnover")
def simple_turnover(v):
    return bt.simple_turnover(_held(v))


_SRET = f"SELECT g.trade_date, gross_return, turnover, turnover * 0.002 AS cost, gross_return - turnover * 0.002 AS net_return FROM (SELECT trade_date, sum(weight * forward_return) AS gross_return FROM ({_HELD}) h GROUP BY trade_date) g JOIN ({_TURN}) t ON t.trade_date = g.trade_date"


def _sret(v):
    held = _held(v)
    return bt.simple_returns(held, bt.simple_turnover(held), 0.002)


@query("simple_period_returns", _SRET, "gross_return turnover cost net_return")
def simple_period_returns(v):
    return _sret(v)


_SNAV = f"SELECT *, product(1 + net_return) OVER (ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS nav FROM ({_SRET}) s"


@query("simple_nav", _SNAV, "gross_return turnover cost net_return nav")
def simple_nav(v):
    return bt.simple_nav(_sret(v))


_SMETRICS = f"""SELECT *, annual_return / nullif(annual_volatility, 0) AS sharpe_ratio FROM (SELECT min(trade_date) AS start_date, max(trade_date) AS end_date, count(*) AS n_periods, arg_max(nav, trade_date) - 1 AS cumulative_return,
    CASE WHEN arg_max(nav, trade_date) >= 0 THEN pow(arg_max(nav, trade_date), 12.0 / count(*)) - 1 END AS annual_return, stddev_samp(net_return) * sqrt(12) AS annual_volatility, min(dd) AS max_drawdown,
    avg(net_return) AS mean_monthly_return, avg(CASE WHEN net_return > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, avg(turnover) AS average_turnover
    FROM (SELECT *, nav / nullif(max(nav) OVER (ORDER BY trade_date ROWS UNBOUNDED PRECEDING), 0) - 1 AS dd FROM ({_SNAV}) s) d) m"""
_S_DOUBLES = "cumulative_return annual_return annual_volatility sharpe_ratio max_drawdown mean_monthly_return win_rate average_turnover"


@query("simple_metrics", _SMETRICS, _S_DOUBLES)
def simple_metrics(v):
    return bt.simple_metrics(bt.simple_nav(_sret(v)))


@query("simple_backtest", _SMETRICS, _S_DOUBLES)
def simple_backtest(v):
    return bt.simple_backtest(_picked(v), 0.002)
