"""Queries of the joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as op
from ..registry import query

_ASOF = """
    SELECT trade_date, ts_code, ann_date, end_date, value FROM (
    SELECT p.trade_date, p.ts_code, r.ann_date, r.end_date, r.value, row_number() OVER (PARTITION BY p.ts_code, p.trade_date ORDER BY r.pos DESC, r.ann_date DESC, r.end_date DESC) AS n
    FROM (SELECT *, row_number() OVER (PARTITION BY ts_code ORDER BY trade_date) AS pos FROM v_month) p LEFT JOIN (
        SELECT f.ts_code, f.ann_date, f.end_date, f.value, min(m.pos) + 1 AS pos FROM v_financial f JOIN (SELECT *, row_number() OVER (PARTITION BY ts_code ORDER BY trade_date) AS pos FROM v_month) m
        ON m.ts_code = f.ts_code AND m.trade_date >= f.ann_date GROUP BY f.ts_code, f.ann_date, f.end_date, f.value) r ON r.ts_code = p.ts_code AND r.pos <= p.pos) a WHERE n = 1"""


@query("asof_financials", _ASOF, "value")
def asof_financials(v):
    return op.asof_financials(v.v_month, v.v_financial, ["value"], lag=1)


@query("adjust_prices", "SELECT d.trade_date, d.ts_code, close, low, high, vol, adj_factor, close * adj_factor AS adj_close, low * adj_factor AS adj_low, high * adj_factor AS adj_high FROM v_day d JOIN v_adj a ON d.ts_code = a.ts_code AND d.trade_date = a.trade_date", "close low high vol adj_factor adj_close adj_low adj_high")
def adjust_prices(v):
    return op.adjust_prices(v.v_day.select("trade_date", "ts_code", "close", "low", "high", "vol"), v.v_adj, ["close", "low", "high"])


_FORWARD = """SELECT s.trade_date, s.ts_code, e.trade_date AS entry_date, x.trade_date AS exit_date, pe.close AS entry_price, px.close AS exit_price, px.close / nullif(pe.close, 0) - 1 AS forward_return
    FROM v_month s JOIN (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS pos FROM (SELECT DISTINCT trade_date FROM v_month) t) c ON s.trade_date = c.trade_date
    LEFT JOIN (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS pos FROM (SELECT DISTINCT trade_date FROM v_month) t) e ON e.pos = c.pos + 1
    LEFT JOIN (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS pos FROM (SELECT DISTINCT trade_date FROM v_month) t) x ON x.pos = c.pos + 3
    LEFT JOIN v_month pe ON pe.ts_code = s.ts_code AND pe.trade_date = e.trade_date LEFT JOIN v_month px ON px.ts_code = s.ts_code AND px.trade_date = x.trade_date"""


def _labels(v):
    return op.forward_return(v.v_month, v.v_month, 1, 2)


@query("forward_return", _FORWARD, "entry_price exit_price forward_return")
def forward_return(v):
    return _labels(v)


@query("label_cutoff", f"SELECT trade_date, ts_code, exit_date AS available_at, forward_return FROM ({_FORWARD}) f WHERE exit_date <= DATE '1998-06-30'", "forward_return")
def label_cutoff(v):
    import datetime

    labels = _labels(v).selectExpr("trade_date", "ts_code", "exit_date AS available_at", "forward_return")
    return op.label_cutoff(labels, datetime.date(1998, 6, 30))


_OUTER = "SELECT coalesce(a.trade_date, b.trade_date) AS trade_date, coalesce(a.ts_code, b.ts_code) AS ts_code, close, adj_factor FROM (SELECT trade_date, ts_code, close FROM v_day WHERE vol > 30) a FULL JOIN (SELECT trade_date, ts_code, adj_factor FROM v_adj WHERE year(trade_date) < 2000) b ON a.trade_date = b.trade_date AND a.ts_code = b.ts_code"


@query("factor_input_outer", _OUTER, "close adj_factor")
def factor_input_outer(v):
    return op.outer_on_keys([v.v_day.where("vol > 30").select("trade_date", "ts_code", "close"), v.v_adj.where("year(trade_date) < 2000")])


@query("price_panel", "SELECT d.trade_date, d.ts_code, close * adj_factor AS adj_close FROM v_day d JOIN v_adj a ON d.ts_code = a.ts_code AND d.trade_date = a.trade_date WHERE d.trade_date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'", "adj_close")
def price_panel(v):
    bars = v.v_day.where("trade_date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'").select("trade_date", "ts_code", "close")
    return op.adjust_prices(bars, v.v_adj, ["close"]).select("trade_date", "ts_code", "adj_close")


@query("select_score_keys", "SELECT k.trade_date, k.ts_code, factor_a, factor_b FROM (SELECT trade_date, ts_code FROM v_month WHERE month(trade_date) = 12) k LEFT JOIN v_factor f ON k.trade_date = f.trade_date AND k.ts_code = f.ts_code", "factor_a factor_b")
def select_score_keys(v):
    return op.select_score_keys(v.v_month.where("month(trade_date) = 12"), v.v_factor, ["factor_a", "factor_b"])


_KEYED = "SELECT CAST(trade_date AS STRING) AS trade_date, concat('  ', ts_code, ' ') AS ts_code FROM v_month UNION ALL SELECT CAST(trade_date AS STRING), ts_code FROM v_month WHERE month(trade_date) = 6"


@query("score_keys", f"SELECT CAST(trade_date AS DATE) AS trade_date, trim(ts_code) AS ts_code, count(*) AS rows FROM ({_KEYED}) k GROUP BY 1, 2")
def score_keys(v):
    return op.score_keys(v.sql(_KEYED))


@query("modeling_panel", f"SELECT f.trade_date, f.ts_code, factor_a, factor_b, entry_date, exit_date, entry_price, exit_price, l.forward_return FROM v_factor f JOIN ({_FORWARD}) l ON f.trade_date = l.trade_date AND f.ts_code = l.ts_code", "factor_a factor_b entry_price exit_price forward_return")
def modeling_panel(v):
    return op.modeling_panel(v.v_factor, _labels(v), ["factor_a", "factor_b"])


_L, _R = "SELECT trade_date, ts_code FROM v_month WHERE vol > 60", "SELECT trade_date, ts_code FROM v_month WHERE amount > 60000"
_ANTI = "SELECT a.* FROM ({0}) a LEFT JOIN ({1}) b ON a.trade_date = b.trade_date AND a.ts_code = b.ts_code WHERE b.ts_code IS NULL"


@query("unmatched_audit", f"SELECT side, count(*) AS keys, min(trade_date) AS first_date, max(trade_date) AS last_date FROM (SELECT 'left_only' AS side, trade_date FROM ({_ANTI.format(_L, _R)}) x UNION ALL SELECT 'right_only', trade_date FROM ({_ANTI.format(_R, _L)}) y) u GROUP BY side")
def unmatched_audit(v):
    return op.unmatched_audit(v.sql(_L), v.sql(_R))


@query("key_sets_equal", f"SELECT * FROM (SELECT trade_date, ts_code, 'left_only' AS side FROM ({_ANTI.format(_L, _R)}) x ORDER BY trade_date, ts_code LIMIT 5) p UNION ALL SELECT * FROM (SELECT trade_date, ts_code, 'right_only' AS side FROM ({_ANTI.format(_R, _L)}) y ORDER BY trade_date, ts_code LIMIT 5) q")
def key_sets_equal(v):
    return op.key_sets_equal(v.sql(_L), v.sql(_R))


#: Labels with faults: dates that go backwards, prices that are gone, returns that are off.
_FAULTY = f"""SELECT trade_date, ts_code, CASE WHEN k = 1 THEN {{add_days(trade_date, -3)}} WHEN k = 2 THEN NULL ELSE entry_date END AS entry_date, CASE WHEN k = 3 THEN entry_date ELSE exit_date END AS exit_date,
    CASE WHEN k = 4 THEN NULL ELSE entry_price END AS entry_price, exit_price, CASE WHEN k = 5 THEN forward_return + 0.01 ELSE forward_return END AS forward_return
    FROM (SELECT *, row_number() OVER (ORDER BY ts_code, trade_date) % 89 AS k FROM ({_FORWARD}) f) g"""


def _count(rules: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS rule, count(CASE WHEN {c} THEN 1 END) AS violations FROM ({_FAULTY}) f" for n, c in rules.items())


@query("time_order_rules", _count({"entry_before_signal": "entry_date < trade_date", "exit_not_after_entry": "exit_date <= entry_date"}))
def time_order_rules(v):
    return op.time_order_rules(v.sql(_FAULTY))


@query("label_formula_rule", _count({"label_differs": "abs(forward_return - (exit_price / nullif(entry_price, 0) - 1)) > 1e-12 + 1e-10 * abs(exit_price / nullif(entry_price, 0) - 1)"}))
def label_formula_rule(v):
    return op.label_formula_rule(v.sql(_FAULTY))


@query(
    "structure_rules",
    _count(
        {
            "exit_without_entry": "exit_date IS NOT NULL AND entry_date IS NULL",
            "price_without_date": "(entry_price IS NOT NULL AND entry_date IS NULL) OR (exit_price IS NOT NULL AND exit_date IS NULL)",
            "label_without_parts": "forward_return IS NOT NULL AND (entry_date IS NULL OR exit_date IS NULL OR entry_price IS NULL OR exit_price IS NULL)",
        }
    ),
)
def structure_rules(v):
    return op.structure_rules(v.sql(_FAULTY))


@query("ml_align", "SELECT f.trade_date, f.ts_code, factor_a, factor_b, forward_return FROM v_factor f JOIN v_label l ON f.trade_date = l.trade_date AND f.ts_code = l.ts_code WHERE forward_return IS NOT NULL", "factor_a factor_b forward_return")
def ml_align(v):
    return op.ml_align(v.v_factor, v.v_label, ["factor_a", "factor_b"])


_WIDE = "SELECT f.*, l.forward_return, 1.0E0 AS flat, CASE WHEN factor_b > 6 THEN factor_b END AS future_b FROM v_factor f JOIN v_label l ON f.trade_date = l.trade_date AND f.ts_code = l.ts_code"


@query("feature_coverage", " UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS n_values, count(CASE WHEN forward_return IS NOT NULL THEN {c} END) AS n_labelled, count(*) AS n_rows FROM ({_WIDE}) w" for c in ("factor_a", "factor_b", "flat")))
def feature_coverage(v):
    return op.feature_coverage(v.sql(_WIDE), ["factor_a", "factor_b", "flat"])


@query(
    "panel_warnings",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, w.warning FROM (SELECT min({c}) = max({c}) AS a, avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) >= 0.5 AS b, {'TRUE' if c.startswith('future') else 'FALSE'} AS s FROM ({_WIDE}) w) f, (VALUES ('constant'), ('high_missing'), ('suspicious_name')) w(warning) WHERE (warning = 'constant' AND a) OR (warning = 'high_missing' AND b) OR (warning = 'suspicious_name' AND s)"
        for c in ("factor_a", "factor_b", "flat", "future_b")
    ),
)
def panel_warnings(v):
    return op.panel_warnings(v.sql(_WIDE), ["factor_a", "factor_b", "flat", "future_b"])


_SUSPEND = "SELECT trade_date, ts_code, 'S' AS suspend_type, CASE WHEN n > 1 THEN '09:30-10:00' END AS suspend_timing FROM v_activity WHERE errors > 0"
_CODES = "SELECT ts_code, {add_days(min(trade_date), 2)} AS list_date, CASE WHEN ts_code LIKE '%7' THEN {add_days(max(trade_date), -4)} END AS delist_date FROM v_activity GROUP BY ts_code"
_OBSERVED = "SELECT trade_date, ts_code FROM v_activity WHERE n > errors OR day(trade_date) % 5 = 0"


_STATUSES = f"""SELECT g.trade_date, g.ts_code, s.ts_code AS event, s.full_day, r.ts_code AS traded, CASE WHEN g.trade_date < list_date THEN 'PRE_LISTING' WHEN g.trade_date > delist_date THEN 'POST_DELIST' WHEN g.trade_date = delist_date THEN 'DELIST_DATE'
        WHEN r.ts_code IS NOT NULL THEN 'AVAILABLE' WHEN s.full_day THEN 'SUSPENDED' ELSE 'UNKNOWN_MISSING' END AS status
        FROM (SELECT c.*, d.trade_date FROM ({_CODES}) c, (SELECT DISTINCT trade_date FROM v_activity) d) g
        LEFT JOIN (SELECT trade_date, ts_code, bool_or(suspend_type = 'S' AND suspend_timing IS NULL) AS full_day FROM ({_SUSPEND}) s GROUP BY trade_date, ts_code) s ON s.trade_date = g.trade_date AND s.ts_code = g.ts_code
        LEFT JOIN (SELECT DISTINCT trade_date, ts_code FROM ({_OBSERVED}) r) r ON r.trade_date = g.trade_date AND r.ts_code = g.ts_code"""


@query("security_status", f"SELECT trade_date, ts_code, status, CASE WHEN status = 'AVAILABLE' AND full_day THEN 'return on a suspended day' WHEN status IN ('PRE_LISTING', 'POST_DELIST') AND (event IS NOT NULL OR traded IS NOT NULL) THEN 'data outside the listing' END AS conflict FROM ({_STATUSES}) s")
def security_status(v):
    return op.security_status(v.v_activity, v.sql(_CODES), v.sql(_SUSPEND), v.sql(_OBSERVED), fail=False)


@query(
    "month_panel_join",
    "SELECT m.ts_code, m.trade_date, m.close, r.name, r.market, b.turnover_rate FROM v_month m LEFT JOIN v_reference r ON m.ts_code = r.ts_code LEFT JOIN (SELECT ts_code, trade_date, turnover_rate FROM v_month WHERE turnover_rate > 4) b ON m.ts_code = b.ts_code AND m.trade_date = b.trade_date WHERE m.ts_code IN (SELECT con_code FROM v_index_weight)",
    "close turnover_rate",
)
def month_panel_join(v):
    basics = v.v_month.where("turnover_rate > 4").select("ts_code", "trade_date", "turnover_rate")
    constituents = v.v_index_weight.select(F.col("con_code").alias("ts_code"))
    return op.month_panel_join(v.v_month.select("ts_code", "trade_date", "close"), v.v_reference.select("ts_code", "name", "market"), basics, constituents)
