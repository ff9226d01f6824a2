"""Queries of the point-in-time universes."""

from __future__ import annotations

import datetime

from ..operators import calendars as cal
from ..operators import universes as op
from ..registry import query

_FORM = "SELECT max(cal_date) AS formation_date FROM v_open GROUP BY year(cal_date), month(cal_date)"
_ACTIVE = f"SELECT f.formation_date, r.* FROM v_reference r JOIN ({_FORM}) f ON list_date <= formation_date AND (delist_date IS NULL OR delist_date > formation_date)"


def _forms(v):
    return cal.formation_dates(cal.open_days(v.v_calendar))


@query("lifecycle_active", _ACTIVE)
def lifecycle_active(v):
    return op.active(v.v_reference, _forms(v))


_ASKED = "SELECT symbol FROM v_reference UNION ALL SELECT '999999'"
_TWICE = "SELECT symbol, ts_code FROM v_reference UNION ALL SELECT symbol, concat(ts_code, 'B') FROM v_reference WHERE market = 'STAR'"


@query("resolve_symbols", f"SELECT symbol, CASE WHEN count(ts_code) = 1 THEN min(ts_code) END AS ts_code, count(ts_code) AS matches FROM ({_ASKED}) a LEFT JOIN ({_TWICE}) t USING (symbol) GROUP BY symbol")
def resolve_symbols(v):
    return op.resolve_symbols(v.sql(_ASKED), v.sql(_TWICE))


_CODES = ["S00007", "S00003", "S00009", "S00001"]


@query("universe_custom", f"SELECT formation_date, ts_code, CAST(list_position({_CODES}, ts_code) - 1 AS INT) AS position FROM ({_ACTIVE}) a WHERE ts_code IN ({', '.join(repr(c) for c in _CODES)})")
def universe_custom(v):
    return op.universe_custom(_CODES, v.v_reference, _forms(v))


_INDEX = f"SELECT f.formation_date, w.con_code AS ts_code FROM (SELECT f.formation_date, max(w.trade_date) AS snapshot FROM ({_FORM}) f JOIN v_index_weight w ON w.trade_date <= f.formation_date WHERE f.formation_date >= DATE '1995-03-01' GROUP BY f.formation_date) f JOIN v_index_weight w ON w.trade_date = f.snapshot JOIN ({_ACTIVE}) a ON a.formation_date = f.formation_date AND a.ts_code = w.con_code"


@query("universe_index", _INDEX)
def universe_index(v):
    return op.universe_index(v.v_index_weight, "IDX", v.v_reference, _forms(v).where("formation_date >= DATE '1995-03-01'"))


_ALL = f"SELECT formation_date, ts_code FROM ({_ACTIVE}) a WHERE market IN ('MAIN', 'GROWTH') AND exchange = 'SSE' AND curr_type = 'CNY'"


def _all(v):
    return op.universe_all(v.v_reference, _forms(v), ["MAIN", "GROWTH"], ["SSE"], ["CNY"], ["STAR"])


@query("universe_all", _ALL)
def universe_all(v):
    return _all(v)


@query("universe_schedule", f"SELECT formation_date, count(*) AS members FROM ({_ALL}) a GROUP BY formation_date")
def universe_schedule(v):
    return _all(v).groupBy("formation_date").count().withColumnRenamed("count", "members")


@query("schedule_panel", f"SELECT formation_date, ts_code FROM ({_ALL}) a UNION SELECT formation_date, ts_code FROM ({_INDEX}) b")
def schedule_panel(v):
    return op.schedule([_all(v), op.universe_index(v.v_index_weight, "IDX", v.v_reference, _forms(v).where("formation_date >= DATE '1995-03-01'"))])


@query("period_constituents", "SELECT DISTINCT con_code AS ts_code FROM v_index_weight WHERE trade_date BETWEEN DATE '1996-01-01' AND DATE '1996-06-30'")
def period_constituents(v):
    return op.period_constituents(v.v_index_weight, datetime.date(1996, 1, 1), datetime.date(1996, 6, 30))
