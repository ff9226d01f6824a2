"""Queries of normalization and quality."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..operators import quality as op
from ..registry import query

_TEXT_DATES = "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strdate WHEN 1 THEN replace(strdate, '-', '') WHEN 2 THEN concat('x', strdate) ELSE concat(replace(strdate, '-', '/'), '') END AS raw FROM (SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS STRING) AS strdate FROM orders) o"


@query("canonical_date", f"SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(raw AS DATE) WHEN 1 THEN CAST(strptime(raw, '%Y%m%d') AS DATE) END AS parsed FROM ({_TEXT_DATES}) t")
def canonical_date(v):
    return v.sql(_TEXT_DATES).select("o_orderkey", op.canonical_date(F.col("raw")).alias("parsed"))


_RAW = """SELECT CASE WHEN k = 1 THEN NULL ELSE ts_code END AS ts_code, CASE WHEN k = 2 THEN 'soon' ELSE CAST(trade_date AS STRING) END AS trade_date, CASE WHEN k = 3 THEN 'n/a' ELSE CAST(CAST(vol AS INT) AS STRING) END AS vol
    FROM (SELECT *, row_number() OVER (ORDER BY ts_code, trade_date) % 53 AS k FROM v_day) a UNION ALL SELECT ts_code, CAST(trade_date AS STRING), CAST(CAST(vol AS INT) AS STRING) FROM v_day WHERE day(trade_date) = 1
    UNION ALL SELECT ts_code, CAST(trade_date AS STRING), '-1' FROM v_day WHERE day(trade_date) = 2"""


@query(
    "normalize_canonical",
    f"""SELECT ts_code, trade_date, vol, CASE WHEN bad THEN 'bad cast' WHEN ts_code IS NULL OR trade_date IS NULL THEN 'null key' WHEN count(*) OVER (PARTITION BY ts_code, trade_date) > 1 THEN 'conflicting key' END AS problem FROM (
        SELECT DISTINCT ts_code, try_cast(trade_date AS DATE) AS trade_date, try_cast(vol AS DOUBLE) AS vol, (trade_date IS NOT NULL AND try_cast(trade_date AS DATE) IS NULL) OR (vol IS NOT NULL AND try_cast(vol AS DOUBLE) IS NULL) AS bad FROM ({_RAW}) r) d""",
    "vol",
)
def normalize_canonical(v):
    return op.normalize_canonical(v.sql(_RAW), ["trade_date"], ["vol"], ["ts_code", "trade_date"])


_SPACED = "SELECT concat(' ', ts_code, ' ') AS ts_code, CAST(trade_date AS STRING) AS trade_date, close FROM v_month UNION ALL SELECT ts_code, CAST(trade_date AS STRING), close FROM v_month WHERE month(trade_date) = 3"


@query("normalize_factor_input", f"SELECT trim(ts_code) AS ts_code, CAST(trade_date AS DATE) AS trade_date, close, count(*) OVER (PARTITION BY trim(ts_code), trade_date) AS key_rows FROM ({_SPACED}) s", "close")
def normalize_factor_input(v):
    return op.normalize_keys(op.require_fields(v.sql(_SPACED), ["ts_code", "trade_date", "close"]))


@query("require_fields", "SELECT ts_code, trade_date, close FROM v_month", "close")
def require_fields(v):
    return op.require_fields(v.v_month, ["ts_code", "trade_date", "close"]).select("ts_code", "trade_date", "close")


_OLD = "SELECT ts_code, trade_date, close, CASE WHEN vol > 60 THEN turnover_rate END AS dv_ttm FROM v_month WHERE year(trade_date) < 1999"
_NEW = "SELECT ts_code, trade_date, CASE WHEN vol > 120 THEN close + 1 ELSE close END AS close, turnover_rate AS dv_ttm FROM v_month WHERE year(trade_date) > 1996"


@query(
    "canonical_upsert",
    f"""SELECT coalesce(o.ts_code, n.ts_code) AS ts_code, coalesce(o.trade_date, n.trade_date) AS trade_date, CASE WHEN o.ts_code IS NULL THEN n.close ELSE o.close END AS close, coalesce(o.dv_ttm, n.dv_ttm) AS dv_ttm,
        o.ts_code IS NOT NULL AND n.ts_code IS NOT NULL AND (o.close IS DISTINCT FROM n.close OR (o.dv_ttm IS NOT NULL AND o.dv_ttm IS DISTINCT FROM n.dv_ttm)) AS conflict
        FROM ({_OLD}) o FULL JOIN ({_NEW}) n ON o.ts_code = n.ts_code AND o.trade_date = n.trade_date""",
    "close dv_ttm",
)
def canonical_upsert(v):
    rows = v.v_month  # sums in one order, so that equal values of both pulls are equal
    old = rows.where("year(trade_date) < 1999").selectExpr("ts_code", "trade_date", "close", "CASE WHEN vol > 60 THEN turnover_rate END AS dv_ttm")
    new = rows.where("year(trade_date) > 1996").selectExpr("ts_code", "trade_date", "CASE WHEN vol > 120 THEN close + 1 ELSE close END AS close", "turnover_rate AS dv_ttm")
    return op.canonical_upsert(old, new, ["ts_code", "trade_date"], ("dv_ttm",))


@query("reference_priority_dedup", "SELECT ts_code, name, CASE WHEN delist_date IS NOT NULL THEN 'D' WHEN list_status = 'P' THEN 'P' ELSE 'L' END AS list_status FROM v_reference")
def reference_priority_dedup(v):
    r = v.v_reference.select("ts_code", "name", "list_status", "delist_date")
    pulls = {"D": r.where("delist_date IS NOT NULL"), "P": r.where("list_status = 'P'"), "L": r}
    return op.priority_dedup({s: f.select("ts_code", "name") for s, f in pulls.items()})


def _rules(source: str, rules: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS rule, count(CASE WHEN {c} THEN 1 END) AS violations FROM {source}" for n, c in rules.items())


# each price rule broken by some row: an open above the high and one below the low too; codes of other forms
_BARS = """SELECT CASE WHEN k = 9 THEN NULL WHEN k % 3 = 1 THEN ts_code ELSE '600000.SH' END AS ts_code, trade_date, CASE WHEN k = 4 THEN high + 1 WHEN k = 5 THEN low - 1 WHEN k = 6 THEN NULL ELSE open END AS open,
    high, CASE WHEN k = 7 THEN high + 2 ELSE low END AS low, close, vol, CASE WHEN k = 8 THEN -amount ELSE amount END AS amount, adj_factor
    FROM (SELECT *, CAST(row_number() OVER (ORDER BY ts_code, trade_date) % 97 AS INT) AS k FROM v_broken) r"""


@query(
    "quality_rules",
    _rules(
        f"({_BARS}) r",
        {
            "high_below_others": "high < greatest(coalesce(open, high), close, low)", "low_above_others": "low > least(coalesce(open, low), close, high)", "negative_volume": "vol < 0", "negative_amount": "amount < 0",
            "factor_not_positive": "adj_factor <= 0", "bad_code": "ts_code IS NULL OR NOT regexp_matches(ts_code, '^[0-9]{6}[.](SH|SZ|BJ)$')",
        },
    )
    + f" UNION ALL SELECT 'row_limit', CASE WHEN count(*) > 20000 THEN 1 ELSE 0 END FROM ({_BARS}) r",
)
def quality_rules(v):
    return op.quality_rules(v.sql(_BARS), 20_000)


# codes of another form: delisted before, inside and after the interval, with dates out of order, without dates, and listed
_MARKED = """SELECT CASE WHEN k % 5 < 4 THEN concat('T', symbol) WHEN k % 25 = 9 THEN NULL ELSE concat(symbol, CASE k % 3 WHEN 0 THEN '.SH' WHEN 1 THEN '.SZ' ELSE '.BJ' END) END AS ts_code,
    CASE WHEN k % 5 = 0 THEN {add_days(DATE '1994-01-01', k)} WHEN k % 7 = 6 THEN NULL ELSE list_date END AS list_date,
    CASE WHEN k % 5 = 0 THEN {add_days(DATE '1995-02-01', k)} WHEN k % 11 = 7 THEN DATE '1990-01-01' ELSE coalesce(delist_date, DATE '1997-01-01') END AS delist_date, CASE WHEN k % 13 = 5 THEN 'L' ELSE 'D' END AS list_status
    FROM (SELECT *, CAST(symbol AS INT) AS k FROM v_reference) r"""
_SHAPED = "coalesce(regexp_matches(ts_code, '^[0-9]{6}[.](SH|SZ|BJ)$'), FALSE)"
_CLASSED = f"""SELECT *, CASE rule_id WHEN 'TS_CODE_6_DIGIT_CN_EXCHANGE_SUFFIX' THEN 'CANONICAL_TRADABLE' WHEN 'LEGACY_REFERENCE_OUTSIDE_REQUIRED_INTERVAL' THEN 'LEGACY_REFERENCE' ELSE 'INVALID' END AS identifier_class FROM (
    SELECT *, CASE WHEN {_SHAPED} THEN 'TS_CODE_6_DIGIT_CN_EXCHANGE_SUFFIX' WHEN coalesce(list_status <> 'D' OR list_date IS NULL OR delist_date IS NULL OR list_date > delist_date, TRUE) THEN 'NONCANONICAL_REFERENCE_IDENTITY_UNPROVEN'
        WHEN delist_date <= DATE '1995-06-01' OR list_date > DATE '1996-06-30' THEN 'LEGACY_REFERENCE_OUTSIDE_REQUIRED_INTERVAL' ELSE 'UNSUPPORTED_LEGACY_SECURITY_IDENTIFIER' END AS rule_id FROM ({_MARKED}) m) c"""


def _classified(v):
    return op.classify_identifier(v.sql(_MARKED), datetime.date(1995, 6, 1), datetime.date(1996, 6, 30))


@query("bad_code_mask", f"SELECT list_date, ts_code, NOT {_SHAPED} AS bad FROM ({_MARKED}) m")
def bad_code_mask(v):
    return v.sql(_MARKED).select("list_date", "ts_code", op.bad_code(F.col("ts_code")).alias("bad"))


@query("classify_identifier", _CLASSED)
def classify_identifier(v):
    return _classified(v)


@query("identifier_evidence", f"SELECT identifier_class, rule_id, count(*) AS rows, coalesce(string_agg(CASE WHEN n <= 20 AND identifier_class <> 'CANONICAL_TRADABLE' THEN coalesce(ts_code, '') END, ',' ORDER BY ts_code NULLS FIRST), '') AS samples FROM (SELECT *, row_number() OVER (PARTITION BY identifier_class, rule_id ORDER BY ts_code NULLS FIRST) AS n FROM ({_CLASSED}) c) e GROUP BY identifier_class, rule_id")
def identifier_evidence(v):
    return op.identifier_evidence(_classified(v))


@query("bounded_samples", f"SELECT DISTINCT identifier_class, ts_code FROM ({_CLASSED}) c ORDER BY identifier_class, ts_code NULLS FIRST LIMIT 20")
def bounded_samples(v):
    return op.bounded_samples(_classified(v), ["identifier_class", "ts_code"])


# nulls and NaNs on one or both sides, text, values inside and beyond the tolerance, and keys of one side
_LEFT = "SELECT ts_code, trade_date, CASE WHEN n = 1 THEN NULL WHEN n = 2 THEN CAST('NaN' AS DOUBLE) ELSE high END AS high, CASE n WHEN 3 THEN 'x' WHEN 4 THEN NULL ELSE 'text' END AS note, vol FROM (SELECT *, day(trade_date) AS n FROM v_day) d WHERE day(trade_date) <> 28"
_RIGHT = "SELECT ts_code, trade_date, CASE WHEN n IN (1, 2) AND vol > 30 THEN NULL WHEN n = 6 THEN high + 0.0001E0 WHEN n = 7 THEN high - 0.01E0 ELSE high END AS high, CASE WHEN n = 4 AND vol > 30 THEN NULL ELSE 'text' END AS note, vol FROM (SELECT *, day(trade_date) AS n FROM v_day) d WHERE day(trade_date) <> 27"


@query(
    "compare_tables",
    f"""SELECT coalesce(a.ts_code, b.ts_code) AS ts_code, coalesce(a.trade_date, b.trade_date) AS trade_date, f.field, CASE WHEN b.ts_code IS NULL THEN 'left_only' WHEN a.ts_code IS NULL THEN 'right_only' ELSE 'value' END AS difference
        FROM (SELECT *, CASE WHEN isnan(high) THEN NULL ELSE high END AS h FROM ({_LEFT}) l) a FULL JOIN (SELECT *, high AS h FROM ({_RIGHT}) r) b ON a.ts_code = b.ts_code AND a.trade_date = b.trade_date,
        (VALUES ('*'), ('high'), ('note')) f(field) WHERE (f.field = '*' AND (a.ts_code IS NULL OR b.ts_code IS NULL)) OR (a.ts_code IS NOT NULL AND b.ts_code IS NOT NULL AND
        ((f.field = 'high' AND (abs(a.h - b.h) > 0.001 OR (a.h IS NULL) <> (b.h IS NULL))) OR (f.field = 'note' AND a.note IS DISTINCT FROM b.note)))""",
)
def compare_tables(v):
    return op.compare_tables(v.sql(_LEFT), v.sql(_RIGHT), ["ts_code", "trade_date"], ["high", "note", "vol"], 0.001)


# a pull for every open day; one without rows is a pull too
@query("check_nonempty_limit", "SELECT o.cal_date AS trade_date, count(d.ts_code) AS rows, count(d.ts_code) > 0 AND count(d.ts_code) < 20 AS complete FROM v_open o LEFT JOIN (SELECT * FROM v_day WHERE day(trade_date) <> 8) d ON d.trade_date = o.cal_date GROUP BY o.cal_date")
def check_nonempty_limit(v):
    return op.nonempty_within(v.v_day.where("day(trade_date) <> 8"), ["trade_date"], 20, v.v_open.select(F.col("cal_date").alias("trade_date")))


def _complete(have: str, want: str) -> str:
    return f"SELECT unit, 'missing' AS problem FROM (SELECT unit FROM ({want}) w EXCEPT SELECT unit FROM ({have}) h) a UNION ALL SELECT unit, 'unexpected' FROM (SELECT unit FROM ({have}) h EXCEPT SELECT unit FROM ({want}) w) b"


_CAL = "SELECT cal_date AS unit, CASE WHEN day(cal_date) = 3 THEN 'SZSE' ELSE 'SSE' END AS exchange FROM v_calendar WHERE day(cal_date) <> 13"
_WANT = "SELECT cal_date AS unit FROM v_calendar WHERE year(cal_date) < 2000"
_TRADED = "SELECT DISTINCT trade_date AS unit FROM v_day"
_OPEN = "SELECT cal_date AS unit FROM v_open WHERE cal_date >= DATE '1996-01-01'"
_ONE = "SELECT trade_date AS unit, ts_code FROM v_day WHERE ts_code = 'Brand#11' OR (ts_code = 'Brand#12' AND day(trade_date) < 9)"
_MONTHS = "SELECT DISTINCT substr(CAST(trade_date AS STRING), 1, 7) AS unit FROM v_index_weight WHERE month(trade_date) <> 5"
_WANT_MONTHS = "SELECT DISTINCT substr(CAST(cal_date AS STRING), 1, 7) AS unit FROM v_calendar WHERE year(cal_date) > 1995"



def _scoped(have: str, want: str, column: str, value: str) -> str:
    return f"{_complete(have, want)} UNION ALL SELECT DISTINCT unit, 'other {column}' FROM ({have}) s WHERE {column} <> '{value}'"


@query("check_calendar_units", _scoped(_CAL, _WANT, "exchange", "SSE"))
def check_calendar_units(v):
    return op.completeness(v.sql(_CAL), v.sql(_WANT), scope={"exchange": "SSE"})


@query("check_entity_units", _scoped(_ONE, _OPEN, "ts_code", "Brand#11"))
def check_entity_units(v):
    return op.completeness(v.sql(_ONE), v.sql(_OPEN), scope={"ts_code": "Brand#11"})


@query("check_market_units", _complete(_TRADED, _OPEN))
def check_market_units(v):
    return op.completeness(v.sql(_TRADED), v.sql(_OPEN))


@query("check_month_units", _complete(_MONTHS, _WANT_MONTHS))
def check_month_units(v):
    return op.completeness(v.sql(_MONTHS), v.sql(_WANT_MONTHS))


_ASKED = """SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN concat('  ', c_name, '  b ') WHEN 1 THEN concat(lower(c_name), '　x　') WHEN 2 THEN lpad(CAST(c_custkey AS STRING), 6, '6') WHEN 3 THEN concat(' ', lpad(CAST(c_custkey AS STRING), 6, '0'), '　')
    WHEN 4 THEN concat(lpad(CAST(c_custkey AS STRING), 6, '8'), '.bj') WHEN 5 THEN lpad(CAST(c_custkey AS STRING), 6, '4') END AS q FROM customer"""
_NORMAL = "upper(trim(replace(coalesce({0}, ''), '　', ' ')))".format
_AS_CODE = "CASE WHEN regexp_matches({0}, '^6[0-9]{{5}}$') THEN concat({0}, '.SH') WHEN regexp_matches({0}, '^[03][0-9]{{5}}$') THEN concat({0}, '.SZ') ELSE {0} END".format


@query("normalize_query", f"SELECT c_custkey, {_NORMAL('q')} AS normalized FROM ({_ASKED}) a")
def normalize_query(v):
    return v.sql(_ASKED).select("c_custkey", op.normalize_query(F.col("q")).alias("normalized"))


@query("normalize_code", f"SELECT c_custkey, {_AS_CODE(_NORMAL('q'))} AS code FROM ({_ASKED}) a")
def normalize_code(v):
    return v.sql(_ASKED).select("c_custkey", op.normalize_code(F.col("q")).alias("code"))


# two tables of rows in order: codes that are one only once normalized, names that change, and a table without industries
_FIRST = "SELECT CASE WHEN CAST(symbol AS INT) % 2 = 0 THEN symbol ELSE concat(' ', lower(ts_code)) END AS ts_code, CASE WHEN CAST(symbol AS INT) % 9 = 4 THEN NULL ELSE name END AS name, industry, CAST(symbol AS INT) AS row_no FROM v_reference WHERE market <> 'STAR'"
_FIRST += " UNION ALL SELECT concat(symbol, '.sz'), concat('A later ', name), NULL, 100000 + CAST(symbol AS INT) FROM v_reference WHERE market <> 'STAR'"
_SECOND = "SELECT ts_code, concat('second ', name) AS name, CAST(symbol AS INT) AS row_no FROM v_reference"
_LOOK = f"""SELECT ts_code, name, industry FROM (SELECT *, row_number() OVER (PARTITION BY ts_code ORDER BY p, row_no) AS n FROM (
    SELECT {_AS_CODE(_NORMAL('ts_code'))} AS ts_code, name, industry, row_no, 0 AS p FROM ({_FIRST}) f UNION ALL SELECT {_AS_CODE(_NORMAL('ts_code'))}, name, NULL, row_no, 1 FROM ({_SECOND}) s) b) l WHERE n = 1"""


def _lookup(v):
    return op.security_lookup(v.sql(_FIRST), v.sql(_SECOND), "row_no")


@query("security_lookup", _LOOK)
def security_lookup(v):
    return _lookup(v)


# a wide space around, a name's part, six digits, a code without its suffix, and a blank, which finds nothing
_TERMS = ("　00001 ", "later supplier#00000000", "000002", "000004.sz", "　 ")


@query("search_security", " UNION ALL ".join(f"SELECT '{i}' AS term, l.* FROM ({_LOOK}) l WHERE {_NORMAL(chr(39) + t + chr(39))} <> '' AND (upper(ts_code) = {_AS_CODE(_NORMAL(chr(39) + t + chr(39)))} OR substr(upper(ts_code), 1, 6) = {_NORMAL(chr(39) + t + chr(39))} OR contains(upper(coalesce(name, '')), {_NORMAL(chr(39) + t + chr(39))}))" for i, t in enumerate(_TERMS)))
def search_security(v):
    found = [op.search_security(_lookup(v), t).select(F.lit(str(i)).alias("term"), "*") for i, t in enumerate(_TERMS)]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


_RECORDS = "SELECT concat(ts_code, ' ') AS ts_code, replace(CAST(ann_date AS STRING), '-', '') AS ann_date, CAST(end_date AS STRING) AS end_date, value FROM v_financial UNION ALL SELECT ts_code, CAST(ann_date AS STRING), CAST(end_date AS STRING), value + 1 FROM v_financial WHERE day(ann_date) = 7"


@query("normalize_financial", "SELECT ts_code, ann_date, end_date, value, count(*) OVER (PARTITION BY ts_code, ann_date, end_date) AS key_rows FROM (SELECT * FROM v_financial UNION ALL SELECT ts_code, ann_date, end_date, value + 1 FROM v_financial WHERE day(ann_date) = 7) f", "value")
def normalize_financial(v):
    return op.normalize_financial(v.sql(_RECORDS))


@query("finite_positive", _rules("v_broken", {"vol": "vol IS NULL OR vol <= 0", "adj_factor": "adj_factor IS NULL OR adj_factor <= 0", "close": "close IS NULL OR close <= 0"}))
def finite_positive(v):
    return op.finite_positive(v.v_broken, ["vol", "adj_factor", "close"])
