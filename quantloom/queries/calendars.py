"""Queries of calendars and coverage."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..operators import calendars as cal
from ..operators import coverage as cov
from ..operators import factors
from ..registry import query

_HOLED = "SELECT cal_date, is_open FROM v_calendar WHERE day(cal_date) <> 17 UNION ALL SELECT cal_date, is_open FROM v_calendar WHERE day(cal_date) = 5 AND month(cal_date) = 2"


@query("build_trading_calendar", "SELECT cal_date, pos FROM v_open")
def build_trading_calendar(v):
    return cal.open_days(cal.proven(v.v_calendar))


# days whose units failed, days without a row, and days with two
_OF_CALENDAR = "SELECT CAST(cal_date AS STRING) AS unit, CASE WHEN day(cal_date) = 21 THEN 'FAILED' ELSE 'COMPLETE' END AS status FROM v_calendar WHERE day(cal_date) <> 23"


@query(
    "open_dates_from_coverage",
    f"""SELECT c.cal_date, CASE WHEN day(c.cal_date) IN (21, 23) THEN 'unit is not complete' WHEN coalesce(n, 0) <> 1 THEN 'unit is missing or ambiguous' END AS problem
        FROM v_calendar c LEFT JOIN (SELECT cal_date, count(*) AS n FROM ({_HOLED}) h GROUP BY cal_date) h ON h.cal_date = c.cal_date WHERE c.cal_date BETWEEN DATE '1995-02-01' AND DATE '1997-12-31' AND (c.is_open = 1 OR day(c.cal_date) IN (21, 23) OR coalesce(n, 0) <> 1)""",
)
def open_dates_from_coverage(v):
    return cal.open_dates_from_coverage(v.sql(_HOLED), v.sql(_OF_CALENDAR), datetime.date(1995, 2, 1), datetime.date(1997, 12, 31), fail=False)


@query("is_trading_day", "SELECT cal_date, is_open = 1 AS is_trading_day FROM v_calendar")
def is_trading_day(v):
    return cal.is_trading_day(v.v_calendar.select("cal_date"), cal.open_days(v.v_calendar))


@query("next_trading_day", "SELECT cal_date, min(CASE WHEN is_open = 1 THEN cal_date END) OVER (ORDER BY cal_date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_trading_day FROM v_calendar")
def next_trading_day(v):
    return cal.next_trading_day(v.v_calendar, cal.open_days(v.v_calendar))


@query("shift_open_date", "SELECT cal_date, lead(cal_date, 5) OVER (ORDER BY cal_date) AS shifted FROM v_open")
def shift_open_date(v):
    days = cal.open_days(v.v_calendar)
    return cal.shift_open(days.select("cal_date"), days, 5, fail=False)


_FORM = "SELECT max(cal_date) AS formation_date FROM v_open GROUP BY year(cal_date), month(cal_date)"


@query("formation_dates", _FORM)
def formation_dates(v):
    return cal.formation_dates(cal.open_days(v.v_calendar))


@query("formation_dates_checked", "SELECT max(CASE WHEN is_open = 1 THEN cal_date END) AS formation_date FROM v_calendar GROUP BY year(cal_date), month(cal_date) HAVING count(*) = day(last_day(min(cal_date)))")
def formation_dates_checked(v):
    return cal.formation_dates_checked(v.v_calendar)


@query(
    "resolve_history",
    f"""SELECT 'DAYS' AS kind, f.formation_date, d.cal_date AS first_date, f.formation_date AS last_date FROM ({_FORM}) f JOIN v_open o ON o.cal_date = f.formation_date LEFT JOIN v_open d ON d.pos = o.pos - 59
        UNION ALL SELECT 'MONTHS', formation_date, (SELECT min(o.cal_date) FROM v_open o WHERE date_trunc('month', o.cal_date) = date_trunc('month', formation_date) - INTERVAL 2 MONTH), formation_date FROM ({_FORM}) f
        UNION ALL SELECT 'DAY', formation_date, formation_date, formation_date FROM ({_FORM}) f""",
)
def resolve_history(v):
    days = cal.open_days(v.v_calendar)
    forms = cal.formation_dates(days)
    windows = [cal.history_window(forms, days, kind, n, fail=False).withColumn("kind", F.lit(kind)) for kind, n in (("DAYS", 60), ("MONTHS", 3), ("DAY", 1))]
    return windows[0].unionByName(windows[1]).unionByName(windows[2])


@query("open_window", f"SELECT f.formation_date, d.cal_date AS window_date FROM ({_FORM}) f JOIN v_open o ON o.cal_date = f.formation_date JOIN v_open d ON d.pos BETWEEN o.pos - 9 AND o.pos")
def open_window(v):
    days = cal.open_days(v.v_calendar)
    return cal.open_window(cal.formation_dates(days), days, 10)


@query("strict_common_calendar", "SELECT trade_date, 'left_only' AS side FROM (SELECT DISTINCT trade_date FROM v_day WHERE day(trade_date) <> 3 EXCEPT SELECT cal_date FROM v_open WHERE day(cal_date) <> 4) a UNION ALL SELECT cal_date, 'right_only' FROM (SELECT cal_date FROM v_open WHERE day(cal_date) <> 4 EXCEPT SELECT trade_date FROM v_day WHERE day(trade_date) <> 3) b")
def strict_common_calendar(v):
    return cal.strict_common(v.v_day.where("day(trade_date) <> 3"), v.sql("SELECT cal_date AS trade_date FROM v_open WHERE day(cal_date) <> 4"), "trade_date")


@query("calendar_covered", "SELECT count(*) AS days, count(CASE WHEN day(cal_date) = 17 THEN 1 END) AS missing, count(CASE WHEN day(cal_date) = 17 THEN 1 END) = 0 AS covered FROM v_calendar WHERE cal_date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'")
def calendar_covered(v):
    return cal.covered(v.sql(_HOLED), datetime.date(1996, 1, 1), datetime.date(1996, 12, 31))


# requirements of the codes' own histories: kinds by code
_NEED = """SELECT 'daily' AS dataset_id, 'ALL' AS scope_key, 'OPEN_DAYS' AS kind, min(trade_date) AS start_date, max(trade_date) AS end_date FROM v_day
    UNION ALL SELECT 'trade_cal', 'SSE', 'DAYS', min(cal_date), max(cal_date) FROM v_calendar UNION ALL SELECT 'index_weight', 'IDX', 'MONTHS', min(trade_date), max(trade_date) FROM v_index_weight
    UNION ALL SELECT 'stock_basic', ts_code, 'SNAPSHOT', list_date, list_date FROM v_reference"""
_UNITS = """SELECT 'daily' AS dataset_id, 'ALL' AS scope_key, CAST(cal_date AS STRING) AS unit FROM v_open WHERE cal_date BETWEEN (SELECT min(trade_date) FROM v_day) AND (SELECT max(trade_date) FROM v_day)
    UNION ALL SELECT 'trade_cal', 'SSE', CAST(cal_date AS STRING) FROM v_calendar UNION ALL SELECT DISTINCT 'index_weight', 'IDX', substr(CAST(cal_date AS STRING), 1, 7) FROM v_calendar WHERE cal_date BETWEEN (SELECT date_trunc('month', min(trade_date)) FROM v_index_weight) AND (SELECT max(trade_date) FROM v_index_weight)
    UNION ALL SELECT 'stock_basic', ts_code, 'SNAPSHOT' FROM v_reference"""


def _required(v):
    return cov.required_units(v.sql(_NEED), cal.open_days(v.v_calendar))


@query("required_units", f"SELECT DISTINCT * FROM ({_UNITS}) u")
def required_units(v):
    return _required(v)


_DONE = "SELECT dataset_id, scope_key, unit FROM v_coverage WHERE status = 'COMPLETE'"
_GONE = f"SELECT * FROM (SELECT DISTINCT * FROM ({_UNITS}) u WHERE dataset_id = 'daily') u EXCEPT {_DONE}"


@query("missing_units", _GONE)
def missing_units(v):
    return cov.missing_units(_required(v).where("dataset_id = 'daily'"), v.v_coverage)


@query("fetch_islands", f"SELECT dataset_id, scope_key, min(unit) AS first_unit, max(unit) AS last_unit, count(*) AS units FROM (SELECT r.*, pos - row_number() OVER (ORDER BY pos) AS island FROM (SELECT *, row_number() OVER (ORDER BY unit) AS pos FROM (SELECT DISTINCT * FROM ({_UNITS}) u WHERE dataset_id = 'daily') d) r WHERE unit IN (SELECT unit FROM ({_GONE}) g)) i GROUP BY dataset_id, scope_key, island")
def fetch_islands(v):
    required = _required(v).where("dataset_id = 'daily'")
    return cov.islands(required, cov.missing_units(required, v.v_coverage))


@query("units_complete", _DONE)
def units_complete(v):
    return cov.complete_units(v.v_coverage)


@query("coverage_records", "SELECT * FROM v_coverage ORDER BY dataset_id, scope_key, unit")
def coverage_records(v):
    return v.v_coverage.orderBy("dataset_id", "scope_key", "unit")


_SPANS = "SELECT concat('d', CAST(c_nationkey AS STRING)) AS dataset_id, {add_days(CAST(o_orderdate AS DATE), 0)} AS start_date, {add_days(CAST(o_orderdate AS DATE), o_orderkey % 9)} AS end_date FROM orders JOIN customer ON o_custkey = c_custkey"


@query(
    "merge_intervals",
    f"""SELECT dataset_id, min(start_date) AS start_date, max(end_date) AS end_date FROM (SELECT *, sum(fresh) OVER (PARTITION BY dataset_id ORDER BY start_date, end_date ROWS UNBOUNDED PRECEDING) AS island FROM (
        SELECT *, CASE WHEN start_date <= max(end_date) OVER (PARTITION BY dataset_id ORDER BY start_date, end_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM ({_SPANS}) s) a) b GROUP BY dataset_id, island""",
)
def merge_intervals(v):
    return cov.merge_intervals(v.sql(_SPANS), ["dataset_id"])


_FIELDED = "SELECT n_name AS dataset_id, c_mktsegment AS scope_key, CAST(o_orderdate AS DATE) AS start_date, CAST(o_orderdate AS DATE) AS end_date, o_orderpriority AS field FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"


@query("union_requirements", f"SELECT dataset_id, scope_key, min(start_date) AS start_date, max(end_date) AS end_date, string_agg(DISTINCT field, ',' ORDER BY field) AS fields FROM ({_FIELDED}) f GROUP BY dataset_id, scope_key")
def union_requirements(v):
    return cov.union_requirements(v.sql(_FIELDED).withColumn("fields", F.array("field")), ["dataset_id", "scope_key"])


# requirements of orders: fields and reasons by priority, a cutoff by month, snapshots of some segments
_ASKED = """SELECT n_name AS dataset_id, c_mktsegment AS scope_key, CASE WHEN c_mktsegment LIKE '%L%' THEN 'SNAPSHOT' ELSE 'DAYS' END AS kind, CAST(o_orderdate AS DATE) AS start_date, {add_days(CAST(o_orderdate AS DATE), o_orderkey % 40)} AS end_date,
    left(o_orderpriority, 1) AS field, concat('r', CAST(o_orderkey % 3 AS STRING)) AS reason, CASE WHEN o_orderkey % 4 > 0 THEN DATE '1999-01-01' END AS cutoff FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""
_COALESCED = f"""SELECT dataset_id, scope_key, kind, field, cutoff, min(start_date) AS start_date, max(end_date) AS end_date, list(reason) AS reasons FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY dataset_id, scope_key, kind, field, cutoff ORDER BY start_date, end_date ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, CASE WHEN start_date <= max(end_date) OVER (PARTITION BY dataset_id, scope_key, kind, field, cutoff ORDER BY start_date, end_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM ({_ASKED}) s) a) b GROUP BY dataset_id, scope_key, kind, field, cutoff, island"""


@query(
    "merge_snapshot_requirements",
    f"""SELECT dataset_id, scope_key, kind, start_date, end_date, field AS fields, cutoff, array_to_string(list_sort(list_distinct(reasons)), ',') AS reasons FROM ({_COALESCED}) c WHERE kind <> 'SNAPSHOT'
        UNION ALL SELECT dataset_id, scope_key, kind, min(start_date), max(end_date), string_agg(DISTINCT field, ',' ORDER BY field), max(cutoff), string_agg(DISTINCT reason, ',' ORDER BY reason) FROM ({_ASKED}) a WHERE kind = 'SNAPSHOT' GROUP BY dataset_id, scope_key, kind""",
)
def merge_snapshot_requirements(v):
    asked = v.sql(_ASKED).withColumns({"fields": F.array("field"), "reasons": F.array("reason")}).drop("field", "reason")
    return cov.merge_snapshots(asked).withColumns({"fields": F.array_join("fields", ","), "reasons": F.array_join("reasons", ",")})


_CACHED = "SELECT ts_code AS dataset_id, min(trade_date) AS first_date, max(trade_date) AS last_date FROM v_month WHERE vol > 60 GROUP BY ts_code"
_RANGES = f"SELECT dataset_id, 'head' AS part, DATE '1994-12-01' AS start_date, CAST(least(first_date - 1, DATE '2002-01-15') AS DATE) AS end_date FROM ({_CACHED}) c WHERE first_date > DATE '1994-12-01' UNION ALL SELECT dataset_id, 'tail', CAST(greatest(last_date + 1, DATE '1994-12-01') AS DATE), DATE '2002-01-15' FROM ({_CACHED}) c WHERE last_date < DATE '2002-01-15'"


def _ranges(v):
    return cov.missing_ranges(v.sql(_CACHED), datetime.date(1994, 12, 1), datetime.date(2002, 1, 15))


@query("missing_ranges", _RANGES)
def missing_ranges(v):
    return _ranges(v)


@query("coverage_by_dataset", f"SELECT dataset_id, count(*) AS ranges, min(start_date) AS first_missing, max(end_date) AS last_missing FROM ({_RANGES}) r GROUP BY dataset_id")
def coverage_by_dataset(v):
    return _ranges(v).groupBy("dataset_id").agg(F.count(F.lit(1)).alias("ranges"), F.min("start_date").alias("first_missing"), F.max("end_date").alias("last_missing"))


# month-end formations of two years; factors of the same fields are one requirement where their ranges overlap
@query(
    "factor_requirements",
    f"""SELECT dataset_id, 'ALL' AS scope_key, 'OPEN_DAYS' AS kind, d.cal_date AS start_date, last AS end_date, fields, last AS cutoff, reasons FROM (SELECT min(formation_date) AS first, max(formation_date) AS last FROM ({_FORM}) x WHERE formation_date BETWEEN DATE '1998-01-05' AND DATE '1999-12-30') f
        JOIN v_open o ON o.cal_date = first, (VALUES ('daily', 'close', 251, 'factor:high_52w,factor:momentum_20d,factor:momentum_60d'), ('daily_basic', 'turnover_rate', 19, 'factor:turnover_mean_20d')) m(dataset_id, fields, back, reasons) JOIN v_open d ON d.pos = o.pos - back""",
)
def factor_requirements(v):
    metadata = factors.factor_metadata(v.spark).where(F.col("factor_name").isin("momentum_20d", "momentum_60d", "high_52w", "turnover_mean_20d"))
    days = cal.open_days(v.v_calendar)
    forms = cal.formation_dates(days).where("formation_date BETWEEN DATE '1998-01-05' AND DATE '1999-12-30'")
    return cov.factor_requirements(metadata, days, forms).withColumns({"fields": F.array_join("fields", ","), "reasons": F.array_join("reasons", ",")})


_ROWS = "SELECT CAST(trade_date AS STRING) AS unit, ts_code, CAST(vol AS BIGINT) AS vol, CASE WHEN vol > 30 THEN trade_date END AS noted FROM v_day"
# what was stored since: a changed value, a lost row, a value that became null, and two rows whose units are exchanged
_STORED = f"""SELECT CASE WHEN swapped AND day = 20 THEN following WHEN swapped AND day = 21 THEN before ELSE unit END AS unit, ts_code, CASE WHEN day = 7 AND ts_code = 'Brand#11' THEN vol + 1 ELSE vol END AS vol, CASE WHEN day = 13 THEN NULL ELSE noted END AS noted FROM (
    SELECT *, ts_code = 'Brand#21' AS swapped, day(CAST(unit AS DATE)) AS day, CAST({{add_days(CAST(unit AS DATE), 1)}} AS STRING) AS following, CAST({{add_days(CAST(unit AS DATE), -1)}} AS STRING) AS before FROM ({_ROWS}) r) t WHERE NOT (day = 9 AND ts_code = 'Brand#11')"""
_TEXT = "coalesce(length(CAST(noted AS STRING)) || ':' || CAST(noted AS STRING), '-') || length(ts_code) || ':' || ts_code || length(CAST(vol AS STRING)) || ':' || CAST(vol AS STRING)"
_HASHED = "SELECT unit, count(*) AS row_count, sha256(concat_ws(':', count(*), sum(CAST(concat('0x', substr(m, 1, 15)) AS BIGINT)), sum(CAST(concat('0x', substr(m, 16, 15)) AS BIGINT)))) AS content_hash FROM (SELECT unit, md5({0}) AS m FROM ({1}) r) h GROUP BY unit".format
_DERIVED = f"SELECT 'daily' AS dataset_id, 'ALL' AS scope_key, unit, 'COMPLETE' AS status, row_count, '1.0' AS schema_version, content_hash FROM ({_HASHED(_TEXT, _ROWS)}) f"
_RECORDED = "CASE WHEN day(CAST(unit AS DATE)) = 3 THEN '0.9' ELSE '1.0' END"


@query("derive_coverage", _DERIVED)
def derive_coverage(v):
    return cov.derive_coverage(v.sql(_ROWS), "daily")


@query(
    "verified_units",
    f"""SELECT c.dataset_id, c.scope_key, c.unit, c.row_count, coalesce(s.row_count, 0) AS stored, {_RECORDED.replace("unit", "c.unit")} AS schema_version,
        coalesce(s.row_count = c.row_count AND s.content_hash = c.content_hash, FALSE) AND day(CAST(c.unit AS DATE)) <> 3 AS verified FROM ({_DERIVED}) c LEFT JOIN ({_HASHED(_TEXT, _STORED)}) s ON s.unit = c.unit WHERE day(CAST(c.unit AS DATE)) <> 5""",
)
def verified_units(v):
    version, failed = F.when(F.dayofmonth(F.to_date("unit")) == 3, "0.9").otherwise("1.0"), F.when(F.dayofmonth(F.to_date("unit")) == 5, "FAILED").otherwise("COMPLETE")
    recorded = cov.derive_coverage(v.sql(_ROWS), "daily").withColumns({"schema_version": version, "status": failed})
    return cov.verified_units(v.sql(_STORED), recorded, ["ts_code", "vol", "noted"], "1.0")


@query("empty_unit_proof", "SELECT 'suspend_d' AS dataset_id, 'ALL' AS scope_key, CAST(cal_date AS STRING) AS unit, 'COMPLETE' AS status, CAST(0 AS BIGINT) AS row_count FROM v_open WHERE cal_date NOT IN (SELECT trade_date FROM v_day WHERE vol < 5) UNION ALL SELECT 'suspend_d', 'ALL', CAST(trade_date AS STRING), 'COMPLETE', count(*) FROM v_day WHERE vol < 5 GROUP BY trade_date")
def empty_unit_proof(v):
    held = cov.derive_coverage(v.sql("SELECT CAST(trade_date AS STRING) AS unit FROM v_day WHERE vol < 5"), "suspend_d").drop("schema_version", "content_hash")
    asked = v.sql("SELECT CAST(cal_date AS STRING) AS unit FROM v_open")
    empty = asked.join(held, "unit", "left_anti").select(F.lit("suspend_d").alias("dataset_id"), F.lit("ALL").alias("scope_key"), "unit", F.lit("COMPLETE").alias("status"), F.lit(0).cast("long").alias("row_count"))
    return held.unionByName(empty)


_NEWER = "SELECT dataset_id, scope_key, unit, 'COMPLETE' AS status, row_count + 1 AS row_count, {add_days(completed_at, 1)} AS completed_at FROM v_coverage WHERE status = 'FAILED' UNION ALL SELECT dataset_id, scope_key, concat(unit, 'x'), status, row_count, completed_at FROM v_coverage WHERE row_count < 15"


@query("coverage_upsert", f"SELECT dataset_id, scope_key, unit, status, row_count, completed_at FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id, scope_key, unit ORDER BY completed_at DESC, i DESC) AS n FROM (SELECT *, 0 AS i FROM v_coverage UNION ALL SELECT *, 1 FROM ({_NEWER}) w) b) u WHERE n = 1")
def coverage_upsert(v):
    return cov.coverage_upsert(v.v_coverage, v.sql(_NEWER))


@query("dataset_status", "SELECT dataset_id, count(unit) AS complete_units FROM (SELECT 'daily' AS dataset_id UNION ALL SELECT 'adj_factor') d LEFT JOIN (SELECT dataset_id, unit FROM v_coverage WHERE status = 'COMPLETE') c USING (dataset_id) GROUP BY dataset_id")
def dataset_status(v):
    return cov.dataset_status(v.v_coverage, v.sql("SELECT 'daily' AS dataset_id UNION ALL SELECT 'adj_factor'"))
