"""Panels of the shapes that research uses, out of the test tables.

Each view is one SQL text that Spark and DuckDB both read; where the dialects differ a
word in braces stands for the expression.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

VIEWS = {
    "v_month": """
        SELECT concat('S', lpad(CAST(l_suppkey AS STRING), 5, '0')) AS ts_code, last_day(CAST(l_shipdate AS DATE)) AS trade_date,
               sum(l_extendedprice) / sum(l_quantity) AS close, sum(l_extendedprice) AS amount, sum(l_quantity) AS vol,
               100 * avg(l_discount) AS turnover_rate, n_name AS industry, s_acctbal + 2000 AS total_mv
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
        GROUP BY l_suppkey, last_day(CAST(l_shipdate AS DATE)), n_name, s_acctbal""",
    "v_day": """
        SELECT p_brand AS ts_code, CAST(l_shipdate AS DATE) AS trade_date, sum(l_extendedprice) / sum(l_quantity) AS close,
               min(l_extendedprice / l_quantity) AS low, max(l_extendedprice / l_quantity) AS high,
               sum(l_extendedprice) AS amount, sum(l_quantity) AS vol, 100 * avg(l_discount) AS turnover_rate
        FROM lineitem JOIN part ON l_partkey = p_partkey WHERE {isodow(CAST(l_shipdate AS DATE))} <= 5
        GROUP BY p_brand, CAST(l_shipdate AS DATE)""",
    "v_valuation": """
        SELECT ts_code, trade_date, close, (turnover_rate - 4.00037) * 10 AS pe_ttm, close / 1000 - 0.5 AS pb,
               CASE WHEN vol > 30 THEN vol END AS ps_ttm, turnover_rate - 2.00037 AS dv_ttm, amount AS total_mv, amount - 50000 AS circ_mv FROM v_day""",
    "v_calendar": """
        SELECT d.cal_date, CASE WHEN {isodow(d.cal_date)} <= 5 THEN 1 ELSE 0 END AS is_open
        FROM (SELECT {days(min(CAST(l_shipdate AS DATE)), max(CAST(l_shipdate AS DATE)))} AS cal_date FROM lineitem) d""",
    "v_open": "SELECT cal_date, row_number() OVER (ORDER BY cal_date) AS pos FROM v_calendar WHERE is_open = 1",
    "v_financial": """
        SELECT ts_code, ann_date, last_day({add_months(ann_date, -1)}) AS end_date, value FROM (
            SELECT concat('S', lpad(CAST(o_custkey % (SELECT count(*) FROM supplier) + 1 AS STRING), 5, '0')) AS ts_code,
                   CAST(o_orderdate AS DATE) AS ann_date, max(o_totalprice) AS value
            FROM orders GROUP BY 1, 2) f""",
    "v_reference": """
        SELECT concat('S', lpad(CAST(s_suppkey AS STRING), 5, '0')) AS ts_code, lpad(CAST(s_suppkey AS STRING), 6, '0') AS symbol, s_name AS name, n_name AS industry,
               CASE s_suppkey % 3 WHEN 0 THEN 'MAIN' WHEN 1 THEN 'GROWTH' ELSE 'STAR' END AS market,
               CASE s_suppkey % 2 WHEN 0 THEN 'SSE' ELSE 'SZSE' END AS exchange, 'CNY' AS curr_type,
               CASE WHEN s_suppkey % 7 = 3 THEN 'D' WHEN s_suppkey % 11 = 5 THEN 'P' ELSE 'L' END AS list_status,
               {add_days(DATE '1995-01-01', 7 * s_suppkey)} AS list_date,
               CASE WHEN s_suppkey % 7 = 3 THEN {add_days(DATE '1998-01-01', 7 * s_suppkey)} END AS delist_date
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "v_index_weight": """
        SELECT 'IDX' AS index_code, ts_code AS con_code, trade_date, amount / sum(amount) OVER (PARTITION BY trade_date) AS weight
        FROM (SELECT ts_code, trade_date, amount, row_number() OVER (PARTITION BY trade_date ORDER BY amount DESC, ts_code) AS n FROM v_month) t WHERE n <= 5""",
    "v_adj": "SELECT ts_code, trade_date, 1 + year(trade_date) / 100.0E0 AS adj_factor FROM v_day",
    "v_activity": "SELECT concat('U', CAST(user_id AS STRING)) AS ts_code, CAST(ts AS DATE) AS trade_date, sum(value) AS value, count(*) AS n, count(CASE WHEN event_type = 'error' THEN 1 END) AS errors FROM events GROUP BY user_id, CAST(ts AS DATE)",
    "v_coverage": """
        SELECT 'daily' AS dataset_id, 'ALL' AS scope_key, CAST(trade_date AS STRING) AS unit, CASE WHEN n % 13 = 0 THEN 'FAILED' ELSE 'COMPLETE' END AS status, row_count,
               {add_days(trade_date, 1)} AS completed_at
        FROM (SELECT trade_date, count(*) AS row_count, row_number() OVER (ORDER BY trade_date) AS n FROM v_day GROUP BY trade_date) u WHERE n % 11 <> 0""",
    "v_broken": """
        SELECT ts_code, trade_date, close AS open, CASE WHEN k = 1 THEN close * 0.5 ELSE high END AS high, low, close, CASE WHEN k = 2 THEN -vol ELSE vol END AS vol, amount, CASE WHEN k = 3 THEN 0.0E0 ELSE 1.5E0 END AS adj_factor
        FROM (SELECT v.*, CAST(row_number() OVER (ORDER BY ts_code, trade_date) % 97 AS INT) AS k FROM v_day v) b""",
    # a monthly study: two factors, the next return, exposures
    "v_ret": "SELECT ts_code, trade_date, industry, total_mv, amount, turnover_rate, close, close / nullif(lag(close) OVER (PARTITION BY ts_code ORDER BY trade_date), 0) - 1 AS ret, lead(close) OVER (PARTITION BY ts_code ORDER BY trade_date) / nullif(close, 0) - 1 AS forward_return FROM v_month",
    "v_factor": "SELECT ts_code, trade_date, ret AS factor_a, CASE WHEN turnover_rate > 2 THEN turnover_rate END AS factor_b FROM v_ret",
    "v_label": "SELECT ts_code, trade_date, forward_return FROM v_ret",
    "v_long": "SELECT ts_code, trade_date, 'factor_a' AS factor_name, factor_a AS value FROM v_factor UNION ALL SELECT ts_code, trade_date, 'factor_b', factor_b FROM v_factor",
}

# the monthly study's factors, standardized by date, as a report reads them
_MONTHS = "OVER (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN {0} PRECEDING AND 1 PRECEDING)".format
_RAW = {
    "momentum_1m": f"sum(ret) {_MONTHS(1)}", "momentum_3m": f"CASE WHEN count(ret) {_MONTHS(3)} = 3 THEN sum(ret) {_MONTHS(3)} END", "volatility_6m": f"CASE WHEN count(ret) {_MONTHS(6)} = 6 THEN stddev_samp(ret) {_MONTHS(6)} END",
    "ep": "CASE WHEN turnover_rate > 4 THEN 1 / turnover_rate END", "bp": "1 / close", "ps_inverse": "CASE WHEN amount > 30000 THEN 1 / amount END", "size_factor": "-ln(total_mv)",
}
_DAY = "OVER (PARTITION BY trade_date)"
VIEWS["v_scored"] = f"""
        SELECT ts_code, trade_date, {", ".join(f"round(({c} - avg({c}) {_DAY}) / nullif(stddev_samp({c}) {_DAY}, 0), 6) AS {c}" for c in _RAW)},
               CASE WHEN turnover_rate > 3 THEN (rank() OVER (PARTITION BY trade_date ORDER BY amount) + 0.0E0) / count(*) {_DAY} END AS score_pct_rank
        FROM (SELECT ts_code, trade_date, turnover_rate, amount, {", ".join(f"{x} AS {c}" for c, x in _RAW.items())} FROM v_ret) r"""

VIEWS |= {
    # a monthly selection of daily codes, effective on the next open day; mean prices jump about, so
    # daily returns are small parts of theirs
    "v_pred": "SELECT trade_date, ts_code, ret AS prediction, forward_return AS target, industry, total_mv FROM v_ret WHERE ret IS NOT NULL",
    "v_dret": "SELECT ts_code, trade_date, 0.002E0 * (close / lag(close) OVER (PARTITION BY ts_code ORDER BY trade_date) - 1) AS ret FROM v_day",
    "v_pick": """
        SELECT m AS formation_date, ts_code, amount AS score, CAST(n AS INT) AS rank FROM (
        SELECT last_day(trade_date) AS m, ts_code, sum(amount) AS amount, row_number() OVER (PARTITION BY last_day(trade_date) ORDER BY sum(amount) DESC, ts_code) AS n FROM v_day GROUP BY last_day(trade_date), ts_code) p WHERE n <= 5""",
    "v_hold": """
        SELECT e.effective_date, p.ts_code, (6 - p.rank) / 15.0E0 AS target_weight, p.score, p.rank FROM v_pick p
        JOIN (SELECT f.formation_date, min(o.cal_date) AS effective_date FROM (SELECT DISTINCT formation_date FROM v_pick) f JOIN v_open o ON o.cal_date > f.formation_date GROUP BY f.formation_date) e ON e.formation_date = p.formation_date""",
    "v_bench": "SELECT trade_date, 'BENCH' AS benchmark_code, 0.2E0 * (close / lag(close) OVER (ORDER BY trade_date) - 1) AS pct_chg FROM (SELECT trade_date, sum(amount) / sum(vol) AS close FROM v_day GROUP BY trade_date) b",
}

_SPARK = {
    "isodow": "extract(DAYOFWEEK_ISO FROM {0})",
    "days": "explode(sequence({0}, {1}, INTERVAL 1 DAY))",
    "add_days": "date_add({0}, CAST({1} AS INT))",
    "add_months": "add_months({0}, {1})",
}
_DUCKDB = {
    "isodow": "isodow({0})",
    "days": "CAST(unnest(generate_series({0}, {1}, INTERVAL 1 DAY)) AS DATE)",
    "add_days": "CAST({0} + CAST({1} AS INT) AS DATE)",
    "add_months": "CAST({0} + ({1}) * INTERVAL 1 MONTH AS DATE)",
}


def _in_order(place: str, sums: dict[str, str]) -> str:
    """A struct of sums of doubles, and `n_` counts, of a group's rows in the order of `place`; nulls are left out."""
    start = [f"'{s}', CAST(NULL AS DOUBLE), 'n_{s}', 0L" for s in sums]
    step = [f"'{s}', coalesce(s.{s} + r.{c}, r.{c}, s.{s}), 'n_{s}', s.n_{s} + if(r.{c} IS NULL, 0L, 1L)" for s, c in sums.items()]
    rows = f"sort_array(collect_list(struct({place}, {', '.join(sums.values())})))"
    return f"aggregate({rows}, named_struct({', '.join(start)}), (s, r) -> named_struct({', '.join(step)}))"


# The last bit of a sum of doubles depends on the order of addition, and what is ranked or tested against
# a bound depends on that bit. Spark's rows of a month are added as they are stored, which the SQL does too where
# one thread runs it; so every run has the same sums. A security has few rows in a month.
_SPARK_VIEWS = {
    "v_month": f"""
        SELECT concat('S', lpad(CAST(l_suppkey AS STRING), 5, '0')) AS ts_code, trade_date, sums.price / sums.quantity AS close, sums.price AS amount, sums.quantity AS vol,
               100 * (sums.discount / nullif(sums.n_discount, 0L)) AS turnover_rate, n_name AS industry, s_acctbal + 2000 AS total_mv
        FROM (SELECT l_suppkey, last_day(CAST(l_shipdate AS DATE)) AS trade_date, n_name, s_acctbal, {_in_order("l_place", {"price": "l_extendedprice", "quantity": "l_quantity", "discount": "l_discount"})} AS sums
              FROM lineitem_rows JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
              GROUP BY l_suppkey, last_day(CAST(l_shipdate AS DATE)), n_name, s_acctbal) g""",
}


def _dialect(text: str, words: dict[str, str]) -> str:
    def put(m: re.Match) -> str:
        arguments, depth, start = [], 0, 0
        for i, c in enumerate(m[2]):
            depth += (c == "(") - (c == ")")
            if c == "," and not depth:
                arguments.append(m[2][start:i].strip())
                start = i + 1
        return words[m[1]].format(*arguments, m[2][start:].strip())

    return re.sub(r"\{(\w+)\((.*?)\)\}", put, text)


def for_spark(text: str) -> str:
    return _dialect(text, _SPARK)


def for_duckdb(text: str) -> str:
    return _dialect(text, _DUCKDB)


def needed(text: str) -> list[str]:
    """The views that a text uses, each after those it uses itself."""
    found: list[str] = []
    for name in VIEWS:
        if re.search(rf"\b{name}\b", text):
            found += [x for x in (*needed(VIEWS[name]), name) if x not in found]
    return found


def with_views(text: str) -> str:
    """DuckDB SQL with the views it uses in front."""
    names = needed(text)
    body = text.strip()
    parts = [f"{n} AS ({VIEWS[n].strip()})" for n in names]
    if body.upper().startswith("WITH "):
        return for_duckdb(f"WITH {', '.join(parts)}, {body[5:]}" if parts else body)
    return for_duckdb(f"WITH {', '.join(parts)} {body}" if parts else body)


class Views:
    """The views of a folder of tables as DataFrames: `views.v_month`, and the tables themselves."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name in VIEWS:
            return self.sql(_SPARK_VIEWS.get(name, VIEWS[name]))
        if name == "lineitem_rows":  # with each row's place in the table
            rows, place = self.lineitem, "_metadata.row_index"
            if len(rows.inputFiles()) > 1:
                place = f"struct(_metadata.file_path, {place})"
            return rows.select("*", F.expr(place).alias("l_place"))
        raise AttributeError(name)

    def sql(self, text: str) -> DataFrame:
        """The rows of a text over tables and views."""
        used = {n: getattr(self, n) for n in (*TABLES, *VIEWS, "lineitem_rows") if re.search(rf"\b{n}\b", text)}
        spelled = for_spark(text)
        for n in used:
            spelled = re.sub(rf"\b{n}\b", f"{{{n}}}", spelled)
        return self.spark.sql(spelled, **used)
