"""Joins of research data: as-of, by calendar position, with audits of what doesn't match."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.math import ratio

KEYS = ["trade_date", "ts_code"]


def asof_financials(panel: DataFrame, records: DataFrame, values: list[str], lag: int = 1) -> DataFrame:
    """The latest usable record of each code at every trading row.

    A record is usable `lag` trading rows after its code's first trading row at or after the
    announcement (0 would use it on its own day); of records usable from the same row the one with the latest (ann_date,
    end_date) counts, and later rows take the last usable one. Union, sort and a running
    last: one exchange by code, no range join.
    """
    code = Window.partitionBy("ts_code")
    rows = panel.select(*KEYS).withColumn("pos", F.row_number().over(code.orderBy("trade_date")))
    record = F.struct("ann_date", "end_date", *values)
    # the first trading row at or after an announcement: the next row of the code in date order
    events = rows.select("ts_code", F.col("trade_date").alias("at"), "pos", F.lit(None).cast(records.select(record.alias("r")).schema["r"].dataType).alias("r")).unionByName(
        records.select("ts_code", F.col("ann_date").alias("at"), F.lit(None).cast("int").alias("pos"), record.alias("r"))
    )
    ahead = code.orderBy(F.col("at").asc(), F.col("pos").asc_nulls_first()).rowsBetween(0, Window.unboundedFollowing)
    usable = events.withColumn("next", F.first("pos", ignorenulls=True).over(ahead)).where("r IS NOT NULL AND next IS NOT NULL")
    best = usable.groupBy("ts_code", (F.col("next") + lag).alias("pos")).agg(F.max(F.struct("r.ann_date", "r.end_date", F.col("r"))).alias("m")).select("ts_code", "pos", "m.r")
    running = code.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.join(best, ["ts_code", "pos"], "left").withColumn("r", F.last("r", ignorenulls=True).over(running))
    return filled.select(*KEYS, "r.ann_date", "r.end_date", *[f"r.{c}" for c in values])


def adjust_prices(bars: DataFrame, factors: DataFrame, columns: list[str]) -> DataFrame:
    """Prices times the factor of the same code and date; bars without a factor are not in the result (see `unmatched`)."""
    joined = bars.join(factors.select(*KEYS, "adj_factor"), KEYS)
    return joined.withColumns({f"adj_{c}": F.col(c) * F.col("adj_factor") for c in columns})


def unmatched(left: DataFrame, right: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Keys of `left` that `right` hasn't."""
    keys = keys or KEYS
    return left.select(*keys).join(right.select(*keys), keys, "left_anti")


def forward_return(scores: DataFrame, prices: DataFrame, lag: int = 1, holding: int = 1, column: str = "close") -> DataFrame:
    """Entry and exit by position on the market's dates, and exit / entry - 1.

    A missing price leaves the return null and moves no date. The calendar, a row for each
    date, is numbered apart and joined; prices join twice on (code, position).
    """
    dates = prices.select("trade_date").distinct().withColumn("pos", F.row_number().over(Window.orderBy("trade_date")))
    at = lambda p, d: dates.select(F.col("pos").alias(p), F.col("trade_date").alias(d))
    price = lambda d, p: prices.select("ts_code", F.col("trade_date").alias(d), F.col(column).alias(p))
    rows = scores.select(*KEYS).join(dates, "trade_date").withColumn("_in", F.col("pos") + lag).withColumn("_out", F.col("pos") + lag + holding)
    rows = rows.join(at("_in", "entry_date"), "_in", "left").join(at("_out", "exit_date"), "_out", "left")
    rows = rows.join(price("entry_date", "entry_price"), ["ts_code", "entry_date"], "left").join(price("exit_date", "exit_price"), ["ts_code", "exit_date"], "left")
    return rows.select(*KEYS, "entry_date", "exit_date", "entry_price", "exit_price", (ratio(F.col("exit_price"), F.col("entry_price")) - 1).alias("forward_return"))


def label_cutoff(labels: DataFrame, cutoff, column: str = "available_at") -> DataFrame:
    """Labels that are known at the cutoff."""
    return labels.where(F.col(column) <= F.lit(cutoff))


def outer_on_keys(frames: list[DataFrame]) -> DataFrame:
    """Datasets side by side on (date, code), with all keys of any."""
    return reduce(lambda a, b: a.join(b, KEYS, "full"), frames)


def select_score_keys(keys: DataFrame, factors: DataFrame, names: list[str]) -> DataFrame:
    """The factor rows of the scoring keys."""
    return keys.select(*KEYS).join(factors.select(*KEYS, *names), KEYS, "left")


def score_keys(scores: DataFrame) -> DataFrame:
    """Trimmed codes and dates, each key once with the number of rows that had it."""
    return scores.select(F.to_date("trade_date").alias("trade_date"), F.trim("ts_code").alias("ts_code")).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("rows"))


def modeling_panel(factors: DataFrame, labels: DataFrame, names: list[str]) -> DataFrame:
    """Features and labels of the keys that both have."""
    return factors.select(*KEYS, *names).join(labels, KEYS)


def unmatched_audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """Keys that only one side has: how many, and from when to when."""
    sides = unmatched(left, right).withColumn("side", F.lit("left_only")).unionByName(unmatched(right, left).withColumn("side", F.lit("right_only")))
    return sides.groupBy("side").agg(F.count(F.lit(1)).alias("keys"), F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"))


def _violations(frame: DataFrame, rules: dict) -> DataFrame:
    """(rule, violations) in one pass."""
    counted = frame.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])
    return counted.unpivot([], list(rules), "rule", "violations")


def time_order_rules(labels: DataFrame) -> DataFrame:
    return _violations(labels, {"entry_before_signal": F.col("entry_date") < F.col("trade_date"), "exit_not_after_entry": F.col("exit_date") <= F.col("entry_date")})


def label_formula_rule(labels: DataFrame, rtol: float = 1e-10, atol: float = 1e-12) -> DataFrame:
    expected = ratio(F.col("exit_price"), F.col("entry_price")) - 1
    return _violations(labels, {"label_differs": F.abs(F.col("forward_return") - expected) > atol + rtol * F.abs(expected)})


def structure_rules(labels: DataFrame) -> DataFrame:
    c = F.col
    return _violations(
        labels,
        {
            "exit_without_entry": c("exit_date").isNotNull() & c("entry_date").isNull(),
            "price_without_date": (c("entry_price").isNotNull() & c("entry_date").isNull()) | (c("exit_price").isNotNull() & c("exit_date").isNull()),
            "label_without_parts": c("forward_return").isNotNull() & (c("entry_date").isNull() | c("exit_date").isNull() | c("entry_price").isNull() | c("exit_price").isNull()),
        },
    )


def ml_align(features: DataFrame, labels: DataFrame, names: list[str]) -> DataFrame:
    """Rows with a finite label."""
    joined = features.select(*KEYS, *names).join(labels.select(*KEYS, "forward_return"), KEYS)
    return joined.where(F.col("forward_return").isNotNull() & ~F.isnan("forward_return") & (F.abs("forward_return") < float("inf")))


def key_sets_equal(left: DataFrame, right: DataFrame, examples: int = 5) -> DataFrame:
    """The first keys of each side that the other hasn't."""
    first = lambda a, b, side: unmatched(a, b).orderBy(*KEYS).limit(examples).withColumn("side", F.lit(side))
    return first(left, right, "left_only").unionByName(first(right, left, "right_only"))


def feature_coverage(panel: DataFrame, names: list[str], label: str = "forward_return") -> DataFrame:
    """Values of each feature, overall and on labelled rows."""
    long = panel.select(*[F.col(n).cast("double").alias(n) for n in names], F.col(label).isNotNull().alias("_labelled")).unpivot("_labelled", names, "feature", "value")
    return long.groupBy("feature").agg(F.count("value").alias("n_values"), F.count(F.when(F.col("_labelled"), F.col("value"))).alias("n_labelled"), F.count(F.lit(1)).alias("n_rows"))


#: Words in a feature's name that suggest it knows the future.
SUSPICIOUS = "(?i)forward|future|next|target|label"


def panel_warnings(panel: DataFrame, names: list[str], high: float = 0.5) -> DataFrame:
    """(feature, warning) of constant, mostly missing and suspiciously named features."""
    long = panel.select(*[F.col(n).cast("double").alias(n) for n in names]).unpivot([], names, "feature", "value")
    facts = long.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg(F.col("value").isNull().cast("double")).alias("missing"))
    warned = F.filter(F.array(F.when(F.col("lo") == F.col("hi"), "constant"), F.when(F.col("missing") >= high, "high_missing"), F.when(F.col("feature").rlike(SUSPICIOUS), "suspicious_name")), lambda w: w.isNotNull())
    return facts.select("feature", F.explode(warned).alias("warning"))


def security_status(dates: DataFrame, codes: DataFrame, suspensions: DataFrame, returns: DataFrame, fail: bool = True) -> DataFrame:
    """The status of every code on every date.

    `codes` has list_date and delist_date, `suspensions` suspend_type and suspend_timing (only
    a full day, type S without timing, suspends), `returns` the keys with a return. A return on
    a suspended day, and a return or any suspension row before the listing or after the
    delisting, are conflicts: the query fails on them, or names them in `conflict` if not to
    `fail`. The dates are few and broadcast, so the grid isn't a shuffle.
    """
    grid = codes.crossJoin(F.broadcast(dates.select("trade_date").distinct()))
    full_day = (F.col("suspend_type") == "S") & F.col("suspend_timing").isNull()
    events = suspensions.groupBy(*KEYS).agg(F.coalesce(F.bool_or(full_day), F.lit(False)).alias("_s"))
    there = returns.select(*KEYS).distinct().withColumn("_r", F.lit(True))
    rows = grid.join(events, KEYS, "left").join(there, KEYS, "left")
    d, traded, event = F.col("trade_date"), F.col("_r").isNotNull(), F.col("_s").isNotNull()
    suspended = F.coalesce("_s", F.lit(False))
    status = (
        F.when(d < F.col("list_date"), "PRE_LISTING")
        .when(d > F.col("delist_date"), "POST_DELIST")
        .when(d == F.col("delist_date"), "DELIST_DATE")
        .when(traded, "AVAILABLE")
        .when(suspended, "SUSPENDED")
        .otherwise("UNKNOWN_MISSING")
    )
    rows = rows.withColumn("status", status)
    conflict = F.when((F.col("status") == "AVAILABLE") & suspended, "return on a suspended day").when(F.col("status").isin("PRE_LISTING", "POST_DELIST") & (traded | event), "data outside the listing")
    if not fail:
        return rows.select(*KEYS, "status", conflict.alias("conflict"))
    told = F.concat_ws(" ", conflict, *KEYS)
    return rows.select(*KEYS, F.when(conflict.isNull(), F.col("status")).otherwise(F.raise_error(told).cast("string")).alias("status"))


def month_panel_join(monthly: DataFrame, reference: DataFrame, basics: DataFrame, constituents: DataFrame) -> DataFrame:
    """Monthly bars with reference and month-end values, of the constituents."""
    return monthly.join(reference, "ts_code", "left").join(basics, KEYS, "left").join(constituents, "ts_code", "left_semi")
