"""Time-series factors: one Column each, over the rows of a security in date order.

A factor needs all values of its frame; null and NaN are one thing. Factors that share a
window share one sort, so a panel of many costs one exchange by code.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.math import by_code, finite, full_frame, ratio


def change(column: str, n: int, skip: int = 0) -> Column:
    """Relative change from n rows before to `skip` rows before."""
    w = by_code()
    recent = F.lag(column, skip).over(w) if skip else F.col(column)
    return ratio(recent, F.lag(column, n).over(w)) - 1


def row_return(column: str = "close") -> Column:
    return change(column, 1)


def _over_returns(aggregate: Callable[[Column], Column], n: int, weight: Column | None = None) -> Callable[[DataFrame], Column]:
    def make(returns: Column) -> Column:
        x = returns if weight is None else ratio(F.abs(returns), weight)
        return full_frame(aggregate(x), x, by_code(), n)

    return make


def positive(x: Column, value: Column) -> Column:
    return F.when(x > 0, value)


@dataclass(frozen=True)
class Factor:
    """A registered factor: its Column (`_ret` is the row return of close), and what it needs."""

    name: str
    column: Column | Callable[[], Column]
    category: str
    direction: int = 1
    fields: tuple[str, ...] = ("close",)
    datasets: tuple[str, ...] = ("daily",)
    lookback: int = 0
    lag: int = 0
    extra: dict = field(default_factory=dict)

    def build(self) -> Column:
        return self.column() if callable(self.column) else self.column


_ret = lambda: F.col("_ret")


def registry() -> dict[str, Factor]:
    """All factors by name."""
    w = by_code()
    listed = [
        Factor("momentum_20d", lambda: change("close", 20), "momentum", lookback=20),
        Factor("momentum_60d", lambda: change("close", 60), "momentum", lookback=60),
        Factor("momentum_120d", lambda: change("close", 120), "momentum", lookback=120),
        Factor("momentum_252_20d", lambda: change("close", 252, 20), "momentum", lookback=252),
        Factor("reversal_5d", lambda: -change("close", 5), "reversal", lookback=5),
        Factor("high_52w", lambda: ratio(F.col("close"), full_frame(F.max("close"), F.col("close"), w, 252)), "momentum", lookback=251),
        Factor("volatility_20d", lambda: full_frame(F.stddev_samp(_ret()), _ret(), w, 20), "volatility", -1, lookback=20),
        Factor("volatility_60d", lambda: full_frame(F.stddev_samp(_ret()), _ret(), w, 60), "volatility", -1, lookback=60),
        Factor("turnover_mean_20d", lambda: full_frame(F.avg("turnover_rate"), F.col("turnover_rate"), w, 20), "liquidity", -1, ("turnover_rate",), ("daily_basic",), 19),
        Factor("amihud_20d", lambda: _over_returns(F.avg, 20, F.col("amount"))(_ret()), "liquidity", 1, ("close", "amount"), lookback=20),
        Factor("ep_ttm", lambda: positive(F.col("pe_ttm"), ratio(F.lit(1.0), F.col("pe_ttm"))), "valuation", 1, ("pe_ttm",), ("daily_basic",)),
        Factor("bp", lambda: positive(F.col("pb"), ratio(F.lit(1.0), F.col("pb"))), "valuation", 1, ("pb",), ("daily_basic",)),
        Factor("sp_ttm", lambda: positive(F.col("ps_ttm"), ratio(F.lit(1.0), F.col("ps_ttm"))), "valuation", 1, ("ps_ttm",), ("daily_basic",)),
        Factor("dividend_yield_ttm", lambda: F.when(F.col("dv_ttm") >= 0, F.col("dv_ttm")), "valuation", 1, ("dv_ttm",), ("daily_basic",)),
        Factor("log_total_mv", lambda: F.when(F.col("total_mv") > 0, F.log(F.greatest(F.col("total_mv"), F.lit(1e-300)))), "size", -1, ("total_mv",), ("daily_basic",)),
        Factor("log_circ_mv", lambda: F.when(F.col("circ_mv") > 0, F.log(F.greatest(F.col("circ_mv"), F.lit(1e-300)))), "size", -1, ("circ_mv",), ("daily_basic",)),
    ]
    for name, direction in FINANCIAL.items():
        listed.append(Factor(name, lambda n=name: finite(F.col(n)), "financial", direction, (name,), ("financial",)))
    return {f.name: f for f in listed}


#: Financial factors and their directions.
FINANCIAL = {
    "fin_roe_ttm": 1, "fin_roa_ttm": 1, "fin_gross_margin_ttm": 1, "fin_net_margin_ttm": 1,
    "fin_revenue_yoy": 1, "fin_net_profit_yoy": 1, "fin_debt_to_assets": -1, "fin_ocf_to_assets": 1,
}


def factor_panel(panel: DataFrame, names: list[str], known: dict[str, Factor] | None = None) -> DataFrame:
    """ts_code, trade_date and a column for each named factor."""
    known = known or registry()
    missing = [n for n in names if n not in known]
    if missing:
        raise ValueError(f"unknown factors: {missing}")
    rows = panel.withColumn("_ret", row_return()) if "close" in panel.columns else panel
    return rows.select("ts_code", "trade_date", *[known[n].build().alias(n) for n in names])


def factor_metadata(spark, known: dict[str, Factor] | None = None) -> DataFrame:
    """factor_name, category, direction, datasets, fields, lookback and lag of every factor."""
    rows = [(f.name, f.category, f.direction, list(f.datasets), list(f.fields), f.lookback, f.lag) for f in (known or registry()).values()]
    return spark.createDataFrame(rows, "factor_name string, category string, direction int, datasets array<string>, fields array<string>, lookback int, lag int")


def factors_by_category(metadata: DataFrame, category: str) -> DataFrame:
    return metadata.where(F.col("category") == category)


def describe_requirements(metadata: DataFrame, names: list[str]) -> DataFrame:
    """One row: all datasets and fields that the named factors need, and the largest lookback and lag."""
    wanted = metadata.where(F.col("factor_name").isin(names))
    union = lambda c: F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))), ",")
    return wanted.agg(union("datasets").alias("datasets"), union("fields").alias("fields"), F.max("lookback").alias("lookback"), F.max("lag").alias("lag"))


def user_factor(panel: DataFrame, name: str, function: Callable, fields: list[str], lookback: int | None = None, chunk: int = 10_000) -> DataFrame:
    """A factor from a user's Python function of one security's rows in date order (pandas) to a series of as many values.

    With `lookback`, how many earlier rows a value depends on, a security's rows are dealt in chunks of
    `chunk`, each with the rows before it that its first ones need, so no task needs a whole
    history; the values are those of the whole.
    """
    schema = "ts_code string, trade_date date, " + f"{name} double"
    rows = panel.select("ts_code", "trade_date", *fields)
    if lookback is None:
        rows = rows.withColumns({"_own": F.lit(0).cast("long"), "_chunk": F.lit(0).cast("long")})
    else:
        place = (F.row_number().over(by_code()) - 1).cast("long")
        rows = rows.withColumn("_place", place).withColumn("_own", F.floor(F.col("_place") / chunk))
        rows = rows.withColumn("_chunk", F.explode(F.sequence(F.col("_own"), F.floor((F.col("_place") + lookback) / chunk)))).drop("_place")

    def run(part):
        part = part.sort_values("trade_date")
        out = part[["ts_code", "trade_date"]].copy()
        out[name] = function(part[["ts_code", "trade_date", *fields]]).astype(float)
        return out[(part["_own"] == part["_chunk"]).to_numpy()]

    return rows.groupBy("ts_code", "_chunk").applyInPandas(run, schema)


def monthly_return(monthly: DataFrame) -> DataFrame:
    """Month key (last day) and close / pre_close - 1 where pre_close is positive."""
    r = F.when(F.col("pre_close") > 0, ratio(F.col("close"), F.col("pre_close")) - 1)
    return monthly.select("ts_code", F.last_day("trade_date").alias("trade_date"), "close", "amount", r.alias("monthly_return"))


def month_end(daily: DataFrame) -> DataFrame:
    """The last row of every code and month, at the month's last day."""
    last = F.row_number().over(Window.partitionBy("ts_code", F.trunc("trade_date", "month")).orderBy(F.desc("trade_date")))
    return daily.withColumn("_n", last).where("_n = 1").drop("_n").withColumn("trade_date", F.last_day("trade_date"))


def compound_lagged(column: str, n: int) -> Column:
    """Product of 1 + r over the n rows before this one, less 1."""
    frame = by_code().rowsBetween(-n, -1)
    return F.when(F.count(column).over(frame) == n, F.product(1 + F.col(column)).over(frame) - 1)


def base_factors(panel: DataFrame) -> DataFrame:
    """Nine monthly factors of a panel with pe, pb, ps, total_mv, turnover_rate, amount and monthly_return."""
    frame = by_code().rowsBetween(-6, -1)
    return panel.select(
        "ts_code",
        "trade_date",
        positive(F.col("pe"), ratio(F.lit(1.0), F.col("pe"))).alias("ep"),
        positive(F.col("pb"), ratio(F.lit(1.0), F.col("pb"))).alias("bp"),
        positive(F.col("ps"), ratio(F.lit(1.0), F.col("ps"))).alias("ps_inverse"),
        F.when(F.col("total_mv") > 0, -F.log(F.greatest(F.col("total_mv"), F.lit(1e-300)))).alias("size"),
        F.col("turnover_rate").alias("turnover"),
        F.when(F.col("amount") > 0, F.log(F.greatest(F.col("amount"), F.lit(1e-300)))).alias("amount"),
        compound_lagged("monthly_return", 1).alias("momentum_1m"),
        compound_lagged("monthly_return", 3).alias("momentum_3m"),
        F.when(F.count("monthly_return").over(frame) == 6, F.stddev_samp("monthly_return").over(frame)).alias("volatility_6m"),
    )


def next_return(panel: DataFrame, column: str = "monthly_return") -> DataFrame:
    return panel.withColumn("next_return", F.lead(column, 1).over(by_code()))
