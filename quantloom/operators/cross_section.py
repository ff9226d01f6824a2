"""Cross-sectional transforms of a long panel (trade_date, ts_code, factor_name, value).

Each works inside (trade_date, factor_name); all of them share that one partitioning, so
a chain of them costs one exchange. Null values are left out of statistics and stay null; NaN is
null, and infinite values have no part in statistics, nor a transformed value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.math import average_rank, finite, number, ratio


def section() -> WindowSpec:
    return Window.partitionBy("trade_date", "factor_name")


def to_long(panel: DataFrame, factors: list[str]) -> DataFrame:
    """One row for each key and factor of a wide panel."""
    return panel.unpivot(["trade_date", "ts_code"], factors, "factor_name", "value")


def fill_median(long: DataFrame) -> DataFrame:
    x = number(F.col("value"))
    return long.withColumn("value", F.coalesce(x, F.median(finite(x)).over(section())))


def clip(x: Column, low: Column, high: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(low, F.least(high, x)))


def winsorize(long: DataFrame, method: str = "mad", lower: float = 0.01, upper: float = 0.99, width: float = 3.0) -> DataFrame:
    """Clip to the section's quantiles, or to `width` scaled median deviations (none where the deviation is 0)."""
    x = finite(F.col("value"))
    if method == "quantile":
        return long.withColumn("value", clip(x, F.percentile(x, F.lit(lower)).over(section()), F.percentile(x, F.lit(upper)).over(section())))
    centred = long.withColumn("_m", F.median(x).over(section())).withColumn("_d", F.median(F.abs(x - F.col("_m"))).over(section()))
    reach = F.lit(width * 1.4826) * F.col("_d")
    bounded = F.when(F.col("_d") > 0, clip(x, F.col("_m") - reach, F.col("_m") + reach)).otherwise(x)
    return centred.withColumn("value", bounded).drop("_m", "_d")


def standardize(long: DataFrame, method: str = "zscore", least: int = 3) -> DataFrame:
    """Population z-scores (null where constant), or average ranks scaled to [-1, 1] (0 where constant); null in sections below `least` values."""
    x = finite(F.col("value"))
    n = F.count(x).over(section())
    if method == "zscore":
        spread = F.stddev_pop(x).over(section())
        scaled = F.when(spread > 1e-12, (x - F.avg(x).over(section())) / F.nullif(spread, F.lit(0.0)))
    else:
        constant = F.min(x).over(section()) == F.max(x).over(section())
        scaled = F.when(constant, F.lit(0.0)).otherwise(2 * ratio(average_rank(x, section()) - 1, (n - 1).cast("double")) - 1)
    return long.withColumn("value", F.when(x.isNotNull() & (n >= least), scaled))


def with_direction(long: DataFrame, directions: dict[str, int]) -> DataFrame:
    sign = F.lit(1.0)
    for name, d in directions.items():
        sign = F.when(F.col("factor_name") == name, float(d)).otherwise(sign)
    return long.withColumn("value", F.col("value") * sign)


def preprocess(long: DataFrame, directions: dict[str, int] | None = None, winsor: str = "mad", scale: str = "zscore", least: int = 3) -> DataFrame:
    """Fill, winsorize, sign, standardize."""
    return standardize(with_direction(winsorize(fill_median(long), winsor), directions or {}), scale, least)


#: Factors that are the size exposure themselves.
SIZE_FACTORS = ("log_total_mv", "log_circ_mv")


def neutralize(long: DataFrame, exposures: DataFrame, least: int = 10, least_industry: int = 2, rescale: bool = False) -> DataFrame:
    """Residual of a regression on industry dummies and standardized size, in closed form.

    Value and size are demeaned in (date, industry), which leaves one slope for each section;
    where size doesn't vary inside any industry the residual is the demeaned value, but a section in
    which size doesn't vary at all has none. Factors of size itself are regressed on industries only, so
    their rows need no size. Rows of industries below `least_industry`, and sections of fewer than
    `least` rows or not more rows than the design's rank, become null. The result also has n and design_rank.
    """
    industry = Window.partitionBy("trade_date", "factor_name", "industry")
    rows = long.join(exposures.select("trade_date", "ts_code", "industry", "log_total_mv"), ["trade_date", "ts_code"], "left")
    sized = ~F.col("factor_name").isin(*SIZE_FACTORS)
    usable = finite(F.col("value")).isNotNull() & F.col("industry").isNotNull() & (~sized | finite(F.col("log_total_mv")).isNotNull())
    rows = rows.withColumn("_ok", F.coalesce(usable, F.lit(False)))
    rows = rows.withColumn("_ok", F.col("_ok") & (F.sum(F.col("_ok").cast("int")).over(industry) >= least_industry))
    y, s = F.when(F.col("_ok"), F.col("value")), F.when(F.col("_ok") & sized, F.col("log_total_mv"))
    spread = F.stddev_pop(s).over(section())
    z = F.when(F.col("_ok"), F.when(sized, (s - F.avg(s).over(section())) / F.nullif(spread, F.lit(0.0))).otherwise(0.0))
    rows = rows.withColumn("_flat", sized & F.coalesce(spread <= 1e-12, F.lit(True)))
    rows = rows.withColumn("_z", z).withColumn("_y", y - F.avg(y).over(industry)).withColumn("_x", F.col("_z") - F.avg("_z").over(industry))
    rows = rows.withColumn("_xx", F.sum(F.col("_x") * F.col("_x")).over(section())).withColumn("_xy", F.sum(F.col("_x") * F.col("_y")).over(section()))
    groups = F.size(F.collect_set(F.when(F.col("_ok"), F.col("industry"))).over(section()))  # as many as there are industries
    rows = rows.withColumn("n", F.sum(F.col("_ok").cast("long")).over(section())).withColumn("design_rank", groups + F.when(F.col("_xx") > 1e-12, 1).otherwise(0))
    slope = F.when(F.col("_xx") > 1e-12, F.col("_xy") / F.nullif(F.col("_xx"), F.lit(0.0))).otherwise(0.0)
    kept = F.col("_ok") & (F.col("n") >= least) & ~F.col("_flat") & (F.col("n") > F.col("design_rank"))
    out = rows.withColumn("value", F.when(kept, F.col("_y") - slope * F.col("_x"))).select("trade_date", "ts_code", "factor_name", "value", "n", "design_rank", F.col("_flat").alias("flat_size"))
    return standardize(out, "zscore", 1) if rescale else out


def neutralize_sections(neutral: DataFrame, least: int = 10) -> DataFrame:
    """The gates of each section: rows, rank of the design, and whether it was neutralized."""
    gate = neutral.groupBy("trade_date", "factor_name").agg(F.max("n").alias("n"), F.max("design_rank").cast("long").alias("design_rank"), F.bool_or("flat_size").alias("_flat"))
    why = F.when(F.col("n") < least, "too few rows").when(F.col("_flat"), "size is constant").when(F.col("n") <= F.col("design_rank"), "no degree of freedom").otherwise("neutralized")
    return gate.withColumn("status", why).drop("_flat")


def fill_by_industry(panel: DataFrame, column: str, industry: str = "industry") -> DataFrame:
    """Nulls take the median of their date and industry, else of their date."""
    inner, outer = Window.partitionBy("trade_date", industry), Window.partitionBy("trade_date")
    return panel.withColumn(column, F.coalesce(column, F.median(column).over(inner), F.median(column).over(outer)))


def winsorize_simple(panel: DataFrame, column: str, lower: float = 0.01, upper: float = 0.99) -> DataFrame:
    w, x = Window.partitionBy("trade_date"), F.col(column)
    return panel.withColumn(column, clip(x, F.percentile(x, F.lit(lower)).over(w), F.percentile(x, F.lit(upper)).over(w)))


def standardize_simple(panel: DataFrame, column: str) -> DataFrame:
    """Sample z-score by date; null where the deviation is 0 or unknown."""
    w, x = Window.partitionBy("trade_date"), F.col(column)
    spread = F.stddev_samp(x).over(w)
    return panel.withColumn(column, F.when(spread > 1e-12, (x - F.avg(x).over(w)) / F.nullif(spread, F.lit(0.0))))


def preprocess_simple(panel: DataFrame, columns: list[str], target: str, industry: str = "industry") -> DataFrame:
    """Rows with a target; then each column filled, clipped and standardized."""
    out = panel.where(F.col(target).isNotNull())
    for c in columns:
        out = standardize_simple(winsorize_simple(fill_by_industry(out, c, industry), c), c)
    return out
