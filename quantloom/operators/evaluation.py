"""Evaluation of factors against forward returns: information coefficients and quantile groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.math import average_rank, correlation, finite, ratio
from .cross_section import section


def paired(long: DataFrame, labels: DataFrame) -> DataFrame:
    """The long panel with forward_return, and the average ranks of the rows that have both."""
    rows = long.join(labels.select("trade_date", "ts_code", "forward_return"), ["trade_date", "ts_code"], "left")
    both = finite(F.col("value")).isNotNull() & finite(F.col("forward_return")).isNotNull()
    rows = rows.withColumn("x", F.when(both, F.col("value"))).withColumn("y", F.when(both, F.col("forward_return")))
    return rows.withColumn("rx", average_rank(F.col("x"), section())).withColumn("ry", average_rank(F.col("y"), section()))


def ic_by_date(pairs: DataFrame, least: int = 20) -> DataFrame:
    """Pearson and rank IC, number of pairs and coverage of each section; null below `least` pairs."""
    n = F.count("x")
    return pairs.groupBy("trade_date", "factor_name").agg(
        F.when(n >= least, correlation(F.col("x"), F.col("y"))).alias("ic"),
        F.when(n >= least, correlation(F.col("rx"), F.col("ry"))).alias("rank_ic"),
        (n / F.count(F.lit(1))).alias("coverage"),
        n.alias("n"),
    )


def ic_summary(ic: DataFrame) -> DataFrame:
    """Mean, sample deviation, ratio (null where the deviation is 0) and positive share of both coefficients."""
    columns = []
    for c in ("ic", "rank_ic"):
        columns += [
            F.avg(c).alias(f"{c}_mean"),
            F.stddev_samp(c).alias(f"{c}_std"),
            ratio(F.avg(c), F.stddev_samp(c)).alias(f"{c}_ir"),
            F.avg((F.col(c) > 0).cast("double")).alias(f"{c}_positive"),
        ]
    return ic.groupBy("factor_name").agg(
        F.countDistinct("trade_date").alias("periods"), F.count("ic").alias("n_dates"), F.count("rank_ic").alias("n_rank_dates"), *columns, F.avg("coverage").alias("coverage_mean"), F.avg("n").alias("n_mean")
    )


def quantile_returns(pairs: DataFrame, groups: int = 5, least_group: int = 1, least: int = 20) -> DataFrame:
    """Mean forward return and size of every group of each section, also of empty groups, with the section's size, pairs and coverage.

    Groups come from average ranks, so ties are never split; sections of fewer than `least`
    pairs, and those whose values are all equal, have no groups.
    """
    x = F.col("x")
    ranked = pairs.withColumn("n", F.count(x).over(section())).withColumn("_varies", F.min(x).over(section()) < F.max(x).over(section()))
    place = F.floor((F.col("rx") - 1) / F.nullif(F.col("n") - 1, F.lit(0)) * groups) + 1
    placed = ranked.withColumn("quantile", F.when((F.col("n") >= least) & F.col("_varies"), F.least(place, F.lit(groups)).cast("int")))
    counted = placed.groupBy("trade_date", "factor_name", "quantile").agg(F.count("y").alias("group_count"), F.avg("y").alias("mean"), F.count(F.lit(1)).alias("_rows"), F.count(x).alias("_pairs"))
    sizes = counted.groupBy("trade_date", "factor_name").agg(F.sum("_rows").alias("universe_count"), F.sum("_pairs").alias("n_obs"))
    every = sizes.withColumn("coverage", F.col("n_obs") / F.col("universe_count")).withColumn("quantile", F.explode(F.sequence(F.lit(1), F.lit(groups))))
    out = every.join(counted.drop("_rows", "_pairs"), ["trade_date", "factor_name", "quantile"], "left")
    count = F.coalesce("group_count", F.lit(0))
    return out.select("trade_date", "factor_name", "quantile", "universe_count", "n_obs", "coverage", count.alias("group_count"), F.when(count >= least_group, F.col("mean")).alias("group_return"))


def long_short(quantiles: DataFrame, groups: int = 5) -> DataFrame:
    """Bottom and top group and their spread, and the rank correlation of group and return, of each section."""
    both = quantiles.withColumn("q", F.when(F.col("group_return").isNotNull(), F.col("quantile").cast("double")))
    both = both.withColumn("rq", average_rank(F.col("q"), section())).withColumn("rr", average_rank(F.col("group_return"), section()))
    pick = lambda g: F.max(F.when(F.col("quantile") == g, F.col("group_return")))
    return both.groupBy("trade_date", "factor_name").agg(
        pick(1).alias("low_return"), pick(groups).alias("high_return"), (pick(groups) - pick(1)).alias("spread"), F.count("group_return").alias("nonempty_groups"),
        correlation(F.col("rq"), F.col("rr")).alias("monotonicity"), F.max("coverage").alias("coverage"), F.max("n_obs").alias("n_obs"),
    )


def _stats(c: str, prefix: str) -> list:
    spread = F.stddev_samp(c)
    return [F.avg(c).alias(f"{prefix}_mean"), spread.alias(f"{prefix}_std"), F.when(spread > 1e-12, F.avg(c) / F.nullif(spread, F.lit(0.0))).alias(f"{prefix}_ir"), F.avg((F.col(c) > 0).cast("double")).alias(f"{prefix}_positive")]


def quantile_summary(quantiles: DataFrame) -> DataFrame:
    return quantiles.groupBy("factor_name", "quantile").agg(*_stats("group_return", "return"), F.avg("group_count").alias("size_mean"), F.count("group_return").alias("n_dates"))


def long_short_summary(spreads: DataFrame) -> DataFrame:
    m = F.col("monotonicity")
    return spreads.groupBy("factor_name").agg(
        F.countDistinct("trade_date").alias("periods"), *_stats("spread", "spread"), F.count("spread").alias("n_dates"), F.count(m).alias("n_monotonicity"),
        F.avg(m).alias("monotonicity_mean"), F.avg((m > 0).cast("double")).alias("monotonicity_positive"), F.avg("coverage").alias("coverage_mean"), F.avg("n_obs").alias("n_mean"),
    )


def rank_ic(pairs: DataFrame, least: int = 3) -> DataFrame:
    """Spearman's coefficient of each date and factor with `least` pairs that aren't constant."""
    out = pairs.groupBy("trade_date", "factor_name").agg(F.when(F.count("x") >= least, correlation(F.col("rx"), F.col("ry"))).alias("rank_ic"))
    return out.where(F.col("rank_ic").isNotNull())


def ic_stats(ic: DataFrame, column: str = "rank_ic") -> DataFrame:
    """Mean, deviation, ratio, t statistic, positive share and number of dates of each factor."""
    m, s, n = F.avg(column), F.stddev_samp(column), F.count(column)
    return ic.groupBy("factor_name").agg(
        m.alias("mean"), s.alias("std"), ratio(m, s).alias("ir"), ratio(m, s / F.sqrt(n.cast("double"))).alias("t_stat"), F.avg((F.col(column) > 0).cast("double")).alias("positive"), n.alias("n")
    )


def wide_ic(ic: DataFrame, factors: list[str], column: str = "rank_ic") -> DataFrame:
    """A row for each date, a column for each factor."""
    return ic.groupBy("trade_date").pivot("factor_name", factors).agg(F.first(column))


def qcut_returns(pairs: DataFrame, groups: int = 5) -> DataFrame:
    """Mean return of equal-frequency groups between value quantiles; where two edges are equal, groups by first rank."""
    # edges are interpolated, so values are compared to nine places
    edges = F.transform(F.percentile("x", F.array(*[F.lit(i / groups) for i in range(groups + 1)])).over(section()), lambda e: F.round(e, 9))
    rows = pairs.where(F.col("x").isNotNull()).withColumn("n", F.count("x").over(section())).withColumn("edges", edges)
    rows = rows.withColumn("first", F.row_number().over(section().orderBy("x", "ts_code")))
    distinct = F.size(F.array_distinct("edges")) == groups + 1
    by_edge = F.greatest(F.lit(1), F.size(F.filter("edges", lambda e: e < F.round(F.col("x"), 9))))
    width = (F.col("n") - 1) / groups  # the edges of the ranks 1..n
    by_rank = F.greatest(F.lit(1.0), F.ceil((F.col("first") - 1) / F.nullif(width, F.lit(0.0))))
    placed = rows.where(F.col("n") >= groups).withColumn("quantile", F.when(distinct, by_edge).otherwise(F.least(by_rank, F.lit(float(groups)))).cast("int"))
    return placed.groupBy("trade_date", "factor_name", "quantile").agg(F.avg("y").alias("group_return"), F.count(F.lit(1)).alias("group_count"))


def high_minus_low(groups: DataFrame, high: int = 5, low: int = 1) -> DataFrame:
    """The difference of two groups on dates that have both."""
    pick = lambda g: F.max(F.when(F.col("quantile") == g, F.col("group_return")))
    return groups.groupBy("trade_date", "factor_name").agg((pick(high) - pick(low)).alias("spread")).where(F.col("spread").isNotNull())


def evaluate(long: DataFrame, labels: DataFrame, groups: int = 5, least: int = 20) -> dict[str, DataFrame]:
    """The six tables of a panel: ic, ic_summary, quantiles, quantile_summary, long_short, long_short_summary."""
    pairs = paired(long, labels)
    ic, quantiles = ic_by_date(pairs, least), quantile_returns(pairs, groups, least=least)
    spreads = long_short(quantiles, groups)
    return {"ic": ic, "ic_summary": ic_summary(ic), "quantiles": quantiles, "quantile_summary": quantile_summary(quantiles), "long_short": spreads, "long_short_summary": long_short_summary(spreads)}


