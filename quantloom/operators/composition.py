"""Composite scores of several factors: fixed, rolling by information coefficients, and simple."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.math import average_rank, finite, number, ratio


def resolve_weights(spark, factors: list[str], weights: dict[str, float] | None = None, normalize: bool = True) -> DataFrame:
    """(factor_name, weight): equal, or the given ones, optionally scaled to a sum of 1."""
    given = weights or {f: 1.0 / len(factors) for f in factors}
    if set(given) != set(factors):
        raise ValueError("weights must name the factors")
    total = sum(given.values()) if normalize else 1.0
    return spark.createDataFrame([(f, given[f] / total) for f in factors], "factor_name string, weight double")


def compose(long: DataFrame, weights: DataFrame, renormalize: bool = True, least: int = 1) -> DataFrame:
    """Weighted score of each key, its valid factors and the share of all weight that they have.

    With `renormalize` the weighted sum is divided by the valid factors' weight, and a key needs
    `least` of them; without, a key that lacks a factor has no score. `weights` joins on factor_name, and
    on trade_date if it has one: then only factors of positive weight on their date count.
    """
    dated = "trade_date" in weights.columns
    joined = long.join(weights, ["trade_date", "factor_name"]) if dated else long.join(F.broadcast(weights), "factor_name")
    used = F.col("weight") > 0 if dated else F.col("weight").isNotNull()
    value = F.when(used, finite(F.col("value")))
    size = F.when(used, F.abs("weight"))
    covered = F.sum(F.when(value.isNotNull(), size).otherwise(0.0))
    total, n = F.sum(F.col("weight") * value), F.count(value)
    complete = (n == F.count(size)) & (n > 0)
    score = F.when(n >= least, ratio(total, covered)) if renormalize else F.when(complete, total)
    return joined.groupBy("trade_date", "ts_code").agg(score.alias("score"), n.alias("valid_count"), ratio(covered, F.sum(size)).alias("weight_coverage"))


def rolling_ic_weights(dates: DataFrame, ic: DataFrame, factors: list[str], lookback: int = 12, least: int = 6, negative: str = "zero", column: str = "rank_ic") -> DataFrame:
    """The weight of each factor on each date, from the mean of its last `lookback` known coefficients strictly before.

    Columns: history_periods, history_start, history_end and historical_mean of these coefficients; raw,
    the mean with negatives as zero or absolute, null with fewer than `least`; weight, which scales the
    positive ones to 1; where none is positive, all have equal weights and fallback is true.
    """
    spark = dates.sparkSession
    every = dates.select("trade_date").distinct().crossJoin(F.broadcast(spark.createDataFrame([(f,) for f in factors], "factor_name string")))
    known = ic.where(finite(F.col(column)).isNotNull()).select("trade_date", "factor_name", F.col(column).alias("_ic"))
    # one timeline of each factor, on which what is asked of a date comes before what is known of it
    by = Window.partitionBy("factor_name")
    recent = by.orderBy("trade_date").rowsBetween(1 - lookback, 0)
    facts = [F.count("_ic").over(recent).alias("n"), F.avg("_ic").over(recent).alias("ic"), F.min("trade_date").over(recent).alias("first"), F.max("trade_date").over(recent).alias("last")]
    state = known.select("trade_date", "factor_name", F.struct(*facts).alias("_state"))
    line = every.withColumn("_asks", F.lit(True)).unionByName(state.withColumn("_asks", F.lit(False)), allowMissingColumns=True)
    line = line.withColumn("_state", F.last("_state", ignorenulls=True).over(by.orderBy("trade_date", F.desc("_asks")).rowsBetween(Window.unboundedPreceding, 0)))
    mean = F.col("_state.ic")
    raw = F.when(F.col("_state.n") >= least, F.greatest(mean, F.lit(0.0)) if negative == "zero" else F.abs(mean))
    rows = line.where("_asks").withColumn("raw", raw)
    total = F.coalesce(F.sum("raw").over(Window.partitionBy("trade_date")), F.lit(0.0))
    weight = F.when(total > 0, F.coalesce(ratio(F.col("raw"), total), F.lit(0.0))).otherwise(1.0 / len(factors))
    named = [F.coalesce("_state.n", F.lit(0)).alias("history_periods"), F.col("_state.first").alias("history_start"), F.col("_state.last").alias("history_end"), mean.alias("historical_mean")]
    return rows.select("trade_date", "factor_name", *named, "raw", weight.alias("weight"), (total <= 0).alias("fallback"))


#: Directions of factors that are better the lower they are.
DIRECTIONS = {"volatility_6m": -1}


def composite_score(panel: DataFrame, factors: list[str], directions: dict[str, int] | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """Score of directions times weights, row rank (best first) and percentile rank of each date.

    A factor that isn't there adds 0; a row without any has no score and no rank."""
    given = weights or {f: 1 / len(factors) for f in factors}
    used = [f for f in factors if f in given]
    score = sum((F.coalesce(number(F.col(f)), F.lit(0.0)) * float((DIRECTIONS | (directions or {})).get(f, 1)) * float(given[f]) for f in used), F.lit(0.0))
    out = panel.withColumn("score", F.when(F.coalesce(*[number(F.col(f)) for f in used], F.lit(None)).isNotNull(), score))
    w = Window.partitionBy("trade_date")
    place = F.when(F.col("score").isNotNull(), F.row_number().over(w.orderBy(F.desc_nulls_last("score"), "ts_code")))
    return out.withColumn("rank", place).withColumn("percentile", ratio(average_rank(F.col("score"), w), F.count("score").over(w).cast("double")))


def top_n(scores: DataFrame, n: int, column: str = "score") -> DataFrame:
    """The best n rows of each date that have a score; a window's group limit keeps what is shuffled small."""
    place = F.row_number().over(Window.partitionBy("trade_date").orderBy(F.desc_nulls_last(column), "ts_code"))
    return scores.where(F.col(column).isNotNull()).withColumn("selected_rank", place).where(F.col("selected_rank") <= n)


def scoring_run(panel: DataFrame, factors: list[str], n: int, directions: dict[str, int] | None = None) -> DataFrame:
    return top_n(composite_score(panel, factors, directions), n)
