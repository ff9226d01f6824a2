"""Signals, holdings and weights. Everything is per formation date, in windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.math import ratio
from .backtest import resolve_return
from .risk import complete_cases


def day() -> WindowSpec:
    return Window.partitionBy("trade_date")


def signals(predictions: DataFrame, descending: bool = True) -> DataFrame:
    """trade_date, ts_code, score, rank: contiguous ranks of a date, ties by code in either direction."""
    order = F.desc("prediction") if descending else F.asc("prediction")
    return predictions.where("prediction IS NOT NULL").select("trade_date", "ts_code", F.col("prediction").alias("score"), F.row_number().over(day().orderBy(order, F.asc("ts_code"))).alias("rank"))


def signal_rules(ranked: DataFrame) -> DataFrame:
    """Dates and whether their ranks are 1..N, each once, in the order of the scores."""
    before = F.lag("score").over(day().orderBy("rank"))
    rows = ranked.withColumn("_down", F.coalesce((F.col("score") > before).cast("int"), F.lit(0)))
    out = rows.groupBy("trade_date").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("_a"), F.max("rank").alias("_b"), F.countDistinct("rank").alias("_d"), F.sum("_down").alias("_x"))
    return out.select("trade_date", "n", ((F.col("_a") == 1) & (F.col("_b") == F.col("n")) & (F.col("_d") == F.col("n")) & (F.col("_x") == 0)).alias("valid"))


def holdings(ranked: DataFrame, n: int, partial: bool = True) -> DataFrame:
    """The best n of each date with equal weights, and how many the date had; without `partial` short dates are left out."""
    chosen = ranked.where(F.col("rank") <= n).withColumn("selected", F.count(F.lit(1)).over(day()))
    if not partial:
        chosen = chosen.where(F.col("selected") == n)
    return chosen.withColumn("target_weight", 1.0 / F.col("selected"))


def weight_rank(chosen: DataFrame) -> DataFrame:
    """(n - position + 1) over the sum of those."""
    n, place = F.count(F.lit(1)).over(day()), F.row_number().over(day().orderBy("rank"))
    return chosen.withColumn("target_weight", (n - place + 1) / (n * (n + 1) / 2))


def proportional(chosen: DataFrame, column: str) -> DataFrame:
    """Weights in proportion to a positive column; null where it isn't."""
    x = F.when(F.col(column) > 0, F.col(column))
    return chosen.withColumn("target_weight", ratio(x, F.sum(x).over(day())))


def weight_inverse_volatility(chosen: DataFrame, volatility: DataFrame, fail: bool = True) -> DataFrame:
    """Weights in proportion to 1 / volatility, of all the chosen codes of a date.

    A code without a finite, positive volatility fails the query, or, without `fail`, makes all weights of
    its date null: the others are never weighted as if it weren't there.
    """
    joined = chosen.join(volatility.select("trade_date", "ts_code", "volatility"), ["trade_date", "ts_code"], "left")
    x = F.col("volatility")
    good = F.coalesce((x > 0) & (x < float("inf")), F.lit(False))
    told = F.raise_error(F.concat_ws(" ", F.lit("no finite, positive volatility of"), "ts_code", "trade_date")).cast("double")
    inverse = F.when(good, F.lit(1.0) / x).otherwise(told if fail else F.lit(None).cast("double"))
    rows = joined.withColumn("_inverse", inverse)
    whole = F.count("_inverse").over(day()) == F.count(F.lit(1)).over(day())
    return rows.withColumn("target_weight", F.when(whole, ratio(F.col("_inverse"), F.sum("_inverse").over(day())))).drop("_inverse")


def capped_allocation(chosen: DataFrame, column: str, cap: float) -> DataFrame:
    """Weights in proportion to `column`, none above the cap, what is cut going to the others in proportion.

    In descending order the first k are at the cap, where k is the first for which the next
    one, given its share of what is left, isn't above it; so one sorted window is enough.
    Dates with too few rows for the cap have null weights.
    """
    order = day().orderBy(F.desc(column), "ts_code")
    place, rest = F.row_number().over(order), F.sum(column).over(order.rowsBetween(0, Window.unboundedFollowing))
    share = (1 - (place - 1) * cap) * ratio(F.col(column), rest)
    rows = chosen.withColumn("_place", place).withColumn("_rest", rest).withColumn("_fits", share <= cap + 1e-15)
    rows = rows.withColumn("_k", F.min(F.when(F.col("_fits"), F.col("_place"))).over(day()) - 1)
    rows = rows.withColumn("_left", F.max(F.when(F.col("_place") == F.col("_k") + 1, F.col("_rest"))).over(day()))
    weight = F.when(F.col("_place") <= F.col("_k"), F.lit(float(cap))).otherwise((1 - F.col("_k") * cap) * ratio(F.col(column), F.col("_left")))
    feasible = F.count(F.lit(1)).over(day()) * cap >= 1 - 1e-12
    return rows.withColumn("target_weight", F.when(feasible, weight)).drop("_place", "_rest", "_fits", "_k", "_left")


def max_weight_rule(weighted: DataFrame, cap: float) -> DataFrame:
    """Dates, whether the cap is feasible and whether it is kept."""
    return weighted.groupBy("trade_date").agg((F.count(F.lit(1)) * cap >= 1 - 1e-12).alias("feasible"), (F.max("target_weight") <= cap + 1e-12).alias("kept"))


def weight_rules(candidates: DataFrame, weighted: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Dates, whether weights and candidates are the same keys, and weights are finite, not negative and sum to 1."""
    both = candidates.select("trade_date", "ts_code", F.lit(1).alias("_c")).join(weighted.select("trade_date", "ts_code", "target_weight"), ["trade_date", "ts_code"], "full")
    w = F.col("target_weight")
    out = both.groupBy("trade_date").agg(
        (F.count_if(F.col("_c").isNull() | w.isNull()) == 0).alias("same_keys"), (F.count_if(F.coalesce((w < 0) | F.isnan(w), F.lit(False))) == 0).alias("not_negative"), (F.abs(F.sum(w) - 1) <= tolerance).alias("sums_to_one")
    )
    return out.withColumn("valid", F.col("same_keys") & F.col("not_negative") & F.coalesce("sums_to_one", F.lit(False)))


def return_window(chosen: DataFrame, resolved: DataFrame, days: DataFrame, n: int) -> DataFrame:
    """trade_date (formation), ts_code, return_date, ret: the last n open days up to each formation date.

    `days` has cal_date and pos, `resolved` the status and the resolved return of every code and day (see
    `resolved_returns`); days before a listing are left out. Fails where a formation date has fewer
    than n open days behind it, and where a code has no status on one of them.
    """
    at = chosen.select("trade_date", "ts_code").join(days.select(F.col("cal_date").alias("trade_date"), "pos"), "trade_date", "left")
    short = F.raise_error(F.concat_ws(" ", F.lit("not enough calendar history before"), "trade_date")).cast("int")
    spread = at.select("trade_date", "ts_code", F.explode(F.sequence(F.when(F.col("pos") >= n, F.col("pos") - n + 1).otherwise(short), F.coalesce("pos", F.lit(0)))).alias("pos"))
    placed = spread.join(days.select("pos", F.col("cal_date").alias("return_date")), "pos")
    rows = placed.join(resolved.select("ts_code", F.col("trade_date").alias("return_date"), "status", "ret"), ["ts_code", "return_date"], "left")
    told = F.raise_error(F.concat_ws(" ", F.lit("no status of"), "ts_code", "return_date")).cast("boolean")
    return rows.where(F.when(F.col("status").isNull(), told).otherwise(F.col("status") != "PRE_LISTING")).select("trade_date", "ts_code", "return_date", "ret")


def resolved_returns(status: DataFrame, returns: DataFrame) -> DataFrame:
    """trade_date, ts_code, status and return of every code and day, each resolved once: 0 when suspended, none
    before the listing; conflicts and unknown gaps fail. Rows without a status are left out."""
    return resolve_return(status.where("status IS NOT NULL"), returns, early=True)


def sample_volatility(window: DataFrame, least: int) -> DataFrame:
    return window.groupBy("trade_date", "ts_code").agg(F.when(F.count("ret") >= least, F.stddev_samp("ret")).alias("volatility"))


def min_variance_weights(covariance: np.ndarray, cap: float = 1.0) -> np.ndarray:
    """Weights of least variance that are not negative, at most `cap` and sum to 1, by an active set checked for optimality."""
    values, vectors = np.linalg.eigh(covariance)
    return least_variance((vectors * np.sqrt(np.maximum(values, 0))).T, cap)


def least_variance(root: np.ndarray, cap: float = 1.0) -> np.ndarray:
    """As `min_variance_weights`, of the covariance root' root with a trillionth of its mean variance on the diagonal.

    Starts at a corner, the calmest assets at the cap and one free, and frees one asset at a time, so that
    the free ones hardly outnumber the rows of `root`: no assets x assets matrix is formed.
    """
    n = root.shape[1]
    variance = (root**2).sum(0)
    ridge = 1e-12 * (variance.sum() / n or 1.0)
    calm = np.argsort(variance, kind="stable")
    full = min(int(1 / cap + 1e-12), n - 1)
    low, high = np.ones(n, bool), np.zeros(n, bool)
    low[calm[: full + 1]] = False
    high[calm[:full]] = True
    w = high * cap
    w[calm[full]] = 1 - full * cap
    for _ in range(100 * n):
        free, fixed = np.flatnonzero(~(low | high)), high * cap
        k, part = len(free), root[:, free]
        if k:
            system = np.ones((k + 1, k + 1))
            system[:k, :k] = part.T @ part + ridge * np.eye(k)
            system[:k, k], system[k, k] = -1, 0
            x = np.linalg.solve(system, np.append(-part.T @ (root @ fixed), 1 - fixed.sum()))
            target, level = fixed.copy(), x[-1]
            target[free] = x[:-1]
        else:
            target, level = fixed, np.median(root.T @ (root @ fixed) + ridge * fixed)
        d, room = (target - w)[free], np.ones(k)
        down, up = target[free] < -1e-14, target[free] > cap + 1e-14
        room[down] = w[free][down] / -d[down]
        room[up] = (cap - w[free][up]) / d[up]
        hit = int(np.argmin(room)) if k else -1
        step = max(room[hit], 0.0) if k else 1.0
        w = w + step * (target - w)
        if step < 1:
            (low if down[hit] else high)[free[hit]] = True
            continue
        gradient = root.T @ (root @ w) + ridge * w - level
        wrong = np.where(low, -gradient, 0) + np.where(high, gradient, 0)
        worst = int(np.argmax(wrong))
        if wrong[worst] <= 1e-12 * max(1.0, abs(level)):
            return np.clip(w, 0, cap)
        low[worst] = high[worst] = False
    raise ArithmeticError(f"no weights of least variance found for {n} assets")


def weight_min_variance(window: DataFrame, cap: float, least: int) -> DataFrame:
    """Least-variance weights of each formation date from its complete-case returns; none where these are fewer than
    `least` (2 at least) dates, or the cap leaves weight over.

    Each asset's returns are one row of an array before dates are dealt, so a date's group has a row for each
    asset and holds assets x return dates numbers.
    """
    date, code = (window.schema[c].dataType.simpleString() for c in ("trade_date", "ts_code"))
    rows = complete_cases(window, max(least, 2))
    series = rows.groupBy("trade_date", "ts_code").agg(F.sort_array(F.collect_list(F.struct("return_date", "ret"))).alias("x"))

    def solve(table: pa.Table) -> pa.Table:
        table = table.sort_by("ts_code")
        x = np.array(table.column("x").to_pylist(), float).T
        if len(table) * cap < 1 - 1e-12:
            table, w = table.slice(0, 0), np.zeros(0)
        else:
            w = least_variance((x - x.mean(0)) / (len(x) - 1) ** 0.5, cap)
        return pa.table({"trade_date": table.column("trade_date"), "ts_code": table.column("ts_code"), "target_weight": w})

    series = series.select("trade_date", "ts_code", F.col("x.ret").alias("x"))
    return series.groupBy("trade_date").applyInArrow(solve, f"trade_date {date}, ts_code {code}, target_weight double")
