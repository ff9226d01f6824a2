"""Column arithmetic that is safe under ANSI mode, and the windows of a panel."""

from __future__ import annotations

import operator

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

CODE, DATE = "ts_code", "trade_date"


def by_code(*more: str) -> WindowSpec:
    return Window.partitionBy(CODE, *more).orderBy(DATE)


def by_date(*more: str) -> WindowSpec:
    return Window.partitionBy(DATE, *more)


def finite(x: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.nullif(b, F.lit(0.0))


def full_frame(aggregate: Column, x: Column, window: WindowSpec, n: int) -> Column:
    """An aggregate over the last n rows, null unless all n values are there."""
    frame = window.rowsBetween(-n + 1, 0)
    return F.when(F.count(x).over(frame) == n, aggregate.over(frame))


def average_rank(x: Column, partition: WindowSpec) -> Column:
    """Ascending rank of the non-null values of a partition, ties averaged."""
    ordered = partition.orderBy(x.asc_nulls_last())
    ties = F.count(x).over(ordered.rangeBetween(Window.currentRow, Window.currentRow))
    return F.when(x.isNotNull(), F.rank().over(ordered) + (ties - 1) / 2.0)


def correlation(x: Column, y: Column) -> Column:
    """Pearson's as an aggregate of pairs that are both there; null for constants."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when(spread > 1e-15, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.covar_pop(a, b) / F.nullif(spread, F.lit(0.0)))))


_TESTS = {">=": operator.ge, ">": operator.gt, "<=": operator.le, "<": operator.lt}


def number(x: Column) -> Column:
    """NaN as null."""
    x = x.cast("double")
    return F.when(~F.isnan(x), x)


def steps(x: Column, rules: list[tuple[str, float, object]], otherwise: object, missing: object) -> Column:
    """The value of the first rule (test, bound, value) that x meets; `missing` for null and NaN."""
    x = number(x)
    out = F.when(x.isNull(), missing)
    for test, bound, value in rules:
        out = out.when(_TESTS[test](x, F.lit(bound)), value)
    return out.otherwise(otherwise)
