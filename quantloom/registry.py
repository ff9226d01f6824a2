"""Registered queries: an operator applied to a view, and the same as SQL.

Doubles named in `doubles` are rounded to six places on both sides, as sums of doubles
depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .views import Views, with_views

PLACES = 6
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def to_places(x: Column) -> Column:
    """x to six places, halves as the SQL has them: it rounds the product, Spark's own round the decimal text."""
    whole = x * F.lit(10.0**PLACES)
    return F.when(F.abs(whole) < float("inf"), F.round(whole) / F.lit(10.0**PLACES)).otherwise(x.cast("double")) + F.lit(0.0)


def query(name: str, sql: str | None = None, doubles: str = ""):
    """Register a function from Views to DataFrame under `name`."""
    columns = doubles.split()

    def add(make: Callable[[Views], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = make(Views(spark, sf_dir))
            return out.withColumns({c: to_places(F.col(c)) for c in columns})

        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = run
        if sql:
            rounded = ", ".join(f"round({c}, {PLACES}) + 0.0 AS {c}" for c in columns)
            text = with_views(sql)
            ORACLES[name] = f"SELECT * REPLACE ({rounded}) FROM ({text}) AS result" if columns else text
        return make

    return add
