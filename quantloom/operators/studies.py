"""Whole studies: compositions of the operators, and what data they need."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import calendars, composition, coverage, cross_section, evaluation, factors, learning


def factor_study(long: DataFrame, labels: DataFrame, directions: dict[str, int], weights: DataFrame | None = None, least: int = 20) -> dict[str, DataFrame]:
    """Transformed factors, their evaluation tables, and the composite's score and coefficients."""
    prepared = cross_section.preprocess(long, directions, least=min(least, 5))
    tables = evaluation.evaluate(prepared, labels, least=least)
    if weights is not None:
        score = composition.compose(prepared, weights)
        as_factor = score.select("trade_date", "ts_code", F.lit("composite").alias("factor_name"), F.col("score").alias("value"))
        tables |= {"score": score, "composite_ic": evaluation.ic_by_date(evaluation.paired(as_factor, labels), least)}
    return tables | {"prepared": prepared}


def research_plan(spark, names: list[str], days: DataFrame, start, end, lag: int, holding: int) -> DataFrame:
    """(dataset_id, start_date, end_date): from the longest look-back of any factor before the first open day of
    the interval to the exit of the last one's label; fails where the calendar lacks either."""
    metadata = factors.factor_metadata(spark).where(F.col("factor_name").isin(names))
    formations = days.where(F.col("cal_date").between(F.lit(start), F.lit(end))).select(F.col("cal_date").alias("formation_date"))
    need = coverage.factor_requirements(metadata, days, formations)
    last = formations.agg(F.max("formation_date").alias("cal_date"))
    exit_date = calendars.shift_open(last, days, lag + holding).select(F.col("shifted").alias("exit_date"))
    return need.groupBy("dataset_id").agg(F.min("start_date").alias("start_date")).join(F.broadcast(exit_date), F.lit(True)).select("dataset_id", "start_date", F.col("exit_date").alias("end_date"))


def portfolio_requirements(formations: DataFrame, days: DataFrame, lookback: int) -> DataFrame:
    """One row: the range of open days that weights with a look-back need; fails where the calendar is too short."""
    return calendars.history_window(formations, days, "DAYS", lookback).agg(F.min("first_date").alias("start_date"), F.max("last_date").alias("end_date"))


def history_need(train: int, validation: int, embargo: int, lag: int, holding: int) -> int:
    """Formation periods that one split without leaks needs."""
    return train + validation + embargo + lag + holding


def train_table_experiment(panel: DataFrame, plan: DataFrame, features: list[str], label: str, alpha: float) -> dict[str, DataFrame]:
    """Split, preparation, fit, out-of-sample rows and their tables, in order."""
    prepared = learning.prepare(learning.materialize_split(panel, plan), features)
    coefficients = learning.ridge(prepared, features, label, alpha)
    oos = learning.predict(prepared, coefficients, features, label)
    return {"coefficients": coefficients, "oos": oos, "folds": learning.fold_metrics(oos, learning.date_ic(oos)), "importances": learning.importances(coefficients, features), "date_ic": learning.date_ic(oos)}
