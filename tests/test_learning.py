"""Fits by fold."""

from __future__ import annotations

from pyspark.ml.regression import GBTRegressor

from quantloom.operators import learning


def test_validation_rows_stop_boosting(spark):
    def rows(fold, role, sign):
        return [(fold, role, f"d{i}", f"c{i}", i / 10, sign * (i / 10) ** 2) for i in range(30)]

    # fold 0 is contradicted by its validation rows, fold 1 has none
    table = [*rows(0, "train", 1.0), *rows(0, "validation", -1.0), *rows(0, "prediction", 1.0), *rows(1, "train", 1.0), *rows(1, "prediction", 1.0)]
    prepared = spark.createDataFrame(table, "fold_id int, role string, trade_date string, ts_code string, x double, y double")
    gbt = GBTRegressor(maxIter=4, maxDepth=1, seed=1, validationIndicatorCol="held_out", validationTol=0.0)
    got = learning.fit_by_fold(prepared, ["x"], "y", gbt).collect()
    values = [{round(r["prediction"], 6) for r in got if r["fold_id"] == k} for k in (0, 1)]
    assert len(got) == 60 and len(values[0]) == 2 < len(values[1])  # one tree, and all four
