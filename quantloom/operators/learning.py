"""Walk-forward learning on panels: splits by dates, preparation fitted on the training rows, ridge by
normal equations for all folds at once, and evaluation of out-of-sample predictions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.math import average_rank, correlation, ratio


def walk_forward_plan(dates: DataFrame, train: int, validation: int, embargo: int, step: int, expanding: bool = False) -> DataFrame:
    """(fold_id, role, trade_date) of every fold.

    `dates` has a row for each date: trade_date and max_exit (the last exit of its labels). Only
    dates whose labels are known count. Of those known at a block's start the last `embargo`
    go unused and the `validation` before them are validation dates; of the dates whose labels
    are known at the first of these the last `train` (if expanding, all) are training dates. The
    first block begins where both windows are full, and a block every `step` dates; one
    without enough history later on fails.
    """
    placed = dates.select("trade_date", "max_exit", (F.row_number().over(Window.orderBy("trade_date")) - 1).alias("pos"))
    day = F.broadcast(placed)  # a row for each date
    latest = Window.partitionBy("start").orderBy(F.desc("trade_date"))
    starts = placed.select(F.col("pos").alias("start"), F.col("trade_date").alias("start_date"))
    known = starts.join(day, F.col("max_exit") < F.col("start_date")).where("trade_date < start_date").withColumn("_n", F.row_number().over(latest))
    held_out = known.where((F.col("_n") > embargo) & (F.col("_n") <= embargo + validation)).select("start", "trade_date")
    opens = held_out.groupBy("start").agg(F.min("trade_date").alias("opening"), F.count(F.lit(1)).alias("_v")).where(F.col("_v") == validation)
    eligible = opens.join(day, F.col("max_exit") < F.col("opening")).where("trade_date < opening").select("start", "trade_date", F.row_number().over(latest).alias("_n"))
    full = eligible.groupBy("start").agg(F.count(F.lit(1)).alias("_t")).where(F.col("_t") >= train)
    first = full.agg(F.min("start").alias("first"))
    blocks = starts.join(F.broadcast(first), (F.col("start") >= F.col("first")) & ((F.col("start") - F.col("first")) % step == 0)).join(full, "start", "left")
    short = F.raise_error(F.concat(F.lit("not enough history before "), F.col("start_date").cast("string"))).cast("int")
    blocks = F.broadcast(blocks.select("start", F.when(F.col("_t").isNotNull(), ((F.col("start") - F.col("first")) / step).cast("int")).otherwise(short).alias("fold_id")))
    parts = [
        eligible.where(F.lit(expanding) | (F.col("_n") <= train)).join(blocks, "start").select("fold_id", F.lit("train").alias("role"), "trade_date"),
        held_out.join(blocks, "start").select("fold_id", F.lit("validation").alias("role"), "trade_date"),
        placed.join(blocks, (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("start") + step)).select("fold_id", F.lit("prediction").alias("role"), "trade_date"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def walk_forward_window(plan: DataFrame) -> DataFrame:
    return plan.groupBy("fold_id", "role").agg(F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"), F.count(F.lit(1)).alias("dates"))


def materialize_split(panel: DataFrame, plan: DataFrame) -> DataFrame:
    """The panel's rows of every fold and role; the plan, of dates, is broadcast."""
    return panel.join(F.broadcast(plan), "trade_date")


def leakage_rules(split: DataFrame) -> DataFrame:
    """(rule, violations) over the folds of a split with exit_date."""
    first = lambda r: F.min(F.when(F.col("role") == r, F.col("trade_date")))
    last = lambda r, c: F.max(F.when(F.col("role") == r, F.col(c)))
    folds = split.groupBy("fold_id").agg(first("validation").alias("v"), first("prediction").alias("p"), last("train", "exit_date").alias("te"), last("validation", "exit_date").alias("ve"), last("train", "trade_date").alias("t"), last("validation", "trade_date").alias("vl"))
    c = F.col
    rules = {"train_exit_reaches_validation": c("te") >= c("v"), "validation_exit_reaches_prediction": c("ve") >= c("p"), "roles_out_of_order": (c("t") >= c("v")) | (c("vl") >= c("p"))}
    return folds.agg(*[F.count_if(F.coalesce(x, F.lit(False))).alias(n) for n, x in rules.items()]).unpivot([], list(rules), "rule", "violations")


def prepare(split: DataFrame, features: list[str]) -> DataFrame:
    """Nulls take the fold's training median, then values are scaled by the training mean and population deviation."""
    is_train = F.col("role") == "train"
    medians = split.groupBy("fold_id").agg(*[F.median(F.when(is_train, F.col(f))).alias(f"_m_{f}") for f in features])
    filled = split.join(F.broadcast(medians), "fold_id").withColumns({f: F.coalesce(f, f"_m_{f}") for f in features}).drop(*[f"_m_{f}" for f in features])
    facts = [x for f in features for x in (F.avg(F.when(is_train, F.col(f))).alias(f"_a_{f}"), F.stddev_pop(F.when(is_train, F.col(f))).alias(f"_s_{f}"))]
    scaled = filled.join(F.broadcast(filled.groupBy("fold_id").agg(*facts)), "fold_id")
    z = {f: F.coalesce(ratio(F.col(f) - F.col(f"_a_{f}"), F.col(f"_s_{f}")), F.lit(0.0)) for f in features}
    return scaled.withColumns(z).drop(*[f"_{k}_{f}" for f in features for k in "as"])


def normal_equations(prepared: DataFrame, features: list[str], label: str) -> DataFrame:
    """(fold_id, gram, right): the products of an intercept and the features with each other and with the
    label over the training rows. One aggregate gives those of every fold; a fold's are one row."""
    columns = [F.lit(1.0), *[F.col(f) for f in features]]
    train = prepared.where((F.col("role") == "train") & F.col(label).isNotNull())
    gram = F.array(*[F.sum(a * b) for a in columns for b in columns]).alias("gram")
    right = F.array(*[F.sum(a * F.col(label)) for a in columns]).alias("right")
    return train.groupBy("fold_id").agg(gram, right)


def _solved(equations: DataFrame, features: list[str], solve: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(fold_id, feature, coefficient) of a solver of each fold's equations, intercept first."""
    names = ["intercept", *features]

    def run(batches):
        import pandas as pd

        for rows in batches:
            out = []
            for fold, g, r in zip(rows["fold_id"], rows["gram"], rows["right"]):
                out += [(fold, n, float(x)) for n, x in zip(names, solve(np.array(g, float).reshape(len(names), -1), np.array(r, float)))]
            yield pd.DataFrame(out, columns=["fold_id", "feature", "coefficient"])

    return equations.mapInPandas(run, "fold_id int, feature string, coefficient double")


def ridge(prepared: DataFrame, features: list[str], label: str, alpha: float) -> DataFrame:
    """(fold_id, feature, coefficient), with the intercept as a feature: least squares with alpha times the squared coefficients."""

    def solve(gram: np.ndarray, right: np.ndarray) -> np.ndarray:
        penalty = alpha * np.eye(len(right))
        penalty[0, 0] = 0
        return np.linalg.lstsq(gram + penalty, right, rcond=None)[0]

    return _solved(normal_equations(prepared, features, label), features, solve)


def elastic_net(prepared: DataFrame, features: list[str], label: str, alpha: float = 1.0, l1_ratio: float = 0.5, sweeps: int = 5000, tolerance: float = 1e-12) -> DataFrame:
    """(fold_id, feature, coefficient) that minimise half the mean squared error plus alpha times
    l1_ratio times the absolute coefficients plus alpha times (1 - l1_ratio) / 2 times their squares.

    Coordinate descent on the centred normal equations of every fold, so the rows are read
    once. A sweep sets each coefficient to its soft-thresholded optimum, and one below the threshold to
    exactly 0; it ends when no coefficient moves by more than `tolerance` of the largest, or after `sweeps`.
    """

    def solve(gram: np.ndarray, right: np.ndarray) -> np.ndarray:
        n, sums, total = gram[0, 0], gram[0, 1:], right[0]
        inner, outer = gram[1:, 1:] / n - np.outer(sums, sums) / n**2, right[1:] / n - sums * total / n**2
        w, pull = np.zeros(len(outer)), outer.copy()  # outer less inner times w
        for _ in range(sweeps):
            moved = 0.0
            for j in range(len(w)):
                at = pull[j] + inner[j, j] * w[j]
                base = inner[j, j] + alpha * (1 - l1_ratio)
                new = np.sign(at) * max(abs(at) - alpha * l1_ratio, 0.0) / base if base > 0 else 0.0
                if new != w[j]:
                    moved = max(moved, abs(new - w[j]))
                    pull -= inner[:, j] * (new - w[j])
                    w[j] = new
            if moved <= tolerance * max(np.abs(w).max(initial=0.0), 1e-300):
                break
        return np.concatenate([[(total - sums @ w) / n], w])

    return _solved(normal_equations(prepared, features, label), features, solve)


def train_predict(prepared: DataFrame, features: list[str], label: str, models: dict[str, Callable[[DataFrame, list[str], str], DataFrame]]) -> DataFrame:
    """(model, trade_date, ts_code, target, prediction, fold_id): out-of-sample rows of several linear
    models, each a function that gives its coefficients of all folds. All models' coefficients meet the
    prediction rows in one join, so these are read once."""
    parts = [fit(prepared, features, label).withColumn("model", F.lit(name)) for name, fit in models.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    wide = every.groupBy("fold_id", "model").pivot("feature", ["intercept", *features]).agg(F.first("coefficient"))
    wide = wide.select("fold_id", "model", *[F.col(c).alias(f"_w_{c}") for c in ("intercept", *features)])
    value = sum((F.col(f) * F.col(f"_w_{f}") for f in features), F.col("_w_intercept"))
    rows = prepared.where(F.col("role") == "prediction").join(F.broadcast(wide), "fold_id")  # a row for each fold and model
    return rows.select("model", "trade_date", "ts_code", F.col(label).alias("target"), value.alias("prediction"), "fold_id")


def predict(prepared: DataFrame, coefficients: DataFrame, features: list[str], label: str) -> DataFrame:
    """Out-of-sample rows: trade_date, ts_code, target, prediction, fold_id."""
    wide = coefficients.groupBy("fold_id").pivot("feature", ["intercept", *features]).agg(F.first("coefficient"))
    wide = wide.select("fold_id", *[F.col(c).alias(f"_w_{c}") for c in ("intercept", *features)])
    value = F.col("_w_intercept")
    for f in features:
        value = value + F.col(f) * F.col(f"_w_{f}")
    rows = prepared.where(F.col("role") == "prediction").join(F.broadcast(wide), "fold_id")
    return rows.select("trade_date", "ts_code", F.col(label).alias("target"), value.alias("prediction"), "fold_id")


def importances(coefficients: DataFrame, features: list[str]) -> DataFrame:
    """Size, direction and place of each coefficient of a fold: largest first, ties by the feature's position."""
    at = F.array_position(F.array(*[F.lit(f) for f in features]), F.col("feature")) - 1
    rows = coefficients.where("feature <> 'intercept'").withColumns({"position": at, "importance": F.abs("coefficient")})
    sign = F.when(F.col("coefficient") > 0, "positive").when(F.col("coefficient") < 0, "negative").otherwise("zero")
    place = F.row_number().over(Window.partitionBy("fold_id").orderBy(F.desc("importance"), "position"))
    return rows.withColumns({"direction": sign, "place": place})


def _errors() -> list[Column]:
    e = F.col("prediction") - F.col("target")
    n = F.count(e)
    there = F.when(e.isNotNull(), F.col("target"))
    constant = F.min(there) == F.max(there)
    r2 = 1 - ratio(F.sum(e * e), F.var_pop(there) * n)
    reason = F.when(n < 2, "insufficient_observations").when(constant, "constant_target")
    return [n.alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.when(reason.isNull(), r2).alias("r2"), reason.alias("r2_reason")]


def regression_metrics(oos: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows, mean absolute and root mean square error and r2, with the reason where it has none."""
    return oos.groupBy(*by).agg(*_errors()) if by else oos.agg(*_errors())


def pearson_reason(x: Column, y: Column, least: int) -> Column:
    """Why pairs have no correlation (an aggregate): too few, or a constant side; null if they have one."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    flat_x, flat_y = F.min(a) == F.max(a), F.min(b) == F.max(b)
    return (
        F.when(F.count(a) < least, "insufficient_cross_section")
        .when(flat_x & flat_y, "constant_target_and_prediction")
        .when(flat_y, "constant_target")
        .when(flat_x, "constant_prediction")
    )


def date_ic(oos: DataFrame, least: int = 3) -> DataFrame:
    """Pearson and rank correlation of each date and fold, each with the reason where there is none."""
    w = Window.partitionBy("trade_date", "fold_id")
    both = F.col("prediction").isNotNull() & F.col("target").isNotNull()
    rows = oos.withColumn("x", F.when(both, F.col("prediction"))).withColumn("y", F.when(both, F.col("target")))
    rows = rows.withColumn("rx", average_rank(F.col("x"), w)).withColumn("ry", average_rank(F.col("y"), w))
    parts = [F.count("x").alias("n")]
    for a, b, name in (("x", "y", "ic"), ("rx", "ry", "rank_ic")):
        x, y = F.col(a), F.col(b)
        reason = pearson_reason(x, y, least)
        parts += [F.when(reason.isNull(), correlation(x, y)).alias(name), reason.alias(f"{name}_reason")]
    return rows.groupBy("trade_date", "fold_id").agg(*parts)


def _ic_facts(name: str) -> list[Column]:
    mean, std = F.avg(name), F.stddev_samp(name)
    return [mean.alias(f"{name}_mean"), std.alias(f"{name}_std"), ratio(mean, std).alias(f"{name}_ir"), F.count(name).alias(f"{name}_valid_dates"), F.count_if(F.col(name).isNull()).alias(f"{name}_invalid_dates")]


def ic_summary(ic: DataFrame) -> DataFrame:
    """One row: dates, and for both coefficients mean, deviation, ratio and the dates with and without one."""
    return ic.agg(F.count(F.lit(1)).alias("dates"), *_ic_facts("ic"), *_ic_facts("rank_ic"))


def fold_metrics(oos: DataFrame, ic: DataFrame) -> DataFrame:
    """The errors of each fold, its dates and rows, and both coefficients over its dates."""
    spans = oos.groupBy("fold_id").agg(F.min("trade_date").alias("start_date"), F.max("trade_date").alias("end_date"), F.count(F.lit(1)).alias("n_rows"), F.countDistinct("trade_date").alias("n_dates"), *_errors())
    return spans.join(ic.groupBy("fold_id").agg(*_ic_facts("ic"), *_ic_facts("rank_ic")), "fold_id")


def evaluate_oos(oos: DataFrame) -> DataFrame:
    """All out-of-sample tables as one of (scope, metric, value): all rows, each fold, each date, and the dates' coefficients."""
    by_date = date_ic(oos)

    def long(table: DataFrame, scope) -> DataFrame:
        numbers = [c for c, t in table.dtypes if t in ("bigint", "double") and c not in ("fold_id", "trade_date")]
        wide = table.select(scope.alias("scope"), *[F.col(c).cast("double").alias(c) for c in numbers])
        return wide.unpivot(["scope"], numbers, "metric", "value")

    parts = [
        long(regression_metrics(oos), F.lit("all")),
        long(fold_metrics(oos, by_date), F.concat(F.lit("fold "), F.col("fold_id").cast("string"))),
        long(by_date, F.col("trade_date").cast("string")),
        long(ic_summary(by_date), F.lit("dates")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def _places(keys: list[str], seed: Column, k: int) -> Column:
    """Each row's place in the k-th pseudo-random order of its group."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(F.md5(F.concat_ws("|", "ts_code", seed.cast("string"), F.lit(str(k)))), "ts_code"))


def permute_in_date(panel: DataFrame, column: str, seed: int, by: list[str] | None = None) -> DataFrame:
    """One column shuffled inside each date, the same way for the same seed: values in hash order go to rows in another hash order."""
    keys = [*(by or []), "trade_date"]
    rows = panel.withColumn("_to", _places(keys, F.lit(seed), 1)).withColumn("_from", _places(keys, F.lit(seed), 2))
    values = rows.select(*keys, F.col("_from").alias("_to"), F.col(column).alias("_v"))
    return rows.drop("_from").join(values, [*keys, "_to"]).withColumn(column, F.col("_v")).drop("_to", "_v")


def permutation_importance(prepared: DataFrame, coefficients: DataFrame, features: list[str], label: str, repeats: int = 3, scoring: str = "rmse") -> DataFrame:
    """(fold_id, feature, repeat, loss): how much larger the error (rmse or mae) gets when a feature is
    shuffled inside dates. A repeat shuffles all features by one order, so one join serves them all."""
    if scoring not in ("rmse", "mae"):
        raise ValueError("scoring is rmse or mae")

    def error(prediction: Column) -> Column:
        e = prediction - F.col(label)
        return F.sqrt(F.avg(e * e)) if scoring == "rmse" else F.avg(F.abs(e))

    wide = coefficients.groupBy("fold_id").pivot("feature", ["intercept", *features]).agg(F.first("coefficient"))
    wide = wide.select("fold_id", *[F.col(c).alias(f"_w_{c}") for c in ("intercept", *features)])
    keys = ["fold_id", "trade_date", "repeat"]
    rows = prepared.where("role = 'prediction'").select("fold_id", "trade_date", "ts_code", label, *features, F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))
    seed = F.col("repeat") * 1000 + 7
    rows = rows.withColumn("_to", _places(keys, seed, 1)).withColumn("_from", _places(keys, seed, 2))
    values = rows.select(*keys, F.col("_from").alias("_to"), *[F.col(f).alias(f"_v_{f}") for f in features])
    rows = rows.drop("_from").join(values, [*keys, "_to"]).join(F.broadcast(wide), "fold_id")  # a row for each fold

    def predicted(shuffled: str | None) -> Column:
        terms = [F.col(f"_v_{f}" if f == shuffled else f) * F.col(f"_w_{f}") for f in features]
        return sum(terms, F.col("_w_intercept"))

    losses = rows.groupBy("fold_id", "repeat").agg(error(predicted(None)).alias("_base"), *[error(predicted(f)).alias(f"_l_{f}") for f in features])
    each = F.array(*[F.struct(F.lit(f).alias("feature"), (F.col(f"_l_{f}") - F.col("_base")).alias("loss")) for f in features])
    return losses.select("fold_id", "repeat", F.inline(each)).select("fold_id", "feature", "repeat", "loss")


def importance_summary(losses: DataFrame, by: list[str]) -> DataFrame:
    x = F.col("loss")
    out = losses.groupBy(*by).agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), F.median(x).alias("median"), F.avg((x > 0).cast("double")).alias("positive"))
    others = [c for c in by if c != "feature"]
    return out.withColumn("place", F.row_number().over((Window.partitionBy(*others) if others else Window.partitionBy(F.lit(0))).orderBy(F.desc("mean"), "feature")))


def fit_by_fold(prepared: DataFrame, features: list[str], label: str, estimator) -> DataFrame:
    """Out-of-sample predictions of a `pyspark.ml` regressor fitted fold by fold on
    training rows; one with a validationIndicatorCol gets the fold's validation rows, if any, for its early stop."""
    from functools import reduce

    from pyspark.ml.feature import VectorAssembler

    assembler = VectorAssembler(inputCols=features, outputCol="features")
    folds = sorted(r[0] for r in prepared.select("fold_id").distinct().collect())  # few
    parts = []
    for k in folds:
        rows = prepared.where(F.col("fold_id") == k)
        known, fitted = rows.where(F.col(label).isNotNull()), estimator
        train = known.where("role = 'train'")
        if estimator.hasParam("validationIndicatorCol") and estimator.isSet("validationIndicatorCol"):
            if known.where("role = 'validation'").isEmpty():
                fitted = estimator.copy()
                fitted.clear(fitted.getParam("validationIndicatorCol"))
            else:
                held_out = estimator.getOrDefault("validationIndicatorCol")
                train = known.where("role IN ('train', 'validation')").withColumn(held_out, F.col("role") == "validation")
        model = fitted.fit(assembler.transform(train).withColumnRenamed(label, "label"))
        parts.append(model.transform(assembler.transform(rows.where("role = 'prediction'"))).select("trade_date", "ts_code", F.col(label).alias("target"), "prediction", "fold_id"))
    return reduce(lambda a, b: a.unionByName(b), parts)
