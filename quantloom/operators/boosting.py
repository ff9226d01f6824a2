"""Histogram gradient boosting of regression trees on panels, all folds side by side.

Features are cut into bins at approximate quantiles of the training rows, and nulls have a bin of
their own, so nothing is filled in. A level of a tree, in every fold, takes one pass over the
binned rows: each task adds up its rows' gradients by fold, node, feature and bin, one aggregate
joins these sums, and windows along the bins find each node's best split. A row for
each node comes to the driver. Trees are complete binary heaps in arrays, which the passes
carry; scores are stored every few trees, so a pass walks those since only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.math import number
from ..sources.panels import work_dir

MISSING = 255  # the bin of nulls
STORE_EVERY = 8  # trees between stored scores


@dataclass(frozen=True)
class Boosting:
    """Settings of the trees; squared errors are minimised."""

    trees: int = 100
    depth: int = 3
    rate: float = 0.1
    bins: int = 64
    least_rows: int = 20
    l2: float = 0.0
    patience: int | None = None  # trees without a better loss of validation rows after which a fold stops
    tolerance: float = 1e-7
    accuracy: int = 10_000  # of the quantiles


@dataclass
class Forest:
    """Trees of all folds: arrays of folds x trees x heap nodes; a node without a feature is a leaf."""

    folds: list[int]
    edges: np.ndarray  # folds x features x bins - 1, filled up with infinity
    base: np.ndarray
    depth: int
    feature: np.ndarray = field(default=None)
    cut: np.ndarray = field(default=None)  # the last bin of the left side
    missing_left: np.ndarray = field(default=None)
    value: np.ndarray = field(default=None)
    grown: np.ndarray = field(default=None)  # trees of each fold
    losses: list[list[float]] = field(default_factory=list)  # of validation rows, by fold and number of trees

    def __post_init__(self):
        shape = (len(self.folds), 0, (2 << self.depth) - 1)
        self.feature, self.cut = np.full(shape, -1, np.int32), np.zeros(shape, np.int32)
        self.missing_left, self.value = np.zeros(shape, bool), np.zeros(shape)
        self.grown, self.losses = np.zeros(len(self.folds), np.int64), [[] for _ in self.folds]

    def add_tree(self) -> None:
        for name, empty in (("feature", -1), ("cut", 0), ("missing_left", False), ("value", 0.0)):
            old = getattr(self, name)
            setattr(self, name, np.concatenate([old, np.full((old.shape[0], 1, old.shape[2]), empty, old.dtype)], 1))

    def walk(self, fold: np.ndarray, tree: int, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node that each row (of place `fold`, with its features' bins) comes to."""
        at, rows = np.zeros(len(fold), np.int64), np.arange(len(fold))
        for _ in range(levels):
            f = self.feature[fold, tree, at]
            b = bins[rows, np.maximum(f, 0)]
            left = np.where(b == MISSING, self.missing_left[fold, tree, at], b <= self.cut[fold, tree, at])
            at = np.where(f < 0, at, 2 * at + np.where(left, 1, 2))
        return at

    def added(self, fold: np.ndarray, bins: np.ndarray, first: int, last: int) -> np.ndarray:
        """What trees `first` to `last` (exclusive) add to the rows' scores."""
        total = np.zeros(len(fold))
        for t in range(first, last):
            total += self.value[fold, t, self.walk(fold, t, bins, self.depth)]
        return total

    def binned(self, fold: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.full(x.shape, MISSING, np.uint8)
        for k in np.unique(fold):
            own = np.flatnonzero(fold == k)
            for j in range(x.shape[1]):
                v = x[own, j]
                known = ~np.isnan(v)
                out[own[known], j] = np.searchsorted(self.edges[k, j], v[known], "left")
        return out


def _features(batch: pa.RecordBatch, first: int) -> np.ndarray:
    """Columns from `first` on as doubles; null is NaN."""
    return np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[first:]], 1)


def _bins(column: pa.Array, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(n, -1)


def _stored(spark: SparkSession, frame: DataFrame, name: str) -> DataFrame:
    path = work_dir(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def _begin(split: DataFrame, features: list[str], label: str, settings: Boosting) -> Forest:
    """Folds, their mean labels and bin edges, from one aggregate of the training rows; a row for each fold comes back."""
    train = split.where((F.col("role") == "train") & number(F.col(label)).isNotNull())
    at = F.array(*[F.lit(i / settings.bins) for i in range(1, settings.bins)])
    quantiles = [F.percentile_approx(number(F.col(f)), at, settings.accuracy).alias(f"q{i}") for i, f in enumerate(features)]
    rows = sorted(train.groupBy("fold_id").agg(F.avg(label).alias("base"), *quantiles).collect(), key=lambda r: r["fold_id"])
    edges = np.full((len(rows), len(features), settings.bins - 1), np.inf)
    for k, r in enumerate(rows):
        for j in range(len(features)):
            found = np.unique(np.array(r[f"q{j}"] or [], float))
            edges[k, j, : len(found)] = found
    return Forest([r["fold_id"] for r in rows], edges, np.array([r["base"] for r in rows], float), settings.depth)


def _binned_rows(split: DataFrame, features: list[str], label: str, forest: Forest) -> DataFrame:
    """fold (its place), validation, label, bins and score of the rows to learn from."""
    folds, base = np.array(forest.folds), forest.base

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = np.searchsorted(folds, batch.column(0).to_numpy())
            bins = forest.binned(fold, _features(batch, 3))
            yield pa.RecordBatch.from_arrays([pa.array(fold, pa.int32()), batch.column(1), batch.column(2), pa.array([b.tobytes() for b in bins], pa.binary()), pa.array(base[fold])], names=["fold", "validation", "label", "bins", "score"])

    rows = split.where(F.col("role").isin("train", "validation") & number(F.col(label)).isNotNull() & F.col("fold_id").isin(forest.folds))
    given = rows.select("fold_id", (F.col("role") == "validation").alias("validation"), number(F.col(label)).alias("label"), *[number(F.col(f)).alias(f) for f in features])
    return given.mapInArrow(run, "fold int, validation boolean, label double, bins binary, score double")


def _level(rows: DataFrame, forest: Forest, since: int, tree: int, level: int, open_folds: np.ndarray, n_features: int, n_bins: int) -> DataFrame:
    """Sums (fold, node, feature, bin, g, n) of a level's nodes; node -1 has the squared errors of validation rows."""
    begin, width = (1 << level) - 1, 1 << level

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = (len(forest.folds), width, n_features, n_bins)
        gradients, counts = np.zeros(shape), np.zeros(shape, np.int64)
        losses = np.zeros((2, len(forest.folds)))
        for batch in batches:
            if not batch.num_rows:
                continue
            fold, held, label, score = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 4))
            bins = _bins(batch.column(3), batch.num_rows)
            error = score + forest.added(fold, bins, since, tree) - label
            held = held.astype(bool)
            losses += np.stack([np.bincount(fold[held], v[held], len(forest.folds)) for v in (error**2, np.ones(len(fold)))])
            used = ~held & open_folds[fold]
            fold, bins, error = fold[used], bins[used], error[used]
            node = forest.walk(fold, tree, bins, level) - begin
            inside = node >= 0  # others are in leaves above
            fold, bins, error, node = fold[inside], bins[inside], error[inside], node[inside]
            for j in range(n_features):
                b = np.where(bins[:, j] == MISSING, n_bins - 1, bins[:, j])
                flat = (fold.astype(np.int64) * width + node) * n_bins + b
                size = shape[0] * width * n_bins
                gradients[:, :, j] += np.bincount(flat, error, size).reshape(shape[0], width, n_bins)
                counts[:, :, j] += np.bincount(flat, None, size).reshape(shape[0], width, n_bins)
        k, m, j, b = np.nonzero(counts)
        own = np.flatnonzero(losses[1])
        names = ["fold", "node", "feature", "bin", "g", "n"]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k, m + begin, j, np.where(b == n_bins - 1, MISSING, b), gradients[k, m, j, b], counts[k, m, j, b])], names=names)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (own, np.full(len(own), -1), np.zeros(len(own), np.int64), np.zeros(len(own), np.int64), losses[0, own], losses[1, own].astype(np.int64))], names=names)

    sums = rows.mapInArrow(run, "fold long, node long, feature long, bin long, g double, n long")
    return sums.groupBy("fold", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("n").alias("n"))


def _splits(sums: DataFrame, settings: Boosting) -> DataFrame:
    """A row for each (fold, node): g, n, and its best split, if one is worth it.

    Every bin but the last is a possible cut, with the nulls on either side; nulls that
    a node hasn't seen go with the larger side. Ties go to the first feature, the lowest cut, and nulls on the right.
    """
    along = Window.partitionBy("fold", "node", "feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("fold", "node", "feature")
    is_missing = F.col("bin") == MISSING
    rows = sums.withColumns(
        {
            "all_g": F.sum("g").over(whole), "all_n": F.sum("n").over(whole),
            "miss_g": F.coalesce(F.sum(F.when(is_missing, F.col("g"))).over(whole), F.lit(0.0)), "miss_n": F.coalesce(F.sum(F.when(is_missing, F.col("n"))).over(whole), F.lit(0)),
            "upto_g": F.sum("g").over(along), "upto_n": F.sum("n").over(along),
        }
    )
    sides = F.array(F.lit(False), F.lit(True))
    cuts = rows.where(~is_missing).select("*", F.explode(sides).alias("missing_left")).where("NOT missing_left OR miss_n > 0")
    left_g = F.col("upto_g") + F.when(F.col("missing_left"), F.col("miss_g")).otherwise(0.0)
    left_n = F.col("upto_n") + F.when(F.col("missing_left"), F.col("miss_n")).otherwise(0)
    cuts = cuts.withColumns({"left_g": left_g, "left_n": left_n}).withColumns({"right_g": F.col("all_g") - F.col("left_g"), "right_n": F.col("all_n") - F.col("left_n")})
    cuts = cuts.where((F.col("left_n") >= settings.least_rows) & (F.col("right_n") >= settings.least_rows))
    part = lambda side: F.pow(F.col(f"{side}_g"), F.lit(2.0)) / (F.col(f"{side}_n") + settings.l2)
    gain = part("left") + part("right") - part("all")
    cuts = cuts.withColumn("gain", gain).where("gain > 1e-12")
    missing_left = F.when(F.col("miss_n") > 0, F.col("missing_left")).otherwise(F.col("left_n") > F.col("right_n"))
    best = F.max_by(F.struct("feature", "bin", missing_left.alias("missing_left"), "left_g", "left_n", "right_g", "right_n"), F.struct("gain", -F.col("feature"), -F.col("bin"), (~F.col("missing_left")).cast("int")))
    chosen = cuts.groupBy("fold", "node").agg(best.alias("split"))
    totals = sums.where("feature = 0 OR node < 0").groupBy("fold", "node").agg(F.sum("g").alias("g"), F.sum("n").alias("n"))
    return totals.join(chosen, ["fold", "node"], "left")


def _leaf(g: float, n: int, settings: Boosting) -> float:
    return -settings.rate * g / (n + settings.l2)


def _stops(losses: list[float], settings: Boosting) -> bool:
    """Whether none of the last `patience` losses is better than the one before them."""
    if settings.patience is None or len(losses) <= settings.patience:
        return False
    return min(losses[-settings.patience :]) >= losses[-settings.patience - 1] - settings.tolerance


def fit_forest(split: DataFrame, features: list[str], label: str, settings: Boosting = Boosting()) -> Forest:  # noqa: B008
    """A forest for each fold of `split` (fold_id, role, features, label).

    Rows without a label aren't learned from; features may be null or NaN. A fold without training
    rows has no forest. With `patience`, a fold's growth ends when its validation rows' loss gets no
    better; one without validation rows grows all its trees.
    """
    if not 2 <= settings.bins <= MISSING:
        raise ValueError("bins must be from 2 to 255")
    spark = split.sparkSession
    forest = _begin(split, features, label, settings)
    rows, since = _stored(spark, _binned_rows(split, features, label, forest), "boosting-rows"), 0
    open_folds = np.ones(len(forest.folds), bool)
    for tree in range(settings.trees):
        forest.add_tree()
        for level in range(settings.depth):
            sums = _level(rows, forest, since, tree, level, open_folds, len(features), settings.bins + 1)
            for r in _splits(sums, settings).collect():  # a row for each open node of the level
                k, node, best = r["fold"], r["node"], r["split"]
                if node < 0:
                    if open_folds[k] and level == 0:
                        forest.losses[k].append(r["g"] / r["n"])
                elif best is None:
                    if level == 0:
                        forest.value[k, tree, 0] = _leaf(r["g"], r["n"], settings)
                else:
                    forest.feature[k, tree, node], forest.cut[k, tree, node], forest.missing_left[k, tree, node] = best["feature"], best["bin"], best["missing_left"]
                    for child, side in ((2 * node + 1, "left"), (2 * node + 2, "right")):
                        forest.value[k, tree, child] = _leaf(best[f"{side}_g"], best[f"{side}_n"], settings)
            if level == 0:
                stopped = np.array([_stops(x, settings) for x in forest.losses], bool) & open_folds
                open_folds &= ~stopped
                forest.feature[stopped, tree], forest.value[stopped, tree] = -1, 0  # a stopped fold's tree adds nothing
            if not (forest.feature[:, tree, (1 << level) - 1 :] >= 0).any():
                break
        forest.grown += open_folds
        if not open_folds.any():
            break
        if (tree + 1) % STORE_EVERY == 0 and tree + 1 < settings.trees:
            rows, since = _stored(spark, _rescored(rows, forest, since, tree + 1), "boosting-rows"), tree + 1
    return forest


def _rescored(rows: DataFrame, forest: Forest, first: int, last: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                fold = batch.column(0).to_numpy()
                score = batch.column(4).to_numpy() + forest.added(fold, _bins(batch.column(3), len(fold)), first, last)
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(score)], names=batch.schema.names)

    return rows.mapInArrow(run, rows.schema)


def predict_forest(split: DataFrame, forest: Forest, features: list[str], label: str) -> DataFrame:
    """Out-of-sample rows of the folds that have a forest: trade_date, ts_code, target, prediction, fold_id."""
    folds = np.array(forest.folds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = np.searchsorted(folds, batch.column(3).to_numpy())
            bins = forest.binned(fold, _features(batch, 4))
            score = forest.base[fold] + forest.added(fold, bins, 0, forest.feature.shape[1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(score), batch.column(3)], names=["trade_date", "ts_code", "target", "prediction", "fold_id"])

    rows = split.where((F.col("role") == "prediction") & F.col("fold_id").isin(forest.folds))
    given = rows.select("trade_date", "ts_code", F.col(label).cast("double").alias("target"), F.col("fold_id").cast("int"), *[number(F.col(f)).alias(f) for f in features])
    kinds = {c: t for c, t in given.dtypes}
    return given.mapInArrow(run, f"trade_date {kinds['trade_date']}, ts_code {kinds['ts_code']}, target double, prediction double, fold_id int")
