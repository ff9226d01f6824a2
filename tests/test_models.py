"""Boosting and the elastic net by hand, on rows with nulls, and over the study's folds."""

from __future__ import annotations

import random

import numpy as np
import pytest

from quantloom import catalog
from quantloom.operators import boosting, learning

SF = "/root/testdata/sf0.001"
SCHEMA = "fold_id int, role string, trade_date string, ts_code string, x double, y double, z double, label double"


def best_split(bins, g, rows, s):
    """(gain, feature, cut, missing_left) of a node's rows by trying every cut."""
    found = (1e-12, None)
    for j in range(bins.shape[1]):
        b = bins[rows, j]
        gone = b == boosting.MISSING
        for cut in sorted(set(b[~gone])):
            for side in (False, True) if gone.any() else (False,):
                left = np.where(gone, side, b <= cut)
                if min(left.sum(), (~left).sum()) < s.least_rows:
                    continue
                if not gone.any():
                    side = bool(left.sum() > (~left).sum())
                part = lambda m: g[rows][m].sum() ** 2 / (m.sum() + s.l2)  # noqa: E731, B023
                gain = part(left) + part(~left) - part(np.ones(len(rows), bool))
                if gain > found[0] + 1e-9:
                    found = (gain, (j, int(cut), side, left))
    return found[1]


def grown(bins, label, held, s, trees):
    """Scores after every tree, and the trees' splits, node by node."""
    score, splits, scores = np.full(len(label), label[~held].mean()), [], []
    for _ in range(trees):
        g, step, tree = score - label, np.zeros(len(label)), {}
        todo = [(0, np.arange(len(label)), 0)]
        while todo:
            node, rows, level = todo.pop()
            own = rows[~held[rows]]
            best = best_split(bins, g, own, s) if level < s.depth and len(own) else None
            if best is None:
                step[rows] = -s.rate * g[own].sum() / (len(own) + s.l2)
                continue
            j, cut, side, _ = best
            tree[node] = best[:3]
            left = np.where(bins[rows, j] == boosting.MISSING, side, bins[rows, j] <= cut)
            todo += [(2 * node + 1, rows[left], level + 1), (2 * node + 2, rows[~left], level + 1)]
        score = score + step
        splits.append(tree)
        scores.append(score)
    return splits, scores


@pytest.fixture(scope="module")
def table():
    r = random.Random(3)
    rows = []
    for fold in (2, 5):
        for i in range(260):
            x, y, z = r.random(), r.gauss(0, 1), float(r.randrange(4))
            label = (3 * x if x > 0.4 else -y) + (z == 2) + r.gauss(0, 0.1)
            rows.append((fold, "train" if i < 180 else "validation" if i < 220 else "prediction", f"d{i % 9}", f"c{i}", None if i % 7 == 0 else x, float("nan") if i % 11 == 0 else y, z, None if i % 50 == 49 else label))
    return rows


def test_splits_are_those_of_trying_every_cut(spark, table):
    s = boosting.Boosting(trees=10, depth=3, rate=0.3, bins=16, least_rows=5, l2=0.5)
    features = ["x", "y", "z"]
    split = spark.createDataFrame(table, SCHEMA).repartition(3)
    forest = boosting.fit_forest(split, features, "label", s)
    found = {(r["fold_id"], r["ts_code"]): r["prediction"] for r in boosting.predict_forest(split, forest, features, "label").collect()}
    assert forest.folds == [2, 5] and forest.grown.tolist() == [10, 10]
    for k, fold in enumerate(forest.folds):
        own = [r for r in table if r[0] == fold and r[7] is not None]
        bins = forest.binned(np.full(len(own), k), np.array([[np.nan if v is None else v for v in r[4:7]] for r in own], float))
        train = np.array([r[1] == "train" for r in own])
        assert (bins[train] == boosting.MISSING).any(0).tolist() == [True, True, False]
        splits, scores = grown(bins, np.array([r[7] for r in own]), ~train, s, s.trees)
        for t, tree in enumerate(splits):
            nodes = np.flatnonzero(forest.feature[k, t] >= 0)
            assert {n: (forest.feature[k, t, n], forest.cut[k, t, n], forest.missing_left[k, t, n]) for n in nodes} == tree
        assert all(found[fold, r[3]] == pytest.approx(v, rel=1e-9) for r, v in zip(own, scores[-1], strict=True) if r[1] == "prediction")
        held = np.array([r[1] == "validation" for r in own])
        losses = [np.mean((v[held] - np.array([r[7] for r in own])[held]) ** 2) for v in scores[:-1]]
        assert forest.losses[k][1:] == pytest.approx(losses, rel=1e-9)
    assert sum(1 for r in table if r[1] == "prediction") == len(found)


def test_validation_rows_stop_growth(spark):
    def rows(fold, role, sign):
        return [(fold, role, f"d{i}", f"c{i}", i / 10, None, 0.0, sign * (i / 10) ** 2) for i in range(30)]

    # fold 0 is contradicted by its validation rows, fold 1 has none; fold 2 has nothing to learn from
    parts = [*rows(0, "train", 1.0), *rows(0, "validation", -1.0), *rows(0, "prediction", 1.0), *rows(1, "train", 1.0), *rows(1, "prediction", 1.0), *rows(2, "prediction", 1.0)]
    split = spark.createDataFrame(parts, SCHEMA)
    s = boosting.Boosting(trees=4, depth=1, least_rows=1, patience=1)
    forest = boosting.fit_forest(split, ["x", "y"], "label", s)
    assert forest.folds == [0, 1] and forest.grown.tolist() == [1, 4]
    got = boosting.predict_forest(split, forest, ["x", "y"], "label").collect()
    assert len(got) == 60 and len({r["prediction"] for r in got if r["fold_id"] == 0}) == 2


def test_no_training_rows(spark):
    split = spark.createDataFrame([], SCHEMA)
    forest = boosting.fit_forest(split, ["x"], "label", boosting.Boosting(trees=2))
    assert forest.folds == [] and boosting.predict_forest(split, forest, ["x"], "label").count() == 0


@pytest.mark.parametrize(("alpha", "ratio"), [(0.01, 0.5), (0.1, 0.9), (0.3, 1.0), (0.05, 0.0), (100.0, 0.5)])
def test_elastic_net_is_optimal(spark, alpha, ratio):
    r = np.random.default_rng(8)
    names = [f"f{i}" for i in range(6)]
    x = r.normal(size=(400, 6))
    x[:, 5] = x[:, 0] * 0.9 + x[:, 5] * 0.1
    y = x[:, 0] - 0.5 * x[:, 1] + 0.05 * x[:, 2] + 3 + r.normal(size=400) * 0.2
    fold = np.arange(400) % 2
    rows = [(int(k), "train", *map(float, v), float(t)) for k, v, t in zip(fold, x, y, strict=True)] + [(0, "prediction", *[99.0] * 6, 99.0), (1, "train", *[99.0] * 6, None)]
    prepared = spark.createDataFrame(rows, f"fold_id int, role string, {', '.join(f'{n} double' for n in names)}, label double").repartition(4)
    found = {(c["fold_id"], c["feature"]): c["coefficient"] for c in learning.elastic_net(prepared, names, "label", alpha, ratio).collect()}
    for k in (0, 1):
        w, own, t = np.array([found[k, n] for n in names]), x[fold == k], y[fold == k]
        rest = t - found[k, "intercept"] - own @ w
        assert rest.mean() == pytest.approx(0, abs=1e-9)
        slope = own.T @ rest / len(t) - alpha * (1 - ratio) * w
        for j in range(6):  # the subgradient holds zero
            assert abs(slope[j]) <= alpha * ratio + 1e-8 if w[j] == 0 else slope[j] == pytest.approx(np.sign(w[j]) * alpha * ratio, abs=1e-8)
    if alpha == 0.3:
        assert any(found[0, n] == 0 for n in names) and any(found[0, n] != 0 for n in names)


def test_gbt_query(spark):
    got = catalog.queries()["gbt"](spark, SF)
    ridge = catalog.queries()["predict"](spark, SF)
    assert sorted(got.columns) == sorted(ridge.columns)
    assert sorted((r["trade_date"], r["ts_code"]) for r in got.collect()) == sorted((r["trade_date"], r["ts_code"]) for r in ridge.collect())
    assert all(r["prediction"] is not None for r in got.collect())
