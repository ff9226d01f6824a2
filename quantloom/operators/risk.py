"""Risk estimates per formation date: covariances by blocks of assets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 512  # assets

def complete_cases(window: DataFrame, least: int) -> DataFrame:
    """Rows of the return dates on which all of a formation date's assets have a return, if there are `least` such dates."""
    assets = window.groupBy("trade_date").agg(F.countDistinct("ts_code").alias("assets"))
    here = F.count("ret").over(Window.partitionBy("trade_date", "return_date"))
    rows = window.join(assets, "trade_date").withColumn("_n", here).where("_n = assets")
    dates = rows.groupBy("trade_date").agg(F.countDistinct("return_date").alias("observations"))
    return rows.join(dates.where(F.col("observations") >= least), "trade_date").select("trade_date", "ts_code", "return_date", "ret", "observations")


def _moments(rows: DataFrame, block: int = BLOCK, fourth: bool = True) -> DataFrame:
    """(trade_date, i, j, s, q, n): mean products of two assets' centred returns and, if `fourth`, of their squares, over n dates.

    Each asset's window is one row of an array. Assets are dealt into blocks, and the matrix of a date is
    computed a pair of blocks at a time, so a task holds two blocks of assets, whatever the universe.
    """
    date, code = rows.schema["trade_date"].dataType.simpleString(), rows.schema["ts_code"].dataType.simpleString()
    series = rows.groupBy("trade_date", "ts_code").agg(F.sort_array(F.collect_list(F.struct("return_date", "ret"))).alias("x"))
    blocks = F.ceil(F.count(F.lit(1)).over(Window.partitionBy("trade_date")) / block)
    dealt = series.select("trade_date", "ts_code", F.col("x.ret").alias("x"), blocks.alias("blocks"), F.pmod(F.xxhash64("ts_code"), blocks).alias("own"))
    sent = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    sent = sent.select("trade_date", "ts_code", "x", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))

    def products(table: pa.Table) -> pa.Table:
        x = np.array(table.column("x").to_pylist(), float)
        x -= x.mean(axis=1, keepdims=True)
        n, own = x.shape[1], table.column("own").to_numpy()
        a, b = np.flatnonzero(own == own.min()), np.flatnonzero(own == table.column("high")[0].as_py())
        s = x[a] @ x[b].T / n
        q = (x[a] ** 2) @ (x[b] ** 2).T / n if fourth else np.full(s.shape, np.nan)
        i, j, s, q = np.repeat(a, len(b)), np.tile(b, len(a)), s.ravel(), q.ravel()
        if len(np.unique(own)) > 1:  # two blocks: both triangles
            i, j, s, q = np.concatenate([i, j]), np.concatenate([j, i]), np.tile(s, 2), np.tile(q, 2)
        codes, dates = table.column("ts_code").combine_chunks(), table.column("trade_date").combine_chunks()
        return pa.table({"trade_date": dates.take(pa.array(np.zeros(len(i), np.int64))), "i": codes.take(pa.array(i)), "j": codes.take(pa.array(j)), "s": s, "q": q, "n": np.full(len(i), float(n))})

    return sent.groupBy("trade_date", "low", "high").applyInArrow(products, f"trade_date {date}, i {code}, j {code}, s double, q double, n double")


def covariance(rows: DataFrame) -> DataFrame:
    """(trade_date, i, j, covariance), sample, of complete cases."""
    n = F.col("n")
    return _moments(rows, fourth=False).select("trade_date", "i", "j", (F.col("s") * n / F.nullif(n - 1, F.lit(0.0))).alias("covariance"))


def shrinkage_facts(rows: DataFrame) -> DataFrame:
    """(trade_date, assets, observations, mean, shrinkage) of complete cases, without listing pairs of assets.

    With x the matrix of centred returns, dates by assets, the covariance S has the trace and the squared norm
    of x x' / dates, which is as large as the look-back, not the universe; and the mean squares of all
    products add up to those of the diagonal of x x'. That matrix is a sum over assets: each task adds
    up its own, and a date's partial matrices are added once more.
    """
    date = rows.schema["trade_date"].dataType.simpleString()
    series = rows.groupBy("trade_date", "ts_code").agg(F.sort_array(F.collect_list(F.struct("return_date", "ret"))).alias("x"))

    def add_up(batches):
        for batch in batches:
            days = batch.column(0).to_numpy(zero_copy_only=False)
            series = batch.column(1).to_pylist()
            kinds, of = np.unique(days, return_inverse=True)
            first, grams, counts = [], [], []
            for k in range(len(kinds)):
                own = np.flatnonzero(of == k)
                x = np.array([series[i] for i in own], float)
                x -= x.mean(axis=1, keepdims=True)
                first.append(own[0])
                grams.append((x.T @ x).ravel())
                counts.append(len(own))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first, pa.int64())), pa.array(counts, pa.int64()), pa.array(grams, pa.list_(pa.float64()))], names=["trade_date", "assets", "gram"])

    def judge(table):
        gram = np.array(table.column("gram").to_pylist(), float).sum(0)
        t = int(len(gram) ** 0.5)
        gram, p = gram.reshape(t, t), float(sum(table.column("assets").to_pylist()))
        mean = np.trace(gram) / t / p
        squares, fourth = (gram**2).sum() / t**2, (np.diag(gram) ** 2).sum() / t
        spread, noise = squares / p - mean**2, (fourth - squares) / (t * p)
        return pa.table({"trade_date": table.column("trade_date").slice(0, 1), "assets": pa.array([int(p)]), "observations": pa.array([t]), "mean": pa.array([mean]), "shrinkage": pa.array([min(noise, spread) / spread if spread != 0 else 0.0])})

    partial = series.select("trade_date", F.col("x.ret").alias("x")).mapInArrow(add_up, f"trade_date {date}, assets long, gram array<double>")
    return partial.groupBy("trade_date").applyInArrow(judge, f"trade_date {date}, assets long, observations long, mean double, shrinkage double")


def ledoit_wolf(rows: DataFrame) -> DataFrame:
    """(trade_date, i, j, covariance, shrinkage): the covariance shrunk to a multiple of the identity (Ledoit and Wolf, 2004)."""
    facts = shrinkage_facts(rows).select("trade_date", F.col("mean").alias("_mean"), "shrinkage")
    shrunk = (1 - F.col("shrinkage")) * F.col("s") + F.col("shrinkage") * F.when(F.col("i") == F.col("j"), F.col("_mean")).otherwise(0.0)
    pair = _moments(rows, fourth=False).join(F.broadcast(facts), "trade_date")  # a row for each formation date
    return pair.select("trade_date", "i", "j", shrunk.alias("covariance"), "shrinkage")
