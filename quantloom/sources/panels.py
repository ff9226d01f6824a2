"""Sources and sinks of research tables: Parquet and CSV, partitioned, with coverage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.coverage import complete_units
from ..operators.quality import canonical_upsert


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quantloom-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet to the shared folder and read again, so that they are computed once."""
    path = work_dir(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a declared schema, so that codes and dates stay text."""
    return spark.read.csv(path, header=True, schema=schema)


def read_panel(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A Parquet panel; only the columns asked for are scanned."""
    panel = spark.read.parquet(path)
    return panel.select(*columns) if columns else panel


def modeling_columns(panel: DataFrame, keys: list[str], label: str, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Keys, feature columns (the ones included, or all but the excluded) and the label."""
    features = include if include is not None else [c for c in panel.columns if c not in {*keys, label, *(exclude or [])}]
    missing = [c for c in [*keys, *features, label] if c not in panel.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return panel.select(*keys, *features, label)


def read_unit(dataset: DataFrame, unit) -> DataFrame:
    """The rows of one date; on a partitioned dataset only its partition is scanned."""
    d = F.lit(unit)
    pruned = dataset.where((F.col("year") == F.year(d)) & (F.col("month") == F.month(d))) if {"year", "month"} <= set(dataset.columns) else dataset
    return pruned.where(F.col("trade_date") == d)


def uncovered(dates: DataFrame, coverage: DataFrame) -> DataFrame:
    """Requested dates (trade_date) that the coverage doesn't call complete."""
    units = complete_units(coverage).select(F.to_date("unit").alias("trade_date")).distinct()
    return dates.select("trade_date").distinct().join(units, "trade_date", "left_anti")


def read_covered(dataset: DataFrame, dates: DataFrame, coverage: DataFrame) -> DataFrame:
    """The rows of the requested dates; an error if any date isn't covered.

    Of a dataset partitioned by year and month, only the dates' partitions are scanned: they are
    found at run time, from the broadcast table of dates.
    """
    if not uncovered(dates, coverage).isEmpty():
        raise ValueError("not all requested dates are covered")
    first, last = dates.agg(F.min("trade_date"), F.max("trade_date")).first()
    asked = dates.select("trade_date").where(F.col("trade_date").between(F.lit(first), F.lit(last))).distinct()
    keys = ["trade_date"]
    if {"year", "month"} <= set(dataset.columns):
        asked = asked.withColumns({"year": F.year("trade_date"), "month": F.month("trade_date")})
        keys = ["year", "month", "trade_date"]
    return dataset.join(F.broadcast(asked), keys, "left_semi")  # a row for each date


def read_range(dataset: DataFrame, start, end, code: str | None = None, date: str = "trade_date") -> DataFrame:
    rows = dataset.where(F.col(date).between(F.lit(start), F.lit(end)))
    return rows.where(F.col("ts_code") == code) if code else rows


def checked_holdings(held: DataFrame, dates: int, rows: int) -> DataFrame:
    """Published holdings, if they have the dates and rows that they should."""
    found = held.agg(F.countDistinct("effective_date"), F.count(F.lit(1))).first()
    if tuple(found) != (dates, rows):
        raise ValueError(f"holdings have {found[0]} dates and {found[1]} rows")
    return held


def _there(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def write_partitioned(frame: DataFrame, path: str, keys: tuple[str, ...] = ("trade_date", "ts_code"), fillable: tuple[str, ...] = (), date: str = "trade_date") -> None:
    """Merge rows into a table by year and month: new keys are added, no row is lost.

    Only the partitions that `frame` has are read and written again. A key that is there
    already must have the same values (nulls of `fillable` columns may be filled), and a
    key may come once: else nothing is written and it is an error.
    """
    spark = frame.sparkSession
    dated = frame.withColumn("year", F.year(date)).withColumn("month", F.month(date))
    if not dated.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"keys {keys} are not unique")
    there = _there(spark, path)
    if there is None:
        dated.write.partitionBy("year", "month").parquet(path)
        return
    touched = dated.select("year", "month").distinct()
    merged = canonical_upsert(there.join(F.broadcast(touched), ["year", "month"], "left_semi"), dated, list(keys), fillable)
    staged = work_dir(spark, "merge")  # a table can't be read and replaced at once
    merged.write.parquet(staged)
    merged = spark.read.parquet(staged)
    if not merged.where("conflict").isEmpty():
        raise ValueError("rows conflict with the rows that are there")
    merged.drop("conflict").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "month").parquet(path)


def write_raw(frame: DataFrame, path: str, fetch_id: str) -> None:
    """A pull under its fetch id, which must be new."""
    frame.write.mode("errorifexists").parquet(f"{path}/fetch_id={fetch_id}")


def fingerprint(frame: DataFrame) -> DataFrame:
    """rows, total and mixed: an order-insensitive hash of a table, in one pass."""
    h = F.xxhash64(*[F.col(c) for c in sorted(frame.columns)])
    return frame.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("total"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("mixed"))


def identity(frames: dict[str, DataFrame]) -> str:
    """One hash over the fingerprints of several tables."""
    import hashlib

    facts = [f"{n}:{':'.join(map(str, fingerprint(f).first()))}" for n, f in sorted(frames.items())]
    return hashlib.sha256("|".join(facts).encode()).hexdigest()


def publish(frames: dict[str, DataFrame], path: str) -> DataFrame:
    """Write all tables and return their manifest (table, rows, total, mixed), which is written beside them."""
    spark = next(iter(frames.values())).sparkSession
    facts = []
    for name, frame in frames.items():
        frame.write.mode("errorifexists").parquet(f"{path}/{name}")
        facts.append((name, *fingerprint(spark.read.parquet(f"{path}/{name}")).first()))
    manifest = spark.createDataFrame(facts, "table string, rows long, total string, mixed long")
    manifest.coalesce(1).write.parquet(f"{path}/manifest")
    return manifest


def publish_inputs(frames: dict[str, DataFrame], root: str) -> str:
    """Publish a set of tables under its content's id; an id that is there already is reused.

    Each table is computed once, so that its id is that of the rows that are published.
    """
    spark = next(iter(frames.values())).sparkSession
    frames = {name: stored(frame, f"input-{name}") for name, frame in frames.items()}
    path = f"{root}/materialization_id={identity(frames)}"
    if _there(spark, f"{path}/manifest") is None:
        publish(frames, path)
    return path


def verify(spark: SparkSession, path: str) -> DataFrame:
    """(table, rows, stored_rows, unchanged) of every published table."""
    manifest = spark.read.parquet(f"{path}/manifest")
    again = [(r["table"], *fingerprint(spark.read.parquet(f"{path}/{r['table']}")).first()) for r in manifest.select("table").collect()]  # a row for each table
    now = spark.createDataFrame(again, "table string, stored_rows long, stored_total string, stored_mixed long")
    same = (F.col("rows") == F.col("stored_rows")) & (F.col("total") == F.col("stored_total")) & (F.col("mixed") == F.col("stored_mixed"))
    return manifest.join(now, "table", "full").select("table", "rows", "stored_rows", F.coalesce(same, F.lit(False)).alias("unchanged"))
