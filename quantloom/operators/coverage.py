"""Coverage of datasets by units, and what a study needs of them. All tables here have a row for
each unit or requirement, never for each security."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .calendars import history_window
from .quality import content_hash, content_sums

UNIT = ["dataset_id", "scope_key", "unit"]


def required_units(requirements: DataFrame, days: DataFrame) -> DataFrame:
    """The units of each requirement (dataset_id, scope_key, kind, start_date, end_date): natural days, open days, months or one snapshot."""
    r = requirements
    text = lambda c: F.date_format(c, "yyyy-MM-dd")
    daily = r.where("kind IN ('DAYS', 'OPEN_DAYS')").select("dataset_id", "scope_key", "kind", F.explode(F.sequence("start_date", "end_date")).alias("d"))
    natural = daily.where("kind = 'DAYS'").select("dataset_id", "scope_key", text("d").alias("unit"))
    opened = daily.where("kind = 'OPEN_DAYS'").join(F.broadcast(days.select(F.col("cal_date").alias("d"))), "d", "left_semi").select("dataset_id", "scope_key", text("d").alias("unit"))
    months = r.where("kind = 'MONTHS'").select("dataset_id", "scope_key", F.explode(F.sequence(F.trunc("start_date", "month"), F.trunc("end_date", "month"), F.expr("interval 1 month"))).alias("d"))
    monthly = months.select("dataset_id", "scope_key", F.date_format("d", "yyyy-MM").alias("unit"))
    snapshot = r.where("kind = 'SNAPSHOT'").select("dataset_id", "scope_key", F.lit("SNAPSHOT").alias("unit"))
    return natural.unionByName(opened).unionByName(monthly).unionByName(snapshot).distinct()


def complete_units(coverage: DataFrame) -> DataFrame:
    return coverage.where("status = 'COMPLETE'").select(*UNIT).distinct()


def missing_units(required: DataFrame, coverage: DataFrame) -> DataFrame:
    return required.join(complete_units(coverage), UNIT, "left_anti")


def islands(required: DataFrame, missing: DataFrame) -> DataFrame:
    """Runs of missing units that follow each other in the required order."""
    w = Window.partitionBy("dataset_id", "scope_key")
    placed = required.withColumn("pos", F.row_number().over(w.orderBy("unit"))).join(missing, UNIT, "left_semi")
    run = placed.withColumn("island", F.col("pos") - F.row_number().over(w.orderBy("pos")))
    return run.groupBy("dataset_id", "scope_key", "island").agg(F.min("unit").alias("first_unit"), F.max("unit").alias("last_unit"), F.count(F.lit(1)).alias("units")).drop("island")


def merge_intervals(requirements: DataFrame, keys: list[str], more: dict[str, Column] | None = None) -> DataFrame:
    """Overlapping intervals of equal keys as one; a day between two keeps them apart. `more` are aggregates of what is merged."""
    w = Window.partitionBy(*keys).orderBy("start_date", "end_date")
    reach = F.max("end_date").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = requirements.withColumn("_new", F.when(F.col("start_date") <= reach, 0).otherwise(1))
    numbered = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    named = [c.alias(n) for n, c in (more or {}).items()]
    return numbered.groupBy(*keys, "_island").agg(F.min("start_date").alias("start_date"), F.max("end_date").alias("end_date"), *named).drop("_island")


def _union(column: str) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(column))))


def union_requirements(requirements: DataFrame, keys: list[str]) -> DataFrame:
    """One range and one sorted list of fields for each key."""
    return requirements.groupBy(*keys).agg(F.min("start_date").alias("start_date"), F.max("end_date").alias("end_date"), F.array_join(_union("fields"), ",").alias("fields"))


def coalesce_requirements(requirements: DataFrame) -> DataFrame:
    """Requirements (dataset_id, scope_key, kind, start_date, end_date, and arrays fields and reasons, and cutoff)
    of equal dataset, scope, fields and cutoff as one where their intervals overlap, with all reasons."""
    kept = requirements.withColumn("fields", F.array_sort(F.array_distinct("fields")))
    return merge_intervals(kept, ["dataset_id", "scope_key", "kind", "fields", "cutoff"], {"reasons": _union("reasons")})


def merge_snapshots(requirements: DataFrame) -> DataFrame:
    """Snapshot requirements as one for each dataset and scope, over all their fields and reasons and with the
    latest cutoff; others coalesced."""
    shape = ["dataset_id", "scope_key", "kind", "start_date", "end_date", "fields", "cutoff", "reasons"]
    joined = coalesce_requirements(requirements).select(*shape)
    whole = [F.min("start_date").alias("start_date"), F.max("end_date").alias("end_date"), _union("fields").alias("fields"), F.max("cutoff").alias("cutoff"), _union("reasons").alias("reasons")]
    snapshots = joined.where("kind = 'SNAPSHOT'").groupBy("dataset_id", "scope_key", "kind").agg(*whole)
    return joined.where("kind <> 'SNAPSHOT'").unionByName(snapshots)


def missing_ranges(cached: DataFrame, start, end) -> DataFrame:
    """The head and the tail of an asked interval that each cached one (first_date, last_date) leaves open."""
    ends = F.array(
        F.struct(F.lit("head").alias("part"), F.lit(start).alias("start_date"), F.least(F.date_sub("first_date", 1), F.lit(end)).alias("end_date")),
        F.struct(F.lit("tail").alias("part"), F.greatest(F.date_add("last_date", 1), F.lit(start)).alias("start_date"), F.lit(end).alias("end_date")),
    )
    return cached.select("dataset_id", F.explode(ends).alias("r")).select("dataset_id", "r.*").where("start_date <= end_date")


def factor_requirements(metadata: DataFrame, days: DataFrame, formations: DataFrame, scope: str = "ALL") -> DataFrame:
    """What factors need at the formation dates: from each one's look-back before the first to the last, coalesced.

    Fails where the calendar has less history than a look-back, or where there is no formation date.
    """
    ends = formations.agg(F.min("formation_date").alias("formation_date"), F.max("formation_date").alias("last"))
    proven = F.when(F.col("formation_date").isNull(), F.raise_error(F.lit("no formation date")).cast("date")).otherwise(F.col("formation_date"))
    ends = ends.select(proven.alias("formation_date"), "last")
    backs = metadata.select((F.col("lookback") + F.col("lag") + 1).alias("n")).distinct().collect()  # a few look-backs
    windows = None
    for r in backs:
        w = history_window(ends.select("formation_date"), days, "DAYS", r["n"]).withColumn("n", F.lit(r["n"]))
        windows = w if windows is None else windows.unionByName(w)
    need = metadata.select("factor_name", (F.col("lookback") + F.col("lag") + 1).alias("n"), "fields", F.explode("datasets").alias("dataset_id"))
    rows = need.join(F.broadcast(windows.select("n", F.col("first_date").alias("start_date"))), "n").join(F.broadcast(ends.select(F.col("last").alias("end_date"))), F.lit(True))
    reason = F.array(F.concat(F.lit("factor:"), F.col("factor_name")))
    return coalesce_requirements(rows.select("dataset_id", F.lit(scope).alias("scope_key"), F.lit("OPEN_DAYS").alias("kind"), "start_date", "end_date", "fields", reason.alias("reasons"), F.col("end_date").alias("cutoff")))


def unit_facts(rows: DataFrame, fields: list[str]) -> DataFrame:
    """unit, row_count and content_hash: a fingerprint of each unit's rows in any order, from one aggregate."""
    return rows.groupBy("unit").agg(*content_sums(sorted(fields))).select("unit", "row_count", content_hash().alias("content_hash"))


def verified_units(rows: DataFrame, coverage: DataFrame, fields: list[str], version: str) -> DataFrame:
    """Complete units and whether the stored rows still have the recorded count and content, in the right version of the schema."""
    held = unit_facts(rows, fields).select("unit", F.col("row_count").alias("stored"), F.col("content_hash").alias("_hash"))
    out = coverage.where("status = 'COMPLETE'").join(held, "unit", "left").withColumn("stored", F.coalesce("stored", F.lit(0)))
    same = (F.col("row_count") == F.col("stored")) & (F.col("schema_version") == version) & F.col("content_hash").eqNullSafe(F.col("_hash"))
    return out.select(*UNIT, "row_count", "stored", "schema_version", F.coalesce(same, F.lit(False)).alias("verified"))


def derive_coverage(rows: DataFrame, dataset: str, scope: str = "ALL", fields: list[str] | None = None, version: str = "1.0") -> DataFrame:
    """Coverage rows for the units that a table has, with the fingerprint of each one's rows."""
    facts = unit_facts(rows, fields if fields is not None else [c for c in rows.columns if c != "unit"])
    return facts.select(F.lit(dataset).alias("dataset_id"), F.lit(scope).alias("scope_key"), "unit", F.lit("COMPLETE").alias("status"), "row_count", F.lit(version).alias("schema_version"), "content_hash")


def coverage_upsert(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """The last written row of each unit; of equal times the incoming one."""
    both = existing.withColumn("_i", F.lit(0)).unionByName(incoming.withColumn("_i", F.lit(1)))
    return both.withColumn("_n", F.row_number().over(Window.partitionBy(*UNIT).orderBy(F.desc("completed_at"), F.desc("_i")))).where("_n = 1").drop("_n", "_i")


def dataset_status(coverage: DataFrame, datasets: DataFrame) -> DataFrame:
    done = coverage.where("status = 'COMPLETE'").groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"))
    return datasets.join(done, "dataset_id", "left").select("dataset_id", F.coalesce("n", F.lit(0)).alias("complete_units"))
