"""Trading calendars. A calendar has a row for each day, so it is numbered in one window and broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def natural_days(calendar: DataFrame) -> DataFrame:
    """Every day from the calendar's first to its last."""
    return calendar.agg(F.explode(F.sequence(F.min("cal_date"), F.max("cal_date"))).alias("cal_date"))


def calendar_gaps(calendar: DataFrame) -> DataFrame:
    """(cal_date, problem): days that are missing or listed more than once."""
    gaps = natural_days(calendar).join(calendar.select("cal_date"), "cal_date", "left_anti").withColumn("problem", F.lit("missing"))
    twice = calendar.groupBy("cal_date").count().where("count > 1").select("cal_date", F.lit("duplicate").alias("problem"))
    return gaps.unionByName(twice)


def proven(calendar: DataFrame) -> DataFrame:
    """The calendar's rows; the query fails on a missing or repeated day, and on an is_open other than 0 and 1."""
    before = F.lag("cal_date").over(Window.orderBy("cal_date"))
    wrong = F.when(F.datediff("cal_date", before) == 0, "repeated day").when(F.datediff("cal_date", before) > 1, "missing day before").when(F.col("is_open").isNull() | ~F.col("is_open").isin(0, 1), "is_open is neither 0 nor 1 on")
    checked = F.when(wrong.isNull(), F.col("is_open")).otherwise(F.raise_error(F.concat_ws(" ", wrong, "cal_date")).cast("int"))
    return calendar.select("cal_date", checked.alias("is_open"))


def open_dates_from_coverage(calendar: DataFrame, coverage: DataFrame, start, end, fail: bool = True) -> DataFrame:
    """(cal_date, problem): the open days of an interval, each proven by a complete unit of coverage (unit, status) and one row.

    Fails on a natural day that isn't; with `fail` off it is listed with its problem instead.
    """
    asked = calendar.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("cal_date"))
    complete = coverage.where("status = 'COMPLETE'").select(F.to_date("unit").alias("cal_date"), F.lit(True).alias("complete")).distinct()
    rows = calendar.groupBy("cal_date").agg(F.count(F.lit(1)).alias("n"), F.max("is_open").alias("is_open"))
    days = asked.join(complete, "cal_date", "left").join(rows, "cal_date", "left")
    problem = F.when(F.col("complete").isNull(), "unit is not complete").when(F.coalesce("n", F.lit(0)) != 1, "unit is missing or ambiguous")
    if fail:
        problem = F.when(problem.isNotNull(), F.raise_error(F.concat_ws(" ", problem, "cal_date")))
    return days.withColumn("problem", problem).where("problem IS NOT NULL OR is_open = 1").select("cal_date", "problem")


def open_days(calendar: DataFrame) -> DataFrame:
    """(cal_date, pos) of the open days in order."""
    days = calendar.where("is_open = 1").select("cal_date").distinct()
    return days.withColumn("pos", F.row_number().over(Window.orderBy("cal_date")))


def is_trading_day(dates: DataFrame, days: DataFrame, column: str = "cal_date") -> DataFrame:
    known = days.select(F.col("cal_date").alias(column), F.lit(True).alias("_o"))
    return dates.join(F.broadcast(known), column, "left").withColumn("is_trading_day", F.coalesce("_o", F.lit(False))).drop("_o")


def next_trading_day(dates: DataFrame, days: DataFrame, column: str = "cal_date") -> DataFrame:
    """The first open day strictly after each date: a running minimum from the end over dates and open days together."""
    both = dates.select(F.col(column).alias("d"), F.lit(None).cast("date").alias("o"), F.lit(True).alias("asked")).unionByName(days.select(F.col("cal_date").alias("d"), F.col("cal_date").alias("o"), F.lit(False).alias("asked")))
    found = both.withColumn("n", F.datediff("d", F.lit("1970-01-01"))).withColumn("next_trading_day", F.min("o").over(Window.orderBy("n").rangeBetween(1, Window.unboundedFollowing)))
    return found.where("asked").select(F.col("d").alias(column), "next_trading_day")


def shift_open(anchors: DataFrame, days: DataFrame, periods: int, column: str = "cal_date", fail: bool = True) -> DataFrame:
    """The open day `periods` positions after each anchor, which must be open. Fails where there is none, or gives null."""
    at = days.select(F.col("cal_date").alias(column), (F.col("pos") + periods).alias("_p"))
    to = days.select(F.col("pos").alias("_p"), F.col("cal_date").alias("shifted"))
    found = anchors.join(at, column, "left").join(to, "_p", "left")
    told = F.raise_error(F.concat_ws(" ", F.lit(f"no open day {periods} after"), column)).cast("date")
    return found.withColumn("shifted", F.coalesce("shifted", told) if fail else F.col("shifted")).drop("_p")


def formation_dates(days: DataFrame, frequency: str = "MONTHLY") -> DataFrame:
    """All open days, or the last one of each month."""
    if frequency == "DAILY":
        return days.select(F.col("cal_date").alias("formation_date"))
    return days.groupBy(F.trunc("cal_date", "month").alias("m")).agg(F.max("cal_date").alias("formation_date")).select("formation_date")


def formation_dates_checked(calendar: DataFrame) -> DataFrame:
    """The last open day of each month whose every day is in the calendar."""
    month = calendar.groupBy(F.trunc("cal_date", "month").alias("m")).agg(F.max(F.when(F.col("is_open") == 1, F.col("cal_date"))).alias("formation_date"), F.countDistinct("cal_date").alias("n"))
    return month.where((F.col("n") == F.dayofmonth(F.last_day("m"))) & F.col("formation_date").isNotNull()).select("formation_date")


def history_window(formations: DataFrame, days: DataFrame, kind: str, n: int = 1, fail: bool = True) -> DataFrame:
    """(formation_date, first_date, last_date): the last n open days, the open days of the last n calendar months, or the day itself.

    A formation date must be an open day. Fails where the calendar doesn't reach back far enough (for
    months: has no open day in the first of them), or gives a null first_date.
    """
    at = formations.select("formation_date").join(days.select(F.col("cal_date").alias("formation_date"), "pos"), "formation_date", "left")
    if kind == "DAYS":
        first = days.select((F.col("pos") + (n - 1)).alias("pos"), F.col("cal_date").alias("first_date"))
        found = at.join(first, "pos", "left")
    elif kind == "MONTHS":
        first = days.groupBy(F.trunc("cal_date", "month").alias("month")).agg(F.min("cal_date").alias("first_date"))
        found = at.withColumn("month", F.add_months(F.trunc("formation_date", "month"), -(n - 1))).join(first, "month", "left").withColumn("first_date", F.when(F.col("pos").isNotNull(), F.col("first_date")))
    else:
        found = at.withColumn("first_date", F.when(F.col("pos").isNotNull(), F.col("formation_date")))
    told = F.raise_error(F.concat_ws(" ", F.lit("not enough calendar history before"), "formation_date")).cast("date")
    return found.select("formation_date", (F.coalesce("first_date", told) if fail else F.col("first_date")).alias("first_date"), F.col("formation_date").alias("last_date"))


def open_window(formations: DataFrame, days: DataFrame, n: int) -> DataFrame:
    """(formation_date, window_date): the last n open days up to each formation date; fails where there are fewer."""
    at = formations.join(days, F.col("formation_date") == F.col("cal_date")).select("formation_date", F.col("pos").alias("p"))
    short = F.raise_error(F.concat_ws(" ", F.lit("not enough calendar history before"), "formation_date")).cast("int")
    spread = at.select("formation_date", F.explode(F.sequence(F.when(F.col("p") >= n, F.col("p") - n + 1).otherwise(short), F.col("p"))).alias("pos"))
    return spread.join(days, "pos").select("formation_date", F.col("cal_date").alias("window_date"))


def strict_common(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """(date, side): dates that only one side has."""
    a, b = left.select(column).distinct(), right.select(column).distinct()
    return a.exceptAll(b).withColumn("side", F.lit("left_only")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right_only")))


def covered(calendar: DataFrame, start, end) -> DataFrame:
    """One row: natural days asked for, those the calendar lacks, and whether it covers the interval."""
    spark = calendar.sparkSession
    asked = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("cal_date"))
    missing = asked.join(calendar.select("cal_date").distinct().withColumn("_c", F.lit(1)), "cal_date", "left")
    return missing.agg(F.count(F.lit(1)).alias("days"), F.count_if(F.col("_c").isNull()).alias("missing")).withColumn("covered", F.col("missing") == 0)
