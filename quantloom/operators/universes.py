"""Point-in-time universes: who was listed, and eligible, on each formation date."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _proven(reference: DataFrame) -> DataFrame:
    """Reference rows; the query fails on one without a list date, or delisted before it was listed."""
    wrong = F.col("list_date").isNull() | F.coalesce(F.col("delist_date") < F.col("list_date"), F.lit(False))
    told = F.raise_error(F.concat_ws(" ", F.lit("list and delist dates prove no lifecycle of"), "ts_code")).cast("date")
    return reference.withColumn("list_date", F.when(wrong, told).otherwise(F.col("list_date")))


def active(reference: DataFrame, formations: DataFrame) -> DataFrame:
    """Reference rows listed on or before a formation date and not delisted by it; dates that prove nothing fail.
    Formation dates are few, so the range join broadcasts them."""
    on = (F.col("list_date") <= F.col("formation_date")) & (F.col("delist_date").isNull() | (F.col("delist_date") > F.col("formation_date")))
    return _proven(reference).join(F.broadcast(formations.select("formation_date").distinct()), on)


def resolve_symbols(symbols: DataFrame, reference: DataFrame) -> DataFrame:
    """(symbol, ts_code, matches): the code where exactly one has the symbol."""
    found = symbols.select("symbol").join(reference.select("symbol", "ts_code"), "symbol", "left").groupBy("symbol").agg(F.count("ts_code").alias("matches"), F.min("ts_code").alias("code"))
    return found.select("symbol", F.when(F.col("matches") == 1, F.col("code")).alias("ts_code"), "matches")


def universe_custom(codes: list[str], reference: DataFrame, formations: DataFrame) -> DataFrame:
    """The listed codes of a given list, with their places in it; a code that the reference lacks, or has twice, fails."""
    listed = reference.sparkSession.createDataFrame(list(enumerate(codes)), "position int, ts_code string")
    known = reference.groupBy("ts_code").agg(F.count(F.lit(1)).alias("rows"))
    found = F.broadcast(listed).join(known, "ts_code", "left")
    told = F.raise_error(F.concat_ws(" ", F.lit("not one reference row of"), "ts_code")).cast("int")
    checked = found.select("ts_code", F.when(F.col("rows") == 1, F.col("position")).otherwise(told).alias("position"))
    rows = checked.join(active(reference.join(F.broadcast(listed.select("ts_code")), "ts_code", "left_semi"), formations), "ts_code", "left")
    return rows.where("position IS NOT NULL AND formation_date IS NOT NULL").select("formation_date", "ts_code", "position")


def universe_index(weights: DataFrame, index_code: str, reference: DataFrame, formations: DataFrame) -> DataFrame:
    """Constituents of the latest snapshot at or before each formation date, that are listed.

    Fails on a formation date without a snapshot, and on a snapshot with a constituent twice, or with one that the
    reference lacks.
    """
    own = weights.where(F.col("index_code") == index_code)
    shots = own.select(F.col("trade_date").alias("snapshot")).distinct()
    dates = formations.select("formation_date").distinct()
    latest = dates.join(shots, F.col("snapshot") <= F.col("formation_date"), "left").groupBy("formation_date").agg(F.max("snapshot").alias("trade_date"))  # tables of dates
    none = F.raise_error(F.concat_ws(" ", F.lit("no index snapshot on or before"), "formation_date")).cast("date")
    latest = latest.withColumn("trade_date", F.coalesce("trade_date", none))
    members = own.join(F.broadcast(latest), "trade_date").groupBy("formation_date", F.col("con_code").alias("ts_code")).agg(F.count(F.lit(1)).alias("rows"))
    known = reference.select("ts_code", F.lit(True).alias("known")).distinct()
    wrong = F.when(F.col("rows") > 1, "constituent twice:").when(F.col("known").isNull(), "constituent without a reference row:")
    told = F.raise_error(F.concat_ws(" ", wrong, "ts_code", "formation_date")).cast("boolean")
    checked = members.join(known, "ts_code", "left").where(F.when(wrong.isNotNull(), told).otherwise(F.lit(True)))
    return checked.join(active(reference, formations).select("formation_date", "ts_code"), ["formation_date", "ts_code"], "left_semi").select("formation_date", "ts_code")


def universe_all(reference: DataFrame, formations: DataFrame, markets: list[str], exchanges: list[str], currencies: list[str], other_markets: list[str] = ()) -> DataFrame:
    """The listed codes of the given markets, exchanges and currencies.

    A market that is neither among `markets` nor `other_markets`, known ones that are left out, fails; a null one is left out.
    """
    told = F.raise_error(F.concat_ws(" ", F.lit("unknown market"), "market", F.lit("of"), "ts_code")).cast("boolean")
    kind = F.when(F.col("market").isin(markets), F.lit(True)).when(F.col("market").isNull() | F.col("market").isin(list(other_markets)), F.lit(False)).otherwise(told)
    kept = reference.where(kind).where(F.col("exchange").isin(exchanges) & F.col("curr_type").isin(currencies))
    return active(kept, formations).select("formation_date", "ts_code")


def schedule(universes: list[DataFrame]) -> DataFrame:
    """(formation_date, ts_code) of several resolved universes, each once."""
    return reduce(lambda a, b: a.unionByName(b), [u.select("formation_date", "ts_code") for u in universes]).distinct()


#: Names of pools from before universes had specifications.
ALIASES = {"HS300": ("INDEX", "000300.SH"), "CSI300": ("INDEX", "000300.SH"), "ALL": ("ALL_A_SHARES", None), "ALL_A_SHARES": ("ALL_A_SHARES", None)}


def universe_from_alias(pool: Column) -> Column:
    """A struct of kind and index code for a pool's name, in any case; a name with a dot is an index; others fail."""
    name = F.upper(F.trim(pool))
    kind, code = F.lit(None).cast("string"), F.lit(None).cast("string")
    for alias, (k, c) in ALIASES.items():
        kind, code = F.when(name == alias, k).otherwise(kind), F.when(name == alias, c).otherwise(code)
    unknown = F.raise_error(F.concat(F.lit("unsupported pool: "), F.coalesce(pool, F.lit("null")))).cast("string")
    listed = name.isin(*ALIASES)
    return F.struct(F.when(listed, kind).when(F.contains(name, F.lit(".")), "INDEX").otherwise(unknown).alias("kind"), F.when(listed, code).otherwise(name).alias("code"))


def period_constituents(weights: DataFrame, start, end) -> DataFrame:
    return weights.where(F.col("trade_date").between(F.lit(start), F.lit(end))).select(F.col("con_code").alias("ts_code")).distinct()


