"""Normalization and quality rules. Rules are counted together in one pass over a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.math import number

KEYS = ["trade_date", "ts_code"]
#: Fixed value: a tradable code.
CODE_FORM = r"^[0-9]{6}\.(SH|SZ|BJ)$"


def canonical_date(c: Column) -> Column:
    """A date from YYYYMMDD or YYYY-MM-DD, else null."""
    text = F.trim(c.cast("string"))
    return F.when(text.rlike(r"^\d{8}$"), F.try_to_date(text, "yyyyMMdd")).when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def count_rules(frame: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations): how many rows meet each condition; null counts as not."""
    counted = frame.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])
    return counted.unpivot([], list(rules), "rule", "violations")


def normalize_canonical(frame: DataFrame, dates: list[str], numbers: list[str], keys: list[str]) -> DataFrame:
    """Declared fields only, cast; exact duplicates once; `problem` names a bad cast, a null key or a key with other values."""
    cast = {c: canonical_date(F.col(c)) for c in dates} | {c: F.try_cast(F.col(c), "double") if hasattr(F, "try_cast") else F.col(c).try_cast("double") for c in numbers}
    lost = [F.col(c).isNotNull() & x.isNull() for c, x in cast.items()]
    bad = lost[0]
    for x in lost[1:]:
        bad = bad | x
    others = [c for c in keys if c not in cast]
    out = frame.select(*others, *[x.alias(c) for c, x in cast.items()], bad.alias("_bad")).dropDuplicates()
    null_key = F.lit(False)
    for k in keys:
        null_key = null_key | F.col(k).isNull()
    same = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    problem = F.when(F.col("_bad"), "bad cast").when(null_key, "null key").when(same > 1, "conflicting key")
    return out.withColumn("problem", problem).drop("_bad")


def normalize_keys(frame: DataFrame, code: str = "ts_code", date: str = "trade_date") -> DataFrame:
    """Trimmed codes and dates, with the number of rows that share a key."""
    out = frame.withColumn(code, F.trim(code)).withColumn(date, canonical_date(F.col(date)))
    return out.withColumn("key_rows", F.count(F.lit(1)).over(Window.partitionBy(code, date)))


def require_fields(frame: DataFrame, fields: list[str]) -> DataFrame:
    """`frame` if it has the fields, else an error that names the missing ones."""
    missing = [f for f in fields if f not in frame.columns]
    if missing:
        raise ValueError(f"missing fields: {missing}")
    return frame


def canonical_upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], fillable: tuple[str, ...] = ()) -> DataFrame:
    """Insert-only merge on the keys: equal overlap stays, a null of a fillable field is filled, other changes are named in `conflict`."""
    values = [c for c in existing.columns if c not in keys]
    old = existing.select(*keys, F.struct(*values).alias("_old"))
    new = incoming.select(*keys, F.struct(*values).alias("_new"))
    joined = old.join(new, keys, "full")
    both = F.col("_old").isNotNull() & F.col("_new").isNotNull()
    clash = F.lit(False)
    columns = []
    for c in values:
        a, b = F.col(f"_old.{c}"), F.col(f"_new.{c}")
        changed = ~a.eqNullSafe(b)
        clash = clash | (both & (changed & a.isNotNull() if c in fillable else changed))
        columns.append((F.when(F.col("_old").isNull(), b).otherwise(F.coalesce(a, b)) if c in fillable else F.when(F.col("_old").isNull(), b).otherwise(a)).alias(c))
    return joined.select(*keys, *columns, clash.alias("conflict"))


def priority_dedup(frames: dict[str, DataFrame], key: str = "ts_code") -> DataFrame:
    """One row for each key out of several pulls, from the first pull (in the order given) that has it."""
    pulls = [f.withColumn("list_status", F.lit(s)).withColumn("_p", F.lit(i)) for i, (s, f) in enumerate(frames.items())]
    out = pulls[0]
    for p in pulls[1:]:
        out = out.unionByName(p)
    return out.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_p"))).where("_n = 1").drop("_n", "_p")


def quality_rules(bars: DataFrame, row_limit: int = 1_000_000) -> DataFrame:
    """Violations of the price, volume, factor and code rules, and whether the row limit is passed.

    The high must not be below open, close or low, nor the low above open, close or high; a null price
    takes no part, and so does a null or NaN volume, amount or factor.
    """
    c = {n: number(F.col(n)) for n in ("open", "high", "low", "close", "vol", "amount", "adj_factor")}
    counted = count_rules(
        bars,
        {
            "high_below_others": c["high"] < F.greatest(c["open"], c["close"], c["low"]),
            "low_above_others": c["low"] > F.least(c["open"], c["close"], c["high"]),
            "negative_volume": c["vol"] < 0,
            "negative_amount": c["amount"] < 0,
            "factor_not_positive": c["adj_factor"] <= 0,
            "bad_code": bad_code(F.col("ts_code")),
        },
    )
    over = bars.agg((F.count(F.lit(1)) > row_limit).cast("long").alias("violations")).select(F.lit("row_limit").alias("rule"), "violations")
    return counted.unionByName(over)


def bad_code(c: Column) -> Column:
    return c.isNull() | ~c.rlike(CODE_FORM)


# Classes of identifiers and the rules that put them there.
TRADABLE, LEGACY, INVALID = "CANONICAL_TRADABLE", "LEGACY_REFERENCE", "INVALID"
CANONICAL_RULE = "TS_CODE_6_DIGIT_CN_EXCHANGE_SUFFIX"
LEGACY_RULE = "LEGACY_REFERENCE_OUTSIDE_REQUIRED_INTERVAL"
UNSUPPORTED_RULE = "UNSUPPORTED_LEGACY_SECURITY_IDENTIFIER"
UNPROVEN_RULE = "NONCANONICAL_REFERENCE_IDENTITY_UNPROVEN"


def classify_identifier(reference: DataFrame, start=None, end=None) -> DataFrame:
    """identifier_class and rule_id of each reference row (ts_code, list_status, list_date, delist_date) for an interval.

    A code of another form is legacy only if its row is a delisted one whose two dates, in order, lie
    outside the interval; inside, it has no known mapping; without that proof, or without an
    interval, it is invalid.
    """
    proven = (F.col("list_status") == "D") & (F.col("list_date") <= F.col("delist_date")) & F.lit(start is not None and end is not None)
    outside = (F.col("delist_date") <= F.lit(start)) | (F.col("list_date") > F.lit(end))
    rule = F.when(~bad_code(F.col("ts_code")), CANONICAL_RULE).when(proven & outside, LEGACY_RULE).when(proven, UNSUPPORTED_RULE).otherwise(UNPROVEN_RULE)
    classed = reference.withColumn("rule_id", rule)
    return classed.withColumn("identifier_class", F.when(F.col("rule_id") == CANONICAL_RULE, TRADABLE).when(F.col("rule_id") == LEGACY_RULE, LEGACY).otherwise(INVALID))


def tradable_reference(reference: DataFrame, start, end) -> DataFrame:
    """The rows with tradable codes; legacy ones are dropped, and one that can't be mapped fails the query."""
    told = F.concat_ws(" ", F.col("ts_code"), F.lit(f"cannot be mapped for {start} through {end}:"), F.col("rule_id"))
    kept = F.when(F.col("identifier_class") == INVALID, F.raise_error(told).cast("boolean")).otherwise(F.col("identifier_class") == TRADABLE)
    return classify_identifier(reference, start, end).where(kept).drop("identifier_class", "rule_id")


def identifier_evidence(classified: DataFrame, samples: int = 20, buckets: int = 64) -> DataFrame:
    """Rows of each class and rule, and the smallest `samples` codes of the non-canonical ones among them.

    The samples are taken in two steps: of each class and hash bucket of codes the smallest, from
    windows that Spark cuts to `samples` rows before it deals them, then of these the smallest.
    """
    counts = classified.groupBy("identifier_class", "rule_id").agg(F.count(F.lit(1)).alias("rows"))
    code = F.coalesce("ts_code", F.lit(""))
    others = classified.where(F.col("identifier_class") != TRADABLE).select("identifier_class", "rule_id", code.alias("ts_code"))
    dealt = others.withColumn("bucket", F.pmod(F.xxhash64("ts_code"), F.lit(buckets)))
    first = Window.partitionBy("identifier_class", "rule_id", "bucket").orderBy("ts_code")
    some = dealt.withColumn("n", F.row_number().over(first)).where(F.col("n") <= samples)
    listed = some.groupBy("identifier_class", "rule_id").agg(F.array_join(F.slice(F.array_sort(F.collect_list("ts_code")), 1, samples), ",").alias("samples"))  # of `buckets` times `samples` rows at most
    return counts.join(listed, ["identifier_class", "rule_id"], "left").withColumn("samples", F.coalesce("samples", F.lit("")))


def bounded_samples(frame: DataFrame, columns: list[str], most: int = 20) -> DataFrame:
    return frame.select(*columns).dropDuplicates().orderBy(*columns).limit(most)


def content(columns: list[str]) -> Column:
    """A text that differs wherever a value does: each as its length, a colon and the value, null as a hyphen."""
    text = [F.col(c).cast("string") for c in columns]
    return F.concat(F.lit(""), *[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text])


def content_sums(columns: list[str]) -> list[Column]:
    """A count, and the sums of the first and the next 60 bits of each row's MD5: a fingerprint of rows in any order, as a partial aggregate."""
    row = F.md5(content(columns).cast("binary"))
    bits = lambda at: F.sum(F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(20,0)"))
    return [F.count(F.lit(1)).alias("row_count"), bits(1).alias("_first"), bits(16).alias("_next")]


def content_hash() -> Column:
    """The fingerprint of `content_sums` as text."""
    return F.sha2(F.concat_ws(":", "row_count", "_first", "_next").cast("binary"), 256)


def differing_ranges(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str], ranges: int = 1024) -> tuple[DataFrame, DataFrame]:
    """The rows of both sides in those of `ranges` hash ranges of keys whose fingerprints differ.

    Equal content has equal fingerprints; numbers that differ within a tolerance, or are written in
    different ways, still have two, so that their range is kept.
    """
    at = F.pmod(F.xxhash64(*keys), F.lit(ranges)).alias("_range")
    kinds, used = dict(left.dtypes), [*keys, *fields]
    plain = [number(F.col(c)).alias(c) if kinds[c] in ("float", "double") else F.col(c) for c in used]
    a, b = (side.select(at, *plain).groupBy("_range").agg(*content_sums(used)).select("_range", content_hash().alias("_hash")) for side in (left, right))
    both = a.join(b.withColumnRenamed("_hash", "_other"), "_range", "full")
    found = F.broadcast(both.where(~F.col("_hash").eqNullSafe(F.col("_other"))).select("_range"))  # `ranges` rows at most
    pruned = [side.select(at, *used).join(found, "_range", "left_semi").drop("_range") for side in (left, right)]
    return pruned[0], pruned[1]


def compare_tables(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str], tolerance: float = 1e-8, ranges: int = 1024) -> DataFrame:
    """(keys, field, difference): keys that one side lacks, and values that differ, numbers by more than the tolerance.

    Null and NaN are the same, text and other values must be equal. Only rows of differing ranges are
    joined, so that of equal tables none is.
    """
    kinds = dict(left.dtypes)
    some, others = differing_ranges(left, right, keys, fields, ranges)
    a = some.select(*keys, F.lit(True).alias("_l"), *[F.col(f).alias(f"{f}_l") for f in fields])
    b = others.select(*keys, F.lit(True).alias("_r"), *[F.col(f).alias(f"{f}_r") for f in fields])
    joined = a.join(b, keys, "full")
    missing = F.when(F.col("_r").isNull(), F.array(F.struct(F.lit("*").alias("field"), F.lit("left_only").alias("difference")))).when(F.col("_l").isNull(), F.array(F.struct(F.lit("*").alias("field"), F.lit("right_only").alias("difference"))))
    cells = []
    for f in fields:
        x, y = F.col(f"{f}_l"), F.col(f"{f}_r")
        if kinds[f] in ("float", "double", "int", "bigint", "smallint", "tinyint") or kinds[f].startswith("decimal"):
            x, y = number(x), number(y)
            differs = (x.isNull() != y.isNull()) | F.coalesce((F.abs(x - y) > tolerance) | ((F.abs(x) == float("inf")) & (x != y)), F.lit(False))
        else:
            differs = ~x.eqNullSafe(y)
        cells.append(F.when(differs, F.struct(F.lit(f).alias("field"), F.lit("value").alias("difference"))))
    found = F.coalesce(missing, F.filter(F.array(*cells), lambda c: c.isNotNull()))
    return joined.select(*keys, F.explode(found).alias("_d")).select(*keys, "_d.field", "_d.difference")


def completeness(units: DataFrame, expected: DataFrame, unit: str = "unit", scope: dict[str, str] | None = None) -> DataFrame:
    """(unit, problem): expected units that are missing, units that nobody asked for, and units with a row of another scope.

    `scope` gives columns and the value that each row must have there.
    """
    have, want = units.select(unit).distinct(), expected.select(unit).distinct()
    gone = want.join(have, unit, "left_anti").withColumn("problem", F.lit("missing"))
    found = gone.unionByName(have.join(want, unit, "left_anti").withColumn("problem", F.lit("unexpected")))
    for column, value in (scope or {}).items():
        other = units.where(~F.col(column).eqNullSafe(F.lit(value))).select(unit).distinct()
        found = found.unionByName(other.withColumn("problem", F.lit(f"other {column}")))
    return found


def nonempty_within(frame: DataFrame, group: list[str], limit: int, asked: DataFrame | None = None) -> DataFrame:
    """Rows of each pull, and whether it may count as complete: not empty and below the provider's limit.

    `asked` has the groups that were pulled, so that one without rows is reported as well.
    """
    out = frame.groupBy(*group).agg(F.count(F.lit(1)).alias("rows"))
    if asked is not None:
        out = asked.select(*group).distinct().join(out, group, "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    return out.withColumn("complete", (F.col("rows") > 0) & (F.col("rows") < limit))


_BLANK = r"^[\s\p{Z}\x1c-\x1f]+|[\s\p{Z}\x1c-\x1f]+$"


def normalize_query(c: Column) -> Column:
    """Trimmed at both ends, wide spaces as plain ones, upper case; null is empty."""
    return F.upper(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "\u3000", " "), _BLANK, ""))


def normalize_code(c: Column) -> Column:
    """A normalized query with an exchange suffix for six digits that begin with 6, 0 or 3; others as they are."""
    q = normalize_query(c)
    return F.when(q.rlike(r"^6\d{5}$"), F.concat(q, F.lit(".SH"))).when(q.rlike(r"^[03]\d{5}$"), F.concat(q, F.lit(".SZ"))).otherwise(q)


def security_lookup(first: DataFrame, second: DataFrame, order: str | None = None) -> DataFrame:
    """One (ts_code, name, industry) for each normalized code: its first row, of the first table that has it.

    `order` names the column that tells which of a table's rows is first; without it the rows that share a
    code should be alike. A missing name or industry column is null.
    """
    both = first.withColumn("_p", F.lit(0)).unionByName(second.withColumn("_p", F.lit(1)), allowMissingColumns=True)
    place = F.row_number().over(Window.partitionBy("ts_code").orderBy("_p", *([order] if order else [])))
    rows = both.where("ts_code IS NOT NULL").withColumn("ts_code", normalize_code(F.col("ts_code")))
    return rows.withColumn("_n", place).where("_n = 1").select("ts_code", "name", "industry")


def search_security(lookup: DataFrame, query: str) -> DataFrame:
    """Rows whose code is the normalized query, or whose first six characters are, or whose name holds it; a blank query finds none."""
    q = query.replace("\u3000", " ").strip().upper()
    code = F.upper("ts_code")
    found = (code == normalize_code(F.lit(q))) | (F.substring(code, 1, 6) == q) | F.contains(F.upper(F.coalesce("name", F.lit(""))), F.lit(q))
    return lookup.where(found & F.lit(q != "")).select("ts_code", "name", "industry")


def normalize_financial(records: DataFrame) -> DataFrame:
    """Trimmed codes, parsed dates, and how many records share (code, announcement, period)."""
    out = records.select(F.trim("ts_code").alias("ts_code"), canonical_date(F.col("ann_date")).alias("ann_date"), canonical_date(F.col("end_date")).alias("end_date"), "value")
    return out.withColumn("key_rows", F.count(F.lit(1)).over(Window.partitionBy("ts_code", "ann_date", "end_date")))


def finite_positive(frame: DataFrame, columns: list[str], positive: bool = True) -> DataFrame:
    """(rule, violations) of columns that must be finite, and positive."""
    rules = {}
    for c in columns:
        x = F.col(c)
        bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
        rules[c] = bad | (x <= 0) if positive else bad
    return count_rules(frame, rules)
