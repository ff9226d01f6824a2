"""Mixing sources to target weights by entropy balancing.

Of all document rates r the one nearest to 1 in relative entropy is sought that gives
every source its target of tokens: minimise sum(r log r - r) with sum(size * r) = target
and 0 <= r <= 3 in each source. Its convex dual has one multiplier for each source, and
r = min(3, exp(lambda * size)): documents are tilted exponentially by their size. The
multipliers are found by Newton steps, kept inside a bracket; every step is a grouped
sum over a table of (source, size, documents), in which all equal sizes are one row.

Rates become whole copies by systematic rounding: along a cell's documents the running
sum of rates is rounded, so a cell's copies stay within one of their expectation. Cells
are hashed parts of a source, of a bounded number of documents.
"""

from __future__ import annotations

import json
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, stored

WEIGHTS = (1, 2, 3)
LIMIT = 3.0
CELL_DOCS = 1000
STEPS = 40  # Newton steps; what hasn't converged by then is bisected
HALVINGS = 200  # no bracket of doubles has more
TOLERANCE = 1e-7


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, limit: float = LIMIT) -> DataFrame:
    """source, source_size, target: shares of all tokens by weight, none above `limit` times its source.

    `sizes` has a row for each source (source, source_size). Sources come by code point, null
    last, and take the weights in turn. Filling up is settled in one pass: in ascending order
    of limit * size / weight, a source is full as long as its limit is not above what its
    weight gives it of what the full ones before it leave.
    """
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    listed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int")))
    cap = F.lit(float(limit)) * F.col("source_size")
    fill = Window.orderBy((cap / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    listed = listed.withColumns(
        {
            "all_size": F.sum("source_size").over(everything).cast("double"),
            "left_size": F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0.0)),
            "left_weight": F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    listed = listed.withColumn("full", cap * F.col("left_weight") <= F.col("left_size") * F.col("weight"))
    rest = F.sum(F.when(F.col("full"), cap).otherwise(0.0)).over(everything)
    open_weight = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(everything)
    share = F.when(F.col("full"), cap).otherwise((F.col("all_size") - rest) * F.col("weight") / F.when(open_weight > 0, open_weight))
    return listed.select("source", "source_size", F.least(share, cap).alias("target"))


def tilt(lam: Column, size: Column, limit: float) -> Column:
    """min(limit, exp(lambda * size)) without overflow."""
    return F.exp(F.least(lam * size, F.log(F.lit(float(limit)))))


def _table(spark, counts: DataFrame, rows: list[tuple]) -> DataFrame:
    """The multipliers (of, lam), a row for each source, as an inline table."""
    kind = counts.schema["source"].dataType.simpleString()
    listed = json.dumps([{"of": s, "lam": lam} for s, lam in rows])
    return spark.sql(f"SELECT inline(from_json(:rows, 'array<struct<of:{kind},lam:double>>'))", args={"rows": listed})


def solve(counts: DataFrame, goals: DataFrame, limit: float = LIMIT, steps: int = STEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """`goals` with the multiplier `lam` of every source; null where every rate is the limit.

    `counts` (source, size, docs) should be stored: each Newton step aggregates it once. Only
    one row for each source travels between steps. Steps end when each source's tokens are
    within `tolerance` of the target, or its bracket holds no other double; after `steps` of
    them brackets are halved, and a source that doesn't converge then fails.
    """
    spark = counts.sparkSession
    rows = [r.asDict() for r in goals.collect()]  # a row for each source
    state = {}
    for r in rows:
        full = r["target"] >= limit * r["source_size"]
        state[r["source"]] = {"lam": 0.0, "lo": None, "hi": None, "done": full or r["target"] <= 0, "full": full, "target": r["target"]}
    span = {r["source"]: r for r in counts.where("size > 0").groupBy("source").agg(F.min("size").alias("least"), F.max("size").alias("most")).collect()}
    for turn in count():
        todo = [(s, x["lam"]) for s, x in state.items() if not x["done"]]
        if not todo:
            break
        if turn >= steps + HALVINGS:
            raise ValueError(f"no multiplier found for the sources {[s for s, _ in todo]}")
        current = _table(spark, counts, todo)
        size, rate = F.col("size").cast("double"), tilt(F.col("lam"), F.col("size").cast("double"), limit)
        inside = F.col("lam") * size < F.log(F.lit(float(limit)))
        sums = (
            counts.join(F.broadcast(current), F.col("source").eqNullSafe(F.col("of")))
            .groupBy("source")
            .agg(F.sum(F.col("docs") * size * rate).alias("tokens"), F.sum(F.when(inside, F.col("docs") * size * size * rate).otherwise(0.0)).alias("slope"))
        )
        for r in sums.collect():
            x, gap = state[r["source"]], r["tokens"] - state[r["source"]]["target"]
            if abs(gap) <= tolerance * x["target"]:
                x["done"] = True
                continue
            x["hi" if gap > 0 else "lo"] = x["lam"]
            step = x["lam"] - gap / r["slope"] if r["slope"] > 0 else None
            lo, hi, least = x["lo"], x["hi"], span[r["source"]]["least"]
            if lo is not None and hi is not None:
                newton = turn < steps and step is not None and lo < step < hi
                x["lam"] = step if newton else (lo + hi) / 2
                x["done"] = not newton and x["lam"] in (lo, hi)
            else:  # no bracket yet: a Newton step, at most twice as far as the last
                far = max(abs(x["lam"]) * 2, 1.0 / max(span[r["source"]]["most"], 1), 1e-12)
                move = abs(step - x["lam"]) if step is not None else far
                x["lam"] += (-1 if gap > 0 else 1) * max(min(move, far), 1e-15)
                if x["lam"] * least > 50:
                    x["full"] = x["done"] = True
    found = [(s, None if x["full"] else x["lam"]) for s, x in state.items()]
    lams = _table(spark, counts, found)
    return goals.join(F.broadcast(lams), F.col("source").eqNullSafe(F.col("of")), "left").drop("of")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, limit: float = LIMIT, cell_docs: int = CELL_DOCS, text: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, rate and copies (0 to ceil(limit)) of every row; with
    `text` also the row itself as a struct column `doc`.

    A null or empty text has size 0 and one copy, which adds no tokens; a null source is a
    source; repeated rows are told apart only by their order, and may get different copies;
    a table without tokens keeps every row once. Columns beside doc_id, text and source
    aren't read, and come back in `doc` only. The number of sources must fit the driver; a
    source may be of any size. The sizes and multipliers are the only passes over the texts.
    """
    kept = {"doc": F.struct("*")} if text else {}
    sized = docs.select("doc_id", "source", n_tokens(F.col("text")).alias("size"), *[v.alias(k) for k, v in kept.items()])
    if not text:
        sized = stored(sized, "mix-documents")
    counts = stored(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("docs")), "mix-sizes")
    per_source = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size"), F.sum("docs").alias("source_docs"))
    goals = stored(targets(per_source.drop("source_docs"), weights, limit), "mix-targets")
    solved = solve(counts, goals, limit).join(per_source.select(F.col("source").alias("of"), "source_docs"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    facts = solved.withColumnRenamed("source", "of")
    rated = sized.join(F.broadcast(facts), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("lam").isNull(), float(limit)).otherwise(tilt(F.col("lam"), F.col("size").cast("double"), limit))
    cell = F.pmod(F.xxhash64("doc_id", "size"), F.ceil(F.col("source_docs") / cell_docs))
    rated = rated.withColumns({"rate": rate, "cell": cell})
    along = Window.partitionBy("source", "cell").orderBy(F.col("size").desc(), F.xxhash64("doc_id"), "doc_id")
    begin = F.pmod(F.xxhash64("source", "cell"), F.lit(1_000_003)) / 1_000_003.0
    upto = F.sum("rate").over(along.rowsBetween(Window.unboundedPreceding, 0)) + begin
    before = F.coalesce(F.sum("rate").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) + begin
    copies = F.when(F.col("size") == 0, 1).when(F.col("lam").isNull(), int(limit)).otherwise(F.floor(upto + 1e-9) - F.floor(before + 1e-9))
    return rated.select("doc_id", "source", "size", "source_size", "target", "rate", F.least(copies, F.lit(int(limit))).cast("int").alias("copies"), *kept)


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, limit: float = LIMIT) -> DataFrame:
    """The rows of the mix, each as often as its copies say, with the columns of `docs`. Nulls, repeated
    rows and an empty table are as in `mix`; a document without words stays once."""
    mixed = mix(docs, weights, limit, text=True)
    n = fresh(docs, "copy")
    return mixed.where("copies > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias(n)).select("doc.*")


def op10_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
