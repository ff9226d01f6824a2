"""Hard negatives: for an anchor and each of its positives, the best rows of other labels in a score window.

Rows are ordered by label and by their place on a Hilbert curve through the vectors'
dimensions, cut into blocks, and written as Parquet: a block a row, with the least and greatest
value of every dimension (its zone map) in columns of their own. Interval arithmetic
on a zone map bounds the inner products of an anchor with all members of a block; a block is
read for an anchor only if the bounds meet one of the anchor's windows. A window is first
narrowed by what a few promising blocks hold: the k-th score found there is a lower limit
that drops no row of the result. Bounds and scores are exact integers, so pruning never
changes a result.

Anchors are dealt to pages and blocks to groups, so that a task has one page and one group
at most, of bounded size, whatever rows repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parts_for, stored

SCALE = 256
BLOCK_ROWS, BLOCK_BYTES = 512, 1 << 18  # of a block, at most
GROUP_BLOCKS = 64  # blocks of a group, at most; a page has the anchors of one group
ZONES = 1024  # zone maps that are compared at a time
HOME = 2  # blocks, of each ZONES, that are read first to narrow a window
HILBERT_BITS = 4  # of a dimension, at most
KEY_BITS = 256  # of a place on the curve, if there are no more dimensions
SLICE = 1 << 21  # scores in memory at once
HITS = 1 << 20  # scores inside windows that are held before all but the best go
FAR = (1 << 63) - 1


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The places of lattice points (rows x dimensions, below 2^bits) on a Hilbert curve, as rows of bits.

    Level by level from the highest bit, a dimension's set bit inverts the lower bits of the
    first dimension and a clear one swaps where the two differ; a Gray code of the levels' bits follows.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(n):
            high = (x[i] >> level & 1).astype(bool)
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> level & 1, (1 << level) - 1, 0)
    x ^= turn
    return np.stack([x >> level & 1 for level in range(bits - 1, -1, -1)]).reshape(bits * n, -1).T.astype(np.uint8)


def _unpack(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, "<f8").reshape(-1, dim)


def _pack(x: np.ndarray) -> bytes:
    """Integers in two, four or eight bytes each."""
    most = np.abs(x).max(initial=0)
    return x.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8").tobytes()


def _members(data: bytes, n: int, dim: int, kind: type) -> np.ndarray:
    width = len(data) // (n * dim)
    return np.frombuffer(data, f"<i{width}").reshape(n, dim).astype(kind)


def scaled_vectors(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label (long), vec (of floor(scale * x), float64 bytes) and dim of the rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(2)
            lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = pc.list_flatten(vectors)
            good = flat.is_valid().to_numpy(zero_copy_only=False)
            values = np.nan_to_num(flat.fill_null(0).to_numpy(zero_copy_only=False).astype(float), nan=np.inf, posinf=np.inf, neginf=np.inf)
            good &= np.isfinite(values)
            row = np.repeat(np.arange(len(lengths)), lengths)
            keep = np.bincount(row, ~good, len(lengths)) == 0
            whole = np.floor(np.where(good, values, 0) * scale)
            ends = np.cumsum(lengths)
            vec = [whole[e - n : e].astype("<f8").tobytes() for e, n in zip(ends[keep].tolist(), lengths[keep].tolist(), strict=True)]
            kept = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept), pa.array(vec, pa.binary()), pa.array(lengths[keep], pa.int32())], names=["vec_id", "label", "vec", "dim"])

    rows = embeddings.where("vec_id IS NOT NULL AND label IS NOT NULL AND size(embedding) > 0")
    return rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding").mapInArrow(run, "vec_id long, label long, vec binary, dim int")


def _ranges(rows: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest value of every dimension; a row for each dimension comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo, hi = np.full(dim, np.inf), np.full(dim, -np.inf)
        for batch in batches:
            x = _unpack(b"".join(batch.column(0).to_pylist()), dim)
            lo, hi = np.minimum(lo, x.min(0, initial=np.inf)), np.maximum(hi, x.max(0, initial=-np.inf))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(lo), pa.array(hi)], names=["d", "lo", "hi"])

    found = rows.select("vec").mapInArrow(run, "d long, lo double, hi double").groupBy("d").agg(F.min("lo"), F.max("hi")).orderBy("d").collect()
    return np.array([r[1] for r in found]), np.array([r[2] for r in found])


def zoned_blocks(rows: DataFrame, dim: int, lo: np.ndarray, hi: np.ndarray) -> DataFrame:
    """Stored blocks of rows of one label, along a Hilbert curve: block, label, n, ids, vec, low and high."""
    bits = max(1, min(HILBERT_BITS, KEY_BITS // dim))
    step = np.maximum(hi - lo, 1) / (1 << bits)
    size = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (4 * dim)))

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _unpack(b"".join(batch.column(2).to_pylist()), dim)
                cells = np.minimum((x - lo) / step, (1 << bits) - 1)
                keys = np.packbits(hilbert_keys(cells, bits), axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([k.tobytes() for k in keys], pa.binary())], names=["vec_id", "label", "vec", "key"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth, label, held, count = TaskContext.get().partitionId(), 0, None, [], 0

        def block(n: int) -> pa.RecordBatch:
            nonlocal nth, held, count
            ids, x = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            values = [[part], [nth], [label], [n], [ids[:n]], [_pack(x[:n])], [x[:n].min(0).astype("<f8").tobytes()], [x[:n].max(0).astype("<f8").tobytes()]]
            held, count, nth = [(ids[n:], x[n:])], count - n, nth + 1
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=["part", "nth", "label", "n", "ids", "vec", "low", "high"])

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x = _unpack(b"".join(batch.column(2).to_pylist()), dim)
            edges = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(labels)]
            for a, b in zip(edges, edges[1:], strict=False):
                if count and labels[a] != label:
                    yield block(count)
                if labels[a] != label:
                    label, held, count = int(labels[a]), [], 0
                held.append((ids[a:b], x[a:b]))
                count += b - a
                while count >= size:
                    yield block(size)
        if count:
            yield block(count)

    n = parts_for(rows.sparkSession, rows.count() * dim * 8, 32 << 20)
    order = ["label", "key", "vec_id", "tie"]
    keyed = rows.select("vec_id", "label", "vec").mapInArrow(key, "vec_id long, label long, vec binary, key binary").withColumn("tie", F.monotonically_increasing_id())
    dealt = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).select("vec_id", "label", "vec")
    blocks = stored(dealt.mapInArrow(cut, "part int, nth long, label long, n int, ids array<bigint>, vec binary, low binary, high binary"), "negatives-blocks")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.groupBy("part").agg(F.count(F.lit(1)).alias("of_part")).select("part", F.coalesce(F.sum("of_part").over(before), F.lit(0)).alias("first"))
    return blocks.join(F.broadcast(offsets), "part").withColumn("block", F.col("first") + F.col("nth")).drop("part", "nth", "first")  # a row for each partition


class Search:
    """Blocks of an embedding table, and the reading of those that anchors' windows need."""

    def __init__(self, rows: DataFrame, dim: int):
        lo, hi = _ranges(rows, dim)
        most = int(max(np.abs(lo).max(), np.abs(hi).max()))
        if dim * most * most * 100 >= FAR:
            raise OverflowError("inner products of these vectors don't fit 64-bit integers")
        self.kind = float if dim * most * most < 1 << 53 else np.int64  # doubles are exact, and much faster, below 2^53
        self.dim, self.blocks = dim, zoned_blocks(rows, dim, lo, hi)
        self.zones = stored(self.blocks.select("block", "label", "low", "high"), "negatives-zones")
        count = self.zones.count()
        tiles = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.group = max(1, min(GROUP_BLOCKS, -(-count // int(tiles**0.5 + 1))))
        self.pages, self.zone_pages = -(-count // self.group), -(-count // ZONES)

    def anchors(self, one_in: int) -> DataFrame:
        """page, key (one for each row), vec_id, label and vec of the rows whose id `one_in` divides."""
        dim, group = self.dim, self.group

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, label, n, ids, vec in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    ids = np.array(ids, np.int64)
                    at = np.flatnonzero(ids % one_in == 0)
                    if len(at):
                        x = _members(vec, n, dim, np.int64)[at].astype("<f8")
                        columns = [pa.array(np.full(len(at), block // group)), pa.array(block * BLOCK_ROWS + at), pa.array(ids[at]), pa.array(np.full(len(at), label)), pa.array([v.tobytes() for v in x], pa.binary())]
                        yield pa.RecordBatch.from_arrays(columns, names=["page", "key", "vec_id", "label", "vec"])

        return self.blocks.select("block", "label", "n", "ids", "vec").mapInArrow(run, "page long, key long, vec_id long, label long, vec binary")

    def choose(self, asks: DataFrame, same: bool, home: int | None = None) -> DataFrame:
        """page, block and, as bits in the order of the page's keys, which anchors must read it.

        `asks` has an anchor's columns and its windows, `low` and `high`, one of each for a window. With
        `home`, only so many blocks of each page of zone maps: those of the greatest upper bounds.
        """
        dim, kind = self.dim, self.kind

        def bounds(key, table):
            is_ask = table.column("block").is_null()
            asks, zones = table.filter(is_ask).sort_by("key"), table.filter(pc.invert(is_ask)).sort_by("block")
            need = np.zeros((zones.num_rows, asks.num_rows), bool)
            if asks.num_rows and zones.num_rows:
                z_lo, z_hi = (_unpack(b"".join(zones.column(c).to_pylist()), dim).astype(kind) for c in ("zone_low", "zone_high"))
                x, low, high = _vectors(asks, dim, kind), _windows(asks, "low"), _windows(asks, "high")
                z_label, a_label = zones.column("label").to_numpy(), asks.column("label").to_numpy()
                for i in range(0, asks.num_rows, 1024):
                    a = slice(i, i + 1024)
                    up, down = np.maximum(x[a], 0), np.minimum(x[a], 0)
                    most, least = z_hi @ up.T + z_lo @ down.T, z_lo @ up.T + z_hi @ down.T
                    meets = np.zeros(most.shape, bool)
                    for w in range(low.shape[1]):
                        meets |= (most >= low[a, w]) & (least <= high[a, w]) & (low[a, w] <= high[a, w])
                    meets &= (z_label[:, None] == a_label[None, a]) == same
                    if home is not None and home < len(meets):
                        best = np.argpartition(np.where(meets, -most, np.inf), home - 1, axis=0)[:home]
                        chosen = np.zeros_like(meets)
                        np.put_along_axis(chosen, best, True, axis=0)
                        meets &= chosen
                    need[:, a] = meets
            used = np.flatnonzero(need.any(1))
            bits = [np.packbits(row).tobytes() for row in need[used]]
            return pa.table({"page": pa.array(np.full(len(used), key[0].as_py()), pa.int64()), "block": pa.array(zones.column("block").to_numpy()[used], pa.int64()), "need": pa.array(bits, pa.binary())})

        numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
        left = asks.select("page", numbers(self.zone_pages).alias("zone_page"), "key", "label", "vec", "low", "high")
        right = self.zones.select(numbers(self.pages).alias("page"), F.floor(F.col("block") / ZONES).alias("zone_page"), "block", "label", F.col("low").alias("zone_low"), F.col("high").alias("zone_high"))
        both = left.unionByName(right.join(asks.select("page").distinct(), "page", "left_semi"), allowMissingColumns=True)
        return stored(both.groupBy("page", "zone_page").applyInArrow(bounds, "page long, block long, need binary"), "negatives-visits")

    def read(self, asks: DataFrame, visits: DataFrame, k: int) -> DataFrame:
        """key, window (from 0), place (from 1), vec_id and score: the `k` best of each window in the visited blocks."""
        dim, kind = self.dim, self.kind

        def search(_, table):
            is_ask = table.column("ids").is_null()
            asks, blocks = table.filter(is_ask).sort_by("key"), table.filter(pc.invert(is_ask))
            x, low, high = _vectors(asks, dim, kind), _windows(asks, "low"), _windows(asks, "high")
            own = asks.column("vec_id").to_numpy()
            low_most, high_most = low.min(1, initial=FAR), high.max(1, initial=-FAR)
            hits, count = [], 0
            for n, ids, vec, need in zip(*[blocks.column(c).to_pylist() for c in ("n", "ids", "vec", "need")], strict=True):
                ids, members = np.array(ids, np.int64), _members(vec, n, dim, kind)
                chosen = np.flatnonzero(np.unpackbits(np.frombuffer(need, np.uint8), count=asks.num_rows))
                for i in range(0, len(chosen), step := max(1, SLICE // n)):
                    some = chosen[i : i + step]
                    scores = x[some] @ members.T
                    a, m = np.nonzero((scores >= low_most[some, None]) & (scores <= high_most[some, None]) & (own[some, None] != ids[None, :]))
                    hits.append((some[a], ids[m], scores[a, m].astype(np.int64)))
                    count += len(a)
                    if count > HITS:
                        hits = [_best(hits, low, high, k)[0]]
                        count = len(hits[0][0])
            _, (a, w, ids, scores) = _best(hits, low, high, k)
            return pa.table({"key": asks.column("key").to_numpy()[a], "window": pa.array(w, pa.int32()), "vec_id": ids, "score": scores})

        group = F.floor(F.col("block") / self.group).alias("group")
        tiles = visits.select("page", group).distinct()
        left = asks.join(tiles, "page").select("page", "group", "key", "vec_id", F.col("vec").alias("vec"), "low", "high")
        right = visits.join(self.blocks, "block").select("page", group, "n", "ids", "vec", "need")
        both = left.unionByName(right, allowMissingColumns=True)
        found = both.groupBy("page", "group").applyInArrow(search, "key long, window int, vec_id long, score long")
        best_first = Window.partitionBy("key", "window").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("place", F.row_number().over(best_first)).where(F.col("place") <= k)

    def nearest(self, asks: DataFrame, same: bool, k: int) -> DataFrame:
        """`read` of all blocks that can hold any of the `k` best, which a first reading of few blocks narrows down."""
        first = self.read(asks, self.choose(asks, same, HOME), k)
        limit = first.groupBy("key", "window").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("limit"))
        limits = limit.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("window", "limit"))).alias("limits"))  # an entry for each window
        narrowed = F.transform("low", lambda low, w: F.greatest(low, F.try_element_at("limits", w)))
        asks = stored(asks.join(limits, "key", "left").withColumn("low", narrowed).drop("limits"), "negatives-asks")
        return self.read(asks, self.choose(asks, same), k)


def _vectors(asks: pa.Table, dim: int, kind: type) -> np.ndarray:
    return _unpack(b"".join(asks.column("vec").to_pylist()), dim).astype(kind)


def _windows(asks: pa.Table, name: str) -> np.ndarray:
    """Anchors x windows; an anchor with fewer windows has empty ones."""
    rows = asks.column(name).to_pylist()
    out = np.full((len(rows), max(map(len, rows), default=0)), FAR if name == "low" else -FAR, np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def _best(hits: list, low: np.ndarray, high: np.ndarray, k: int) -> tuple[tuple, tuple]:
    """Of hits (anchor, id, score) the `k` best of each anchor's windows: once each, and with their windows."""
    a, ids, scores = (np.concatenate([h[i] for h in hits]) if hits else np.zeros(0, np.int64) for i in range(3))
    order = np.lexsort((ids, -scores, a))
    a, ids, scores = a[order], ids[order], scores[order]
    first = np.searchsorted(a, a)  # where the anchor's hits begin
    any_, parts = np.zeros(len(a), bool), []
    for w in range(low.shape[1]):
        inside = (scores >= low[a, w]) & (scores <= high[a, w])
        seen = np.cumsum(inside) - inside
        at = np.flatnonzero(inside & (seen - seen[first] < k)) if len(a) else np.zeros(0, np.int64)
        any_[at] = True
        parts.append((a[at], np.full(len(at), w), ids[at], scores[at]))
    of_window = tuple(np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(4))
    return (a[any_], ids[any_], scores[any_]), of_window


def _windowed(asks: DataFrame, windows: DataFrame) -> DataFrame:
    """`asks` with the windows (key, place, low, high) of their keys, in the order of place."""
    listed = windows.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", "low", "high"))).alias("w"))  # a few for each key
    return stored(asks.join(listed, "key").withColumns({"low": F.col("w.low"), "high": F.col("w.high")}).drop("w"), "negatives-asks")


def hard_negatives(embeddings: DataFrame, anchors_one_in: int = 100, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score of `embeddings` (vec_id, embedding, label).

    Anchors are the rows whose id `anchors_one_in` divides; positives, its best rows of the same label;
    negatives, for each positive, the best rows of other labels whose score is from `least` to
    `most` percent of the positive's. Best is largest inner product of floor(scale * x), ties to
    the smaller id. A positive of negative score has an empty window; one of 0 takes scores of 0.

    Rows without an id, a label or a vector, with a null or non-finite component, without
    components or of another length than most take no part. Rows that share an id are rows
    each, but not each other's positives or negatives; as anchors each has a result.
    An empty table has no result; other columns aren't read. Scores whose bound, dimensions times the
    largest square times 100, is beyond 64 bits raise an OverflowError.
    """
    spark = embeddings.sparkSession
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = stored(scaled_vectors(embeddings, scale), "negatives-rows")
    dims = rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    if dims is None:
        return spark.createDataFrame([], result)
    search = Search(rows.where(F.col("dim") == dims["dim"]), dims["dim"])
    anchors = stored(search.anchors(anchors_one_in), "negatives-anchors")
    whole = anchors.withColumns({"low": F.array(F.lit(-FAR)), "high": F.array(F.lit(FAR))})
    found = stored(search.nearest(whole, True, positives).select("key", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")
    # from the least whole score of the window to the greatest
    windows = found.where("positive_score >= 0").select("key", "place", F.expr(f"(positive_score * {least} + 99) div 100").alias("low"), F.expr(f"(positive_score * {most}) div 100").alias("high"))
    # windows of an anchor are in the order of its positives, whose places go down without gaps as scores do
    best = search.nearest(_windowed(anchors, windows), False, negatives)
    named = anchors.select("key", F.col("vec_id").alias("anchor_id"))
    ranked = best.select("key", (F.col("window") + 1).alias("of"), F.col("place").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    joined = ranked.join(found.withColumnRenamed("place", "of"), ["key", "of"]).join(named, "key")
    return joined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return hard_negatives(rows.select("vec_id", "embedding", label.alias("label")))


OP11_SQL = """
WITH valid AS (
    SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scores AS (
    SELECT a.r, a.vec_id AS anchor_id, b.r AS s, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
    FROM valid a JOIN valid b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
),
positives AS (
    SELECT r, anchor_id, s AS p, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
    QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) <= 5
),
ranked AS (
    SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY r, p ORDER BY score DESC, vec_id) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
    FROM positives JOIN scores USING (r, anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
"""
