"""Approximate nearest neighbours by largest inner product.

An inverted file of coarse centroids, whose members are kept as product-quantised residuals
beside their original vectors. A query visits its best lists; there, tables of its inner
products with the residual codes' centroids score all members, and the best of each block
are ranked again by the exact inner product. Lists, and the queries that visit them, are
split into blocks of bounded size, so a hot list is dealt over many tasks.

No member of a list has a larger inner product with q than q * centre + |q| * radius, the
radius being the largest residual in the list. Once a query's best lists have given it k
scores, lists whose bound is below the k-th aren't visited; nothing is lost by that. The
same bound on a member's quantisation error tells which members a guess can't rule out, so
that a search can also be exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SAMPLE_ROWS = 16_384  # centroids are fitted on so many vectors at most: those of smallest id hash
MOST_LISTS = 4096
CODE_WORDS = 64
SUBSPACE = 2  # dimensions that share a code
ITERATIONS = 8
BLOCK = 256
MOST_ROWS = 1 << 15  # a task's members, and its queries, at most on average
SCORES = 1 << 22  # guessed products in memory at once
RERANK = 60
HOME = 8  # lists of a query that are searched first
SLACK = 1e-9  # of rounding in bounds, relative to the lengths of the vectors
VISITED = 0.85  # share of the lists that a query visits, 16 of them at least; vectors with clusters need far fewer


def _kmeans(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = x[np.sort(rng.choice(len(x), k, replace=False))].astype(float)
    for _ in range(ITERATIONS):
        at = _nearest(x, centers)
        count = np.bincount(at, minlength=k)
        sums = np.stack([np.bincount(at, c, k) for c in x.T], 1)
        centers = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centers)
    return centers


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    half = (centers**2).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + 2048] @ centers.T - half, 1) for i in range(0, len(x), 2048)] or [np.zeros(0, np.int64)])


@dataclass
class InvertedFile:
    dim: int
    centers: np.ndarray  # lists x dim
    books: list[np.ndarray]  # for each subspace, words x its dimensions

    def parts(self) -> list[slice]:
        return [slice(i, min(i + SUBSPACE, self.dim)) for i in range(0, self.dim, SUBSPACE)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = _nearest(x, self.centers)
        rest = x - self.centers[at]
        return at, np.stack([_nearest(rest[:, s], b) for s, b in zip(self.parts(), self.books, strict=True)], 1).astype(np.uint8)

    def residuals(self, x: np.ndarray, at: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lengths of the vectors' residuals, and of what the codes leave of them, with room for rounding."""
        rest = x - self.centers[at]
        kept = np.concatenate([b[codes[:, j]] for j, b in enumerate(self.books)], 1)
        far, lost = np.linalg.norm(rest, axis=1), np.linalg.norm(rest - kept, axis=1)
        room = SLACK * (np.linalg.norm(self.centers, axis=1)[at] + far)
        return far + room, lost + room

    def reachable(self, queries: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """The largest inner product that a member of each list can have: queries x lists."""
        return queries @ self.centers.T + np.linalg.norm(queries, axis=1)[:, None] * radius[None, :]

    def approximate(self, queries: np.ndarray, which: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances (inner products): queries x members of list `which`."""
        out = np.repeat((queries @ self.centers[which])[:, None], len(codes), 1)
        for j, (s, b) in enumerate(zip(self.parts(), self.books, strict=True)):
            out += (queries[:, s] @ b.T)[:, codes[:, j]]
        return out


def fit(x: np.ndarray, lists: int) -> InvertedFile:
    x = np.unique(x, axis=0)  # copies would take several lists
    centers = _kmeans(x, min(lists, len(x)), 1)
    rest = x - centers[_nearest(x, centers)]
    books = [_kmeans(rest[:, i : i + SUBSPACE], min(CODE_WORDS, len(x)), 2 + i) for i in range(0, x.shape[1], SUBSPACE)]
    return InvertedFile(x.shape[1], centers, books)


def _valid(column: pa.Array) -> np.ndarray:
    """Which vectors are neither null nor zero and hold finite components only."""
    n = len(column)
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(column)
    good = flat.is_valid().to_numpy(zero_copy_only=False)
    values = np.nan_to_num(flat.fill_null(0).to_numpy(zero_copy_only=False).astype(float), nan=np.inf, posinf=np.inf, neginf=np.inf)
    row = np.repeat(np.arange(n), lengths)
    bad = np.bincount(row, ~(good & np.isfinite(values)), n)[:n]
    nonzero = np.bincount(row, values != 0, n)[:n]
    return (bad == 0) & (nonzero > 0)


def valid_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, vec (float64 bytes) and dim of the vectors that take part."""
    kind = embeddings.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array(_valid(batch.column(1)))
            ids, vectors = batch.column(0).filter(keep), batch.column(1).filter(keep)
            lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = pc.list_flatten(vectors).to_numpy(zero_copy_only=False).astype("<f8")
            ends = np.cumsum(lengths)
            rows = [flat[e - n : e].tobytes() for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(rows, pa.binary()), pa.array(lengths, pa.int32())], names=["vec_id", "vec", "dim"])

    # rows without an id can't be named in a result
    return embeddings.where("vec_id IS NOT NULL").select("vec_id", "embedding").mapInArrow(run, f"vec_id {kind}, vec binary, dim int")


def _matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, dim)


def _reaching(q: np.ndarray, x: np.ndarray, guess: np.ndarray, lost: np.ndarray, bound: np.ndarray, k: int, rerank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in q, place in x, inner product) of all pairs that can be among a query's `k` best of x and aren't below its bound.

    A pair without a guess (minus infinity) is none. Where nothing bounds a query yet, the k-th product of its
    `rerank` best guesses does. What a guess and what its code lost can't bring up to the bound is not ranked.
    """
    length, floor, n = np.linalg.norm(q, axis=1), bound.copy(), min(max(rerank, k), len(x))
    room = SLACK * length * np.linalg.norm(x, axis=1).max()
    unbounded = np.flatnonzero(np.isneginf(bound)) if len(x) >= k else np.zeros(0, np.int64)
    for i in range(0, len(unbounded), step := max(1, SCORES // (n * x.shape[1]))):
        part = unbounded[i : i + step]
        first = np.argpartition(-guess[part], n - 1, 1)[:, :n]
        score = np.where(np.take_along_axis(guess[part], first, 1) > -np.inf, np.einsum("qnd,qd->qn", x[first], q[part]), -np.inf)
        floor[part] = np.partition(score, n - k, 1)[:, n - k]
    least = (floor - room)[:, None]
    keep = (guess > -np.inf) & (guess + length[:, None] * lost >= least)
    some = np.flatnonzero(keep.any(0))
    at, row = np.nonzero(keep[:, some] & (q @ x[some].T >= least))
    row = some[row]
    step = max(1, SCORES // x.shape[1])
    score = np.concatenate([(x[row[i : i + step]] * q[at[i : i + step]]).sum(1) for i in range(0, len(at), step)] or [np.zeros(0)])
    good = score >= bound[at]
    return at[good], row[good], score[good]


def nearest(embeddings: DataFrame, k: int = 20, one_in: int = 20, visited: float = VISITED, rerank: int = RERANK, exact: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score: the `k` nearest found of every row whose id `one_in` divides, among all other rows.

    Vectors that are null, zero, of another length than most, or with null or non-finite
    components take no part, nor do rows without an id; equal scores go to the smaller id;
    rows that share an id are candidates each, but not of a query with that id; as queries each
    has its own `k` neighbours, so that an id that occurs twice has every rank twice; with at most
    `k` candidates all are found; an empty table has no result; other columns aren't read.
    `exact` visits every list, and ranks every member, that the bounds don't rule out, whatever `visited`
    and `rerank` say: the result is then that of brute force.
    """
    spark = embeddings.sparkSession
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    result = f"query_id {kind}, rank int, vec_id {kind}, score double"
    vectors = stored(valid_vectors(embeddings), "ann-vectors")
    dims = vectors.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    if dims is None:
        return spark.createDataFrame([], result)
    dim, rows = dims["dim"], dims["count"]
    vectors = vectors.where(F.col("dim") == dim)
    sample = vectors.select("vec_id", "vec").orderBy(F.xxhash64("vec_id"), "vec_id", "vec").limit(SAMPLE_ROWS).collect()
    index = fit(np.frombuffer(b"".join(bytes(r[1]) for r in sample), "<f8").reshape(-1, dim), max(1, min(int(rows**0.5), MOST_LISTS)))
    del sample

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1), dim)
                at, codes = index.encode(x)
                far, lost = index.residuals(x, at, codes)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(far), pa.array(lost)], names=["vec_id", "vec", "list", "codes", "far", "lost"])

    members = stored(vectors.select("vec_id", "vec").mapInArrow(encode, f"vec_id {kind}, vec binary, list long, codes binary, far double, lost double"), "ann-lists")
    held, radius = np.zeros(len(index.centers), np.int64), np.zeros(len(index.centers))
    for r in members.groupBy("list").agg(F.count(F.lit(1)).alias("rows"), F.max("far").alias("far")).collect():  # a row for each list, MOST_LISTS of them at most
        held[r["list"]], radius[r["list"]] = r["rows"], r["far"]
    least = len(held) if exact else max(16, round(visited * len(held)))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                near = _matrix(part.column(1), dim) @ index.centers.T
                order = np.argsort(-near, 1, kind="stable")
                seen = np.cumsum(held[order], 1)
                enough = (seen < k + part.column(2).to_numpy()[:, None]).sum(1) + 1  # lists that hold k candidates beside the rows of the query's id
                home = np.maximum(HOME, enough)
                full = np.maximum(least, home)
                lists = [[row[:n][held[row[:n]] > 0] for row, n in zip(order, home.tolist(), strict=True)], [row[m:n][held[row[m:n]] > 0] for row, m, n in zip(order, home.tolist(), full.tolist(), strict=True)]]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(x, pa.list_(pa.int64())) for x in lists]], names=["vec_id", "vec", "home", "others"])

    def skip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                most = index.reachable(_matrix(part.column("vec"), dim), radius)
                bound = part.column("bound").to_numpy()
                others = [np.array(x, np.int64) for x in part.column("others").to_pylist()]
                lists = [x[row[x] >= b] for x, row, b in zip(others, most, bound.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("query", "vec_id", "vec")], pa.array(lists, pa.list_(pa.int64())), part.column("bound")], names=["query", "vec_id", "vec", "others", "bound"])

    asked = members.where(F.col("vec_id") % one_in == 0).select("vec_id", "vec")
    asked = asked.join(asked.groupBy("vec_id").agg(F.count(F.lit(1)).alias("same")), "vec_id").select("vec_id", "vec", "same")
    visits = asked.mapInArrow(visit, f"vec_id {kind}, vec binary, home array<bigint>, others array<bigint>")
    queries = stored(visits.withColumn("query", F.monotonically_increasing_id()), "ann-visits")  # a key for each row, as ids can repeat
    size = min(max(BLOCK, -(-rows // len(held))), MOST_ROWS)  # a task's rows; their scores are taken SCORES at a time

    def search(key, table):
        is_query = table.column("codes").is_null()
        asks, own = table.filter(is_query), table.filter(pc.invert(is_query)).sort_by("vec_id")
        out: tuple[list, list, list, list] = ([], [], [], [])
        if asks.num_rows and own.num_rows:
            q, x = _matrix(asks.column("vec"), dim), _matrix(own.column("vec"), dim)
            codes = np.frombuffer(b"".join(own.column("codes").to_pylist()), np.uint8).reshape(len(x), -1)
            lost = own.column("lost").to_numpy()
            keys, q_ids, ids, bound = asks.column("query").to_numpy(), asks.column("vec_id").to_numpy(), own.column("vec_id").to_numpy(), asks.column("bound").to_numpy()
            for begin in range(0, len(q), step := max(1, SCORES // len(x))):
                part = slice(begin, begin + step)
                guess = index.approximate(q[part], key[0].as_py(), codes)
                guess[q_ids[part, None] == ids[None, :]] = -np.inf
                if exact:
                    at, row, score = _reaching(q[part], x, guess, lost, bound[part], k, rerank)
                    order = np.lexsort((ids[row], -score, at))
                    order = order[np.arange(len(order)) - np.searchsorted(at[order], at[order]) < k]
                    at, row = at[order] + begin, row[order]
                    for o, found in zip(out, (q_ids[at], ids[row], score[order], keys[at]), strict=True):
                        o.append(found)
                    continue
                best = np.argsort(-guess, 1, kind="stable")[:, : max(rerank, k)]
                for i, row in enumerate(best, begin):
                    row = row[ids[row] != q_ids[i]]
                    score = (x[row] * q[i]).sum(1)
                    row, score = row[score >= bound[i]], score[score >= bound[i]]
                    top = np.lexsort((ids[row], -score))[:k]
                    out[0].append(np.full(len(top), q_ids[i]))
                    out[1].append(ids[row][top])
                    out[2].append(score[top])
                    out[3].append(np.full(len(top), keys[i]))
        cat = lambda parts, t: np.concatenate(parts) if parts else np.zeros(0, t)
        return pa.table({"query_id": cat(out[0], np.int64), "vec_id": cat(out[1], np.int64), "score": cat(out[2], float), "query": cat(out[3], np.int64)})

    def scan(visits: DataFrame) -> DataFrame:
        """What the visits (query, vec_id, vec, list, bound) find that is not below their bounds."""
        of_members = members.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / size).alias("blocks"))
        of_visits = visits.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / size).alias("turns"))
        plan = F.broadcast(of_members.join(of_visits, "list"))  # a row for each list
        block = F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("long")
        turn = F.pmod(F.xxhash64("query"), F.col("turns")).cast("long")
        left = members.join(plan, "list").select("list", block.alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)).alias("turn"), "vec_id", "vec", "codes", "lost", F.lit(0.0).alias("bound"), F.lit(None).cast("long").alias("query"))
        right = visits.join(plan, "list").select("list", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), turn.alias("turn"), "vec_id", "vec", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("lost"), "bound", "query")
        return left.unionByName(right).groupBy("list", "block", "turn").applyInArrow(search, "query_id long, vec_id long, score double, query long")

    best_first = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    # the k-th score of a query's best lists bounds what its other lists need to return
    home = queries.select("query", "vec_id", "vec", F.explode("home").alias("list"), F.lit(float("-inf")).alias("bound"))
    first = stored(scan(home).withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k).drop("rank"), "ann-home")
    bounds = first.groupBy("query").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("bound"))
    bounded = queries.join(bounds, "query", "left").select("query", "vec_id", "vec", "others", F.coalesce("bound", F.lit(float("-inf"))).alias("bound"))
    kept = bounded.mapInArrow(skip, f"query long, vec_id {kind}, vec binary, others array<bigint>, bound double")
    others = kept.select("query", "vec_id", "vec", F.explode("others").alias("list"), "bound")
    ranked = first.unionByName(scan(stored(others, "ann-others"))).withColumn("rank", F.row_number().over(best_first))
    return ranked.where(F.col("rank") <= k).select(F.col("query_id").cast(kind), "rank", F.col("vec_id").cast(kind), "score")


def op8_nearest(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), exact=True)
