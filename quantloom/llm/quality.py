"""Quality classifier: histogram gradient-boosted trees over statistics of the text.

Statistics are computed for runs of documents at once in numpy, over whole texts. Trees are
grown on binned statistics of a bounded sample of labelled rows, level by level, from
histograms of gradients; then they are flattened into arrays, which are walked for all
documents and trees together. Scoring needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NONSPACE, chunks, fold, fresh, hash_spans, text_bytes, word_bounds

SAMPLE_ROWS = 20_000  # the trees learn from so many labelled rows at most: those of smallest id hash
TREES, DEPTH, RATE, BINS, LEAST_LEAF, RIDGE = 60, 4, 0.2, 64, 10, 1.0

_SYMBOLS = b".,!?|*#%&$:;'\"-/()_=<>@+"
_KIND = np.zeros(256, np.int64)
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 1, 2, 3, 4
_KIND[9:14] = _KIND[32] = 5
for _i, _c in enumerate(_SYMBOLS):
    _KIND[_c] = 6 + _i
_KINDS = 6 + len(_SYMBOLS)
FEATURES = [
    "log_bytes", "log_words", "mean_word", "std_word", "longest_word", "mean_line", "line_distinct", "line_repeat_bytes",
    "word_distinct", "top_word", "same_as_last", "same_as_last_but_one", "trigram_distinct", "short_words", "upper_words", "symbol_ends",
    *[f"share_{i}" for i in range(_KINDS)],
]


def _per_doc(doc: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(doc, weights, n)[:n].astype(float)


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of every document, and the count of its commonest."""
    key = np.sort((doc.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)))
    if not len(key):
        return np.zeros(n), np.zeros(n)
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    of = (key[at] >> np.uint64(44)).astype(np.int64)
    top = np.zeros(n)
    np.maximum.at(top, of, np.diff(np.append(at, len(key))))
    return _per_doc(of, n), top


def _chunk_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n, size = len(offsets) - 1, np.diff(offsets)
    out = np.zeros((n, len(FEATURES)), np.float32)
    low, starts, ends, bounds = word_bounds(data, offsets, NONSPACE)
    words = np.diff(bounds)
    doc = np.repeat(np.arange(n), words)
    some, sized = np.maximum(words, 1), np.maximum(size, 1)
    length = (ends - starts).astype(float)
    h = hash_spans(low, starts, ends)
    out[:, 0], out[:, 1] = np.log1p(size), np.log1p(words)
    mean = _per_doc(doc, n, length) / some
    out[:, 2] = mean
    out[:, 3] = np.sqrt(np.maximum(_per_doc(doc, n, length**2) / some - mean**2, 0))
    longest = np.zeros(n)
    np.maximum.at(longest, doc, length)
    out[:, 4] = np.log1p(longest)
    breaks = np.zeros(256, bool)
    breaks[10] = True
    _, ls, le, lb = word_bounds(data, offsets, ~breaks)
    lines = np.diff(lb)
    line_doc = np.repeat(np.arange(n), lines)
    line_hash = hash_spans(low, ls, le)
    out[:, 5] = np.log1p(size / np.maximum(lines, 1))
    out[:, 6] = _distinct(line_doc, line_hash, n)[0] / np.maximum(lines, 1)
    if len(ls) > 1:
        again = np.zeros(len(ls), bool)
        again[1:] = (line_hash[1:] == line_hash[:-1]) & (line_doc[1:] == line_doc[:-1])
        out[:, 7] = _per_doc(line_doc, n, (le - ls) * again) / sized
    distinct, top = _distinct(doc, h, n)
    out[:, 8], out[:, 9] = distinct / some, top / some
    for k, column in ((1, 10), (2, 11)):
        if len(h) > k:
            same = (h[k:] == h[:-k]) & (doc[k:] == doc[:-k])
            out[:, column] = _per_doc(doc[k:], n, same) / some
    if len(h) > 2:
        inside = doc[2:] == doc[:-2]
        grams = fold(fold(h[:-2], h[1:-1]), h[2:])[inside]
        out[:, 12] = _distinct(doc[2:][inside], grams, n)[0] / np.maximum(words - 2, 1)
    out[:, 13] = _per_doc(doc, n, length <= 3) / some
    if len(starts):
        out[:, 14] = _per_doc(doc, n, _KIND[data[starts]] == 1) / some
        out[:, 15] = _per_doc(doc, n, _KIND[data[ends - 1]] >= 6) / some
    kinds = np.bincount(np.repeat(np.arange(n) * _KINDS, size) + _KIND[data], minlength=n * _KINDS).reshape(n, _KINDS)
    out[:, 16:] = kinds / sized[:, None]
    return out


def features(texts: pa.Array) -> np.ndarray:
    """A row of statistics for every text; a null or empty text has zeros."""
    data, offsets = text_bytes(texts)
    parts = [_chunk_features(d, o) for _, _, d, o in chunks(data, offsets)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)), np.float32)


@dataclass
class FlatTrees:
    """All trees as arrays: a node goes left where feature <= threshold; leaves point at themselves."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for i in range(0, len(x), 4096):
            part = x[i : i + 4096]
            row = np.arange(len(part))[:, None]
            at = np.broadcast_to(self.roots, (len(part), len(self.roots)))
            for _ in range(self.depth):
                at = np.where(part[row, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            total[i : i + 4096] += self.value[at].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> FlatTrees:
    """Boosted trees for the log-odds of y (0 or 1); without rows of both classes only their share."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    empty = FlatTrees(*[np.zeros(0, np.int64)] * 2, *[np.zeros(0, np.int64)] * 2, np.zeros(0), np.zeros(0, np.int64), 0, base)
    if len(np.unique(y)) < 2:
        return empty
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)], 1)
    n, width = binned.shape
    places = binned + np.arange(width) * BINS
    score, nodes, roots = np.full(n, base), [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        roots.append(len(nodes))
        nodes.append([0, np.inf, len(nodes), len(nodes), 0.0])
        at, level = np.full(n, roots[-1]), [roots[-1]]
        for d in range(depth + 1):
            k = len(level)
            of = np.full(len(nodes), -1)
            of[level] = np.arange(k)
            here = of[at]
            rows = np.flatnonzero(here >= 0)
            G, H = np.bincount(here[rows], g[rows], k), np.bincount(here[rows], h[rows], k)
            for j, node in enumerate(level):
                nodes[node][4] = -rate * G[j] / (H[j] + RIDGE)
            if d == depth:
                break
            flat = (here[rows, None] * (width * BINS) + places[rows]).ravel()
            size = k * width * BINS
            sums = [np.bincount(flat, w, size).reshape(k, width, BINS).cumsum(2) for w in (np.repeat(g[rows], width), np.repeat(h[rows], width), None)]
            gl, hl, nl = sums
            gr, hr, nr = G[:, None, None] - gl, H[:, None, None] - hl, nl[:, :, -1:] - nl
            gain = gl**2 / (hl + RIDGE) + gr**2 / (hr + RIDGE) - (G**2 / (H + RIDGE))[:, None, None]
            gain[(nl < LEAST_LEAF) | (nr < LEAST_LEAF)] = -np.inf
            best = gain.reshape(k, -1).argmax(1)
            following = []
            for j, node in enumerate(level):
                f, b = divmod(int(best[j]), BINS)
                if gain[j, f, b] <= 1e-6 or b >= len(cuts[f]):
                    continue
                left, right = len(nodes), len(nodes) + 1
                nodes += [[0, np.inf, left, left, 0.0], [0, np.inf, right, right, 0.0]]
                nodes[node] = [f, cuts[f][b], left, right, 0.0]
                mine = rows[here[rows] == j]
                at[mine] = np.where(binned[mine, f] <= b, left, right)
                following += [left, right]
            level = following
            if not level:
                break
        score += np.array([v[4] for v in nodes])[at]
    f, t, a, b, v = (np.array(c) for c in zip(*nodes, strict=True))
    return FlatTrees(f.astype(np.int64), t.astype(np.float32), a.astype(np.int64), b.astype(np.int64), v.astype(float), np.array(roots), depth, base)


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> FlatTrees:
    """Trees from at most `rows` labelled documents; `labels` has doc_id and quality (0 or 1; others are left out).

    Only the sampled ids, whose number is bounded, are broadcast; the documents aren't shuffled. Of an
    id's repeated rows one counts, that of the smallest label and statistics.
    """
    chosen = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(rows)
    known = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "quality", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = known.withColumn("quality", F.col("quality").cast("int")).mapInArrow(stats, f"doc_id {kind}, quality int, x binary")
    found = found.groupBy("doc_id").agg(F.min(F.struct("quality", "x")).alias("row")).select("doc_id", "row.*").collect()
    found.sort(key=lambda r: (r[0], r[1], r[2]))
    x = np.array([np.frombuffer(r[2], np.float32) for r in found]).reshape(-1, len(FEATURES))
    return fit(x, np.array([r[1] for r in found], float))


def with_score(docs: DataFrame, trees: FlatTrees, result: str = "score") -> DataFrame:
    """`docs` with a double column `result` from 0 to 1 (leading underscores if its name is taken).

    A null or empty text is scored by its statistics, which are zeros; of any length, a text
    is read whole; repeated rows score alike; an empty table stays empty.
    """
    name = fresh(docs, result)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(batch.schema.get_field_index("text")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(trees.score(x), pa.float64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def id_class(doc_id: Column, classes: int) -> Column:
    return F.crc32(doc_id.cast("string")) % classes


def learned(spark, sf_dir: str, docs: DataFrame) -> FlatTrees:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return train(docs, labels.where(id_class(F.col("doc_id"), 3) != 1))


def op6_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = with_score(docs, learned(spark, sf_dir, docs))
    held = F.coalesce(id_class(F.col("doc_id"), 3) == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
