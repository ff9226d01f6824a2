"""Benchmark decontamination over suffix arrays of the training text.

Every run of documents of about a megabyte is a shard. The words of a shard become codes of
the benchmark's vocabulary (0: not in it). The shard's suffixes are sorted one word deeper at
a time, and every benchmark suffix is binary-searched in them, as far as it has matches: that
leaves its longest verbatim match and all its places. Suffixes that no benchmark suffix
matches so far aren't sorted any deeper. The work needs no shuffle of documents: the benchmark
is stored in blocks of about `BLOCK_BYTES`, and a task takes one block after another for each
batch of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, chunks, fresh, hashed_words, shared_dir, text_bytes

WINDOW = 13
BLOCK_BYTES = 4 << 20
ONE_IN = 20  # a document is contaminated from one hit word in so many

_STATE = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("longest", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("starts", T.ArrayType(T.LongType())),
        T.StructField("ends", T.ArrayType(T.LongType())),
    ]
)


class TestSuffixes:
    """The suffixes of a block of benchmark items, as word codes."""

    def __init__(self, names: list[str | None], texts: pa.Array, window: int):
        words, bounds = hashed_words(*text_bytes(texts), ALNUM)
        self.names = names
        self.vocabulary, codes = np.unique(words, return_inverse=True)
        self.codes, self.width = codes + 1, len(self.vocabulary) + 2
        sizes = np.diff(bounds)
        self.item = np.repeat(np.arange(len(names)), sizes)
        at = np.arange(len(words))
        self.left = bounds[1:][self.item] - at
        whole = (at == bounds[:-1][self.item]) & (self.left < window)
        self.window = np.where(self.left >= window, window, np.where(whole, self.left, 0))  # words of the window that begins here, if one does

    def search(self, words: np.ndarray, doc: np.ndarray, docs: int):
        """Of a shard: how many windows cover each word, (document, item) pairs of windows that occur, and each document's longest match."""
        cover, longest, pairs = np.zeros(len(words) + 1, np.int64), np.zeros(docs, np.int64), [np.zeros((0, 2), np.int64)]
        if not len(self.codes) or not len(words):
            return cover[:-1], pairs[0], longest
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        code = np.where(self.vocabulary[at] == words, at + 1, 0)
        last = np.searchsorted(doc, doc, "right")  # where each word's document ends
        place, group = np.flatnonzero(code), None  # suffixes in order, and where the run of equal ones so far begins
        suffix, low = np.arange(len(self.codes)), np.zeros(len(self.codes), np.int64)
        depth = 0
        while len(suffix):
            there = place + depth < last[place]
            following = np.where(there, code[np.minimum(place + depth, len(code) - 1)], 0)
            order = np.argsort(following, kind="stable") if group is None else np.lexsort((following, group))
            place = place[order]
            key = following[order] if group is None else group * self.width + following[order]
            want = low * self.width + self.codes[suffix + depth]
            first, end = np.searchsorted(key, want, "left"), np.searchsorted(key, want, "right")
            found = end > first
            suffix, first, end = suffix[found], first[found], end[found]
            depth += 1
            turn = np.zeros(len(place) + 1, np.int64)
            np.add.at(turn, first, 1)
            np.add.at(turn, end, -1)
            kept = np.cumsum(turn[:-1]) > 0
            longest[doc[place[kept]]] = depth
            full = np.flatnonzero(self.window[suffix] == depth)
            if len(full):
                runs, run = np.unique(first[full], return_index=True)  # equal windows are the same run
                n = end[full[run]] - runs
                which = np.repeat(np.arange(len(runs)), n)
                hit = place[np.repeat(runs - np.cumsum(n) + n, n) + np.arange(n.sum())]
                np.add.at(cover, hit, 1)
                np.add.at(cover, hit + depth, -1)
                held = np.unique(np.stack([which, doc[hit]], 1), axis=0)
                owned = np.unique(np.stack([np.searchsorted(runs, first[full]), self.item[suffix[full]]], 1), axis=0)
                a, b = np.searchsorted(owned[:, 0], held[:, 0], "left"), np.searchsorted(owned[:, 0], held[:, 0], "right")
                m = b - a
                pairs.append(np.unique(np.stack([np.repeat(held[:, 1], m), owned[np.repeat(a - np.cumsum(m) + m, m) + np.arange(m.sum()), 1]], 1), axis=0))
            fresh_run = np.ones(len(key), bool)
            fresh_run[1:] = key[1:] != key[:-1]
            number = np.cumsum(kept) - 1
            begins = np.maximum.accumulate(np.where(fresh_run, np.arange(len(key)), 0))
            place, group = place[kept], number[begins[kept]]
            longer = self.left[suffix] > depth
            suffix, low = suffix[longer], number[first[longer]]
        return np.cumsum(cover[:-1]), np.concatenate(pairs), longest


_loaded: dict[tuple[str, int], TestSuffixes] = {}


def _block(path: str, window: int) -> TestSuffixes:
    """A stored block; a worker keeps the last one."""
    if (path, window) not in _loaded:
        _loaded.clear()
        system, name = fs.FileSystem.from_uri(path)
        table = pq.read_table(name, filesystem=system, columns=["item", "text"])
        _loaded[path, window] = TestSuffixes(table.column("item").to_pylist(), table.column("text"), window)
    return _loaded[path, window]


def _lists(of: np.ndarray, values: pa.Array, n: int) -> pa.Array:
    """A list for each of n documents, of the values that are its."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)), pa.int32()), values)


def _scan(blocks: list[str], window: int, texts: pa.Array) -> pa.Array:
    n = len(texts)
    shards = [(i, j - i, *hashed_words(d, o, ALNUM)) for i, j, d, o in chunks(*text_bytes(texts))]
    sizes = np.concatenate([np.diff(b) for *_, b in shards]) if shards else np.zeros(0, np.int64)
    hit = [np.zeros(len(w), bool) for _, _, w, _ in shards]
    longest, found = np.zeros(n, np.int64), [set() for _ in range(n)]
    for path in blocks:
        tests = _block(path, window)
        for k, (i, m, words, bounds) in enumerate(shards):
            cover, pairs, reach = tests.search(words, np.repeat(np.arange(m), np.diff(bounds)), m)
            hit[k] |= cover > 0
            longest[i : i + m] = np.maximum(longest[i : i + m], reach)
            for d, item in pairs.tolist():
                if tests.names[item] is not None:
                    found[i + d].add(tests.names[item])
    mask = np.concatenate(hit) if hit else np.zeros(0, bool)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(n), sizes)
    edge = np.zeros(len(mask) + 1, bool)
    edge[0], edge[ends] = True, True
    before, here = np.append(False, mask), np.append(mask, False)
    starts, stops = np.flatnonzero(here & (edge | ~before)), np.flatnonzero(before & (edge | ~here))
    total = np.append(0, np.cumsum(mask))
    base = ends - sizes
    items = [sorted(x) for x in found]
    of_run = owner[starts]
    columns = [
        pa.array(sizes),
        pa.array(total[ends] - total[base]),
        pa.array(longest),
        pa.array(items, pa.list_(pa.string())),
        _lists(of_run, pa.array(starts - base[of_run]), n),
        _lists(of_run, pa.array(stops - base[of_run]), n),
    ]
    return pa.StructArray.from_arrays(columns, names=_STATE.names)


def stored_blocks(benchmark: DataFrame, block_bytes: int) -> list[str]:
    """Files of about `block_bytes` of the benchmark's items in the shared folder; items are dealt by a hash."""
    spark = benchmark.sparkSession
    items = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    count = max(1, -(-int(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    path = shared_dir(spark, "benchmark")
    items.repartition(count, F.xxhash64("item", "text")).write.parquet(path)
    return sorted(spark.read.parquet(path).inputFiles())


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, result: str = "contamination") -> DataFrame:
    """`docs` with a struct column `result`: n_words, n_hit, longest (words of the longest verbatim
    match of a benchmark suffix), items (sorted ids of items with a window in the text), starts and
    ends (runs of hit words).

    A null or empty text has no words and no hits; one longer than a shard is a shard of its
    own; repeated rows get the same result each; a benchmark without items, or without words,
    hits nothing; null item ids hit but aren't listed; an empty table gives an empty one; other
    columns pass through, and `result` gets leading underscores if a column has its name.
    """
    state = fresh(docs, result)
    blocks = stored_blocks(benchmark, block_bytes)
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _scan(blocks, window, batch.column(text))], names=[*batch.schema.names, state])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(state, _STATE)]))


def contaminated(n_hit, n_words, one_in: int = ONE_IN):
    return (n_hit > 0) & (one_in * n_hit >= n_words)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, one_in: int = ONE_IN) -> DataFrame:
    """The documents of `docs` that aren't contaminated, with its columns."""
    state = fresh(docs, "contamination")
    found = find_contamination(docs, benchmark, window, result=state)
    return found.where(~contaminated(F.col(state)["n_hit"], F.col(state)["n_words"], one_in)).drop(state)


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    c = F.col("contamination")
    return found.select(
        "doc_id",
        c["n_words"].alias("n_words"),
        c["n_hit"].alias("n_hit"),
        F.size(c["items"]).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", c["items"]), 256).alias("items_sha256"),
        contaminated(c["n_hit"], c["n_words"]).alias("contaminated"),
    )


OP1_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS k, list_slice(w, j, j + 12) AS g FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS u(j) WHERE len(w) > 0),
lens AS (SELECT DISTINCT k FROM win),
pos AS (SELECT r, k, j, list_slice(w, j, j + k - 1) AS g FROM d, lens, unnest(range(1, len(w) - k + 2)) AS u(j) WHERE len(w) >= k),
hits AS (SELECT p.r, p.j, p.k, item_id FROM pos p JOIN win USING (k, g)),
n AS (SELECT r, count(DISTINCT x) AS n_hit FROM hits, unnest(range(j, j + k)) AS u(x) GROUP BY r),
i AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
 sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN i USING (r)
"""
