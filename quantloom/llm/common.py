"""What the corpus operators share: byte-level words, shared folders, row packing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Word bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: Word bytes of `[^\x20\x09-\x0D]+`.
NONSPACE = np.ones(256, bool)
NONSPACE[9:14] = NONSPACE[32] = False

_rng = np.random.default_rng(20_240_117)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_MULT = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fold(h: np.ndarray, more: np.ndarray) -> np.ndarray:
    """The hash of a sequence with one more member."""
    return mix(h * _MULT + more)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts one after another, and n+1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole documents of about `limit` bytes: first, last (exclusive), bytes, offsets."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def word_bounds(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts and ends of the words, and the n+1 word offsets of the documents."""
    low = _LOWER[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = kind[low]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    here, before = inside[1:], inside[:-1]
    starts = np.flatnonzero(here & (edge | ~before))
    ends = np.flatnonzero(before & (edge | ~here))
    return low, starts, ends, np.searchsorted(starts, offsets)


def hash_spans(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of every span (none empty): every eight bytes are mixed with their place before they are added up."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    lens = ends - starts
    n = (lens + 7) >> 3
    first, begin = np.cumsum(n) - n, np.cumsum(lens) - lens
    every = np.arange(int(begin[-1] + lens[-1]))
    padded = np.zeros(8 * int(first[-1] + n[-1]), np.uint8)
    padded[every + np.repeat(8 * first - begin, lens)] = low[every + np.repeat(starts - begin, lens)]
    place = np.arange(1, len(padded) // 8 + 1) - np.repeat(first, n)
    values = mix(padded.view("<u8") + place.astype(np.uint64) * _MULT)
    return mix(np.add.reduceat(values, first) + lens.astype(np.uint64))


def hashed_words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word, and the n+1 word offsets of the documents."""
    low, starts, ends, bounds = word_bounds(data, offsets, kind)
    return hash_spans(low, starts, ends), bounds


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's shared checkpoint folder, which is set only where there is none."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quantloom-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet to the shared folder and read again: cuts the lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that no column of `df` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def total_bytes(df: DataFrame, column: str = "text") -> int:
    return int(df.agg(F.sum(F.octet_length(F.col(column)))).first()[0] or 0)


def parts_for(spark: SparkSession, size: int, each: int) -> int:
    """Partitions of about `each` bytes, and as many as the session's shuffles have at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each), 1)
