"""Removal of repeated byte strings over a sparse suffix array.

Of all strings of 100 bytes only the first occurrence in the corpus stays. Sorting every
suffix would move each byte many times over; so suffixes are sampled by content: every
100-byte window names the smallest hash among its 28-byte strings, and the places so named,
one in about 37, are the anchors. Equal windows have the same anchor at the same offset, so
only windows of equal anchors need comparing, and the windows of one anchor, an extended
suffix around it, are compared as a whole first.

Round one range-partitions the anchored suffixes, by splitters that a sample of them gives:
the key is the suffix's eight leading bytes, a hash of its first 28, and a hash of the whole
extended suffix. A bucket sorts its keys by multikey quicksort. An extended suffix that
isn't the first of its kind is a repeat throughout. If different ones share an anchor's
string, also across a bucket's boundaries, their windows go to round two, which sorts the
windows by their leading bytes and hashes in the same way.

Texts are dealt into blocks of bounded size, and exchange keys and verdicts with the
buckets in arrays; a block sends each key once, so no key is hot. The texts are shuffled
once, and each stage hashes a block once. Keys are 160 bits in round one and 128 in round
two, 64 of them the leading bytes themselves.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTE, _MULT, chunks, fold, mix, parts_for, text_bytes, total_bytes

WINDOW = 100
SEED = 28
SPAN = WINDOW - SEED + 1
BLOCK_BYTES = 6 << 20
RUN_BYTES = 1 << 16  # text that is hashed at once: its arrays fit a core's cache
SAMPLE_DOCS = 3000  # splitters come from the anchors of about so many documents,
BUCKET_DOCS = 4  # and of so many more for each bucket

_M = [pow(int(_MULT), e, 1 << 64) for e in range(WINDOW + 1)]
_LAST = np.iinfo(np.int64).max


def multikey_quicksort(columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The order of rows by several key words, and for each word whether a row equals the one before it
    in that and all earlier words. Only runs that are equal so far are sorted by the next word."""
    order = np.argsort(columns[0])
    same = np.zeros(len(order), bool)
    same[1:] = columns[0][order][1:] == columns[0][order][:-1]
    levels = [same]
    for c in columns[1:]:
        tied = same.copy()
        tied[:-1] |= same[1:]
        at = np.flatnonzero(tied)
        if len(at):
            run = np.cumsum(~same)[at]
            order[at] = order[at][np.lexsort((c[order[at]], run))]
        same = same.copy()
        same[1:] &= c[order][1:] == c[order][:-1]
        levels.append(same)
    return order, levels


def _anchors(data: np.ndarray, offsets: np.ndarray):
    """Leading bytes, string hashes, extended-suffix hashes, first and last windows of the anchors of a run of documents; the windows' hashes."""
    n = len(data)
    start, end = offsets[:-1], offsets[1:]
    long = end - start >= WINDOW
    none = np.zeros(0, np.uint64)
    if not long.any():
        return none, none.astype(np.uint32), none, np.zeros(0, np.int64), np.zeros(0, np.int64), none
    h = {1: _BYTE[data]}
    for j in (1, 2, 4, 8, 16, 32):
        h[2 * j] = h[j][:-j] * np.uint64(_M[j]) + h[j][j:]
    m = n - SEED + 1
    seed = mix(h[16][:m] * np.uint64(_M[12]) + h[8][16 : 16 + m] * np.uint64(_M[4]) + h[4][24 : 24 + m])
    w = n - WINDOW + 1
    window = mix(h[64][:w] * np.uint64(_M[36]) + h[32][64 : 64 + w] * np.uint64(_M[4]) + h[4][96 : 96 + w])
    del h
    bits = np.uint64(n.bit_length())
    low = (seed >> bits << bits) | np.arange(m, dtype=np.uint64)
    step = 1
    while 2 * step <= SPAN:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    low = np.minimum(low[:w], low[SPAN - step : SPAN - step + w])
    turn = np.zeros(w + 1, np.int64)
    np.add.at(turn, start[long], 1)
    np.add.at(turn, end[long] - WINDOW + 1, -1)
    s = np.flatnonzero(np.cumsum(turn[:-1]) > 0)
    p = (low[s] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.ones(len(s), bool)
    new[1:] = (p[1:] != p[:-1]) | (s[1:] != s[:-1] + 1)
    at = np.flatnonzero(new)
    a, b, p = s[at], s[np.append(at[1:], len(s)) - 1], p[at]
    whole = fold(fold(window[a], window[b]), ((b - a) << 8 | (p - a)).astype(np.uint64))
    return _leading(data, p), (seed[p] >> np.uint64(32)).astype(np.uint32), whole, a, b, window


def _leading(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number of the same order."""
    return np.ascontiguousarray(data[places[:, None] + np.arange(8)]).view(">u8")[:, 0].astype(np.uint64)


class _Block:
    """The documents of a block in order, their anchors and, if asked, the windows of each run of documents."""

    def __init__(self, table, with_windows: bool = True):
        order = pc.sort_indices(table.select(["doc_id", "text"]), sort_keys=[("doc_id", "ascending"), ("text", "ascending")])
        table = table.take(order)
        self.ids = table.column("doc_id")
        self.rank = self.ids.cast(pa.int64()).fill_null(_LAST).to_numpy()
        self.data, self.offsets = text_bytes(table.column("text"))
        runs, self.windows_of = [], []
        for i, _, d, o in chunks(self.data, self.offsets, RUN_BYTES):
            lead, seed, whole, a, b, window = _anchors(d, o)
            runs.append((lead, seed, whole, a + self.offsets[i], b + self.offsets[i]))
            if with_windows:
                self.windows_of.append((self.offsets[i], len(lead), window))
        kinds = (np.uint64, np.uint32, np.uint64, np.int64, np.int64)
        self.lead, self.seed, self.whole, self.begin, self.end = (np.concatenate(x) for x in zip(*(runs or [[np.zeros(0, t) for t in kinds]]), strict=True))
        self.first, self.group = _distinct(self.lead, self.seed, self.whole)
        self.id_of = self.rank_at(self.begin[self.first])

    def rank_at(self, places: np.ndarray) -> np.ndarray:
        return self.rank[np.searchsorted(self.offsets, places, "right") - 1]

    def asked(self):
        return self.lead[self.first], self.seed[self.first], self.whole[self.first], self.id_of

    def _is_first(self) -> np.ndarray:
        out = np.zeros(len(self.lead), bool)
        out[self.first] = True
        return out

    def windows(self, verdict: np.ndarray):
        """Of the anchors that go to round two: the windows' leading bytes, hashes and places."""
        chosen = self._is_first() & (verdict[self.group] == 2)
        places, hashes, done = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
        for offset, n, window in self.windows_of:
            own = done + np.flatnonzero(chosen[done : done + n])
            done += n
            if len(own):
                sizes = self.end[own] - self.begin[own] + 1
                s = np.repeat(self.begin[own] - offset - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                places.append(s + offset)
                hashes.append(window[s])
        self.windows_of = []
        place = np.concatenate(places)
        return _leading(self.data, place), np.concatenate(hashes), place

    def repeats(self, verdict: np.ndarray) -> np.ndarray:
        """First and last windows of the anchors that are repeats throughout."""
        chosen = ~self._is_first() | (verdict[self.group] == 1)
        return np.stack([self.begin[chosen], self.end[chosen]], 1)


def _distinct(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each distinct key in the rows' order, and every row's number among them."""
    order, (*_, same) = multikey_quicksort(list(columns))
    run = np.cumsum(~same) - 1
    first = np.minimum.reduceat(order, np.flatnonzero(~same)) if len(order) else order
    by_place = np.argsort(first)
    number = np.empty(len(first), np.int64)
    number[by_place] = np.arange(len(first))
    group = np.empty(len(order), np.int64)
    group[order] = number[run]
    return first[by_place], group


def _deal(bucket: np.ndarray, buckets: int):
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _bucket(lead: np.ndarray, whole: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    """Places among the splitters (rows of leading bytes and whole, sorted)."""
    lo, hi = np.searchsorted(splitters[:, 0], lead, "left"), np.searchsorted(splitters[:, 0], lead, "right")
    at = np.flatnonzero(hi > lo)
    at = at[np.argsort(lead[at])]
    for own in np.split(at, np.flatnonzero(np.diff(lo[at])) + 1) if len(at) else []:  # a splitter's leading bytes: the whole decides
        lo[own] += np.searchsorted(splitters[lo[own[0]] : hi[own[0]], 1], whole[own], "right")
    return lo


_BIG = np.uint32(0xFFFFFFFF)


def _pack_ids(ids: np.ndarray) -> bytes:
    """Ascending ids by their differences: four bytes each, larger ones in eight after them."""
    step = np.diff(ids, prepend=np.int64(0))
    big = (step < 0) | (step >= int(_BIG))
    return np.where(big, _BIG, step.astype(np.uint32)).tobytes() + step[big].astype("<i8").tobytes()


def _unpack_ids(data: bytes, n: int, at: int) -> np.ndarray:
    step = np.frombuffer(data, "<u4", n, at)
    big = step == _BIG
    out = step.astype(np.int64)
    out[big] = np.frombuffer(data[at + 4 * n :], "<i8")
    return np.cumsum(out)


def _rows(kind, block, order, bounds, columns, ids, buckets):
    """A row for each bucket that gets anything; a bucket's entries are in the order of their places."""
    some = [j for j in range(buckets) if bounds[j + 1] > bounds[j]]
    data = []
    for j in some:
        own = order[bounds[j] : bounds[j + 1]]
        data.append(b"".join([np.int64(len(own)).tobytes(), *(c[own].tobytes() for c in columns), _pack_ids(ids[own])]))
    return pa.table({"bucket": pa.array(some, pa.int64()), "block": pa.array([block] * len(some), pa.int64()), "kind": pa.array([kind] * len(some), pa.int32()), "data": pa.array(data, pa.binary())})


def _received(table, types):
    """The columns of all rows together with the ids, the rows' sizes, and every entry's block."""
    data = table.column("data").to_pylist()
    sizes = np.array([int(np.frombuffer(x, "<i8", 1)[0]) for x in data], np.int64)
    columns, at = [], np.full(len(data), 8)
    for t in types:
        columns.append(np.concatenate([np.frombuffer(x[o : o + n * np.dtype(t).itemsize], t) for x, o, n in zip(data, at.tolist(), sizes.tolist(), strict=True)]))
        at += sizes * np.dtype(t).itemsize
    columns.append(np.concatenate([_unpack_ids(x, n, o) for x, o, n in zip(data, at.tolist(), sizes.tolist(), strict=True)]))
    return columns, sizes, np.repeat(table.column("block").to_numpy(), sizes)


def _replies(table, verdict, sizes, kind):
    ends = np.cumsum(sizes)
    data = [verdict[e - n : e].tobytes() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "kind": pa.array([kind] * len(data), pa.int32()), "data": pa.array(data, pa.binary())})


def _splitters(docs: DataFrame, buckets: int, rows: int) -> np.ndarray:
    """Keys that cut a sample of the anchored suffixes into equal parts; the sample grows with the buckets."""
    one_in = max(1, rows // (SAMPLE_DOCS + BUCKET_DOCS * buckets))

    def sample(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for _, _, d, o in chunks(data, offsets, RUN_BYTES):
                lead, _, whole, _, _, _ = _anchors(d, o)
                some = np.flatnonzero(whole % np.uint64(8) == 0)
                yield pa.RecordBatch.from_arrays([pa.array(lead[some].view(np.int64)), pa.array(whole[some].view(np.int64))], names=["lead", "whole"])

    chosen = docs.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(7)), F.lit(one_in)) == 0).select("text")
    found = chosen.mapInArrow(sample, "lead long, whole long").toArrow()
    pairs = np.unique(np.stack([found.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in (0, 1)], 1), axis=0)
    at = (np.arange(1, buckets) * len(pairs)) // buckets
    return np.unique(pairs[at], axis=0) if len(pairs) else np.zeros((0, 2), np.uint64)


def remove_repeats(docs: DataFrame, block_bytes: int = BLOCK_BYTES, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row; `with_text` adds the kept bytes as `kept`.

    A byte goes if a 100-byte string over it also starts earlier: in a row of smaller doc_id
    (an integer; null is largest; rows that share one are ordered by a hash), or before in the
    same row. A null text is empty; texts below 100 bytes keep everything; repeated rows are
    copies of each other; an empty table gives an empty one; other columns aren't read.
    """
    spark = docs.sparkSession
    size, rows = total_bytes(docs), docs.count()
    blocks = parts_for(spark, size, block_bytes)
    splitters = _splitters(docs, blocks, rows)
    buckets = len(splitters) + 1
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    long = F.octet_length("text") >= WINDOW
    dealt = rows.where(long).withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))).repartition(blocks, "block")

    def suffixes(table):
        block = _Block(table, with_windows=False)
        lead, seed, whole, ids = block.asked()
        order, bounds = _deal(_bucket(lead, whole, splitters), buckets)
        return _rows(1, table.column("block")[0].as_py(), order, bounds, (lead, seed, whole), ids, buckets)

    def judge_suffixes(table):
        (lead, seed, whole, ids), sizes, block = _received(table, ["<u8", "<u4", "<u8"])
        order, (_, same_key, same, _, _) = multikey_quicksort([lead, seed, whole, ids, block])
        verdict = np.zeros(len(order), np.uint8)
        # several extended suffixes of one string: any row but the run's first whole differs from one before or after
        run = np.cumsum(~same_key) - 1
        kinds = np.bincount(run, ~same) if len(run) else np.zeros(0)
        edge = np.isin(lead[order], splitters[:, 0])  # the string may go on beyond the bucket's boundary
        verdict[order] = np.where(same, 1, np.where((kinds[run] > 1) | edge, 2, 0))
        return _replies(table, verdict, sizes, 1)

    def verdicts(block, told):
        out = np.zeros(len(block.first), np.uint8)
        lead, _, whole, _ = block.asked()
        order, bounds = _deal(_bucket(lead, whole, splitters), buckets)
        for j, data in zip(told.column("bucket").to_pylist(), told.column("data").to_pylist(), strict=True):
            out[order[bounds[j] : bounds[j + 1]]] = np.frombuffer(data, np.uint8)
        return out

    def of_hash(hashes):
        return ((hashes >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)

    def windows(table, told):
        block, number = _Block(table), table.column("block")[0].as_py()
        verdict = verdicts(block, told)
        lead, hashes, places = block.windows(verdict)
        first, _ = _distinct(lead, hashes)
        order, bounds = _deal(of_hash(hashes[first]), blocks)
        out = _rows(2, number, order, bounds, (lead[first], hashes[first]), block.rank_at(places[first]), blocks)
        own = pa.table({"bucket": pa.array([-1 - number], pa.int64()), "block": pa.array([number], pa.int64()), "kind": pa.array([1], pa.int32()), "data": pa.array([verdict.tobytes()], pa.binary())})
        return pa.concat_tables([out, own])

    def judge_windows(table):
        if table.column("kind")[0].as_py() == 1:  # round one's verdicts on their way back
            return table.select(["block", "bucket", "kind", "data"])
        (lead, hashes, ids), sizes, block = _received(table, ["<u8", "<u8"])
        order, (_, same, _, _) = multikey_quicksort([lead, hashes, ids, block])
        verdict = np.zeros(len(order), np.uint8)
        verdict[order] = same
        return _replies(table, verdict, sizes, 2)

    def cut(table, told):
        block = _Block(table)
        rounds = told.column("kind").to_numpy()
        data = told.column("data").to_pylist()
        verdict = np.frombuffer(data[int(np.flatnonzero(rounds == 1)[0])], np.uint8)
        lead, hashes, places = block.windows(verdict)
        first, group = _distinct(lead, hashes)
        again = np.zeros(len(first), bool)
        order, bounds = _deal(of_hash(hashes[first]), blocks)
        for j, k, x in zip(told.column("bucket").to_pylist(), rounds.tolist(), data, strict=True):
            if k == 2:
                again[order[bounds[j] : bounds[j + 1]]] = np.frombuffer(x, np.uint8)
        repeat = again[group]
        later = np.ones(len(group), bool)
        later[first] = False
        turn = np.zeros(len(block.data) + 1, np.int64)
        starts = places[repeat | later]
        np.add.at(turn, starts, 1)
        np.add.at(turn, starts + WINDOW, -1)
        spans = block.repeats(verdict)
        np.add.at(turn, spans[:, 0], 1)
        np.add.at(turn, spans[:, 1] + WINDOW, -1)
        gone = np.cumsum(turn[:-1]) > 0
        total = np.concatenate(([0], np.cumsum(gone)))
        edge = gone.copy()
        edge[1:] &= ~gone[:-1]
        begin = block.offsets[:-1][block.offsets[:-1] < len(gone)]
        edge[begin] = gone[begin]
        edges = np.concatenate(([0], np.cumsum(edge)))
        o = block.offsets
        kept = [block.data[x:y][~gone[x:y]].tobytes() for x, y in zip(o[:-1].tolist(), o[1:].tolist(), strict=True)]
        columns = {
            "doc_id": block.ids,
            "n_bytes": np.diff(o),
            "n_removed": total[o[1:]] - total[o[:-1]],
            "n_spans": edges[o[1:]] - edges[o[:-1]],
            "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
        }
        return pa.table(columns | ({"kept": pa.array(kept, pa.binary())} if with_text else {}))

    message = "bucket long, block long, kind int, data binary"
    reply = "block long, bucket long, kind int, data binary"
    result = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    of_bucket = lambda sent: sent.repartition(blocks, "bucket").groupBy("bucket")
    own = lambda sent: sent.repartition(blocks, "block").groupBy("block")
    one = of_bucket(dealt.groupBy("block").applyInArrow(suffixes, message)).applyInArrow(judge_suffixes, reply)
    two = of_bucket(dealt.groupBy("block").cogroup(own(one)).applyInArrow(windows, message)).applyInArrow(judge_windows, reply)
    cleaned = dealt.groupBy("block").cogroup(own(two)).applyInArrow(cut, result)
    text = F.encode("text", "UTF-8")
    zero = F.lit(0).cast("long")
    short = rows.where(~long).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(text, 256).alias("kept_sha256"), *([text.alias("kept")] if with_text else []))
    return cleaned.unionByName(short)


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, b, substr(h, 2000 * b + 1, 2198) AS part FROM d, unnest(range(0, length(h) // 2000 + 1)) AS u(b)),
s AS (SELECT doc_id, 1000 * b + j AS pos, substr(part, 2 * j + 1, 200) AS g FROM p, unnest(range(0, least(1000, length(part) // 2 - 99))) AS u(j)),
again AS (SELECT doc_id, pos FROM s QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, pos) > 1),
turn AS (SELECT doc_id, pos, coalesce(pos > lag(pos) OVER w + 100, true) AS fresh FROM again WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
run AS (SELECT doc_id, pos, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM turn),
span AS (SELECT doc_id, min(pos) AS lo, max(pos) + 100 AS hi FROM run GROUP BY doc_id, k),
cut AS (SELECT doc_id, lo, hi FROM span UNION ALL SELECT doc_id, length(h) // 2, length(h) // 2 FROM d),
kept AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo, hi), 0) AS last FROM cut)
SELECT doc_id, CAST(length(any_value(h)) // 2 AS BIGINT) AS n_bytes, CAST(sum(hi - lo) AS BIGINT) AS n_removed, CAST(count(*) - 1 AS BIGINT) AS n_spans,
 sha256(unhex(string_agg(substr(h, 2 * last + 1, 2 * (lo - last)), '' ORDER BY lo, hi))) AS kept_sha256
FROM kept JOIN d USING (doc_id) GROUP BY doc_id
"""
