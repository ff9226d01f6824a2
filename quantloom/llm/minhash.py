"""Near-duplicates: fast similarity sketching, banding, and exact verification.

A document is the set of its distinct word shingles. Sets are sketched in rounds: each
round places every member in a hashed bin with a hashed value, and later rounds count
less than earlier ones; from the t-th round on all members go to one bin each round, so
2t rounds fill every bin of any set. Bands of coordinates give buckets of candidates.

Equal sets are one node throughout, so copies cost nothing. The candidates' components
(of the graph that links each bucket's nodes to its smallest) are the groups in which
links are verified on full sets. A group of bounded size is clustered whole. A larger one is dealt into
blocks, each with the group's leaders, the nodes with the fullest buckets. Then only its buckets
with nodes of several clusters are left: in each, every node outside the bucket's largest
cluster is compared with all nodes of the bucket, in tiles of blocks. Comparisons that can't
change the components are skipped; no pair is listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NONSPACE, chunks, fold, fresh, hashed_words, mix, stored, text_bytes
from .graph import components

SHINGLE = 5
PERCENT = 80
BANDS, ROWS = 25, 4
BLOCK_NODES = 256
BLOCK_MEMBERS = 1 << 20  # shingles in a block
LEADERS = 4

_C1, _C2 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every document, sorted within it, and their n+1 offsets."""
    words, bounds = hashed_words(data, offsets, NONSPACE)
    n = np.diff(bounds)
    docs = len(n)
    count = np.where(n > 0, np.maximum(n - k + 1, 1), 0)
    owner = np.repeat(np.arange(docs), count)
    first = np.cumsum(count) - count
    start = np.arange(count.sum()) - np.repeat(first - bounds[:-1], count)
    h = np.zeros(len(start), np.uint64)
    last = bounds[1:][owner]
    for j in range(k):
        at = start + j
        ok = at < last
        h[ok] = fold(h[ok], words[at[ok]])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[keep], owner[keep]
    return h, np.searchsorted(owner, np.arange(docs + 1))


def sketch(h: np.ndarray, offsets: np.ndarray, t: int) -> np.ndarray:
    """A row of t coordinates for every set (an empty one's stay at the maximum)."""
    docs, size = len(offsets) - 1, np.diff(offsets)
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(docs * t, none)
    todo = np.flatnonzero(size > 0)
    for i in range(2 * t):
        if not len(todo):
            break
        n = size[todo]
        first = np.cumsum(n) - n
        member = np.arange(n.sum()) - np.repeat(first - offsets[todo], n)
        x = mix(h[member] ^ np.uint64(int(_C1) * (i + 1) & 0xFFFFFFFFFFFFFFFF))
        place = (mix(x ^ _C2) % np.uint64(t)).astype(np.int64) if i < t else np.full(len(x), i - t)
        value = (np.uint64(i) << np.uint64(54)) | (x >> np.uint64(10))  # a later round is larger
        np.minimum.at(out, np.repeat(todo, n) * t + place, value)
        todo = todo[(out.reshape(docs, t)[todo] == none).any(1)]
    return out.reshape(docs, t)


def band_hashes(rows: np.ndarray, bands: int) -> np.ndarray:
    parts = rows.reshape(len(rows), bands, -1)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(rows), bands)).copy()
    for j in range(parts.shape[2]):
        h = fold(h, parts[:, :, j])
    return h


def fingerprints(h: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """16 bytes for each set: equal for equal sets."""
    out = np.zeros((len(offsets) - 1, 2), np.uint64)
    size = np.diff(offsets)
    some = np.flatnonzero(size)
    if len(some):
        for j, c in enumerate((_C1, _C2)):
            out[some, j] = mix(np.add.reduceat(mix(h ^ c), offsets[:-1][some]) + size[some].astype(np.uint64))
    return [r.tobytes() for r in out]


def sketched(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, h (text hash), n (set size), fp, and bands (null for empty sets) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            for i, j, d, o in chunks(data, offsets):
                h, off = shingle_sets(d, o, k)
                size, hashes = np.diff(off), band_hashes(sketch(h, off, bands * rows), bands)
                found = [b.tobytes() if n else None for b, n in zip(hashes, size.tolist(), strict=True)]
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(size, pa.int64()), pa.array(fingerprints(h, off), pa.binary()), pa.array(found, pa.binary())], names=["doc_id", "h", "n", "fp", "bands"])

    return source.mapInArrow(run, f"doc_id {kind}, h long, n long, fp binary, bands binary")


class _Sets:
    """Sets as lists of members, and for each value the sets that hold it."""

    def __init__(self, texts, k: int):
        parts, sizes = [], []
        data, offsets = text_bytes(texts)
        for _, _, d, o in chunks(data, offsets):
            h, off = shingle_sets(d, o, k)
            parts.append(h)
            sizes.append(np.diff(off))
        self.size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        values = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        _, self.value = np.unique(values, return_inverse=True)
        self.first = np.concatenate(([0], np.cumsum(self.size)))
        order = np.argsort(self.value, kind="stable")
        self.holder = np.repeat(np.arange(len(self.size)), self.size)[order]
        self.at = np.searchsorted(self.value[order], np.arange(int(self.value.max(initial=-1)) + 2))

    def linked(self, i: int, percent: int) -> np.ndarray:
        """The sets whose similarity to set i is at least `percent` hundredths."""
        own = self.value[self.first[i] : self.first[i + 1]]
        lo, n = self.at[own], self.at[own + 1] - self.at[own]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - lo, n)
        common = np.bincount(self.holder[inner], minlength=len(self.size))
        return np.flatnonzero((100 * common >= percent * (self.size[i] + self.size - common)) & (common > 0))


def cluster(sets: _Sets, order: np.ndarray, percent: int) -> np.ndarray:
    """Labels of the exact clusters. A set in the largest cluster at its turn waits; passes go on
    until all sets that were never compared are in one cluster, the largest then: a pair of two
    such sets changes nothing, and any other pair has been seen from one of its sets."""
    label = np.arange(len(sets.size))
    seen = np.zeros(len(label), bool)
    first = True
    while True:
        before = seen.sum()
        for i in order:
            if seen[i]:
                continue
            if not first:
                count = np.bincount(label)
                if count.max() == len(label):
                    return label
                if label[i] == count.argmax():
                    continue
            seen[i] = True
            merge = np.unique(label[sets.linked(i, percent)])
            label[np.isin(label, merge)] = merge.min() if len(merge) else label[i]
            if first:
                break
        if not first and seen.sum() == before:  # the largest cluster stayed the same throughout this pass
            return label
        first = False


def similarity_groups(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, h (hash of the text), n_shingles and component_id (smallest doc_id that links reach) of every row.

    Documents with at least `percent` hundredths of their shingles in common are linked. A
    text of fewer than `k` words, but not none, is one shingle; one without words, or null,
    has none, is linked with nothing and is its own component. Equal rows are linked like any
    copies; null ids take part but are never a component's smallest unless all are null; an
    empty table gives an empty one; other columns aren't read. With 25 bands of 4 a pair at
    0.8 shares no bucket with a probability of 2e-6; what shares one is decided exactly.
    """
    return _classes(docs, k, percent, bands, rows).drop("comp")


def _classes(docs: DataFrame, k: int, percent: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The rows of similarity_groups with comp, the component's own key (null without words), as
    unrelated components can have the same smallest doc_id, or none."""
    known = stored(sketched(docs, k, bands, rows), "near-sketches")
    nodes = known.where("n > 0").groupBy("fp").agg(F.first("bands").alias("bands"), F.min(F.struct("doc_id", "h")).alias("row"), F.first("n").alias("n"))
    cut = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.substring(F.col("bands"), i * 8 + 1, F.lit(8)))
    placed = nodes.select("fp", F.explode(cut).alias("bucket"))
    buckets = placed.groupBy("bucket").agg(F.min("fp").alias("least"), F.count(F.lit(1)).alias("held")).where("held > 1")
    shared = stored(placed.join(buckets, "bucket"), "near-candidates")
    near = shared.groupBy("fp", "least").agg(F.sum("held").alias("held"))
    groups = components(near.select(F.col("fp").alias("a"), F.col("least").alias("b")))
    degree = near.groupBy("fp").agg(F.sum("held").alias("degree"))
    # a text for each node of a group
    wanted = groups.withColumnRenamed("node", "fp").withColumnRenamed("comp", "group").join(nodes.select("fp", "row", "n"), "fp").join(degree, "fp")
    wanted = wanted.select("group", "fp", "n", "degree", F.col("row.doc_id").alias("id"), F.col("row.h").alias("text_hash"))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    joined = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["id"]) & (texts["h"] == wanted["text_hash"]))
    members = stored(joined.select("group", "fp", "n", "degree", "text").dropDuplicates(["fp"]), "near-members")
    links = _links(members, shared.select("bucket", "fp"), k, percent)
    linked = components(links).withColumnRenamed("node", "fp")
    ids = known.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("least"))
    of_fp = ids.join(linked, "fp", "left").select("fp", F.coalesce("comp", "fp").alias("comp"), "least")
    of_comp = stored(of_fp.groupBy("comp").agg(F.min("least").alias("component_id")), "near-components")  # a side of its own, so that a hot component's join can be split
    classes = of_fp.join(of_comp, "comp").select("fp", "comp", "component_id")
    full = known.where("n > 0").join(classes, "fp", "left").select("doc_id", "h", F.col("n").alias("n_shingles"), "component_id", "comp")
    return full.unionByName(known.where("n = 0").select("doc_id", "h", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("binary").alias("comp")))


def _blocks(nodes: Column, members: Column) -> Column:
    """How many blocks hold so many nodes with so many shingles."""
    return F.greatest(F.ceil(nodes / BLOCK_NODES), F.ceil(members / BLOCK_MEMBERS))


def _links(members: DataFrame, shared: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b) that connect exactly what verified links connect; `shared` has the buckets (bucket, fp) of more than one node."""
    sized = stored(members.groupBy("group").agg(_blocks(F.count(F.lit(1)), F.sum("n")).alias("blocks")), "near-groups")
    large = sized.where("blocks > 1")
    leaders = members.select("group", "fp", "degree").join(large, "group").withColumn("place", F.row_number().over(Window.partitionBy("group").orderBy(F.desc("degree"), "fp"))).where(F.col("place") <= LEADERS)
    dealt = members.join(sized, "group").select("group", "fp", "text", "degree", F.pmod(F.xxhash64("fp"), F.col("blocks")).alias("block"))
    led = members.join(leaders.select("fp", "blocks"), "fp")
    led = led.select("group", "fp", "text", "degree", F.pmod(F.xxhash64("fp"), F.col("blocks")).alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    led = led.where("own <> block").drop("own")

    def within(table):
        fps = table.column("fp").to_pylist()
        if len(fps) < 2:
            return pa.table({"a": pa.array([], pa.binary()), "b": pa.array([], pa.binary())})
        label = cluster(_Sets(table.column("text"), k), np.argsort(-table.column("degree").to_numpy(), kind="stable"), percent)
        pairs = [(fps[i], fps[j]) for i, j in enumerate(label.tolist()) if i != j]
        return pa.table({"a": pa.array([a for a, _ in pairs], pa.binary()), "b": pa.array([b for _, b in pairs], pa.binary())})

    first = stored(dealt.unionByName(led).groupBy("group", "block").applyInArrow(within, "a binary, b binary"), "near-links")
    if large.isEmpty():
        return first
    # buckets of large groups that hold several clusters
    label = components(first).withColumnRenamed("node", "fp")
    some = members.select("group", "fp", "n").join(large.select("group"), "group").join(label, "fp", "left").select("fp", "n", F.coalesce("comp", "fp").alias("comp"))
    held = stored(shared.join(some, "fp"), "near-buckets")
    counts = held.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("nodes"), F.sum("n").alias("total"))
    mixed = counts.groupBy("bucket").agg(F.max_by("comp", F.struct("nodes", "comp")).alias("main"), F.max(F.struct("nodes", "comp", "total")).alias("most"), F.sum("nodes").alias("nodes"), F.sum("total").alias("total"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    turns = _blocks(F.col("nodes") - F.col("most.nodes"), F.col("total") - F.col("most.total"))
    mixed = stored(mixed.select("bucket", "main", _blocks(F.col("nodes"), F.col("total")).alias("blocks"), turns.alias("turns")), "near-mixed")
    if mixed.isEmpty():
        return first
    met = held.join(mixed, "bucket").select("bucket", "fp", "comp", (F.col("comp") != F.col("main")).alias("asks"), "blocks", "turns")
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    asks = met.where("asks").select("bucket", "fp", "comp", "asks", F.pmod(F.xxhash64("fp"), F.col("turns")).alias("turn"), F.explode(every("blocks")).alias("block"))
    answers = met.select("bucket", "fp", "comp", F.lit(False).alias("asks"), F.explode(every("turns")).alias("turn"), F.pmod(F.xxhash64("fp"), F.col("blocks")).alias("block"))
    tiles = asks.unionByName(answers).join(members.select("fp", "text"), "fp")

    def across(table):
        fps, comps, asking = table.column("fp").to_pylist(), table.column("comp").to_pylist(), table.column("asks").to_numpy(zero_copy_only=False)
        out = {}
        if asking.any() and not asking.all():
            sets = _Sets(table.column("text"), k)
            for i in np.flatnonzero(asking).tolist():
                for j in sets.linked(i, percent).tolist():
                    if comps[i] != comps[j]:
                        out.setdefault((comps[i], comps[j]), None)
        return pa.table({"a": pa.array([a for a, _ in out], pa.binary()), "b": pa.array([b for _, b in out], pa.binary())})

    second = stored(tiles.groupBy("bucket", "turn", "block").applyInArrow(across, "a binary, b binary"), "near-links")
    return first.unionByName(second)


def deduplicate(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One document of each group of near-duplicates, with the columns of `docs`: the one with the
    smallest doc_id, null only if all are (of a group's rows that share it, that of smallest text
    hash, and of equal ones that of smallest row hash, once). Unrelated texts with one id, or without ids, are groups of their own. Texts
    without words, null ones among them, all stay; an empty table stays empty."""
    found = _classes(docs, k, percent)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "h"))
    linked = found.where("n_shingles > 0").groupBy("comp").agg(first.alias("row")).select("row.doc_id", "row.h")
    some = found.where("n_shingles = 0").select("doc_id", "h").distinct()
    single, word, key, turn = (fresh(docs, c) for c in ("doc", "wordless", "texthash", "turn"))
    rows = docs.select(F.struct("*").alias(single), F.col("doc_id"), F.xxhash64("text").alias(key))
    chosen = linked.withColumn(word, F.lit(False)).unionByName(some.withColumn(word, F.lit(True))).withColumnRenamed("doc_id", "id")
    hashed = F.xxhash64(*[F.col(f"{single}.`{c}`") for c, t in docs.dtypes if "map<" not in t])
    joined = rows.join(chosen, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col(key) == F.col("h")))
    place = F.row_number().over(Window.partitionBy("id", "h", word).orderBy(hashed))
    return joined.withColumn(turn, place).where(F.col(word) | (F.col(turn) == 1)).select(f"{single}.*")


def op4_near_duplicates(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = similarity_groups(docs, 4, 80)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, list_slice(w, j, j + 3) AS g FROM d, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS u(j) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
SELECT a AS doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(b) AS component_id, min(b) = a AS kept FROM reach LEFT JOIN n ON n.doc_id = a GROUP BY a
"""
