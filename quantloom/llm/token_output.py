"""Token ids as Arrow files of equal-length sequences.

Documents are range-partitioned by id; every partition encodes its documents in order
into one Arrow IPC file, whose record batches hold fixed-size lists: `tokens` (uint16
where the vocabulary allows, else uint32) and `mask` (false for the padding behind the
last id). All batches but the last have the same number of sequences, so the place of
any id follows from arithmetic and a memory-mapped file gives it without a copy. A
second file beside it lists the documents: id, start in the part, number of ids. A stored
table has a row for each part, and window sums over it give the part's place among all ids.

Byte-level vocabularies split a text at places that a few bytes around them decide: around
added tokens, before the last character of white space between other characters, and
between ASCII letters, digits and punctuation. A run of documents is cut there at once;
every distinct piece is encoded by the tokenizer once and remembered, and the ids of all
pieces are gathered as arrays.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs, ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, parts_for, shared_dir, stored, text_bytes, total_bytes

LENGTH = 2048
BATCH_SEQUENCES = 256
PART_BYTES = 48 << 20
RUN_BYTES = 6 << 20  # text that is cut and encoded at once
REMEMBERED = 1_000_000  # pieces, in each Python worker
LONGEST = 64  # bytes of a piece that is remembered
END_ID = 2

#: 1 letter, 2 digit, 3 punctuation, 0 for what isn't cut from its neighbours: other bytes, and the apostrophe of contractions.
_CLASS = np.zeros(256, np.uint8)
_CLASS[33:127] = 3
_CLASS[48:58] = 2
_CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[39] = 0
_WHITE = np.zeros(256, bool)
_WHITE[9:14] = _WHITE[32] = True
#: First bytes of characters none of which is white space.
_SOLID = np.zeros(256, bool)
_SOLID[33:127] = _SOLID[0xC3:0xF5] = True
_SOLID[[0xE1, 0xE2, 0xE3]] = False


def _cuts(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Whether the text may be cut before a byte: at `edges` (of documents and added tokens) and where the tokenizer splits whatever stands around."""
    n = len(data)
    cut = np.zeros(n + 1, bool)
    if n:
        kind = _CLASS[data]
        before, here = kind[:-1], kind[1:]
        cut[1:n] = (before != here) & (before > 0) & (here > 0)
        white = np.zeros(n + 2, bool)
        white[1:-1] = _WHITE[data]
        edge = np.zeros(n + 1, bool)
        edge[edges] = True
        begin = np.flatnonzero(white[1:] & (edge | ~white[:-1]))
        end = np.flatnonzero(white[:-1] & (edge | ~white[1:]))
        own = ~edge[begin] & ~edge[end]
        begin, end = begin[own], end[own]
        # a character above ASCII that ends before the run may be white space if its lead byte is one of four
        last = data[begin - 1]
        lead2, lead3 = data[np.maximum(begin - 2, 0)], data[np.maximum(begin - 3, 0)]
        solid = np.where(last < 128, _SOLID[last], (lead2 != 0xC2) & ~((lead3 >= 0xE1) & (lead3 <= 0xE3)))
        own = solid & _SOLID[data[end]]
        begin, end = begin[own], end[own]
        cut[begin] = cut[end - 1] = True  # the last one goes on its own, a space with what follows
        cut[end[data[end - 1] != 32]] = True
    cut[edges] = True
    return cut


class Encoder:
    """Ids of whole texts, with a memory of pieces; the same as `Tokenizer.encode(text, add_special_tokens=False)`."""

    def __init__(self, path: str, dtype: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype, self.end_id = Tokenizer.from_file(path), np.dtype(dtype), end_id
        added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = re.compile(b"|".join(re.escape(t.encode()) for t in added)) if added else None
        self.spaced = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.spaced[[i for t, i in self.tokenizer.get_vocab().items() if t[0] == "\u0120"]] = True  # how byte-level vocabularies write a space
        self._forget()

    def _forget(self) -> None:
        self.memory: dict[bytes, int] = {}
        self.ids = np.array([self.end_id], self.dtype)  # entry 0: the end of a document
        self.first, self.size = np.zeros(1, np.int64), np.ones(1, np.int64)

    def _encode(self, pieces: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """An order of the pieces, their ids one after another in it, and how many each has.

        Pieces of a space and other characters are encoded as one text, which is cut before every id that begins with a space."""
        texts = [p.decode() for p in pieces]
        plain = [i for i, t in enumerate(texts) if t[0] == " " and len(t) > 1 and t.rfind(" ") == 0 and not t[-1].isspace()]
        chosen = set(plain)
        other = [i for i in range(len(texts)) if i not in chosen]
        order, ids, sizes = [], [], []
        for i in range(0, len(plain), 4000):
            part = plain[i : i + 4000]
            found = np.array(self.tokenizer.encode_batch_fast(["".join([texts[j] for j in part])], add_special_tokens=False)[0].ids, self.dtype)
            at = np.flatnonzero(self.spaced[found])
            if len(at) == len(part):
                order += part
                ids.append(found)
                sizes.append(np.diff(at, append=len(found)))
            else:
                other += part
        for i in range(0, len(other), 4000):
            part = other[i : i + 4000]
            found = [e.ids for e in self.tokenizer.encode_batch_fast([texts[j] for j in part], add_special_tokens=False)]
            order += part
            ids.append(np.array([x for e in found for x in e], self.dtype))
            sizes.append(np.array([len(e) for e in found], np.int64))
        return order, np.concatenate(ids), np.concatenate(sizes)

    def _added_tokens(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Starts and ends of the added tokens in the documents, a row each."""
        found: list[tuple[int, int]] = []
        if self.added is not None:
            text = data.tobytes()
            if self.added.search(text):
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    found += [(a + x.start(), a + x.end()) for x in self.added.finditer(text[a:b])]
        return np.array(found, np.int64).reshape(-1, 2)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a run of documents one after another, each followed by the end, and how many each has."""
        if len(self.memory) > REMEMBERED:
            self._forget()
        added = self._added_tokens(data, offsets)
        cut = _cuts(data, np.append(offsets, added))
        for a, b in added.tolist():
            cut[a + 1 : b] = False
        starts = np.flatnonzero(cut)
        ids, first, size, index = self.ids, self.first, self.size, np.zeros(0, np.int64)
        if len(starts) > 1:
            pieces = pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
            words = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
            get = self.memory.get
            entry = np.array([get(w, -1) for w in words], np.int64)
            new = np.flatnonzero(entry < 0)
            if len(new):
                order, more, sizes = self._encode([words[i] for i in new.tolist()])
                new = new[order]
                entry[new] = len(size) + np.arange(len(new))
                first = np.concatenate([first, len(ids) + np.cumsum(sizes) - sizes])
                ids, size = np.concatenate([ids, more]), np.concatenate([size, sizes])
                self.ids, self.first, self.size = ids, first, size
                self.memory.update([(words[i], j) for i, j in zip(new.tolist(), entry[new].tolist(), strict=True) if len(words[i]) <= LONGEST])
            index = entry[pieces.indices.to_numpy()]
        last = np.searchsorted(starts, offsets[1:])
        index = np.insert(index, last, 0)
        counts = size[index]
        ends = np.cumsum(counts)
        out = ids[np.repeat(first[index] - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)]
        if len(self.ids) > REMEMBERED * 16:  # long pieces' ids stay only so long
            self._forget()
        return out, np.diff(ends[last + np.arange(len(last))], prepend=0)


_encoders: dict[tuple, Encoder] = {}


def _encoder(path: str, dtype: str, end_id: int) -> Encoder:
    if (path, dtype, end_id) not in _encoders:
        _encoders.clear()
        _encoders[path, dtype, end_id] = Encoder(path, dtype, end_id)
    return _encoders[path, dtype, end_id]


def byte_level(path: str) -> bool:
    """Whether the tokenizer is a byte-level one whose texts may be cut: no normalizer, added tokens that match as they stand."""
    with open(path) as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    plain = all(t["content"] and not (t["single_word"] or t["lstrip"] or t["rstrip"]) for t in spec.get("added_tokens") or [])
    return plain and not spec.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and bool(pre.get("use_regex", True))


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def part_path(out_dir: str, part: int) -> str:
    return f"{out_dir}/part-{part:06d}"


class TokenWriter:
    """One part: sequences and document list, moved to their names when they are complete."""

    def __init__(self, path: str, dtype: str, length: int, id_type: pa.DataType):
        self.system, self.path = _open(path)
        self.system.create_dir(os.path.dirname(self.path), recursive=True)
        self.tmp = f"{self.path}.{uuid.uuid4().hex}"
        self.dtype, self.length = np.dtype(dtype), length
        value = pa.from_numpy_dtype(self.dtype)
        self.schema = pa.schema([("tokens", pa.list_(value, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.docs_schema = pa.schema([("doc_id", id_type), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.files = [self.system.open_output_stream(f"{self.tmp}{x}") for x in (".arrow", ".docs.arrow")]
        self.tokens = ipc.new_file(self.files[0], self.schema)
        self.docs = ipc.new_file(self.files[1], self.docs_schema)
        self.rest, self.total, self.n_docs = np.zeros(0, self.dtype), 0, 0

    def _batch(self, data: np.ndarray, valid: int) -> None:
        mask = pa.array(np.arange(len(data)) < valid)
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(data), self.length), pa.FixedSizeListArray.from_arrays(mask, self.length)]
        self.tokens.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def add(self, ids: pa.Array, tokens: np.ndarray, counts: np.ndarray) -> None:
        starts = self.total + np.cumsum(counts) - counts
        self.docs.write_batch(pa.RecordBatch.from_arrays([ids, pa.array(starts), pa.array(counts)], schema=self.docs_schema))
        self.total += len(tokens)
        self.n_docs += len(counts)
        rest = np.concatenate([self.rest, tokens])
        size = self.length * BATCH_SEQUENCES
        whole = len(rest) // size * size
        for i in range(0, whole, size):
            self._batch(rest[i : i + size], size)
        self.rest = rest[whole:].copy()

    def close(self) -> None:
        data = self.rest
        if len(data):
            padded = np.zeros(-(-len(data) // self.length) * self.length, self.dtype)
            padded[: len(data)] = data
            self._batch(padded, len(data))
        for x in (self.tokens, self.docs, *self.files):
            x.close()
        for x in (".docs.arrow", ".arrow"):
            self.system.move(f"{self.tmp}{x}", f"{self.path}{x}")


class TokenFile:
    """Random access to the ids of one part."""

    def __init__(self, path: str):
        system, name = _open(path)
        local = isinstance(system, fs.LocalFileSystem)
        source = lambda x: pa.memory_map(f"{name}{x}") if local else system.open_input_file(f"{name}{x}")
        self.file = ipc.open_file(source(".arrow"))
        self.documents = ipc.open_file(source(".docs.arrow"))
        self.length = self.file.schema.field("tokens").type.list_size
        self.span = self.length * BATCH_SEQUENCES
        self._at, self._flat = -1, np.zeros(0)

    def _batch(self, k: int) -> np.ndarray:
        if k != self._at:
            self._at, self._flat = k, self.file.get_batch(k).column(0).flatten().to_numpy(zero_copy_only=True)
        return self._flat

    def ids(self, start: int, n: int) -> np.ndarray:
        out, end = [], start + n
        while start < end:
            k, at = divmod(start, self.span)
            part = self._batch(k)[at : at + end - start]
            out.append(part)
            start += len(part)
        return out[0] if len(out) == 1 else np.concatenate(out or [np.zeros(0, np.uint16)])


def write_tokens(docs: DataFrame, out_dir: str, tokenizer: str, end_id: int = END_ID, length: int = LENGTH, part_bytes: int = PART_BYTES) -> DataFrame:
    """Write all texts of `docs` below `out_dir` in ascending doc_id order (null first, then
    by text); returns (part, n_docs, n_tokens) of every part that has any, from a stored table.

    A null text is an empty one, whose only id is the end; equal ids are ordered by their
    text; equal rows are written each; other columns, whatever their names, aren't read; of an
    empty table no part is written. A part is encoded run by run, in bounded memory.
    """
    spark = docs.sparkSession
    dtype = "<u2" if max(vocabulary_size(tokenizer), end_id + 1) <= 1 << 16 else "<u4"
    if not byte_level(tokenizer):
        raise ValueError("the tokenizer must be byte-level, without normalizer and with plain added tokens")
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = docs.repartitionByRange(parts_for(spark, total_bytes(docs), part_bytes), *keys).sortWithinPartitions(*keys, "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, writer, encode = TaskContext.get().partitionId(), None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                encode = _encoder(tokenizer, dtype, end_id)
                writer = TokenWriter(part_path(out_dir, part), dtype, length, batch.schema.field(0).type)
            for i, j, data, offsets in chunks(*text_bytes(batch.column(1)), RUN_BYTES):
                writer.add(batch.column(0).slice(i, j - i), *encode(data, offsets))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "n_docs": [writer.n_docs], "n_tokens": [writer.total]})

    return stored(ordered.mapInArrow(write, "part long, n_docs long, n_tokens long"), "token-parts")


def _placed(parts: DataFrame) -> DataFrame:
    """Every part with `before`, the ids of all parts before it: sums within a thousand parts, and over the thousands."""
    shelf = F.floor(F.col("part") / 1000)
    shelves = parts.groupBy(shelf.alias("shelf")).agg(F.sum("n_tokens").alias("shelf_tokens"))
    earlier = Window.orderBy("shelf").rowsBetween(Window.unboundedPreceding, -1)  # a row for each thousand parts, 48 GB of text
    shelves = shelves.select("shelf", F.coalesce(F.sum("shelf_tokens").over(earlier), F.lit(0)).alias("shelf_before"))
    within = Window.partitionBy("shelf").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("shelf", shelf).withColumn("own_before", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return placed.join(shelves, "shelf").select("part", (F.col("own_before") + F.col("shelf_before")).alias("before"))


def read_documents(out_dir: str, parts: DataFrame, id_type: str = "long") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files of `parts`."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = TokenFile(part_path(out_dir, part))
                for j in range(file.documents.num_record_batches):
                    d = file.documents.get_batch(j)
                    starts, counts = d.column(1).to_numpy(), d.column(2).to_numpy()
                    sums = [zlib.crc32(file.ids(s, n).astype("<u4")) for s, n in zip(starts.tolist(), counts.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([d.column(0), pa.array(starts + before), d.column(2), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = _placed(parts).repartition(max(parts.count(), 1), "part")
    return spread.mapInArrow(read, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def public_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_files(docs: DataFrame, tokenizer: str | None = None, out_dir: str | None = None, length: int = LENGTH) -> DataFrame:
    """Write the token files of `docs` to a new shared folder (or `out_dir`), and read back their documents."""
    spark = docs.sparkSession
    out_dir = out_dir or shared_dir(spark, "tokens")
    parts = write_tokens(docs, out_dir, tokenizer or public_tokenizer(), length=length)
    return read_documents(out_dir, parts, docs.schema["doc_id"].dataType.simpleString())


def op7_token_ids(spark, sf_dir: str) -> DataFrame:
    return token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"))
