"""Dictionary-compressed WARC archives.

A Zstandard dictionary is trained on a bounded sample of the records. Every archive
opens with a skippable frame that holds the dictionary (itself compressed); every
record follows as a frame of its own, compressed with it, so that any record can be
read by its offset. Of equal payloads one is a response and the others revisit it.
"""

from __future__ import annotations

import base64
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, stored

SKIPPABLE = 0x184D2A5D  # the frame that carries a dictionary (fixed value of the format)
SAMPLE_RECORDS = 1000  # the dictionary learns from so many records at most,
SAMPLE_BYTES = 64 << 10  # none of them larger than this,
DICTIONARY_BYTES = 64 << 10  # and has this size
ARCHIVE_BYTES = 64 << 20
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace (fixed value)


def with_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html and `refers_to`: null for a response, else the smallest page_id with the same payload.

    Payloads are equal if their lengths and SHA-1 are. Below `least` bytes all are responses.
    Rows that share the smallest page_id and the payload are responses both; null ids are
    never referred to. The hot digest of many copies is reduced before the shuffle, and the
    join's large side is one that adaptive execution can split.
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    pages = pages.select("page_id", "url", html.alias("html"), F.octet_length(html).alias("n"), F.sha1(html).alias("sha"))
    first = pages.where(F.col("n") >= least).groupBy("n", "sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    joined = pages.join(first, ["n", "sha"], "left")
    return joined.select("page_id", "url", "html", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to"))


def record_uri(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, str(page_id))}>"


def digest(payload: bytes) -> str:
    import hashlib

    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def warc_record(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    """A response or revisit record; a revisit keeps the full payload's length and digest, not its bytes."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_uri(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_uri(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers, HTTP head and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


def train_dictionary(pages: DataFrame, records: int = SAMPLE_RECORDS, largest: int = SAMPLE_BYTES, size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from at most `records` records; empty where there is too little to learn from."""
    import zstandard

    fits = pages.where(F.octet_length("html") <= largest)
    order = F.xxhash64("page_id", "url")
    chosen = F.broadcast(fits.select(order.alias("o")).orderBy("o").limit(records).distinct())  # at most `records` hashes
    rows = fits.join(chosen, order == F.col("o")).select("page_id", "url", F.col("html").cast("binary"), "o").orderBy("o").limit(records).collect()
    samples = [warc_record(r[0], r[1], bytes(r[2]), None) for r in rows]
    if len(samples) < 8 or sum(map(len, samples)) < 8 * 1024:
        return b""
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, samples)) // 4), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


class ArchiveWriter:
    """Archives of one task, a new one when the last has `ARCHIVE_BYTES`."""

    def __init__(self, prefix: str, dictionary: bytes):
        import zstandard

        self.system, self.prefix = fs.FileSystem.from_uri(prefix)
        self.system.create_dir(self.prefix.rpartition("/")[0], recursive=True)
        self.dictionary = zstandard.ZstdCompressor(level=19).compress(dictionary)
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=True, write_checksum=True)
        self.done: list[tuple[str, int]] = []
        self.out, self.size, self.records = None, 0, 0

    def add(self, record: bytes) -> None:
        if self.out is None:
            self.tmp = f"{self.prefix}.{uuid.uuid4().hex}"
            self.out = self.system.open_output_stream(self.tmp, compression=None)
            self.out.write(struct.pack("<II", SKIPPABLE, len(self.dictionary)) + self.dictionary)
            self.size = self.records = 0
        frame = self.compressor.compress(record)
        self.out.write(frame)
        self.size, self.records = self.size + len(frame), self.records + 1
        if self.size >= ARCHIVE_BYTES:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            name = f"{self.prefix}-{len(self.done):04d}.warc.zst"
            self.system.move(self.tmp, name)
            self.done.append((name.rpartition("/")[2], self.records))
            self.out = None


def read_archive(path: str) -> Iterator[bytes]:
    """The records of an archive, one after another."""
    import zstandard

    system, name = fs.FileSystem.from_uri(path)
    with system.open_input_stream(name, compression=None) as f:
        magic, n = struct.unpack("<II", f.read(8))
        if magic != SKIPPABLE:
            raise ValueError(f"{path} doesn't begin with a dictionary")
        dictionary = zstandard.ZstdDecompressor().decompress(f.read(n))
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        tool, rest, record, frame = zstandard.ZstdDecompressor(dict_data=known), b"", [], None
        while data := rest or f.read(1 << 20):
            frame = frame or tool.decompressobj()
            record.append(frame.decompress(data))
            rest = frame.unused_data if frame.eof else b""
            if frame.eof:
                yield b"".join(record)
                record, frame = [], None
        if frame is not None:
            raise ValueError(f"{path} is cut off")


def write_archives(pages: DataFrame, out_dir: str, least: int = 0) -> DataFrame:
    """Write a record for every row of `pages` (page_id, url, html; null html is empty); (archive, records), the
    archives' names and counts, from a stored table.

    An empty table writes none; repeated rows are records each; other columns aren't read.
    """
    marked = with_revisits(pages, least)
    dictionary = train_dictionary(pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        for batch in batches:
            if batch.num_rows and writer is None:
                writer = ArchiveWriter(f"{out_dir}/part-{TaskContext.get().partitionId():06d}", dictionary)
            for k in range(batch.num_rows):
                page_id, url, html, refers_to = (c[k].as_py() for c in batch.columns)
                writer.add(warc_record(page_id, url, html, refers_to))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"archive": [n for n, _ in writer.done], "records": [n for _, n in writer.done]})

    return stored(marked.mapInArrow(write, "archive string, records long"), "warc-archives")


def read_archives(out_dir: str, archives: DataFrame, id_type: str = "long") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record of `archives`, which are
    dealt to as many tasks; an archive with another number of records than stated is an error.

    A response's length and digest are those of the payload read; a revisit's are those its headers state.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, n = [], 0
                for data in read_archive(f"{out_dir}/{name}"):
                    h, http, payload = parse_record(data)
                    told, kind = h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"]
                    size = int(http.rpartition(b"Content-Length: ")[2])
                    if kind == "response" and (len(payload), digest(payload)) != (size, told):
                        raise ValueError(f"{name}: a payload differs from its digest")
                    n += 1
                    rows.append((h["X-Page-ID"] or None, size, told, kind, h.get("X-Refers-To-Page-ID")))
                    if len(rows) == 2000:
                        yield _rows(rows)
                        rows = []
                if n != count:
                    raise ValueError(f"{name}: {n} records instead of {count}")
                if rows:
                    yield _rows(rows)

    out = archives.repartition(max(archives.count(), 1), "archive").mapInArrow(read, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return out.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def op9_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    out_dir = shared_dir(spark, "warc")
    return read_archives(out_dir, write_archives(pages, out_dir), pages.schema["page_id"].dataType.simpleString())


OP9_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT page_id, strlen(html) AS n, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first_id FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
 array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
 CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
