"""WARC archives, compressed with Zstandard: one frame per record, the dictionary in a leading skippable frame.

Writing and reading both run on the executors. A worker writes its archives under the folder that all of them share and
reports them in a manifest; only archives of attempts that ended well are in the manifest, so a retried task leaves at
most files that nobody reads.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.shared import grouped, materialize, narrow, partitions, rows, shared_path

# Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
FRAME = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")

RECORDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


@dataclass(frozen=True)
class WarcParams:
    min_bytes: int = 0  # smaller payloads are always written in full
    archive_bytes: int = 16 << 20  # an archive is closed when it has reached this size
    dictionary_bytes: int = 32 << 10
    sample_bytes: int = 2 << 20  # of an archive's first records, for its dictionary
    level: int = 3
    date: str = "1970-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_uri(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _clean(value: str | None) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value or "")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record: a response with its payload, or a revisit that has the HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_uri(page_id)}", f"WARC-Date: {date}", f"Content-Length: {len(block)}", "Content-Type: application/http; msgtype=response"]
    head += [f"WARC-Target-URI: {_clean(url)}"] if url is not None else []
    head += [f"WARC-Page-ID: {page_id}"] if page_id is not None else []
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}"]
    head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_uri(refers_to)}", f"WARC-Refers-To-Page-ID: {refers_to}"] if revisit else []
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(samples: list[bytes], size: int) -> zstandard.ZstdCompressionDict:
    """A trained dictionary; of samples too few or too alike for training, their own bytes."""
    try:
        return zstandard.train_dictionary(min(size, max(256, sum(map(len, samples)) // 8)), samples, level=3)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-size:] or b"\0" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def skippable(content: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE, len(content)) + content


class ArchiveWriter:
    """Holds the first records until there is a sample, then compresses each record into a frame of its own."""

    def __init__(self, params: WarcParams):
        self.params, self.waiting, self.frames, self.size, self.records = params, [], [], 0, 0
        self.compress, self.held = None, 0

    def add(self, raw: bytes) -> bool:
        """True once the archive is large enough to be closed."""
        self.records += 1
        if self.compress is None:
            self.waiting.append(raw)
            self.held += len(raw)
            if self.held >= self.params.sample_bytes:
                self._start()
        else:
            self._put(self.compress(raw))
        return self.size >= self.params.archive_bytes

    def _put(self, frame: bytes) -> None:
        self.frames.append(frame)
        self.size += len(frame)

    def _start(self) -> None:
        made = dictionary(self.waiting, self.params.dictionary_bytes)
        self.compress = zstandard.ZstdCompressor(level=self.params.level, dict_data=made, write_content_size=True, write_checksum=True).compress
        self._put(skippable(made.as_bytes()))
        for raw in self.waiting:
            self._put(self.compress(raw))
        self.waiting = []

    def done(self) -> bytes:
        if self.compress is None:
            self._start()
        return b"".join(self.frames)


def frames(source, chunk: int = 1 << 16) -> Iterator[bytes]:
    """The records of an open archive: the dictionary of the leading skippable frame, then a record per frame."""
    data = source.read(8)
    magic, size = struct.unpack("<II", data) if len(data) == 8 else (0, 0)
    if magic != SKIPPABLE:
        raise ValueError("no leading dictionary frame")
    content = source.read(size)
    if len(content) != size:
        raise ValueError("the dictionary frame is cut short")
    if content[:4] == FRAME:
        content = zstandard.ZstdDecompressor().decompress(content)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
    data = source.read(chunk)
    while data:
        frame, parts = reader.decompressobj(), []
        while not frame.eof:
            if not data:
                raise ValueError("the last frame is cut short")
            parts.append(frame.decompress(data))
            data = frame.unused_data if frame.eof else source.read(chunk)
        yield b"".join(parts)
        data = data or source.read(chunk)


def parse(raw: bytes) -> dict:
    """Validates a record's version, mandatory headers, lengths and digests; its values."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or lines[0] != VERSION:
        raise ValueError(f"not a WARC/1.1 record: {raw[:40]!r}")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError(f"a header without a colon: {line[:80]!r}")
        fields[name.decode().lower()] = value.strip().decode()
    if missing := [name for name in MANDATORY if name not in fields]:
        raise ValueError(f"headers missing: {missing}")
    size = int(fields["content-length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != b"\r\n\r\n":
        raise ValueError("the block's length differs from Content-Length")
    if fields.get("warc-block-digest", "") not in ("", f"sha1:{digest(block)}"):
        raise ValueError("the block differs from its digest")
    http, mark, payload = block.partition(b"\r\n\r\n")
    length = [int(x.split(b":", 1)[1]) for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")]
    if not mark or len(length) != 1:
        raise ValueError("the block is no HTTP response with one Content-Length")
    kind, told = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and (len(payload) != length[0] or digest(payload) != told):
        raise ValueError("the payload differs from its length or digest")
    if kind == "revisit" and (payload or "warc-refers-to" not in fields):
        raise ValueError("a revisit has a payload or refers to nothing")
    number = lambda name: int(fields[name]) if name in fields else None
    return {"page_id": number("warc-page-id"), "url": fields.get("warc-target-uri"), "payload_bytes": length[0], "payload_digest": told, "record_type": kind, "refers_to": number("warc-refers-to-page-id"), "payload": payload if kind == "response" else None}


def write(pages: DataFrame, params: WarcParams = WarcParams()) -> DataFrame:
    """Writes a record per row of ``pages`` (page_id, url, html); a manifest row (archive, records, bytes) per archive.

    Equal payloads of ``min_bytes`` or more: the rows with the largest page_id are responses, the others revisit it.
    Null html: an empty payload. Null url: no target header. A null page_id counts as the smallest and repeated rows are
    each written. Empty table: no archives.
    """
    spark = pages.sparkSession
    base = narrow(pages, "page_id", "url", "html").withColumn("digest", F.sha1("html"))
    large = F.octet_length("html") >= params.min_bytes
    # Only digests that occur twice or more are joined back, salted so that a hot payload's rows spread.
    salts = 16
    keepers = base.where(large).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1 and keeper is not null")
    keepers = keepers.select("digest", "keeper", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    joined = base.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")).join(keepers, ["digest", "salt"], "left")
    refers = F.when(large & F.coalesce(F.col("page_id") < F.col("keeper"), F.col("keeper").isNotNull()), F.col("keeper"))
    folder = shared_path(spark, "warc")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, root = fs.FileSystem.from_uri(folder)
        place.create_dir(root, recursive=True)
        context = TaskContext.get()
        schema, writer, made = pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]), ArchiveWriter(params), 0

        def close() -> pa.RecordBatch:
            name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}-{made:04d}.warc.zst"
            content = writer.done()
            with place.open_output_stream(f"{root}/{name}") as out:
                out.write(content)
            return rows(schema, [[f"{folder}/{name}"], [writer.records], [len(content)]])

        for batch in grouped(batches, "html", 8 << 20):
            for page_id, url, html, keeper in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers")]):
                if writer.add(record(page_id, url, html.encode(), keeper, params.date)):
                    yield close()
                    writer, made = ArchiveWriter(params), made + 1
        if writer.records:
            yield close()

    return materialize(joined.select("page_id", "url", "html", refers.alias("refers")).mapInArrow(task, "archive string, records long, bytes long"), "warc-manifest")


def read(manifest: DataFrame, *, payload: bool = False) -> DataFrame:
    """The records of the archives in a manifest, each validated; a broken archive fails the job with the reason."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, expected in zip(batch.column("archive").to_pylist(), batch.column("records").to_pylist()):
                place, path = fs.FileSystem.from_uri(archive)
                out, held, seen = [], 0, 0
                with place.open_input_stream(path) as source:
                    for raw in frames(source):
                        seen += 1
                        out.append(parse(raw))
                        held += len(raw) if payload else 64
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(out, schema=RECORDS)
                            out, held = [], 0
                if seen != expected:
                    raise ValueError(f"{archive} has {seen} records, not {expected}")
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=RECORDS)

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in task(batches):
            yield batch.select(RECORDS.names[:-1])

    columns = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    spread = manifest.repartition(partitions(manifest.sparkSession), "archive")
    return spread.mapInArrow(task, columns + ", payload binary") if payload else spread.mapInArrow(lean, columns)


def round_trip(pages: DataFrame, params: WarcParams = WarcParams()) -> DataFrame:
    """Writes the archives and reads them back."""
    return read(write(pages, params))
