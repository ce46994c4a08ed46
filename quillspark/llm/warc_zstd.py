"""WARC archives of pages, compressed record by record with a Zstandard dictionary of their own.

Each archive begins with a skippable frame that holds the dictionary, built from records of this archive;
each record is one frame compressed with it, so any record can be read alone. A page whose payload an
earlier page has is a revisit record without the payload, which names the page it repeats.

Archives are written by tasks to a folder that all executors share. A file's name holds the attempt of the
task and appears when the file is whole; the manifest lists the files of the attempts that Spark committed, so
a task that runs again, or twice at a time, neither replaces nor doubles a record.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, shared_dir, split_join

# Fixed values of the format.
_SKIPPABLE = 0x184D2A5D
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Settings:
    """An archive is closed at ``archive_bytes`` of records; its dictionary (``dictionary_bytes`` at most) is
    built from evenly spaced records of ``sample_bytes`` in all. Payloads below ``least_bytes`` are always
    responses."""

    archive_bytes: int = 24 << 20
    dictionary_bytes: int = 64 << 10
    sample_bytes: int = 1 << 20
    least_bytes: int = 0
    level: int = 3
    broadcast_rows: int = 200_000


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=chr(47) + ':?#[]@!$&()*+,;=%~.-_' + chr(39))}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block += payload if refers_to is None else b""
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by name, and the payload behind the HTTP header."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def dictionary(records: list[bytes], s: Settings) -> bytes:
    """A dictionary built from evenly spaced records; of too few to learn from, it is their beginnings."""
    total = sum(map(len, records))
    step = max(1, -(-total // s.sample_bytes))
    some, size = [r[: s.dictionary_bytes] for r in records[::step]], min(s.dictionary_bytes, max(256, total // 16))
    try:
        return zstandard.train_dictionary(size, some, level=s.level, k=256, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(r[: max(64, size // len(some))] for r in some)[:size]


def pack(records: list[bytes], s: Settings) -> Iterator[bytes]:
    """The bytes of an archive: dictionary frame, then a frame for each record."""
    data = dictionary(records, s)
    yield struct.pack("<II", _SKIPPABLE, len(data)) + data
    packer = zstandard.ZstdCompressor(level=s.level, dict_data=zstandard.ZstdCompressionDict(data), write_content_size=True)
    for r in records:
        yield packer.compress(r)


def unpack(stream) -> Iterator[bytes]:
    """Records of an archive, read in pieces: one record and one piece are in memory at a time."""
    buffer, data, piece = b"", None, 1 << 20
    buffer = stream.read(8)
    if len(buffer) == 8 and struct.unpack("<I", buffer[:4])[0] == _SKIPPABLE:
        data = zstandard.ZstdCompressionDict(stream.read(struct.unpack("<I", buffer[4:])[0]))
        buffer = b""
    opener = zstandard.ZstdDecompressor(dict_data=data) if data else zstandard.ZstdDecompressor()
    while True:
        if not buffer:
            buffer = stream.read(piece)
            if not buffer:
                return
        one, out = opener.decompressobj(), []
        while True:
            out.append(one.decompress(buffer))
            if one.eof:
                buffer = one.unused_data
                break
            buffer = stream.read(piece)
            if not buffer:
                raise ValueError("the archive ends within a record")
        yield b"".join(out)


def first_of_equals(spark: SparkSession, pages: DataFrame, s: Settings) -> DataFrame:
    """sha1, refers_to (least page_id) of the payloads that several pages have; payloads are not shuffled."""
    keys = pages.select("page_id", "sha1", "payload_bytes").where(F.col("payload_bytes") >= s.least_bytes)
    groups = keys.groupBy("sha1", "payload_bytes").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last"))
    return materialise(spark, groups.where("refers_to < last").select("sha1", "refers_to"), "payload-groups")


def write_archives(spark: SparkSession, pages: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Writes all pages; path, records, bytes of each archive. ``pages``: page_id, url, html.

    A null html is an empty payload, a null url an empty one; characters a header can't hold are
    percent-encoded. Rows that repeat a page_id and payload are all written, the payload with each; a page
    without a page_id is always a response. An empty table gives no archive. Other columns are not read.
    """
    html = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("payload"))
    rows = rows.withColumns({"sha1": F.sha1("payload"), "payload_bytes": F.octet_length("payload")})
    # an empty or common page is dealt to many tasks
    rows = split_join(spark, rows, first_of_equals(spark, rows, s), "sha1", "page_id", s.broadcast_rows, "left", counted=rows.select("sha1"))
    rows = rows.withColumn("refers_to", F.when(F.col("refers_to") < F.col("page_id"), F.col("refers_to")))
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        task = TaskContext.get()
        number, held, size = 0, [], 0

        def write() -> pa.RecordBatch:
            nonlocal number, held, size
            path = f"{root}/part-{task.partitionId():05d}-{task.taskAttemptId()}-{number:04d}.warc.zst"
            unfinished = f"{path}.unfinished"
            n = 0
            with store.open_output_stream(unfinished, compression=None) as out:
                for frame in pack(held, s):
                    out.write(frame)
                    n += len(frame)
            store.move(unfinished, path)
            name = f"{folder}/{path.rpartition('/')[2]}"
            row = pa.RecordBatch.from_pydict({"path": [name], "records": [len(held)], "bytes": [n]})
            number, held, size = number + 1, [], 0
            return row

        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("page_id", "url", "payload", "sha1", "refers_to")]
            for page_id, url, payload, sha1, refers_to in zip(*columns):
                held.append(record(page_id, url, payload, base32(sha1), refers_to))
                size += len(held[-1])
                if size >= s.archive_bytes:
                    yield write()
        if held:
            yield write()

    manifest = rows.select("page_id", "url", "payload", "sha1", "refers_to")
    return materialise(spark, manifest.mapInArrow(run, "path string, records long, bytes long"), "archives")


def read_archives(spark: SparkSession, archives: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload of every record.

    A revisit's ``payload`` is null; its length and digest are those of the payload it repeats. A payload
    that has another length or digest than its header says is an error. A page_id that was null is null.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        number = lambda urn: int(n) if (n := urn.rpartition(":")[2].rstrip(">")) else None

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for b in batches:
            for path in b.column("path").to_pylist():
                store, name = fs.FileSystem.from_uri(path)
                rows, size = [], 0
                with store.open_input_stream(name, compression=None) as stream:
                    for raw in unpack(stream):
                        head, payload = parse(raw)
                        revisit = head["WARC-Type"] == "revisit"
                        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        to = number(head["WARC-Refers-To"]) if revisit else None
                        length = int(head["WARC-Payload-Length"])
                        if not revisit and (length, digest) != (len(payload), base32(hashlib.sha1(payload).hexdigest())):
                            raise ValueError("a payload has another length or digest than its header says")
                        rows.append((number(head["WARC-Record-ID"]), head["WARC-Target-URI"], length, digest, head["WARC-Type"], to, None if revisit else payload))
                        size += len(raw)
                        if size >= 4 << 20:
                            yield batch(rows)
                            rows, size = [], 0
                if rows:
                    yield batch(rows)

    schema = (
        "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    )
    # an archive a task: files, not rows, are dealt out
    return archives.select("path").repartition(spark.sparkContext.defaultParallelism * 4, "path").mapInArrow(run, schema)
