"""WARC archives as seekable Zstandard bundles.

Each task packs its records into bundle files: records are grouped into independent frames, and a footer
(the seek table of the Zstandard seekable format) lists the frames' sizes, so that any frame
can be read on its own and the file is still a plain .warc.zst. An index maps every record
to its bundle, frame and offset in the frame; only bundles that the index names count, so files
of failed or repeated attempts do no harm.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.shared import cut, map_texts, replace_columns, store

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 32 << 20
#: Bundles that one task reads, where there are many.
BUNDLES_A_TASK = 8
# Fixed values of the Zstandard seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "record_id bigint, record_type string, bundle string, frame int, offset bigint, length bigint"
_RECORD_ARROW = pa.schema(
    [("record_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]
)
RECORDS = "record_id bigint, record_type string, refers_to bigint, url string, payload_bytes bigint, payload_digest string, payload binary"


def base32_sha1(text: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a text's UTF-8 bytes: five hex digits give four base32 digits. Null for a null text."""
    digits = [F.lpad(F.conv(F.substring(F.sha1(F.encode(text, "UTF-8")), i * 5 + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def payload_roles(records: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Adds payload_digest and refers_to: the least record_id of an equal payload of least_bytes or more, if it is another.

    records: record_id bigint, payload string and any other columns, which pass through; input columns of the added
    names are replaced. Null payloads are empty ones, and empty ones are equal. Rows with a null record_id are never
    referred to; repeated rows of the least id are all responses. Only (digest, id) rows are grouped; payloads move
    once, by record id, however many of them are equal. No records, no rows.
    """
    records = replace_columns(records, "payload_digest", "refers_to")
    records = records.withColumn("payload", F.coalesce("payload", F.lit(""))).withColumn("payload_digest", base32_sha1(F.col("payload")))
    large = records.where(F.octet_length("payload") >= least_bytes).select("record_id", "payload_digest")
    first = large.groupBy("payload_digest").agg(F.min("record_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 and first_id is not null")
    revisits = large.join(first, "payload_digest").where("not (record_id <=> first_id)").select("record_id", "payload_digest", "first_id").distinct()
    same = F.col("a.record_id").eqNullSafe(F.col("b.record_id")) & (F.col("a.payload_digest") == F.col("b.payload_digest"))
    return records.alias("a").join(revisits.alias("b"), same, "left").select("a.*", F.col("b.first_id").alias("refers_to"))


def _files(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of an URI; Spark writes local ones as file:/path."""
    if uri.startswith("file:/"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def _uri(record_id: int | None) -> str:
    return f"<urn:record:{'none' if record_id is None else record_id}>"


def record_bytes(record_id: int | None, refers_to: int | None, url: str | None, payload: bytes, digest: str, date: str) -> bytes:
    revisit = refers_to is not None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (b"" if revisit else payload)
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_uri(record_id)}", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "%" and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    if revisit:
        head += [f"WARC-Refers-To: {_uri(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _number(uri: str) -> int | None:
    value = uri.removeprefix("<urn:record:").removesuffix(">")
    return None if value == "none" else int(value)


def parse_records(data: bytes) -> Iterator[dict]:
    """Records of a decompressed frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no WARC record at byte {at}")
        head = dict(line.split(": ", 1) for line in lines[1:])
        block = data[end + 4 : end + 4 + int(head["Content-Length"])]
        payload = block.split(b"\r\n\r\n", 1)[1]
        revisit = head["WARC-Type"] == "revisit"
        yield {
            "record_id": _number(head["WARC-Record-ID"]), "record_type": head["WARC-Type"], "refers_to": _number(head["WARC-Refers-To"]) if revisit else None,
            "url": unquote(head["WARC-Target-URI"]) if "WARC-Target-URI" in head else None, "payload_bytes": int(head["WARC-Payload-Length"]) if revisit else len(payload),
            "payload_digest": head["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else base64.b32encode(hashlib.sha1(payload).digest()).decode(),
            "payload": None if revisit else payload,
        }
        at = end + 4 + len(block) + 4


class BundleWriter:
    """One bundle file: frames, then the seek table."""

    def __init__(self, folder: str, name: str, level: int = 3) -> None:
        files, path = _files(folder)
        self.path = f"{folder}/{name}"
        self.out = files.open_output_stream(f"{path}/{name}", compression=None)  # the name alone would make it compress again
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frames: list[tuple[int, int]] = []
        self.buffer: list[bytes] = []
        self.held = self.size = 0

    def add(self, record: bytes) -> tuple[int, int]:
        """Frame number and offset in the frame."""
        place = len(self.frames), self.held
        self.buffer.append(record)
        self.held += len(record)
        if self.held >= FRAME_BYTES:
            self.flush()
        return place

    def flush(self) -> None:
        if self.held:
            packed = self.packer.compress(b"".join(self.buffer))
            self.out.write(packed)
            self.frames.append((len(packed), self.held))
            self.size += len(packed)
            self.buffer, self.held = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.out.close()


class BundleReader:
    """Random access to a bundle's frames through its footer."""

    def __init__(self, path: str) -> None:
        files, inner = _files(path)
        self.source = files.open_input_file(inner)
        size = self.source.size()
        frames, _, magic = struct.unpack("<IBI", self.source.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"{path} has no seek table")
        table = self.source.read_at(8 * frames, size - 9 - 8 * frames)
        self.sizes = list(struct.iter_unpack("<II", table))
        self.starts = [0]
        for packed, _ in self.sizes:
            self.starts.append(self.starts[-1] + packed)

    def frame(self, number: int) -> bytes:
        packed, plain = self.sizes[number]
        data = zstandard.ZstdDecompressor().decompressobj().decompress(self.source.read_at(packed, self.starts[number]))
        if len(data) != plain:
            raise ValueError(f"frame {number} has {len(data)} bytes, the seek table says {plain}")
        return data

    def close(self) -> None:
        self.source.close()


def write_bundles(records: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes records (record_id, url, payload, payload_digest, refers_to) to bundles in folder and returns their stored index.

    folder is an URI that every executor can write. Every row becomes a record, repeated rows too: a revisit without
    payload where refers_to is set, else a response. Null and empty payloads are records of no bytes, null urls are
    left out, other columns are ignored. A payload larger than a frame or bundle has one of its own. No records,
    an empty index.
    """
    spark = records.sparkSession
    files, path = _files(folder)
    files.create_dir(path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        stem, made, out = f"part-{task.partitionId():05d}-{task.taskAttemptId()}", 0, None
        for batch in batches:
            rows = []
            for rid, url, payload, digest, refers in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if out is None:
                    out, made = BundleWriter(folder, f"{stem}-{made:04d}.warc.zst"), made + 1
                record = record_bytes(rid, refers, url, (payload or "").encode(), digest, date)
                frame, offset = out.add(record)
                rows.append((rid, "response" if refers is None else "revisit", out.path, frame, offset, len(record)))
                if out.size >= BUNDLE_BYTES:
                    out.close()
                    out = None
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)],
                names=["record_id", "record_type", "bundle", "frame", "offset", "length"],
            )
        if out is not None:
            out.close()

    wanted = records.select("record_id", "url", "payload", "payload_digest", "refers_to")
    return store(map_texts(wanted, write, INDEX), f"{folder}/index")


def read_bundles(index: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the bundles an index names, frame by frame; columns as in RECORDS.

    The size and digest of a response are those of the payload read. Without payloads that column is null. Repeated
    index rows change nothing; an empty index gives no rows.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                bundle = BundleReader(path)
                for number in range(len(bundle.sizes)):
                    rows = list(parse_records(bundle.frame(number)))
                    yield pa.RecordBatch.from_pylist(rows if payloads else [r | {"payload": None} for r in rows], _RECORD_ARROW)
                bundle.close()

    bundles = cut(index.select("bundle").distinct())
    n, cores = bundles.count(), index.sparkSession.sparkContext.defaultParallelism
    # a number of our own, as adaptive execution would put the few names into one task: a task a bundle up to some for each
    # core, then BUNDLES_A_TASK in each
    tasks = max(1, min(n, 4 * cores), -(-n // BUNDLES_A_TASK))
    return map_texts(bundles.repartition(tasks, "bundle"), read, RECORDS)


def fetch_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """Records by random access, one per index row: only the frames that the rows point to are read.

    A task keeps one bundle open and one frame unpacked: its rows are sorted by bundle and frame. Columns as in
    RECORDS; repeated index rows are fetched as often, an empty index gives no rows.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, bundle, data = (None, None), None, b""
        for batch in batches:
            found = []
            for path, frame, offset, length in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if path != at[0]:
                    if bundle is not None:
                        bundle.close()
                    bundle = BundleReader(path)
                if (path, frame) != at:
                    at, data = (path, frame), bundle.frame(frame)
                record = next(parse_records(data[offset : offset + length]))
                found.append(record if payloads else record | {"payload": None})
            yield pa.RecordBatch.from_pylist(found, _RECORD_ARROW)
        if bundle is not None:
            bundle.close()

    return map_texts(index.select("bundle", "frame", "offset", "length").sortWithinPartitions("bundle", "frame", "offset"), read, RECORDS)
