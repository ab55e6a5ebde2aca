"""WARC archives as a Spark data source, and pages written to them with duplicate payloads as revisits.

Data source "warc".  Reading plans a partition for each archive file.  Of each
record the reader parses the header first; filters on its columns (type,
page_id, target_uri, payload_digest, refers_to, payload_bytes) are pushed down
and judged on it, and only a wanted record has its payload inflated, checked
against its digest, or decoded.  A record is a gzip member whose "sl" extra
field holds its compressed length, so unwanted members are stepped over without
inflating them; members of other writers, without that field, and plain,
uncompressed archives are read as well.

Option payload: "none" (headers only), "check" (payload digests are computed
and compared, content stays null; a mismatch is an error), "full" (content).
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from shotlake.llm._filter import maybe_in
from shotlake.llm._store import discard, filesystem, kept, modest_batches, write_atomically
from shotlake.sources.filters import column_of, holds

SCHEMA = "page_id long, type string, target_uri string, payload_bytes long, payload_digest string, refers_to long, content binary"
ARROW = pa.schema([("page_id", pa.int64()), ("type", pa.string()), ("target_uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("content", pa.binary())])
COLUMNS = ["page_id", "type", "target_uri", "payload_bytes", "payload_digest", "refers_to"]
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "urn:page:"
READ = 1 << 16


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response, or a revisit of the page refers_to, as an uncompressed WARC record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{RECORD}{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        *([] if url is None else ["WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A")]),
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
        *([] if refers_to is None else [f"WARC-Refers-To: <{RECORD}{refers_to}>", f"WARC-Profile: {PROFILE}"]),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(raw: bytes, level: int = 6) -> bytes:
    """raw as one gzip member with its compressed length in an "sl" extra field."""
    press = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = press.compress(raw) + press.flush()
    length = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, length & 0xFFFFFFFF, len(raw) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


class _Stream:
    """Inflates what lies at a place of a file, as far as asked."""

    def __init__(self, file, at: int):
        self.file, self.at, self.spare, self.ended = file, at, b"", False
        file.seek(at)
        start = file.read(24)
        self.packed = start[:2] == b"\x1f\x8b"
        self.length = struct.unpack("<I", start[16:20])[0] if self.packed and start[3:4] == b"\x04" and start[12:14] == b"sl" else 0
        self.undo, self.raw = zlib.decompressobj(31), start
        self.fed = at + len(start)

    def more(self) -> bytes:
        """The next bytes; empty at the end of the member or file."""
        while True:
            if self.ended:
                return b""
            raw, self.raw = self.raw, b""
            if not raw:
                self.file.seek(self.fed)
                raw = self.file.read(READ)
                self.fed += len(raw)
            if not raw:
                if self.packed:
                    raise ValueError("archive cut short")
                self.ended = True
                return b""
            if not self.packed:
                return raw
            out = self.undo.decompress(raw)
            if self.undo.eof:
                self.ended, self.at_end = True, self.fed - len(self.undo.unused_data)
            if out:
                return out

    def end(self) -> int:
        while self.more():
            pass
        return self.at_end


def records(file, wanted=lambda head: True, payload: str = "none") -> Iterator[dict]:
    """Header columns and content of each record of an archive whose header is wanted."""
    at, size = 0, file.size()
    while at < size:
        stream, data, cut = _Stream(file, at), bytearray(), -1
        while cut < 0 and (x := stream.more()):
            looked = max(0, len(data) - 3)
            data += x
            cut = data.find(b"\r\n\r\n", looked)
        if cut < 0:
            if data.strip(b"\r\n"):
                raise ValueError(f"no WARC header at {at}")
            return
        head = parse(data[:cut].decode("utf-8", "replace"))
        data, need = data[cut + 4 :], head.pop("content_length")
        row = {**head, "content": None}
        keep = wanted(row)
        if keep and payload != "none" and row["type"] == "response":
            while len(data) < need and (x := stream.more()):
                data += x
            body = memoryview(data)[:need]
            # Without a blank line there is an HTTP header and no payload.
            row["content"] = bytes(body[http + 4 if (http := data.find(b"\r\n\r\n", 0, need)) >= 0 else len(body) :] if data.startswith(b"HTTP/") else body)
            if row["payload_digest"] and base64.b32encode(hashlib.sha1(row["content"]).digest()).decode() != row["payload_digest"]:
                raise ValueError(f"payload of page {row['page_id']} does not match its digest")
            if payload == "check":
                row["payload_bytes"], row["content"] = len(row["content"]), None
        if stream.packed:
            at = at + stream.length if stream.length else stream.end()
        else:
            at += cut + 4 + need + 4
        if keep:
            yield row


def parse(head: str) -> dict:
    lines = head.lstrip("\r\n").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}

    def page(value: str | None) -> int | None:
        value = (value or "").strip("<>").removeprefix(RECORD)
        return int(value) if value.lstrip("-").isdigit() else None

    length = fields.get("warc-payload-length")
    return {
        "page_id": page(fields.get("warc-record-id")),
        "type": fields.get("warc-type"),
        "target_uri": fields.get("warc-target-uri"),
        "payload_bytes": int(length) if length else None,
        "payload_digest": fields["warc-payload-digest"].partition(":")[2] if "warc-payload-digest" in fields else None,
        "refers_to": page(fields.get("warc-refers-to")),
        "content_length": int(fields["content-length"]),
    }


@dataclass
class ArchivePartition(InputPartition):
    uri: str

    def __post_init__(self):
        super().__init__(self.uri)


@dataclass
class Archive(WriterCommitMessage):
    order: int
    name: str
    records: int


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload, self.tests = options["path"].rstrip("/"), options.get("payload", "full"), []

    def pushFilters(self, filters):
        for f in filters:
            if column_of(f) in COLUMNS:
                self.tests.append((column_of(f), f))
            else:
                yield f

    def partitions(self):
        fs, path = filesystem(self.path)
        from pyarrow.fs import FileSelector, FileType

        names = {x.base_name for x in fs.get_file_info(FileSelector(path)) if x.type == FileType.File}
        if "manifest.json" in names:
            with fs.open_input_file(f"{path}/manifest.json") as file:
                names = {name for name, _ in json.loads(file.read())}
        return [ArchivePartition(f"{self.path}/{name}") for name in sorted(names) if name.endswith((".warc", ".warc.gz"))]

    def read(self, partition):
        if partition is None:  # no files
            return
        fs, path = filesystem(partition.uri)

        def wanted(row):
            return all(holds(f, row[name]) is True for name, f in self.tests)

        with fs.open_input_file(path) as file:
            rows, held = [], 0
            for row in records(file, wanted, self.payload):
                rows.append(row)
                held += 500 + len(row["content"] or b"")
                if held > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, ARROW)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, ARROW)


class WarcWriter(DataSourceArrowWriter):
    """Rows (page_id, url, html, sha1, refers_to); one archive for each task."""

    def __init__(self, options: dict):
        self.path, self.level = options["path"].rstrip("/"), int(options.get("level", 6))

    def write(self, iterator):
        done = Archive(TaskContext.get().partitionId(), "", 0)
        done.name = f"pages-{done.order:06d}-{uuid.uuid4().hex}.warc.gz"

        def members():
            for batch in iterator:
                done.records += batch.num_rows
                ids, urls, sums, first = (batch.column(c).to_pylist() for c in ("page_id", "url", "sha1", "refers_to"))
                for page_id, url, html, sha1, refers_to in zip(ids, urls, batch.column("html").cast(pa.binary()), sums, first, strict=True):
                    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                    yield member(record(page_id, url, html.as_buffer().to_pybytes(), digest, refers_to), self.level)

        write_atomically(f"{self.path}/{done.name}", members())
        return done

    def commit(self, messages):
        found = sorted((m for m in messages if m is not None and m.records), key=lambda m: m.order)
        write_atomically(f"{self.path}/manifest.json", [json.dumps([[m.name, m.records] for m in found]).encode()])

    def abort(self, messages):
        for m in messages:
            if m is not None:
                fs, path = filesystem(f"{self.path}/{m.name}")
                fs.delete_file(path)


class Warc(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def write_warc(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> None:
    """Archives under path with a record for each row of df.

    Of rows with equal payloads (html in UTF-8, null as empty) of at least
    least_bytes, that with the smallest id becomes a response and the others
    revisits of it; rows that share that smallest id are all responses.  A null
    id counts as larger than any.  Other columns are left out.
    """
    spark = df.sparkSession
    modest_batches(spark)
    spark.dataSource.register(Warc)
    rows = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha1", F.sha1(F.encode("html", "UTF-8")))
    # Written before the join, so that its exchange can be split where one payload has many rows.
    first = kept(rows.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").select("sha1", "first"), "payloads")
    # Only pages whose payload may have copies are moved; all others are written where they are read.
    again = (F.octet_length("html") >= least_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    marked = rows.withColumn("shared", maybe_in(spark, "sha1", first))
    alone = marked.where("not shared").select("page_id", "url", "html", "sha1", F.lit(None).cast("long").alias("refers_to"))
    shared = marked.where("shared").join(first, "sha1", "left").select("page_id", "url", "html", "sha1", F.when(again, F.col("first")).alias("refers_to"))
    alone.union(shared).write.format("warc").mode("append").option("path", path).save()
    discard(first)


def read_warc(spark, path: str, payload: str = "full") -> DataFrame:
    """The records under path: page_id, type, target_uri, payload_bytes, payload_digest, refers_to, content."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Warc)
    return spark.read.format("warc").option("path", path).option("payload", payload).load()
