"""Token-id files: bit-plane or byte-plane shuffled blocks, each plane under zstandard, with a chunk index.

A shard is

    b"SLTP2\\n" | planes of block 0 | planes of block 1 | ... | index | index length (8 bytes) | b"SLTP2\\n"

A block has `block_ids` ids (the last one fewer).  Its ids, little-endian
unsigned 32-bit, are transposed: byte plane j has byte j of each id, bit plane
j has bit j of each id, eight ids to a byte.  High planes are nearly constant
and cost next to nothing.  The index is three zstandard frames, each led by its
length in 8 bytes: JSON with each block's place and plane lengths, then the
documents' ids (signed 64-bit, the first `nulls` of them null) and their numbers
of ids (64-bit).  So any document or block is read without what lies before it.

Data source "token_planes": rows (doc_id long, ids binary) in, in the order of
the partitions and their rows; (doc_id long, start long, ids binary) out, where
start counts the ids of all documents before.  A task begins another shard after
`shard_ids` ids.  A shard belongs to the output once the manifest, written at
commit, names it; attempts that were lost or ran twice are never named.  The
manifest also has a mark for each `split_ids` ids of a shard: the documents and
ids before it and the id it begins with.  A reading task takes what lies between
two marks, and comparisons of doc_id are pushed down: they leave out parts by
their marks and, within a part, blocks that no wanted document needs.
"""

from __future__ import annotations

import json
import struct
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from shotlake.llm._store import filesystem, modest_batches, write_atomically
from shotlake.llm._text import slices
from shotlake.llm._tokens import encoder, with_end
from shotlake.sources.filters import all_hold, column_of, may_hold

MAGIC = b"SLTP2\n"
SCHEMA = "doc_id long, start long, ids binary"


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The 4 byte planes or 32 bit planes of uint32 ids."""
    octets = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    if kind == "byte":
        return [x.tobytes() for x in octets]
    return [np.packbits((octets[j // 8] >> (j % 8)) & 1).tobytes() for j in range(32)]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    octets = np.zeros((4, n), np.uint8)
    for j, plane in enumerate(planes):
        x = np.frombuffer(plane, np.uint8)
        if kind == "byte":
            octets[j] = x
        else:
            octets[j // 8] |= np.unpackbits(x, count=n) << (j % 8)
    return np.ascontiguousarray(octets.T).view("<u4").reshape(-1)


class ShardEncoder:
    """Bytes of one shard, a document at a time; memory holds one block, and 16 bytes a document for the index."""

    def __init__(self, kind: str = "byte", block_ids: int = 65536, level: int = 3, split_ids: int = 1 << 22):
        self.kind, self.block_ids, self.split_ids = kind, block_ids, split_ids
        self.press = zstandard.ZstdCompressor(level=level)
        self.blocks, self.names, self.sizes = [], array("q"), array("q")
        self.at, self.ids, self.nulls, self.waiting, self.held = len(MAGIC), 0, 0, [], 0
        self.marks: list[list] = []  # [documents before, ids before, id]

    def _block(self, ids: np.ndarray) -> bytes:
        planes = [self.press.compress(p) for p in to_planes(ids, self.kind)]
        self.blocks.append([self.at, len(ids), [len(p) for p in planes]])
        out = b"".join(planes)
        self.at += len(out)
        return out

    def add(self, name: int | None, ids: np.ndarray) -> Iterator[bytes]:
        if not self.marks or self.ids >= self.marks[-1][1] + self.split_ids:
            self.marks.append([len(self.names), self.ids, name])
        self.nulls += name is None
        self.names.append(name or 0)
        self.sizes.append(len(ids))
        self.ids += len(ids)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.block_ids:
            ids = np.concatenate(self.waiting)
            whole = self.held // self.block_ids * self.block_ids
            for i in range(0, whole, self.block_ids):
                yield self._block(ids[i : i + self.block_ids])
            self.waiting, self.held = [ids[whole:].copy()], self.held - whole

    def close(self) -> Iterator[bytes]:
        if self.held:
            yield self._block(np.concatenate(self.waiting))
        head = json.dumps({"kind": self.kind, "block_ids": self.block_ids, "blocks": self.blocks, "nulls": self.nulls}).encode()
        frames = [self.press.compress(x) for x in (head, self.names.tobytes(), self.sizes.tobytes())]
        index = b"".join(struct.pack("<Q", len(x)) + x for x in frames)
        yield index + struct.pack("<Q", len(index)) + MAGIC


def encode_shard(documents: Iterator[tuple[int | None, np.ndarray]], kind: str = "byte", block_ids: int = 65536, level: int = 3) -> Iterator[bytes]:
    """The bytes of a shard of these documents, null ids first."""
    shard = ShardEncoder(kind, block_ids, level)
    yield MAGIC
    for name, ids in documents:
        yield from shard.add(name, ids)
    yield from shard.close()


@dataclass
class Index:
    kind: str
    block_ids: int
    blocks: list
    nulls: int
    names: np.ndarray
    ends: np.ndarray  # ids up to each document, led by 0


def read_index(file) -> Index:
    end = file.size()
    file.seek(end - len(MAGIC) - 8)
    tail = file.read(8 + len(MAGIC))
    if tail[8:] != MAGIC:
        raise ValueError("not a token shard, or cut short")
    n = struct.unpack("<Q", tail[:8])[0]
    file.seek(end - len(MAGIC) - 8 - n)
    raw, frames, undo = file.read(n), [], zstandard.ZstdDecompressor()
    while raw:
        size = struct.unpack("<Q", raw[:8])[0]
        frames.append(undo.decompress(raw[8 : 8 + size]))
        raw = raw[8 + size :]
    return Index(**json.loads(frames[0]), names=np.frombuffer(frames[1], np.int64), ends=np.append(0, np.cumsum(np.frombuffer(frames[2], np.int64))))


def decode_shard(file, first: int = 0, last: int | None = None, wanted=None) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, ids before it in the shard, ids) of the documents first to last that are wanted; only their blocks are read, each once."""
    index, undo, have, of = read_index(file), zstandard.ZstdDecompressor(), np.zeros(0, np.uint32), -1
    for d in range(first, len(index.names) if last is None else last):
        name = None if d < index.nulls else int(index.names[d])
        if wanted is not None and not wanted(name):
            continue
        at, end, parts = int(index.ends[d]), int(index.ends[d + 1]), []
        while at < end:
            k = at // index.block_ids
            if k != of:
                place, n, lengths = index.blocks[k]
                file.seek(place)
                raw, planes, i = file.read(sum(lengths)), [], 0
                for length in lengths:
                    planes.append(undo.decompress(raw[i : i + length], max_output_size=index.block_ids))
                    i += length
                have, of = from_planes(planes, n, index.kind), k
            part = have[at - k * index.block_ids : end - k * index.block_ids]
            parts.append(part)
            at += len(part)
        yield name, int(index.ends[d]), np.concatenate(parts) if parts else np.zeros(0, np.uint32)


@dataclass
class Shards(WriterCommitMessage):
    order: int
    done: list  # [name, documents, ids, marks, last id]


@dataclass
class ShardPartition(InputPartition):
    uri: str
    start: int  # ids before the shard
    first: int
    last: int | None

    def __post_init__(self):
        super().__init__(f"{self.uri}:{self.first}")


class TokenPlanesWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.kind = options["path"].rstrip("/"), options.get("planes", "byte")
        self.block_ids, self.level = int(options.get("blockids", 65536)), int(options.get("level", 3))
        self.shard_ids, self.split_ids = int(options.get("shardids", 1 << 26)), int(options.get("splitids", 1 << 22))

    def write(self, iterator):
        order = TaskContext.get().partitionId()

        def documents():
            for batch in iterator:
                yield from zip(batch.column(batch.schema.get_field_index("doc_id")).to_pylist(), batch.column(batch.schema.get_field_index("ids")), strict=True)

        done, rest = [], documents()
        ahead = next(rest, None)
        while ahead is not None:
            shard, name = ShardEncoder(self.kind, self.block_ids, self.level, self.split_ids), f"shard-{order:08d}-{len(done):06d}-{uuid.uuid4().hex}.sltp"

            def chunks(shard=shard):
                nonlocal ahead
                yield MAGIC
                while ahead is not None and shard.ids < self.shard_ids:
                    yield from shard.add(ahead[0], np.frombuffer(ahead[1].as_buffer(), "<u4"))
                    shard.final, ahead = ahead[0], next(rest, None)
                yield from shard.close()

            write_atomically(f"{self.path}/{name}", chunks())
            done.append([name, len(shard.names), shard.ids, shard.marks, shard.final])
        return Shards(order, done)

    def commit(self, messages):
        shards = [x for m in sorted((m for m in messages if m is not None), key=lambda m: m.order) for x in m.done]
        write_atomically(f"{self.path}/manifest.json", [json.dumps(shards).encode()])

    def abort(self, messages):
        for m in messages:
            for name, *_ in m.done if m is not None else ():
                fs, path = filesystem(f"{self.path}/{name}")
                fs.delete_file(path)


class TokenPlanesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.tests = options["path"].rstrip("/"), []

    def pushFilters(self, filters):
        for f in filters:
            if column_of(f) == "doc_id":
                self.tests.append(f)
            else:
                yield f

    def wanted(self, name: int | None) -> bool:
        return all_hold(self.tests, name)

    def _touches(self, first: int | None, last: int | None) -> bool:
        """Whether a part whose ids go from first to last, null first, may have a wanted one."""
        if first is None and all_hold(self.tests, None):
            return True
        return last is not None and may_hold(self.tests, -(2**63) if first is None else first, last)

    def partitions(self):
        fs, path = filesystem(f"{self.path}/manifest.json")
        with fs.open_input_file(path) as file:
            shards = json.loads(file.read())
        out, start = [], 0
        for name, documents, ids, marks, final in shards:
            for mark, after in zip(marks, [*marks[1:], [documents, ids, final]], strict=True):
                if self._touches(mark[2], after[2]):
                    out.append(ShardPartition(f"{self.path}/{name}", start, mark[0], after[0]))
            start += ids
        return out

    def read(self, partition):
        if partition is None:  # no files
            return
        fs, path = filesystem(partition.uri)
        with fs.open_input_file(path) as file:
            rows, held = [], 0
            for name, start, ids in decode_shard(file, partition.first, partition.last, self.wanted if self.tests else None):
                rows.append((name, partition.start + start, ids.tobytes()))
                held += ids.nbytes
                if held > 4 << 20 or len(rows) >= 5000:
                    yield self._batch(rows)
                    rows, held = [], 0
            if rows:
                yield self._batch(rows)

    @staticmethod
    def _batch(rows):
        names, starts, ids = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(starts, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "start", "ids"])


class TokenPlanes(DataSource):
    @classmethod
    def name(cls):
        return "token_planes"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return TokenPlanesReader(self.options)

    def writer(self, schema, overwrite):
        return TokenPlanesWriter(self.options)


def encode_documents(df: DataFrame, vocabulary: str, id_col: str, text_col: str, end_id: int) -> DataFrame:
    """(doc_id, ids) in ascending id order, null first; ids is little-endian unsigned 32-bit, with end_id after each text."""

    def run(batches):
        encode = encoder(vocabulary)
        for b in slices(batches, "text", 2 << 20):
            ids, offsets = with_end(*encode(b.column(1)), end_id)
            raw = pa.py_buffer(ids.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer((offsets * 4).astype(np.int32).tobytes()), raw])], ["doc_id", "ids"])

    # The range is over the text's hash too, so rows that share an id, or have none, are dealt over many tasks.
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(text_col).cast("string")).alias("hash"))
    return docs.repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text").select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def write_token_file(df: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, planes: str = "byte", block_ids: int = 65536, shard_ids: int = 1 << 26, split_ids: int = 1 << 22) -> None:
    """Encodes every text of df and writes it to path as shards in ascending id order.

    Null and empty texts are the end id alone; equal ids lie side by side in
    order of their texts' hashes; an empty df gives no shards.  Other columns are
    left out.  Texts are sorted, not their ids, which would have to be made twice
    for the range's bounds.
    """
    modest_batches(df.sparkSession)
    df.sparkSession.dataSource.register(TokenPlanes)
    encode_documents(df, vocabulary, id_col, text_col, end_id).write.format("token_planes").mode("append").options(path=path, planes=planes, blockids=block_ids, shardids=shard_ids, splitids=split_ids).save()


def read_token_file(spark, path: str) -> DataFrame:
    """(doc_id, start, ids) of every document under path."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TokenPlanes)
    return spark.read.format("token_planes").option("path", path).load()
