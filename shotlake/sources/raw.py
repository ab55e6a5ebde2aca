"""Raw video files and their scan as frames.

A raw video is

    b"RAWV1\n" | one line of JSON: width, height, channels, fps, frames | frames, one after the other

so a frame lies at a known place.  Data source "raw_frames" reads the files of a
folder as rows (stream, frame_index, height, width, channels, fps, data).  The
driver lists files and opens none; a reading task takes the frames that begin within
`split` bytes of one file, whose header it reads.  Filters of stream and
frame_index are pushed down, so frames that are not wanted are never read.  With
gray=true and longside=n frames come as luma, area-averaged to a long side of at most n.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, In, InputPartition

from shotlake.sources.filters import all_hold, column_of, span
from shotlake.sources.media import shrunk, to_gray

MAGIC = b"RAWV1\n"
SPLIT = 64 << 20  # bytes
SCHEMA = "stream string, frame_index long, height int, width int, channels int, fps double, data binary"
ARROW = pa.schema([("stream", pa.string()), ("frame_index", pa.int64()), ("height", pa.int32()), ("width", pa.int32()), ("channels", pa.int32()), ("fps", pa.float64()), ("data", pa.binary())])


def raw_video(frames: np.ndarray, fps: float) -> bytes:
    """A file of frames (count, height, width[, channels]) of bytes."""
    channels = frames.shape[3] if frames.ndim == 4 else 1
    head = {"width": frames.shape[2], "height": frames.shape[1], "channels": channels, "fps": fps, "frames": frames.shape[0]}
    return MAGIC + json.dumps(head).encode() + b"\n" + np.ascontiguousarray(frames, np.uint8).tobytes()


def _open(uri: str):
    fs, path = pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri.removeprefix("file:"))
    return fs, path


def read_header(file) -> tuple[dict, int]:
    """What a file's header says, and where its frames begin."""
    file.seek(0)
    start = file.read(4096)
    if not start.startswith(MAGIC):
        raise ValueError("not a raw video")
    end = start.index(b"\n", len(MAGIC)) + 1
    return json.loads(start[len(MAGIC) : end]), end


@dataclass
class Run(InputPartition):
    uri: str
    stream: str
    first: int  # bytes of the file
    last: int

    def __post_init__(self):
        super().__init__(f"{self.uri}:{self.first}")


class RawFramesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"].rstrip("/"), int(options.get("split", SPLIT))
        self.gray, self.long_side = options.get("gray", "false").lower() == "true", int(options.get("longside", 0))
        self.tests: dict[str, list] = {"stream": [], "frame_index": []}

    def pushFilters(self, filters):
        for f in filters:
            if column_of(f) in self.tests:
                self.tests[column_of(f)].append(f)
            else:
                yield f

    def wanted(self, first: int, last: int) -> list[int]:
        """The frames of [first, last) that the filters let through."""
        tests, some = self.tests["frame_index"], None
        for f in tests:
            low, high = span(f)
            first, last = max(first, first if low is None else low), min(last, last if high is None else high + 1)
            if type(f) is In:  # a short list is gone through instead of the frames between its ends
                some = {v for v in f.value if v is not None} if some is None else some.intersection(f.value)
        return [i for i in (range(first, last) if some is None else sorted(some)) if first <= i < last and all_hold(tests, i)]

    def partitions(self):
        fs, path = _open(self.path)
        out = []
        for info in sorted(fs.get_file_info(pafs.FileSelector(path)), key=lambda x: x.base_name):
            stream = info.base_name.removesuffix(".rawv")
            if info.base_name.endswith(".rawv") and all_hold(self.tests["stream"], stream):
                out += [Run(f"{self.path}/{info.base_name}", stream, at, at + self.split) for at in range(0, max(1, info.size), self.split)]
        return out

    def read(self, partition):
        if partition is None:  # no files
            return
        fs, path = _open(partition.uri)
        with fs.open_input_file(path) as file:
            head, begin = read_header(file)
            h, w, c = head["height"], head["width"], head["channels"]
            rows, held, size = [], 0, h * w * c
            since = lambda at: max(0, -(-(at - begin) // max(1, size)))  # noqa: E731  the first frame that begins at a place or later
            for i in self.wanted(since(partition.first), min(head["frames"], since(partition.last))):
                file.seek(begin + i * size)
                data = file.read(size)
                if len(data) < size:
                    raise ValueError(f"frame {i} of {partition.stream} is cut short")
                shape = (h, w, c)
                if self.gray:
                    pixels = to_gray(np.frombuffer(data, np.uint8).reshape((h, w) if c == 1 else (h, w, c)))
                    pixels = shrunk(pixels, self.long_side) if self.long_side else pixels
                    data, shape = pixels.tobytes(), (*pixels.shape, 1)
                rows.append({"stream": partition.stream, "frame_index": i, "height": shape[0], "width": shape[1], "channels": shape[2], "fps": head["fps"], "data": data})
                held += len(data)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, ARROW)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, ARROW)


class RawFrames(DataSource):
    @classmethod
    def name(cls):
        return "raw_frames"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return RawFramesReader(self.options)


def read_raw_frames(spark: SparkSession, folder: str, gray: bool = False, long_side: int = 0, split: int = SPLIT) -> DataFrame:
    """The frames of all raw videos in folder; a file's name without .rawv is its stream."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RawFrames)
    return spark.read.format("raw_frames").options(path=folder, gray=str(gray).lower(), longside=long_side, split=split).load()
