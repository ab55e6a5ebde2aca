"""Parts of media files that a table asks for: frames of raw videos, and time slices of WAV audio, read by byte range.

What is wanted is dealt by file and place, so that a task goes through a stretch of a
file once, in order.  Ranges that lie near each other are read in one go, and a
read that fails is tried once more on a file opened anew.  Nothing else of a file is
read but its header, so the bytes read are in proportion to what is wanted.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

from shotlake.operators import frames as FR
from shotlake.operators import pictures as P
from shotlake.sources import raw
from shotlake.sources.media import frame_measures, shrunk, to_gray

GAP = 256 << 10  # bytes between two ranges that are read rather than stepped over
MOST = 8 << 20  # bytes that are read in one go, or one range
STRETCH = 4096  # frames, or seconds of audio, that one task reads of a file


def twice(open_: Callable, use: Callable):
    """use(file), once more with the file opened anew if the first time fails to read."""
    try:
        with open_() as file:
            return use(file)
    except OSError:
        with open_() as file:
            return use(file)


def ranges_read(open_: Callable, places: list[tuple[int, int]], gap: int = GAP, most: int = MOST) -> Iterator[bytes]:
    """The bytes of each of places (begin, end), in ascending order of begin; fewer where the file ends."""
    i = 0
    while i < len(places):
        j, end = i + 1, places[i][1]
        while j < len(places) and places[j][0] <= end + gap and max(end, places[j][1]) - places[i][0] <= most:
            end, j = max(end, places[j][1]), j + 1
        first = places[i][0]

        def read(file, first=first, end=end):
            file.seek(first)
            return file.read(end - first)

        data = twice(open_, read)
        for a, b in places[i:j]:
            yield data[a - first : b - first]
        i = j


def _opener(uri: str) -> Callable:
    fs, path = raw._open(uri)
    return lambda: fs.open_input_file(path)


def frames_at(wanted: DataFrame, folder: str, gray: bool = False, long_side: int = 0) -> DataFrame:
    """The frames (stream, frame_index, height, width, channels, fps, data) of raw videos in folder that wanted (stream, frame_index) names, each once.

    Frames that a video does not have give no row; a stream without a file is an error.
    """
    rows = wanted.select(F.col("stream").cast("string").alias("stream"), F.col("frame_index").cast("long").alias("frame_index")).where("stream is not null and frame_index >= 0").distinct()
    dealt = rows.withColumn("stretch", F.floor(F.col("frame_index") / STRETCH)).repartition("stream", "stretch").sortWithinPartitions("stream", "frame_index")

    def run(batches):
        for batch in batches:
            streams, numbers = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            edges = [0, *(i for i in range(1, len(streams)) if streams[i] != streams[i - 1]), len(streams)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                open_ = _opener(f"{folder.rstrip('/')}/{streams[a]}.rawv")
                head, begin = twice(open_, raw.read_header)
                h, w, c = head["height"], head["width"], head["channels"]
                size, out, held = h * w * c, [], 0
                mine = [int(i) for i in numbers[a:b] if i < head["frames"]]
                for i, data in zip(mine, ranges_read(open_, [(begin + i * size, begin + (i + 1) * size) for i in mine]), strict=True):
                    if len(data) < size:
                        raise ValueError(f"frame {i} of {streams[a]} is cut short")
                    shape = (h, w, c)
                    if gray:
                        pixels = to_gray(np.frombuffer(data, np.uint8).reshape((h, w) if c == 1 else (h, w, c)))
                        pixels = shrunk(pixels, long_side) if long_side else pixels
                        data, shape = pixels.tobytes(), (*pixels.shape, 1)
                    out.append({"stream": streams[a], "frame_index": i, "height": shape[0], "width": shape[1], "channels": shape[2], "fps": head["fps"], "data": data})
                    held += len(data)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(out, raw.ARROW)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, raw.ARROW)

    return dealt.select("stream", "frame_index").mapInArrow(run, raw.SCHEMA)


def wav_layout(file) -> dict:
    """Where the samples of a PCM WAV begin and how they lie: begin, bytes, rate, channels, width; only headers of chunks are read."""
    file.seek(0)
    lead = file.read(12)
    if lead[:4] != b"RIFF" or lead[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, found = 12, {}
    while True:
        file.seek(at)
        head = file.read(8)
        if len(head) < 8:
            raise ValueError("a WAV file without samples")
        name, size = head[:4], struct.unpack("<I", head[4:])[0]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", file.read(16))
            if kind not in (1, 0xFFFE) or bits % 8:
                raise ValueError(f"WAV samples of kind {kind} with {bits} bits")
            found = {"rate": rate, "channels": channels, "width": bits // 8}
        elif name == b"data" and found:
            return found | {"begin": at + 8, "bytes": size}
        at += 8 + size + size % 2


def wav_file(samples: bytes, layout: dict) -> bytes:
    """A WAV file of these samples, laid out as in the file that they are from."""
    block = layout["channels"] * layout["width"]
    return b"RIFF" + struct.pack("<I", 36 + len(samples)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, layout["channels"], layout["rate"], layout["rate"] * block, block, 8 * layout["width"]) + b"data" + struct.pack("<I", len(samples)) + samples


def audio_slices(wanted: DataFrame, folder: str) -> DataFrame:
    """wanted (file, start_sec, end_sec, ...) with content, the slice [start, end) of the WAV file below folder as a WAV file of its own, and reason, why there is none.

    Bounds are rounded to samples, half to even, and cut to the file; an empty
    or inverted slice is a file without samples.  Rate, channels and width stay.
    A file that cannot be read, or is none of PCM, gives a reason and no content.
    """
    columns = [c for c in wanted.columns if c not in ("content", "reason")]
    dealt = wanted.select(*columns).withColumn("_stretch", F.floor(F.coalesce("start_sec", F.lit(0.0)) / STRETCH)).repartition("file", "_stretch").sortWithinPartitions("file", "start_sec").drop("_stretch")
    schema = StructType(list(dealt.schema)).add("content", "binary").add("reason", "string")

    def run(batches):
        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c)).to_pylist()  # noqa: E731, B023
            names, starts, ends = column("file"), column("start_sec"), column("end_sec")
            edges = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                open_ = _opener(f"{folder.rstrip('/')}/{names[a]}")
                try:
                    layout = twice(open_, wav_layout)
                    block = layout["channels"] * layout["width"]
                    count = layout["bytes"] // block
                    place = lambda t: min(max(round((t or 0.0) * layout["rate"]), 0), count)  # noqa: E731, B023
                    spans = [(place(s), max(place(s), place(e))) for s, e in zip(starts[a:b], ends[a:b], strict=True)]
                    reads, why = ranges_read(open_, [(layout["begin"] + s * block, layout["begin"] + e * block) for s, e in spans]), None
                except (OSError, ValueError) as e:
                    reads, why = None, str(e)[:200] or type(e).__name__
                for i in range(a, b):
                    content = None if reads is None else wav_file(next(reads), layout)
                    yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, pa.array([content], pa.binary()), pa.array([why], pa.string())], [*batch.schema.names, "content", "reason"])

    return dealt.mapInArrow(run, schema)


PROBED = pa.schema([("width", pa.int32()), ("height", pa.int32()), ("channels", pa.int32()), ("fps", pa.float64()), ("frames", pa.int64()), ("sample_rate", pa.int32()), ("duration_sec", pa.float64()), ("reason", pa.string())])


def probed(files: DataFrame, folder: str) -> DataFrame:
    """files (file, ...) with what the header of the raw video or WAV file below folder says: PROBED; nothing else of it is read.

    A file that is missing, or neither of both, has a reason and null otherwise; names that do not end in .wav are taken for raw videos.
    """
    columns = [c for c in files.columns if c not in PROBED.names]
    rows = files.select(*columns)

    def header(file: str | None) -> dict:
        try:
            open_ = _opener(f"{folder.rstrip('/')}/{file}")
            if (file or "").lower().endswith(".wav"):
                x = twice(open_, wav_layout)
                return {"channels": x["channels"], "sample_rate": x["rate"], "duration_sec": x["bytes"] // (x["channels"] * x["width"]) / x["rate"]}
            x, _ = twice(open_, raw.read_header)
            return {c: x[c] for c in ("width", "height", "channels", "fps", "frames")} | {"duration_sec": x["frames"] / x["fps"] if x["fps"] > 0 else 0.0}
        except (OSError, ValueError, KeyError, struct.error, ZeroDivisionError) as e:
            return {"reason": str(e)[:200] or type(e).__name__}

    schema = StructType([*rows.schema, *from_arrow_schema(PROBED)])

    def run(batches):
        for batch in batches:
            found = [header(x) for x in batch.column(batch.schema.get_field_index("file")).to_pylist()]
            made = [pa.array([x.get(f.name) for x in found], f.type) for f in PROBED]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *PROBED.names])

    return rows.mapInArrow(run, schema)


def extracted(shots: DataFrame, folder: str, rate: float, candidates: int = 3, most: int = 0, most_side: int = 1920, key: tuple[str, ...] = ("stream",)) -> DataFrame:
    """(*key, name, time_sec, frame_index, height, width, channels, data): of shots, as frames.rate_candidates takes them, the sharpest frame of each group of candidates.

    Sharpness is that of the frame as it will be shown, inside most_side; the first wins ties.  Only the
    measures of candidates are moved, and the winners are read again by their places.
    """
    wanted = FR.rate_candidates(shots, rate, candidates, most, key).withColumn("stream", F.col("stream").cast("string"))
    seen = P.bounded(frames_at(wanted, folder), most_side).select("stream", "frame_index", F.struct("height", "width", "channels", "data").alias("image"))
    sharp = seen.select("stream", "frame_index", frame_measures("image", most_side)["sharpness"].alias("sharpness"))
    met = wanted.join(sharp, ["stream", "frame_index"]).groupBy(*key, "group").agg(F.max_by("frame_index", F.struct("sharpness", -F.col("slot"))).alias("frame_index"))
    shown = P.bounded(frames_at(met, folder), most_side).select("stream", "frame_index", "height", "width", "channels", "data")
    named = met.select(*key, "frame_index", F.format_string("frame_%05d.png", F.col("group") + 1).alias("name"), F.round(F.col("group") / float(rate), 3).alias("time_sec"))
    return named.join(shown, ["stream", "frame_index"]).select(*key, "name", "time_sec", "frame_index", "height", "width", "channels", "data")
