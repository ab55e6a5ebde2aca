"""Pictures made of frames: storyboards pasted into a grid, crops of persons, and PNG files of either.

An image is struct(height, width, channels, data) of bytes in rows, blue first
where it has three channels.  Frames meet what is wanted of them by a join, so only
wanted ones are moved, and a storyboard is one group of at most as many frames as it has cells.
"""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from shotlake.functions import geometry as G

IMAGE = "height int, width int, channels int, data binary"


@lru_cache(256)
def _shares(n: int, m: int) -> np.ndarray:
    """[m, n]: how much of each of m equal parts of a line each of n equal parts covers."""
    edge, other = np.arange(m + 1) * (n / m), np.arange(n + 1.0)
    return np.clip(np.minimum(edge[1:, None], other[1:]) - np.maximum(edge[:-1, None], other[:-1]), 0, None) * (m / n)


def resized(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """pixels (height, width, channels) at another size; each new pixel is the mean of the area that it covers, rounded."""
    h, w, _ = pixels.shape
    if (h, w) == (height, width):
        return pixels
    return np.rint(np.einsum("ah,hwc,bw->abc", _shares(h, height), pixels.astype(np.float64), _shares(w, width), optimize=True)).astype(np.uint8)


def pasted(images: list[np.ndarray], cols: int, rows: int, max_side: int = 4096, gap: int = 0, margin: int = 0, background: int = 0) -> np.ndarray:
    """A grid of images, row by row, in cells of the largest width and height, each fitted into its cell's middle; the whole is shrunk to max_side."""
    images = images[: cols * rows]
    width, height = max(x.shape[1] for x in images), max(x.shape[0] for x in images)
    scale = min(1.0, max_side / max(cols * width + (cols - 1) * gap + 2 * margin, rows * height + (rows - 1) * gap + 2 * margin))
    width, height, gap, margin = max(1, round(width * scale)), max(1, round(height * scale)), max(0, round(gap * scale)), max(0, round(margin * scale))
    out = np.full((rows * height + (rows - 1) * gap + 2 * margin, cols * width + (cols - 1) * gap + 2 * margin, images[0].shape[2]), background, np.uint8)
    for i, image in enumerate(images):
        ratio = min(width / image.shape[1], height / image.shape[0])
        h, w = max(1, int(image.shape[0] * ratio)), max(1, int(image.shape[1] * ratio))
        x, y = margin + i % cols * (width + gap) + (width - w) // 2, margin + i // cols * (height + gap) + (height - h) // 2
        out[y : y + h, x : x + w] = resized(image, h, w)
    return out


def storyboards(cells: DataFrame, frames: DataFrame, cols: int = 3, rows: int = 3, key: tuple[str, ...] = ("stream",), max_side: int = 4096, gap: int = 0, margin: int = 0) -> DataFrame:
    """(key, height, width, channels, data): for each key the frames of its cells (key, cell, frame_index) as one picture.

    Cells go by number; those without a frame are passed over and the next ones
    move up, and what is more than cols * rows is left out.  A key without any frame gives no picture.  Gray frames
    among coloured ones become coloured.  Of frames that repeat, one counts.
    """
    by = list(key)
    wanted = cells.select(*dict.fromkeys([*by, "stream"]), "cell", "frame_index").distinct()
    met = wanted.join(frames.dropDuplicates(["stream", "frame_index"]).select("stream", "frame_index", *(c.split()[0] for c in IMAGE.split(", "))), ["stream", "frame_index"])
    place = F.row_number().over(Window.partitionBy(*by).orderBy("cell", "frame_index"))
    met = met.withColumn("place", place).where(F.col("place") <= cols * rows)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        deep = int(pdf["channels"].max())
        images = [np.frombuffer(x.data, np.uint8).reshape(x.height, x.width, x.channels) for x in pdf.itertuples()]
        out = pasted([np.repeat(x, deep, axis=2) if x.shape[2] < deep else x for x in images], cols, rows, max_side, gap, margin)
        return pd.DataFrame({**{c: pdf[c].iloc[:1].to_numpy() for c in by}, "height": [out.shape[0]], "width": [out.shape[1]], "channels": [deep], "data": [out.tobytes()]})

    kinds = dict(wanted.dtypes)
    return met.groupBy(*by).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in by) + f", {IMAGE}")


def bounded(images: DataFrame, most: int = 1920) -> DataFrame:
    """images (height, width, channels, data, ...) inside a frame of most x most * 9/16 of either orientation, and resized, whether they had to change.

    The decision is taken on the sizes; pixels of images that fit do not reach Python and stay as they are.
    """
    size = G.fitted_frame(F.col("width"), F.col("height"), most)
    sized = images.withColumn("_size", size).withColumn("resized", (F.col("_size.width") != F.col("width")) | (F.col("_size.height") != F.col("height")))

    @F.pandas_udf("binary")
    def shrunk(h: pd.Series, w: pd.Series, c: pd.Series, raw: pd.Series, to_h: pd.Series, to_w: pd.Series) -> pd.Series:
        out = []
        for d, *sizes in zip(raw, h, w, c, to_h, to_w, strict=True):
            if d is not None:
                a, b, e, y, x = map(int, sizes)  # not whole numbers where some are null
                d = resized(np.frombuffer(d, np.uint8).reshape(a, b, e), y, x).tobytes()
            out.append(d)
        return pd.Series(out, dtype=object)

    pixels = shrunk("height", "width", "channels", F.when(F.col("resized"), F.col("data")), "_size.height", "_size.width")
    sized = sized.withColumn("data", F.when(F.col("resized"), pixels).otherwise(F.col("data")))
    return sized.withColumns({c: F.when(F.col("resized"), F.col(f"_size.{c}").cast("int")).otherwise(F.col(c)) for c in ("height", "width")}).drop("_size")


def cropped(records: DataFrame, frames: DataFrame) -> DataFrame:
    """records (stream, frame_index, crop struct(x1, y1, x2, y2), ...) with image, the part [x1, x2) x [y1, y2) of their frame.

    Records whose frame is not there, or whose crop lies outside it or is empty, go.
    """
    columns = records.columns
    image = F.struct(*(F.col(c.split()[0]) for c in IMAGE.split(", "))).alias("_frame")
    met = records.join(frames.dropDuplicates(["stream", "frame_index"]).select("stream", "frame_index", image), ["stream", "frame_index"])

    @F.pandas_udf(IMAGE)
    def cut(frame: pd.DataFrame, box: pd.DataFrame) -> pd.DataFrame:
        out = []
        for h, w, c, data, *corners in zip(*(frame[x] for x in ("height", "width", "channels", "data")), *(box[x] for x in ("x1", "y1", "x2", "y2")), strict=True):
            if any(pd.isna(v) for v in corners):
                out.append((0, 0, c, b""))
                continue
            x1, y1, x2, y2 = (int(v) for v in corners)
            part = np.frombuffer(data, np.uint8).reshape(h, w, c)[max(0, y1) : max(0, y2), max(0, x1) : max(0, x2)]
            out.append((*part.shape, part.tobytes()))
        return pd.DataFrame(out, columns=["height", "width", "channels", "data"])

    return met.withColumn("image", cut("_frame", "crop")).where("image.height > 0 and image.width > 0").select(*columns, "image")


def png(pixels: np.ndarray) -> bytes:
    """A PNG file of pixels (height, width, 1 or 3), blue first."""
    h, w, c = pixels.shape
    lines = np.zeros((h, 1 + w * c), np.uint8)  # each line without a filter
    lines[:, 1:] = pixels[:, :, ::-1].reshape(h, -1) if c == 3 else pixels.reshape(h, -1)
    part = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if c == 3 else 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines.tobytes(), 6)) + part(b"IEND", b"")


def png_column(height, width, channels, data) -> Column:
    """The image of these columns as a PNG file."""

    @F.pandas_udf("binary")
    def encode(h: pd.Series, w: pd.Series, c: pd.Series, raw: pd.Series) -> pd.Series:
        return pd.Series([png(np.frombuffer(d, np.uint8).reshape(int(a), int(b), int(e))) for a, b, e, d in zip(h, w, c, raw, strict=True)])

    return encode(height, width, channels, data)


def person_files(records: DataFrame, frames: DataFrame) -> DataFrame:
    """(path, content): a PNG file for each of records (stream, person, frame_index, crop), as persons/<person>/<person>_f<frame>.png below its stream."""
    cut = cropped(records, frames)
    name = F.concat(F.col("person").cast("string"), F.format_string("_f%07d.png", "frame_index"))
    path = F.concat_ws("/", F.col("stream").cast("string"), F.lit("persons"), F.col("person").cast("string"), name)
    return cut.select(path.alias("path"), png_column("image.height", "image.width", "image.channels", "image.data").alias("content")).dropDuplicates(["path"])
