"""Media files as rows: listing, metadata rules, PCM audio, raw frames and their measures.

Codecs other than PCM WAV and raw arrays are behind `Provider`: decoding a video
container needs a library that is not part of this package.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shotlake.functions import text as T

#: Video extensions that are listed.
EXTENSIONS = ["mp4", "mov", "mkv", "avi", "webm"]


class Provider(Protocol):
    """Turns a batch of inputs into rows. It is made once in each worker, so a model loads once for many batches."""

    schema: str

    def rows(self, batch: pd.DataFrame) -> pd.DataFrame: ...


def provided(df: DataFrame, make, schema: str) -> DataFrame:
    """df through a provider that `make` builds in the worker; a batch that fails gives rows of its key with status and reason if the provider says so."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        for batch in batches:
            yield provider.rows(batch)

    return df.mapInPandas(run, schema)


def list_media(spark: SparkSession, folder: str, extensions: list[str] = EXTENSIONS) -> DataFrame:
    """(path, stem, length) of files with these extensions in any case, with sort_key for natural order; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    wanted = F.lower(F.regexp_extract("path", r"\.([^./]*)\z", 1)).isin(extensions)
    return files.where(wanted).select("path", T.safe_stem(F.col("path")).alias("stem"), "length", T.natural_key(F.regexp_extract("path", r"([^/]*)\z", 1)).alias("sort_key"))


def completed_metadata(probes: DataFrame) -> DataFrame:
    """Probe rows (stem, rate, frame_count, duration_sec, width, height) with fps (25 where unknown) and frames and duration filled from each other."""
    fps = T.rate(F.col("rate"))
    out = probes.withColumn("fps", F.when(fps > 0, fps).otherwise(F.lit(25.0)))
    frames = F.when(F.col("frame_count") > 0, F.col("frame_count")).otherwise(F.bround(F.coalesce("duration_sec", F.lit(0.0)) * F.col("fps")).cast("long"))
    return out.withColumn("frame_count", frames).withColumn("duration_sec", F.when(F.col("duration_sec") > 0, F.col("duration_sec")).otherwise(F.col("frame_count") / F.col("fps")))


PROBE = "streams array<struct<codec_type:string,avg_frame_rate:string,nb_frames:string,duration:string,width:int,height:int>>, format struct<duration:string>"


def parsed_probes(probes: DataFrame) -> DataFrame:
    """(stem, rate, frame_count, duration_sec, width, height, has_audio) of probe documents (stem, json): the first video stream's; null where there is none or the document does not parse."""
    doc = probes.select("stem", F.from_json("json", PROBE).alias("d"))
    of = lambda kind: F.filter(F.coalesce("d.streams", F.array().cast(doc.select("d.streams").dtypes[0][1])), lambda s: s["codec_type"] == kind)
    video = F.get(of("video"), F.lit(0))
    return doc.select(
        "stem", video["avg_frame_rate"].alias("rate"), video["nb_frames"].try_cast("long").alias("frame_count"), F.coalesce(video["duration"].try_cast("double"), F.col("d.format.duration").try_cast("double")).alias("duration_sec"),
        video["width"].alias("width"), video["height"].alias("height"), F.when(F.col("d.streams").isNotNull(), F.size(of("audio")) > 0).alias("has_audio"),
    )


def audible(df: DataFrame) -> DataFrame:
    """Sources not known to be silent: has_audio is true, false or null."""
    return df.where(~F.col("has_audio").eqNullSafe(F.lit(False)))


def stems_of_folders(files: DataFrame) -> DataFrame:
    """(folder, vocals, instrumental): of files (folder, position, name) the last one of either kind by position, then by name; null where there is none."""
    rows = files.withColumn("_kind", T.stem_kind(F.col("name")))
    last = lambda kind: F.max(F.when(F.col("_kind") == kind, F.struct("position", "name")))["name"].alias(kind)
    return rows.groupBy("folder").agg(last("vocals"), last("instrumental"))


AUDIO = "path string, sample_rate int, samples array<float>, status string, reason string"


def read_wav(files: DataFrame) -> DataFrame:
    """(path, sample_rate, samples, status, reason) of binaryFile rows: 16-bit PCM as mono floats, channels averaged. Anything else is an error row."""

    def run(batches):
        for batch in batches:
            out = []
            for path, content in zip(batch.path, batch.content, strict=True):
                try:
                    with wave.open(io.BytesIO(content)) as w:
                        if w.getsampwidth() != 2:
                            raise ValueError(f"{8 * w.getsampwidth()}-bit samples")
                        x = np.frombuffer(w.readframes(w.getnframes()), "<i2").astype(np.float32) / 32768
                        out.append((path, w.getframerate(), x.reshape(-1, w.getnchannels()).mean(axis=1), "ok", None))
                except (wave.Error, ValueError, EOFError) as e:
                    out.append((path, None, None, "error", str(e)))
            yield pd.DataFrame(out, columns=["path", "sample_rate", "samples", "status", "reason"])

    return files.select("path", "content").mapInPandas(run, AUDIO)


def wav_bytes(samples, sample_rate: int) -> bytes:
    """A mono 16-bit WAV; samples are clipped to [-1, 1] and truncated."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(int(sample_rate))
        w.writeframes((np.clip(np.asarray(samples, np.float64), -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def wav_column(samples: str, sample_rate: str) -> Column:
    @F.pandas_udf("binary")
    def encode(x: pd.Series, rate: pd.Series) -> pd.Series:
        return pd.Series([wav_bytes(a, r) for a, r in zip(x, rate, strict=True)])

    return encode(samples, sample_rate)


def gray_measures(gray: np.ndarray) -> tuple[float, float, float]:
    """Mean, population deviation, and variance of the 4-neighbour Laplacian with reflected borders."""
    g = gray.astype(np.float64)
    p = np.pad(g, 1, mode="reflect") if min(g.shape) > 1 else np.pad(g, 1, mode="edge")
    laplacian = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g
    return float(g.mean()), float(g.std()), float(laplacian.var())


def to_gray(pixels: np.ndarray) -> np.ndarray:
    """BGR to luma, rounded."""
    return pixels if pixels.ndim == 2 else np.rint(pixels @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)


def shrunk(gray: np.ndarray, long_side: int) -> np.ndarray:
    """Area-averaged to a long side of at most long_side."""
    h, w = gray.shape
    scale = min(1.0, long_side / max(h, w))
    if scale == 1.0:
        return gray
    hh, ww = max(1, round(h * scale)), max(1, round(w * scale))
    weight = lambda n, m: np.clip(np.minimum(np.arange(n) + 1, (np.arange(m)[:, None] + 1) * n / m) - np.maximum(np.arange(n), np.arange(m)[:, None] * n / m), 0, None) * m / n
    return np.rint(weight(h, hh) @ gray.astype(np.float64) @ weight(w, ww).T).astype(np.uint8)


def frame_measures(image: str = "image", long_side: int = 960) -> Column:
    """struct(luma_mean, luma_std, sharpness) of an image struct(height, width, channels, data) column, in Arrow batches."""

    @F.pandas_udf("luma_mean double, luma_std double, sharpness double")
    def measure(images: pd.DataFrame) -> pd.DataFrame:
        out = []
        for h, w, c, data in zip(images.height, images.width, images.channels, images.data, strict=True):
            pixels = np.frombuffer(data, np.uint8).reshape((h, w) if c == 1 else (h, w, c))
            out.append(gray_measures(shrunk(to_gray(pixels), long_side)))
        return pd.DataFrame(out, columns=["luma_mean", "luma_std", "sharpness"])

    return measure(image)


def needed_frames(frames: DataFrame, wanted: DataFrame) -> DataFrame:
    """Frames (stream, frame_index, …) that are wanted, so that payloads are decoded after the semi-join only."""
    return frames.join(wanted.select("stream", "frame_index").distinct(), ["stream", "frame_index"], "left_semi")
