"""Segments of length between a minimum and a maximum from detected cuts."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotlake.operators import frames as FR

#: What a cut's ratio must reach for each sensitivity, and the name of that way of cutting.
SENSITIVITY = {"low": 4.5, "medium": 3.0, "high": 2.0}
DETECTED = "pyscenedetect_adaptive"


def sensitivity(name: str | None) -> float:
    """The ratio to reach; an unknown name counts as medium."""
    return SENSITIVITY.get((name or "medium").strip().lower(), SENSITIVITY["medium"])


def spaced(cuts: Column, start: Column, least: Column) -> Column:
    """The ascending cuts that lie at least least behind the one taken before, or behind start."""

    def one(frames, at, gap):
        out = []
        for f in () if frames is None else frames:
            if f - at >= gap:
                out.append(int(f))
                at = f
        return out

    @F.pandas_udf("array<long>")
    def run(cuts: pd.Series, start: pd.Series, least: pd.Series) -> pd.Series:
        return pd.Series([one(*x) for x in zip(cuts, start, least, strict=True)])

    return run(cuts, start, least)


def _min_frames(min_scene_sec: float, fps: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(F.lit(float(min_scene_sec)) * fps)).cast("long")


def cut_list(frames: DataFrame, fps: float | DataFrame = 25.0, level: str = "medium", min_scene_sec: float = 0.5) -> DataFrame:
    """(stream, total, fps, cuts) of frames (stream, frame_index, luma_mean): ascending cuts, with 0 and total.

    A scene is at least min_scene_sec long, so a cut counts only that far behind
    the one before.  fps is one rate for all streams, or a table (stream, fps);
    a rate that is not known, or not over zero, counts as 25.
    """
    scores = FR.cut_scores(frames, sensitivity(level))
    rows = scores.groupBy("stream").agg((F.max("frame_index") + 1).alias("total"), F.array_sort(F.collect_list(F.when(F.col("is_cut"), F.col("frame_index")))).alias("_c"))
    rows = rows.join(fps.select("stream", "fps"), "stream", "left") if isinstance(fps, DataFrame) else rows.withColumn("fps", F.lit(float(fps)))
    rows = rows.withColumn("fps", F.when(F.col("fps") > 0, F.col("fps").cast("double")).otherwise(25.0))
    inside = spaced(F.col("_c"), F.lit(0).cast("long"), _min_frames(min_scene_sec, F.col("fps")))
    return rows.select("stream", "total", "fps", F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0).cast("long"), F.col("total")), inside))).alias("cuts"))


def subdetected(streams: DataFrame, frames: DataFrame, max_sec: float = 15.0, level: str = "high", min_scene_sec: float = 0.5) -> DataFrame:
    """streams (stream, total, fps, cuts) with the cuts found inside of intervals longer than max_sec added.

    Such an interval is looked at apart, at its own sensitivity, and gives cuts
    strictly inside.  Frames meet their interval in one sorted pass.
    """
    long = intervals(streams).join(streams.select("stream", "fps"), "stream").where(F.col("end") - F.col("start") > F.bround(F.lit(float(max_sec)) * F.col("fps")))
    marks = intervals(streams).select("stream", F.col("start").alias("frame_index"), F.col("start").alias("start"), F.lit(None).cast("double").alias("luma_mean"))
    rows = marks.unionByName(frames.select("stream", F.col("frame_index").cast("long"), F.lit(None).cast("long").alias("start"), "luma_mean"))
    before = Window.partitionBy("stream").orderBy("frame_index", F.col("start").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("start", F.max("start").over(before)).where("luma_mean is not null").join(long.select("stream", "start", "end", "fps"), ["stream", "start"])
    found = FR.cut_scores(placed, sensitivity(level), key=("stream", "start", "end", "fps")).where("is_cut and frame_index > start and frame_index < end")
    extra = found.groupBy("stream", "start", "fps").agg(F.array_sort(F.collect_list("frame_index")).alias("_c"))
    extra = extra.select("stream", spaced(F.col("_c"), F.col("start"), _min_frames(min_scene_sec, F.col("fps"))).alias("_c")).groupBy("stream").agg(F.flatten(F.collect_list("_c")).alias("_more"))
    none = F.array().cast("array<long>")
    merged = F.array_sort(F.array_distinct(F.concat(F.coalesce("cuts", none), F.coalesce("_more", none))))
    return streams.join(extra, "stream", "left").select("stream", "total", "fps", merged.alias("cuts"))


def whole(streams: DataFrame) -> DataFrame:
    """One segment for each stream (stream, total, fps), in place of built() where cutting is turned off."""
    fps = F.when(F.col("fps") > 0, F.col("fps")).otherwise(F.lit(25.0))
    end = F.col("total") / fps
    one = lambda x, t: F.lit(x).cast(t)
    return streams.select(
        "stream", one(1, "int").alias("index"), F.lit("shot_0001").alias("shot_id"), one(0, "long").alias("start_frame"), F.col("total").cast("long").alias("end_frame"), F.lit(0.0).alias("start_sec"), end.alias("end_sec"), end.alias("duration_sec"),
        F.lit(False).alias("below_min"), F.lit("none").alias("method"), one(0, "int").alias("split_iterations"), F.lit(False).alias("fallback"), one(1, "int").alias("detected_shot_count"),
    )


def intervals(df: DataFrame) -> DataFrame:
    """(stream, start, end) between neighbouring bounds of (stream, total, cuts): 0, total and the cuts inside."""
    inside = F.filter(F.coalesce(F.col("cuts"), F.array().cast("array<long>")), lambda c: (c > 0) & (c < F.col("total")))
    bounds = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0).cast("long"), F.col("total").cast("long")), inside)))
    pairs = F.zip_with(F.slice(bounds, 1, F.greatest(F.lit(0), F.size(bounds) - 1)), F.slice(bounds, 2, F.greatest(F.lit(0), F.size(bounds) - 1)), lambda a, b: F.struct(a.alias("start"), b.alias("end")))
    return df.where("total > 0").select("stream", "total", "cuts", F.explode(pairs).alias("_i")).select("stream", "total", "cuts", "_i.start", "_i.end")


def split_over(df: DataFrame, most: int) -> DataFrame:
    """Intervals longer than most become ceil(length / most) parts at proportional points, rounded half to even; empty ones go."""
    n = F.greatest(F.lit(1), F.ceil((F.col("end") - F.col("start")) / most)).cast("int")
    at = lambda k: F.col("start") + F.bround(k * (F.col("end") - F.col("start")) / n).cast("long")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(at(k).alias("start"), at(k + 1).alias("end")))
    return df.withColumn("_p", F.explode(parts)).select(*(c for c in df.columns if c not in ("start", "end")), "_p.start", "_p.end").where("end > start")


def labelled(df: DataFrame) -> DataFrame:
    """Adds method: how an interval (start, end) of (total, cuts) came about."""
    cuts = F.filter(F.coalesce(F.col("cuts"), F.array().cast("array<long>")), lambda c: (c >= 0) & (c <= F.col("total")))
    known = F.concat(F.array(F.lit(0).cast("long"), F.col("total").cast("long")), cuts)
    method = (
        F.when(F.size(F.coalesce(F.col("cuts"), F.array().cast("array<long>"))) < 2, "equal_split")
        .when(F.exists(known, lambda c: (c > F.col("start")) & (c < F.col("end"))), "merge")
        .when(F.array_contains(known, F.col("start")) & F.array_contains(known, F.col("end")), DETECTED)
        .otherwise("equal_split")
    )
    return df.withColumn("method", method)


def _halves(parts: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    out = []
    for a, b in parts:
        n = max(1, math.ceil((b - a) / most))
        points = [a + round(k * (b - a) / n) for k in range(n + 1)]
        out += [(x, y) for x, y in zip(points, points[1:], strict=False) if y > x]
    return out


def _join(parts: list[tuple[int, int]], i: int, j: int) -> list[tuple[int, int]]:
    i, j = min(i, j), max(i, j)
    return [*parts[:i], (parts[i][0], parts[j][1]), *parts[j + 1 :]]


def _absorb(parts: list[tuple[int, int]], least: int, most: int) -> list[tuple[int, int]]:
    """Joins the first short part to a neighbour until none is short: one that stays within most if any, then the shorter, then the left."""
    while len(parts) > 1:
        i = next((i for i, (a, b) in enumerate(parts) if b - a < least), None)
        if i is None:
            break
        size = lambda j: max(parts[i][1], parts[j][1]) - min(parts[i][0], parts[j][0])
        j = min((j for j in (i - 1, i + 1) if 0 <= j < len(parts)), key=lambda j: (size(j) > most, size(j), j))
        parts = _join(parts, i, j)
    return parts


def fold_segments(total: int, cuts: list[int], least: int, most: int, rounds: int = 5) -> tuple[list[tuple[int, int]], int, bool]:
    """(intervals, rounds used, whether the rules could not be met directly) for one stream."""
    if total < least:
        return [(0, total)], 1, True
    inside = sorted({c for c in cuts if 0 < c < total}) if len(cuts) >= 2 else []
    parts = list(zip([0, *inside], [*inside, total], strict=True))
    fits = lambda: all(least <= b - a <= most for a, b in parts)
    used = 0
    while used < rounds:
        parts, used = _absorb(_halves(parts, most), least, most), used + 1
        if fits():
            return parts, used, False
    parts = _halves(parts, most)
    for _ in range(100):
        i = next((i for i, (a, b) in enumerate(parts) if b - a < least), None)
        if i is None or len(parts) == 1:
            break
        near = [j for j in (i - 1, i + 1) if 0 <= j < len(parts)]
        parts = _halves(_join(parts, i, min(near, key=lambda j: (parts[j][1] - parts[j][0], j))), most)
    return parts, used, True


SEGMENTS = "index int, shot_id string, start_frame long, end_frame long, start_sec double, end_sec double, duration_sec double, below_min boolean, method string, split_iterations int, fallback boolean, detected_shot_count int"


def built(df: DataFrame, min_sec: float = 1.0, max_sec: float = 15.0, rounds: int = 5) -> DataFrame:
    """Segments of streams (stream, total, fps, cuts).

    Merging restarts after each join, so it is a fold over one stream's cuts: a
    stream is one row here, and rows are independent (no shuffle).
    """

    def run(frames):
        for pdf in frames:
            out = []
            for s in pdf.itertuples():
                total, fps, cuts = int(s.total), float(s.fps) if s.fps and s.fps > 0 else 25.0, [] if s.cuts is None else [int(c) for c in s.cuts]
                if total <= 0:
                    continue
                least = max(1, round(min_sec * fps))
                most = max(least, round(max_sec * fps))
                parts, used, fallback = fold_segments(total, cuts, least, most, rounds)
                known, found = {0, total, *(c for c in cuts if 0 <= c <= total)}, len(cuts) >= 2
                shots = len({0, total, *(c for c in cuts if 0 < c < total)}) - 1 if found else 1
                for i, (a, b) in enumerate(parts, 1):
                    if total < least:
                        method = "below_min"
                    elif not found:
                        method = "equal_split"
                    elif any(a < c < b for c in known):
                        method = "merge"
                    else:
                        method = DETECTED if a in known and b in known else "equal_split"
                    out.append((s.stream, i, f"shot_{i:04d}", a, b, a / fps, b / fps, (b - a) / fps, b - a < least, method, used, fallback, shots))
            yield pd.DataFrame(out, columns=["stream", *(c.split()[0] for c in SEGMENTS.split(", "))])

    return df.select("stream", "total", "fps", "cuts").mapInPandas(run, f"stream {dict(df.dtypes)['stream']}, {SEGMENTS}")
