"""Frame quality, trimming, sampling and storyboard selection over frames (stream, frame_index, luma_mean, luma_std, sharpness).

Everything is keyed by stream and shuffles once on it, then stays there: windows and
aggregates reuse the partitioning.  Ties go to the lowest frame.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class QualityRules:
    """Thresholds of frame quality; fixed values of the data model's defaults."""

    black_mean: float = 15
    black_std: float = 10
    white_mean: float = 240
    white_std: float = 10
    low_info_std: float = 8
    blur_share: float = 0.4
    invalid_share: float = 0.9
    tolerance: int = 2
    min_valid: int = 2


RULES = QualityRules()


def linspace(lo: Column, hi: Column, count: Column | int) -> Column:
    """count points from lo to hi, the last exactly hi."""
    count = F.lit(count) if isinstance(count, int) else count
    step = (hi - lo) / (count - 1)
    return F.transform(F.sequence(F.lit(0), count.cast("int") - 1), lambda i: F.when(i == count - 1, hi.cast("double")).otherwise(lo + i * step))


def flags(df: DataFrame, rules: QualityRules = RULES) -> DataFrame:
    """Adds is_black, is_white and is_low_info."""
    return df.withColumns(
        {
            "is_black": (F.col("luma_mean") < rules.black_mean) & (F.col("luma_std") < rules.black_std),
            "is_white": (F.col("luma_mean") > rules.white_mean) & (F.col("luma_std") < rules.white_std),
            "is_low_info": F.col("luma_std") < rules.low_info_std,
        }
    )


def scored(df: DataFrame, rules: QualityRules = RULES) -> DataFrame:
    """Adds the stream's exact median sharpness, flags and quality_score, the product of exposure, contrast and relative sharpness."""
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    median = F.col("sharpness_median")
    # Aggregated once and joined back, so that a stream's values are held as counts and not for each row.
    medians = df.groupBy("stream").agg(F.percentile("sharpness", 0.5).alias("sharpness_median")).withColumnRenamed("stream", "_of")
    df = flags(df.join(medians, F.col("stream").eqNullSafe(F.col("_of"))).drop("_of"), rules)
    df = df.withColumn("is_blur", F.col("sharpness") < rules.blur_share * median)
    sharp = F.when(median > 0, clip(F.col("sharpness") / (1.5 * median))).otherwise(F.lit(0.0))
    return df.withColumn("bad", F.col("is_black") | F.col("is_white") | F.col("is_low_info") | F.col("is_blur")).withColumn(
        "quality_score", clip(1 - F.abs(F.col("luma_mean") - 128) / 128) * clip(F.col("luma_std") / 60) * sharp
    )


def source_status(sources: DataFrame, quality: DataFrame, rules: QualityRules = RULES) -> DataFrame:
    """stream_status for every stream of sources; one without a frame is invalid for no_frames."""
    out = sources.select("stream").distinct().join(stream_status(quality, rules), "stream", "left")
    none = F.col("frames").isNull()
    return out.select("stream", F.coalesce("frames", F.lit(0)).alias("frames"), "bad_ratio", F.when(none, "invalid").otherwise(F.col("status")).alias("status"), F.when(none, "no_frames").otherwise(F.col("reason")).alias("reason"))


def stream_status(quality: DataFrame, rules: QualityRules = RULES) -> DataFrame:
    """(stream, frames, bad_ratio, status, reason): whether a stream is usable and, if not, why."""
    out = quality.groupBy("stream").agg(F.count("*").alias("frames"), F.avg(F.col("bad").cast("int")).alias("bad_ratio"), *(F.every(c).alias(f"_{c}") for c in ("is_black", "is_white", "is_low_info")))
    invalid = F.col("bad_ratio") > rules.invalid_share
    reason = F.when(F.col("_is_black"), "all_frames_black").when(F.col("_is_white"), "all_frames_white").when(F.col("_is_low_info"), "all_frames_low_info").otherwise("invalid_quality")
    return out.select("stream", "frames", "bad_ratio", F.when(invalid, "invalid").otherwise("ok").alias("status"), F.when(invalid, reason).alias("reason"))


def valid_range(quality: DataFrame, rules: QualityRules = RULES) -> DataFrame:
    """(stream, valid_start, valid_end, status): from the first to the last good frame with enough good ones beside it."""
    order, span = Window.partitionBy("stream").orderBy("frame_index"), rules.tolerance + rules.min_valid
    good = (~F.col("bad")).cast("int")
    near = quality.withColumns({"_next": F.sum(good).over(order.rowsBetween(0, span)), "_before": F.sum(good).over(order.rowsBetween(-span, 0))})
    frame, ok = F.col("frame_index"), ~F.col("bad")
    ends = near.groupBy("stream").agg(
        F.coalesce(F.min(F.when(ok & (F.col("_next") > rules.min_valid), frame)), F.min(F.when(ok, frame)), F.min(frame)).alias("a"),
        F.coalesce(F.max(F.when(ok & (F.col("_before") > rules.min_valid), frame)), F.max(F.when(ok, frame)), F.max(frame)).alias("b"),
        F.max_by("frame_index", F.struct("quality_score", -frame)).alias("best"),
        F.min(frame).alias("first"),
        F.max(frame).alias("last"),
        (F.avg(F.col("bad").cast("int")) > rules.invalid_share).alias("invalid"),
    )
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    short = hi - lo < rules.min_valid
    return ends.select(
        "stream",
        F.when(F.col("invalid"), F.col("first")).when(short, F.col("best")).otherwise(lo).alias("valid_start"),
        F.when(F.col("invalid"), F.col("last")).when(short, F.col("best")).otherwise(hi).alias("valid_end"),
        F.when(F.col("invalid"), "invalid").otherwise("ok").alias("status"),
    )


def uniform_samples(ranges: DataFrame, k_short: int = 7, k_normal: int = 10, k_long: int = 14) -> DataFrame:
    """(stream, frame_index) evenly over [valid_start, valid_end]; how many depends on duration_sec."""
    a, b = F.col("valid_start"), F.col("valid_end")
    k = F.when(F.col("duration_sec") < 1, k_short).when(F.col("duration_sec") <= 3, k_normal).otherwise(k_long)
    k = F.greatest(F.lit(2), F.least(k, b - a + 1))
    points = F.array_sort(F.array_distinct(F.transform(linspace(a, b, k), lambda x: F.bround(x).cast("long"))))
    points = F.when(b <= a, F.array(a)).when(F.size(points) < 2, F.array(a, b)).otherwise(points)
    return ranges.select("stream", F.explode(points).alias("frame_index"))


def storyboard(quality: DataFrame, ranges: DataFrame, cells: int = 9, tolerance_ms: float = 50.0) -> DataFrame:
    """(stream, cell, target, frame_index): for even times, the sharpest usable frame within the tolerance, never going back.

    Candidates are listed from the target (a handful each) and meet frames by equality, so no range join is needed.
    """
    radius = tolerance_ms / 1000 * F.col("fps")
    a, b = F.col("valid_start"), F.col("valid_end")
    targets = ranges.select("stream", "fps", a, b, F.posexplode(F.when((b > a) & F.lit(cells > 1), linspace(a, b, cells)).otherwise(F.array(a.cast("double")))).alias("cell", "target"))
    clamp = lambda x: F.greatest(a, F.least(b, x))
    first, last = clamp(F.ceil(F.col("target") - radius)), clamp(F.floor(F.col("target") + radius))
    wanted = targets.withColumn("frame_index", F.explode(F.when((last >= first) & (radius > 0), F.sequence(first, last)).otherwise(F.array(clamp(F.bround("target").cast("long"))))))
    found = wanted.join(quality.select("stream", "frame_index", "bad", "sharpness"), ["stream", "frame_index"])
    best = found.groupBy("stream", "cell").agg(F.first("target").alias("target"), F.max_by("frame_index", F.struct(~F.col("bad"), F.col("sharpness"), -F.col("frame_index"))).alias("frame_index"))
    order = Window.partitionBy("stream").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    return best.select("stream", "cell", "target", F.max("frame_index").over(order).alias("frame_index"))


def window_best(df: DataFrame, fps: float, target_fps: float = 1.0, candidates: int = 5, rules: QualityRules = RULES) -> DataFrame:
    """(stream, window, frame_index, time_sec): per tumbling window the sharpest of a few evenly placed frames that is not black, white or flat."""
    length = max(1, int(round(fps / max(target_fps, 1e-6))))
    offsets = sorted({int(round(i * (length - 1) / (candidates - 1))) if candidates > 1 else 0 for i in range(candidates)}) if length >= candidates else range(length)
    seen = flags(df, rules).where((F.col("frame_index") % length).isin(*offsets) & ~F.col("is_black") & ~F.col("is_white") & ~F.col("is_low_info"))
    best = seen.groupBy("stream", F.floor(F.col("frame_index") / length).alias("window")).agg(F.max_by("frame_index", F.struct("sharpness", -F.col("frame_index"))).alias("frame_index"))
    return best.withColumn("time_sec", F.col("frame_index") / fps)


def group_best(df: DataFrame, fps: float, size: int = 3) -> DataFrame:
    """(stream, group, frame_index, time_sec): the sharpest of each run of size candidates."""
    best = df.groupBy("stream", F.floor(F.col("frame_index") / size).alias("group")).agg(F.max_by("frame_index", F.struct("sharpness", -F.col("frame_index"))).alias("frame_index"))
    return best.withColumn("time_sec", F.col("group") / fps)


def rate_candidates(shots: DataFrame, rate: float, candidates: int = 3, most: int = 0, key: tuple[str, ...] = ("stream",)) -> DataFrame:
    """(*key, group, slot, frame_index): the frames that shots (*key, fps, frames, start_sec, duration_sec) show at rate * candidates a second.

    Slot n shows the last frame of the shot that begins before n + 1/2 slots have passed, or its first one, so frames repeat where the
    rate is above theirs.  A shot has as many slots as fit its length, half a slot counting as one; most, if not 0,
    bounds its groups of candidates slots.  A null or negative start is 0; a null or zero duration goes to the end.
    A shot without fps, or that begins after its last frame, has none.
    """
    pace, fps = float(rate) * candidates, F.col("fps").cast("double")
    start = F.greatest(F.lit(0.0), F.coalesce(F.col("start_sec").cast("double"), F.lit(0.0)))
    left = F.col("frames") / fps - start
    length = F.when(F.col("duration_sec") > 0, F.least(left, F.col("duration_sec").cast("double"))).otherwise(left)
    count = F.floor(length * pace + 0.5)
    count = F.least(count, F.lit(most * candidates)) if most else count
    slots = shots.where(fps > 0).select(*key, "frames", fps.alias("fps"), start.alias("start"), F.explode(F.when(count > 0, F.sequence(F.lit(0).cast("long"), count - 1))).alias("slot"))
    first = F.ceil(F.col("start") * F.col("fps"))
    shown = F.ceil((F.col("slot") + 0.5) * F.col("fps") / pace + F.col("start") * F.col("fps")) - 1
    return slots.select(*key, F.floor(F.col("slot") / candidates).alias("group"), "slot", F.least(F.greatest(first, shown), F.col("frames") - 1).alias("frame_index"))


def cut_scores(df: DataFrame, threshold: float = 3.0, min_content: float = 15.0, reach: int = 2, key: tuple[str, ...] = ("stream",)) -> DataFrame:
    """(*key, frame_index, content, ratio, is_cut): change against the frame before, over the mean change of the neighbours, each within key."""
    order = Window.partitionBy(*key).orderBy("frame_index")
    df = df.select(*key, "frame_index", F.abs(F.col("luma_mean") - F.coalesce(F.lag("luma_mean").over(order), F.col("luma_mean"))).alias("content"))
    near, x = order.rowsBetween(-reach, reach), F.col("content")
    mean = F.try_divide(F.sum(x).over(near) - x, F.count(x).over(near) - 1)
    df = df.withColumn("_mean", F.coalesce(mean, F.lit(0.0)))
    ratio = F.when(F.col("_mean") > 1e-9, x / F.col("_mean")).when(x >= min_content, F.lit(255.0)).otherwise(F.lit(0.0))
    return df.select(*key, "frame_index", "content", ratio.alias("ratio"), ((ratio >= threshold) & (x >= min_content)).alias("is_cut"))
