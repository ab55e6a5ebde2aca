"""Joins on overlap and nearness, sliding windows, smoothing and gap merging.

An interval join gets an equality condition from time buckets: each interval is
listed under the buckets it touches, so both sides shuffle on (key, bucket) and
a long stream is spread over many tasks instead of meeting as a nested loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _buckets(df: DataFrame, start: str, end: str, width: float, name: str) -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.floor(F.col(start) / width).cast("long"), F.floor(F.greatest(start, end) / width).cast("long"))))


def overlapping(left: DataFrame, right: DataFrame, key: str, width: float = 30.0) -> DataFrame:
    """Pairs of left (start_sec, end_sec) and right (r_start, r_end) of one key that overlap in more than a point, once each."""
    a = _buckets(left, "start_sec", "end_sec", width, "_bucket")
    b = _buckets(right, "r_start", "r_end", width, "_bucket")
    pairs = a.join(b, [key, "_bucket"]).where("start_sec < r_end and end_sec > r_start")
    # A pair meets in several buckets; the one where the later of the two begins counts.
    return pairs.where(F.col("_bucket") == F.floor(F.greatest("start_sec", "r_start") / width)).drop("_bucket")


def assigned_by_overlap(segments: DataFrame, shots: DataFrame, key: str, segment_id: str, width: float = 30.0) -> DataFrame:
    """(key, segment_id, shot_index, overlap): the shot that a segment overlaps most, the first on ties; segments that overlap none are left out."""
    right = shots.select(key, "shot_index", F.col("start_sec").alias("r_start"), F.col("end_sec").alias("r_end"))
    pairs = overlapping(segments.select(key, segment_id, "start_sec", "end_sec"), right, key, width)
    pairs = pairs.withColumn("overlap", F.least("end_sec", "r_end") - F.greatest("start_sec", "r_start")).where("overlap > 0")
    best = pairs.groupBy(key, segment_id).agg(F.max_by(F.struct("shot_index", "overlap"), F.struct("overlap", -F.col("shot_index"))).alias("b"))
    return best.select(key, segment_id, "b.shot_index", "b.overlap")


def voted_speaker(spans: DataFrame, windows: DataFrame, key: str, span_id: str, width: float = 30.0) -> DataFrame:
    """(key, span_id, speaker): the label of most overlapping windows, the larger label on ties; else that of the window with the nearest middle, the first on ties; else unknown.

    windows has (key, window_no, start_sec, end_sec, label).  The nearest one is
    found by as-of on both sides over sorted middles, not by comparing all pairs.
    """
    right = windows.select(key, F.col("label").alias("_label"), F.col("start_sec").alias("r_start"), F.col("end_sec").alias("r_end"))
    votes = overlapping(spans.select(key, span_id, "start_sec", "end_sec"), right, key, width).groupBy(key, span_id, "_label").count()
    voted = votes.groupBy(key, span_id).agg(F.max_by("_label", F.struct("count", "_label")).alias("speaker"))
    rest = spans.select(key, span_id, ((F.col("start_sec") + F.col("end_sec")) / 2).alias("at")).join(voted, [key, span_id], "left_anti")
    middles = windows.select(key, ((F.col("start_sec") + F.col("end_sec")) / 2).alias("at"), "window_no", "label")
    both = rest.select(key, "at", F.col(span_id).alias("_id"), F.lit(None).cast("struct<at:double,no:long,label:string>").alias("w")).unionByName(middles.select(key, "at", F.lit(None).cast(dict(spans.dtypes)[span_id]).alias("_id"), F.struct(F.col("at"), F.col("window_no").cast("long").alias("no"), F.col("label").cast("string").alias("label")).alias("w")))
    order = Window.partitionBy(key).orderBy("at", F.col("w.no").desc_nulls_last())
    near = both.withColumn("_p", F.last("w", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.first("w", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))).where("_id is not null")
    gap = lambda w: F.abs(w["at"] - F.col("at"))
    p, n = F.col("_p"), F.col("_n")
    pick = F.when(n.isNull(), p["label"]).when(p.isNull(), n["label"]).when((gap(p) < gap(n)) | ((gap(p) == gap(n)) & (p["no"] <= n["no"])), p["label"]).otherwise(n["label"])
    return voted.withColumn("speaker", F.col("speaker").cast("string")).unionByName(near.select(key, F.col("_id").alias(span_id), F.coalesce(pick, F.lit("unknown")).alias("speaker")))


def filled_by_nearest(df: DataFrame, key: str, position: str, label: str) -> DataFrame:
    """df with label, where null, from the row of the key with the nearest position that has one; the earlier on ties."""
    order = Window.partitionBy(key).orderBy(position)
    have = F.when(F.col(label).isNotNull(), F.struct(F.col(position).alias("at"), F.col(label).alias("label")))
    p = F.last(have, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    n = F.first(have, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    df = df.withColumn("_p", p).withColumn("_n", n)
    earlier = F.col("_n").isNull() | (F.col(position) - F.col("_p.at") <= F.col("_n.at") - F.col(position))
    return df.withColumn(label, F.when(F.col("_p").isNotNull() & earlier, F.col("_p.label")).otherwise(F.col("_n.label"))).drop("_p", "_n")


def scene_numbers(df: DataFrame, cuts: DataFrame, key: str, position: str) -> DataFrame:
    """df with scene: how many cuts (key, cut) lie at or before its position. One sorted pass over both."""
    marks = cuts.select(F.col(key), F.col("cut").alias(position), F.lit(1).alias("_cut"))
    both = df.withColumn("_cut", F.lit(0)).unionByName(marks, allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy(position, F.col("_cut").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("scene", F.sum("_cut").over(order)).where("_cut = 0").drop("_cut")


def dense_ids(df: DataFrame, key: str, columns: list[str], position: str, name: str) -> DataFrame:
    """df with name: 0-based numbers of distinct columns within key, by first appearance."""
    first = df.withColumn("_first", F.min(position).over(Window.partitionBy(key, *columns)))
    return first.withColumn(name, F.dense_rank().over(Window.partitionBy(key).orderBy("_first", *columns)) - 1).drop("_first")


def sliding_windows(regions: DataFrame, window_sec: float = 1.2, hop_sec: float = 0.4) -> DataFrame:
    """regions (…, start_sec, end_sec) as windows (…, w_start, w_end): steps of hop, a last one that ends with the region, short regions whole."""
    window, hop = max(0.2, window_sec), max(0.1, hop_sec)
    a, b = F.col("start_sec"), F.col("end_sec")
    n = F.floor((b + 1e-6 - a - window) / hop).cast("int")
    steps = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: F.struct((a + i * hop).alias("w_start"), (a + i * hop + window).alias("w_end")))
    tail = F.when(a + F.greatest(n, F.lit(0)) * hop + window < b - 1e-6, F.array(F.struct((b - window).alias("w_start"), b.alias("w_end")))).otherwise(F.slice(steps, 1, 0))
    all_ = F.when(b - a <= window, F.array(F.struct(a.alias("w_start"), b.alias("w_end")))).otherwise(F.concat(steps, tail))
    return regions.withColumn("_w", F.explode(all_)).select(*regions.columns, "_w.*")


def smoothed(df: DataFrame, key: str, position: str, label: str, radius: int = 1) -> DataFrame:
    """df with smooth_label, the commonest label within radius rows, the lowest on ties; keys of at most two rows keep theirs."""
    order = Window.partitionBy(key).orderBy(position)
    near = F.array_sort(F.collect_list(label).over(order.rowsBetween(-radius, radius)))
    best = F.array_max(F.transform(near, lambda x, i: F.struct(F.size(F.filter(near, lambda y: y == x)).alias("n"), (-F.array_position(near, x)).alias("p"), x.alias("x"))))["x"]
    return df.withColumn("smooth_label", F.when(F.count("*").over(Window.partitionBy(key)) <= 2, F.col(label)).otherwise(best))


def merged_gaps(df: DataFrame, key: str, cluster: str, position: str, most_gap: float, text: str) -> DataFrame:
    """(key, cluster, start_sec, end_sec, text, parts): runs of rows of one cluster no more than most_gap apart, with texts joined."""
    from shotlake.functions import text as T

    order = Window.partitionBy(key).orderBy(position)
    # Rows of a run follow each other, so the end of the run so far is the end of the row before.
    new = F.coalesce((F.col(cluster) != F.lag(cluster).over(order)) | (F.col("start_sec") - F.lag("end_sec").over(order) > most_gap), F.lit(True))
    runs = df.withColumn("_new", new.cast("int")).withColumn("island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy(key, "island").agg(
        F.min_by(cluster, position).alias(cluster), F.min_by("start_sec", position).alias("start_sec"), F.max_by("end_sec", position).alias("end_sec"), F.array_sort(F.collect_list(F.struct(position, F.col(text).alias("_t")))).alias("_l"), F.count("*").alias("parts")
    )
    return out.withColumn(text, F.aggregate(F.col("_l"), F.lit(""), lambda acc, x: T.joined(acc, x["_t"]))).drop("_l")


def subtitles_of_shots(segments: DataFrame) -> DataFrame:
    """segments with (shot_start, shot_end) as rel_start, rel_end inside the shot; empty ones go."""
    out = segments.withColumn("rel_start", F.greatest(F.lit(0.0), F.col("start_sec") - F.col("shot_start"))).withColumn("rel_end", F.least("end_sec", "shot_end") - F.col("shot_start"))
    return out.where("rel_end > rel_start")


def shot_speakers(subtitles: DataFrame, key: list[str], speaker: str = "speaker") -> DataFrame:
    """(key, speakers): the distinct known speakers of each shot, in order of name."""
    return subtitles.groupBy(*key).agg(F.sort_array(F.collect_set(F.nullif(F.trim(F.col(speaker)), F.lit("")))).alias("speakers"))


def kept_regions(df: DataFrame, min_sec: float = 0.6) -> DataFrame:
    return df.where((F.col("start_sec") >= 0) & (F.col("end_sec") > F.col("start_sec")) & (F.col("end_sec") - F.col("start_sec") >= min_sec))


def spoken(df: DataFrame, text: str = "text") -> Column:
    return F.trim(F.coalesce(F.col(text), F.lit(""))) != ""


def speaker_archive(df: DataFrame, key: str, low: float = 1.0, high: float = 30.0) -> DataFrame:
    """Rows with a known speaker and a duration in [low, high], numbered by time within the speaker."""
    out = df.withColumn("duration", F.round(F.col("end_sec") - F.col("start_sec"), 3)).where(F.col("speaker").isNotNull() & (F.col("speaker") != "unknown") & F.col("duration").between(low, high))
    return out.withColumn("seq", F.row_number().over(Window.partitionBy(key, "speaker").orderBy("start_sec", "end_sec")))


def speaker_rollup(archive: DataFrame, key: str) -> DataFrame:
    return archive.groupBy(key, "speaker").agg(F.count("*").alias("count"), F.round(F.sum("duration"), 3).alias("total_duration"))
