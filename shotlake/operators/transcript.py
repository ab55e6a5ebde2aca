"""Transcripts from recognised regions: sentences with word times, speakers, results of silent sources, labels of prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotlake.functions import text as T

#: Labels that a prompt may use.
LABELS = [*(f"<Picture {i}>" for i in range(1, 7)), *(f"<Audio {i}>" for i in range(1, 6))]


def sentence_spans(outputs: DataFrame) -> DataFrame:
    """(stream, region_no, sentence_no, text, start_sec, end_sec, words, timed) of recognised regions.

    outputs has (stream, region_no, start_sec, end_sec, text, words), word times
    counted from the region's start.  Sentences take as many words as they have
    tokens; if the totals differ, the text stays whole.  A region with text but
    no words gives one sentence over all of it, with timed false.
    """
    at = lambda x: F.round(x + F.col("start_sec"), 3)
    words = F.transform(F.coalesce("words", F.array().cast("array<struct<text:string,start:double,end:double>>")), lambda w: F.struct(w["text"].alias("text"), at(w["start"]).alias("start"), at(w["end"]).alias("end")))
    df = outputs.where(F.trim(F.coalesce("text", F.lit(""))) != "").withColumn("_words", words).withColumn("_parts", T.sentences(F.col("text")))
    n = F.size("_words")
    ranges = T.word_ranges(F.transform("_parts", T.token_count), n)
    whole = F.array(F.struct(F.lit(-1).alias("sentence"), F.lit(0).alias("first"), F.lit(-1).alias("last")))
    df = df.withColumn("_r", F.explode(F.when(n == 0, whole).otherwise(ranges)))
    mine = F.slice("_words", F.col("_r.first") + 1, F.greatest(F.lit(0), F.col("_r.last") - F.col("_r.first") + 1))
    single = (n == 0) | ((F.col("_r.first") == 0) & (F.col("_r.last") == n - 1))
    df = df.withColumn("_w", mine).withColumn("_ok", F.filter(mine, lambda w: w["end"] >= w["start"]))
    return df.select(
        "stream",
        "region_no",
        F.greatest(F.lit(0), F.col("_r.sentence")).alias("sentence_no"),
        F.when(single, F.trim("text")).otherwise(F.get("_parts", F.col("_r.sentence"))).alias("text"),
        F.coalesce(F.get("_ok", F.lit(0))["start"], F.col("start_sec")).alias("start_sec"),
        F.coalesce(F.get("_ok", F.size("_ok") - 1)["end"], F.col("end_sec")).alias("end_sec"),
        F.col("_w").alias("words"),
        (n > 0).alias("timed"),
    )


def results_with_reason(sources: DataFrame, regions: DataFrame, transcript: DataFrame) -> DataFrame:
    """(stream, segments, speakers, reason): a row for every source (stream, has_audio); reason is why there are no segments."""
    heard = regions.groupBy("stream").agg(F.count("*").alias("_regions"))
    said = transcript.groupBy("stream").agg(F.count("*").alias("segments"), F.sort_array(F.collect_set("speaker")).alias("speakers"))
    out = sources.join(heard, "stream", "left").join(said, "stream", "left")
    reason = F.when(F.col("segments") > 0, F.lit(None).cast("string")).when(F.col("has_audio").eqNullSafe(F.lit(False)), "no_audio").when(F.coalesce("_regions", F.lit(0)) == 0, "no_speech").otherwise("empty_transcript")
    return out.select("stream", F.coalesce("segments", F.lit(0)).alias("segments"), F.coalesce("speakers", F.array().cast("array<string>")).alias("speakers"), reason.alias("reason"))


def renumbered_speakers(segments: DataFrame, key: list[str]) -> DataFrame:
    """segments with label (S1), (S2), … by the first utterance of each speaker within key."""
    first = segments.withColumn("_first", F.min("start_sec").over(Window.partitionBy(*key, "speaker")))
    number = F.dense_rank().over(Window.partitionBy(*key).orderBy("_first", "speaker"))
    return first.withColumn("label", F.format_string("(S%d)", number)).drop("_first")


def forbidden_labels(text: Column) -> Column:
    """Labels in a prompt that are not allowed, each once."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"<(?:Picture|Audio|Subject|Video) \d+>"), F.lit(0)))
    return F.array_except(found, F.array(*map(F.lit, LABELS)))


def reference_lines(rows: int = 3, cols: int = 3, characters: int = 5) -> str:
    """What the reference labels of a prompt stand for."""
    n = max(1, rows * cols)
    lines = [f"- <Picture 1>: storyboard of this segment, {rows}x{cols}; its {n} cells are read left to right, top to bottom, as moments in time."]
    return "\n".join(lines + [f"- <Picture {i + 1}> / <Audio {i}>: look and voice of main character {i}, where present." for i in range(1, characters + 1)])


def shot_duration(duration: Column, start: Column, end: Column) -> Column:
    """The stated duration unless null or 0, else that of the span, at least 0."""
    return F.coalesce(F.nullif(duration, F.lit(0.0)), F.greatest(F.lit(0.0), end - start))


def accepted_cut(actual_sec: Column, wanted_sec: Column, tolerance: float = 0.1) -> Column:
    """Whether a copied clip is close enough to what was asked for; if not, or not known, it is encoded again."""
    return F.coalesce(F.abs(actual_sec - wanted_sec) <= tolerance, F.lit(False))


def representative_audio(windows: DataFrame) -> DataFrame:
    """(stream, label, samples): all of a cluster's clips in order of window, joined, as input of its voice print."""
    clips = windows.where(F.size("samples") > 0).groupBy("stream", "label").agg(F.array_sort(F.collect_list(F.struct("window_no", "samples"))).alias("_c"))
    return clips.select("stream", "label", F.flatten(F.transform("_c", lambda c: c["samples"])).alias("samples"))


def embeddable_faces(faces: DataFrame, min_px: float, min_score: float) -> DataFrame:
    """Faces large and clear enough to embed: of each owner the best by score, the first on ties."""
    ok = faces.where((F.least(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) >= min_px) & (F.col("score") >= min_score))
    order = Window.partitionBy("stream", "frame_index", "owner").orderBy(F.desc("score"), "face_no")
    return ok.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
