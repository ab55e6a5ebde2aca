"""Queries on the documents that transcripts and shots are written as."""

from __future__ import annotations

from pyspark.sql import functions as F

from shotlake.plans import adapters as A
from shotlake.plans.speech_queries import _OVERLAP_SQL
from shotlake.session import scratch
from shotlake.sources import documents as D
from shotlake.sources import manifests as M
from shotlake.sources.outputs import Outputs


def _relations(spark, d):
    """Conversations as sources, turns as segments, and shots of which every second has a file."""
    u = A.utterances(spark, d)
    segments = u.select(F.col("conv_id").alias("stream"), F.col("turn").alias("index"), "start_sec", "end_sec", "speaker", "text")
    sources = u.groupBy(F.col("conv_id").alias("stream")).agg(F.max("end_sec").alias("duration_sec")).withColumn("file", F.format_string("in/clip_%d.mp4", "stream"))
    named = F.format_string("shot_%04d", "shot_index")
    shots = A.shots(spark, d).select(F.col("conv_id").alias("stream"), "shot_index", named.alias("shot_id"), F.when(F.col("shot_index") % 2 == 0, F.format_string("seg_%04d.mp4", "shot_index")).alias("file"), "start_sec", "end_sec")
    return sources, shots, segments


def shot_subtitle_files(spark, d):
    out = D.shot_documents(*_relations(spark, d)).where("path like '%.srt'")
    return out.select("path", F.col("content").cast("string").alias("content"))


def transcript_files(spark, d):
    sources, _, segments = _relations(spark, d)
    doc = F.from_json(F.col("content").cast("string"), "source struct<file:string,duration_sec:double>, speaker_count int, speakers array<string>, segments array<struct<index:long,speaker:string,text:string>>")
    rows = D.transcript_documents(sources, segments).where("path like '%.json'").select("path", doc.alias("d"))
    of = lambda c: F.array_join(F.transform("d.segments", lambda s: s[c].cast("string")), "|")
    return rows.select("path", F.col("d.source.file").alias("file"), F.round("d.source.duration_sec", 3).alias("duration_sec"), "d.speaker_count", F.array_join("d.speakers", ",").alias("speakers"), of("index").alias("turns"), F.md5(of("text").cast("binary")).alias("texts_md5"))


def latest_outputs(spark, d):
    """Frames of each stream as the outputs of four runs, with the number of the run that they are from.

    All streams are run, every third again, every seventh is dropped, every fourteenth comes back; then useless rows are compacted.
    """
    frames = A.frames(spark, d).select("stream", "frame_index", F.col("sharpness").alias("value"))
    streams, of = frames.select("stream").distinct(), lambda n, times: frames.withColumns({"version": F.lit(n), "value": F.col("value") * times})
    out = Outputs(spark, scratch(spark, "outputs"), of(1, 1).schema)
    out.write(of(1, 1))
    out.write(of(2, 2), streams.where("stream % 3 = 0"))
    out.drop(streams.where("stream % 7 = 0"))
    out.write(of(4, -1), out.pending(streams.where("stream % 14 = 0")))
    out.compacted()
    return out.read()


def quality_lines(spark, d):
    """What the debug file of frame qualities holds: four decimals, and flags as 1 and 0."""
    q = A.quality(spark, d).select("stream", "frame_index", "luma_mean", "luma_std", "sharpness", "bad")
    shown = M.debug_lines(q, dict.fromkeys(("luma_mean", "luma_std", "sharpness"), "%.4f"))
    return shown.select("stream", F.concat_ws(",", *shown.columns[1:]).alias("line"))


QUERIES = [shot_subtitle_files, transcript_files, latest_outputs, quality_lines]

_TIME = "'%02d:%02d:%02d,%03d --> %02d:%02d:%02d,%03d', a // 3600000, a // 60000 % 60, a // 1000 % 60, a % 1000, b // 3600000, b // 60000 % 60, b // 1000 % 60, b % 1000"

ORACLE_SQL = {
    "shot_subtitle_files": f"""WITH {_OVERLAP_SQL}, v_rel AS (SELECT o.conv_id, o.shot_index, o.turn, greatest(0, o.start_sec - o.shot_start) AS s, least(o.end_sec, o.shot_end) - o.shot_start AS e, u.speaker, u.text FROM v_owned o JOIN v_utter u USING (conv_id, turn) WHERE r = 1),
  v_n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, shot_index ORDER BY turn) AS n, CAST(round_even(s * 1000, 0) AS BIGINT) AS a, CAST(round_even(e * 1000, 0) AS BIGINT) AS b FROM v_rel WHERE e > s)
  SELECT printf('clip_%d/shot_%04d/', x.conv_id, x.shot_index) || CASE WHEN x.shot_index % 2 = 0 THEN printf('seg_%04d.srt', x.shot_index) ELSE printf('shot_%04d.srt', x.shot_index) END AS path,
    coalesce(string_agg(n || chr(10) || printf({_TIME}) || chr(10) || coalesce(nullif(speaker, ''), 'unknown') || ': ' || trim(text) || chr(10), chr(10) ORDER BY turn), '') AS content
  FROM v_shots x LEFT JOIN v_n USING (conv_id, shot_index) GROUP BY x.conv_id, x.shot_index""",
    "transcript_files": f"""WITH {A.UTTER_SQL} SELECT printf('clip_%d/transcript.json', conv_id) AS path, printf('in/clip_%d.mp4', conv_id) AS file, round(max(end_sec), 3) AS duration_sec, CAST(count(DISTINCT nullif(speaker, '')) AS INTEGER) AS speaker_count,
    array_to_string(list_sort(list_distinct(list(nullif(speaker, '')))), ',') AS speakers, string_agg(turn::VARCHAR, '|' ORDER BY turn) AS turns, md5(string_agg(text, '|' ORDER BY turn)) AS texts_md5 FROM v_utter GROUP BY conv_id""",
    "latest_outputs": f"""WITH {A.FRAMES_SQL}, v_of AS (SELECT *, CASE WHEN stream % 14 = 0 THEN 4 WHEN stream % 7 = 0 THEN 0 WHEN stream % 3 = 0 THEN 2 ELSE 1 END AS version FROM v_frames)
  SELECT stream, frame_index, CAST(version AS INTEGER) AS version, sharpness * CASE version WHEN 4 THEN -1 ELSE version END AS value FROM v_of WHERE version > 0""",
    "quality_lines": f"""WITH {A.QUALITY_SQL} SELECT stream, concat_ws(',', frame_index, printf('%.4f', luma_mean), printf('%.4f', luma_std), printf('%.4f', sharpness), CAST(bad AS INTEGER)) AS line FROM v_quality""",
}
