"""Queries on utterances, windows, speakers, sentences, subtitles and prompts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shotlake.functions import text as T
from shotlake.operators import intervals as I
from shotlake.plans import adapters as A


def shot_overlap_assign(spark, d):
    out = I.assigned_by_overlap(A.utterances(spark, d), A.shots(spark, d), "conv_id", "turn")
    return out.withColumn("overlap", F.round("overlap", 3))


def shot_subtitles(spark, d):
    """Utterances of each shot, relative to its start."""
    u, s = A.utterances(spark, d), A.shots(spark, d)
    owned = I.assigned_by_overlap(u, s, "conv_id", "turn").join(u, ["conv_id", "turn"])
    owned = owned.join(s.select("conv_id", "shot_index", F.col("start_sec").alias("shot_start"), F.col("end_sec").alias("shot_end")), ["conv_id", "shot_index"])
    return I.subtitles_of_shots(owned).select("conv_id", "shot_index", "turn", F.round("rel_start", 3).alias("rel_start"), F.round("rel_end", 3).alias("rel_end"))


def _windows(spark, d):
    w = I.sliding_windows(A.utterances(spark, d).where("end_sec - start_sec >= 0.6").select("conv_id", "turn", "speaker", "start_sec", "end_sec"), 4.0, 2.5)
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("w_start", "turn")) - 1
    return w.select("conv_id", "turn", "speaker", "w_start", "w_end").withColumn("window_no", number)


_WINDOWS_SQL = A.UTTER_SQL + """, v_regions AS (SELECT *, end_sec - start_sec <= 4.0 AS short, greatest(0, CAST(floor((end_sec + 1e-6 - start_sec - 4.0) / 2.5) AS BIGINT)) AS n FROM v_utter WHERE end_sec - start_sec >= 0.6),
v_slid AS (SELECT conv_id, turn, speaker, start_sec AS w_start, end_sec AS w_end FROM v_regions WHERE short
  UNION ALL SELECT conv_id, turn, speaker, start_sec + i * 2.5::DOUBLE, start_sec + i * 2.5::DOUBLE + 4.0 FROM v_regions, LATERAL (SELECT unnest(generate_series(0, n)) AS i) WHERE NOT short
  UNION ALL SELECT conv_id, turn, speaker, end_sec - 4.0, end_sec FROM v_regions WHERE NOT short AND start_sec + n * 2.5::DOUBLE + 4.0 < end_sec - 1e-6),
v_windows AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY w_start, turn) - 1 AS window_no FROM v_slid)"""


def sliding_windows(spark, d):
    return _windows(spark, d).select("conv_id", "turn", F.round("w_start", 6).alias("w_start"), F.round("w_end", 6).alias("w_end"))


def speaker_vote(spark, d):
    """Spans between the middles of neighbouring turns vote by windows; spans in silence take the nearest."""
    spans = A.utterances(spark, d).select("conv_id", "turn", (F.col("end_sec") - 0.25).alias("start_sec"), (F.col("end_sec") + 0.125).alias("end_sec"))
    far = A.utterances(spark, d).select("conv_id", (F.col("turn") + 100).alias("turn"), (F.col("end_sec") + 500).alias("start_sec"), (F.col("end_sec") + 501).alias("end_sec"))
    w = _windows(spark, d).select("conv_id", "window_no", F.col("w_start").alias("start_sec"), F.col("w_end").alias("end_sec"), F.col("speaker").alias("label"))
    return I.voted_speaker(spans.unionByName(far), w, "conv_id", "turn")


def nearest_label_fill(spark, d):
    f = A.frames(spark, d).withColumn("label", F.when(F.col("luma_std") >= 60, F.col("event_type")))
    return I.filled_by_nearest(f.select("stream", "frame_index", "label"), "stream", "frame_index", "label")


def scene_asof(spark, d):
    f = A.frames(spark, d).select("stream", "frame_index", (F.col("event_id") % 7).alias("base_track"), "event_id")
    cuts = f.where("event_id % 23 = 0").select("stream", F.col("frame_index").alias("cut"))
    scenes = I.scene_numbers(f.select("stream", "frame_index", "base_track"), cuts, "stream", "frame_index")
    return I.dense_ids(scenes, "stream", ["base_track", "scene"], "frame_index", "track_id").select("stream", "frame_index", F.col("scene").cast("long").alias("scene"), F.col("track_id").cast("long").alias("track_id"))


def label_majority_smooth(spark, d):
    f = A.frames(spark, d).select("stream", "frame_index", F.col("event_type").alias("label"))
    return I.smoothed(f, "stream", "frame_index", "label").select("stream", "frame_index", "smooth_label")


def sentence_gap_merge(spark, d):
    out = I.merged_gaps(A.utterances(spark, d), "conv_id", "cluster", "turn", 0.8, "text")
    return out.select("conv_id", "island", "cluster", F.round("start_sec", 3).alias("start_sec"), F.round("end_sec", 3).alias("end_sec"), F.md5("text").alias("text_md5"), "parts")


def srt_render(spark, d):
    u = A.utterances(spark, d)
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    blocks = u.withColumn("block", T.srt_block(n, F.col("start_sec"), F.col("end_sec"), F.col("speaker"), F.col("text")))
    doc = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "block"))), lambda x: x["block"]), "\n")
    return blocks.groupBy("conv_id").agg(doc.alias("srt"))


def speaker_archive_rollup(spark, d):
    u = A.utterances(spark, d).withColumn("speaker", F.when(F.col("turn") % 5 == 4, "unknown").otherwise(F.col("speaker")))
    archive = I.speaker_archive(u, "conv_id")
    return I.speaker_rollup(archive, "conv_id").join(archive.groupBy("conv_id", "speaker").agg(F.max("seq").cast("long").alias("last_seq")), ["conv_id", "speaker"])


#: Texts that the fixture tables lack: ideographs, closers, abbreviations, several ends.
_LITERALS = ["你好。世界！", 'He said "Stop." Then left.', "v1.2 is out... now? Yes!", "3.14 is pi.\nNext line", "안녕 hello 世界 don't", ""]
_LITERAL_ROWS = ", ".join("({}, '{}')".format(-1 - i, x.replace("'", "''")) for i, x in enumerate(_LITERALS))


def _texts(spark, d):
    more = spark.createDataFrame([(-1 - i, x) for i, x in enumerate(_LITERALS)], "doc_id long, text string")
    return A.table(spark, d, "documents").select("doc_id", "text").unionByName(more)


_TEXTS_SQL = f"v_texts AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES {_LITERAL_ROWS}) t(doc_id, text))"
_SENTENCES_SQL = (
    _TEXTS_SQL
    + r""", v_marked AS (SELECT doc_id, text, regexp_replace(regexp_replace(text, '([。！？!?…\n]["''”’)\]}】》]*|\.["''”’)\]}】》]+)', '\1' || chr(1), 'g'), '\.(\s|$)', '.' || chr(1) || '\1', 'g') AS marked FROM v_texts),
v_sentences AS (SELECT doc_id, text, list_filter(string_split(marked, chr(1)), lambda s: regexp_replace(s, '\s', '', 'g') <> '') AS sentences FROM v_marked)"""
)
_CJK_SQL = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{F900}-\x{FAFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7A3}"


def _tokens_sql(x):
    return rf"len(regexp_extract_all(regexp_replace({x}, '[^\p{{L}}\p{{N}}''\s]', '', 'g'), '[{_CJK_SQL}]|[^{_CJK_SQL}\s]+'))"


def sentence_split(spark, d):
    s = _texts(spark, d).withColumn("s", T.sentences(F.col("text")))
    return s.select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "|")).alias("sentences_md5"))


def token_count(spark, d):
    return _texts(spark, d).select("doc_id", T.token_count(F.col("text")).cast("long").alias("tokens"))


def word_alignment(spark, d):
    """Word ranges of sentences; texts whose id is a multiple of ten have a word too many, so they stay whole."""
    s = _texts(spark, d).withColumn("c", F.coalesce(F.transform(T.sentences(F.col("text")), T.token_count), F.array().cast("array<int>")))
    total = F.aggregate("c", F.lit(0), lambda a, x: a + x) + F.when(F.col("doc_id") % 10 == 0, 1).otherwise(0)
    spans = s.select("doc_id", F.explode(T.word_ranges(F.col("c"), total)).alias("r"))
    return spans.select("doc_id", *(F.col(f"r.{c}").cast("long").alias(c) for c in ("sentence", "first", "last")))


def text_join_cjk(spark, d):
    c = A.table(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    more = spark.createDataFrame([(-1, 0, "你好"), (-1, 1, "world"), (-1, 2, ""), (-1, 3, "hi"), (-1, 4, "世界")], "conv_id long, turn long, text string")
    nxt = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return c.unionByName(more).withColumn("nxt", nxt).where("nxt is not null").select("conv_id", "turn", F.md5(T.joined(F.col("text"), F.col("nxt"))).alias("joined_md5"))


_OUTPUTS = ["<think>x</think>ok", "```json\n{\"a\": 1}\n```", "a<|im_end|>b\r\nc", "done <THINKING foo>never closed", "  Summary: x  ", "<reasoning>a</reasoning>```\ncode\n```", "subject_definitions: a summary: b"]


def prompt_clean(spark, d):
    more = spark.createDataFrame([(-1 - i, x) for i, x in enumerate(_OUTPUTS)], "id long, text string")
    docs = A.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("<think>plan\n"), F.substring("text", 1, 40), F.lit("</think>\n```text\n"), F.col("text"), F.lit("\n```<|endoftext|>")).alias("text"))
    clean = F.when(F.col("text").isNotNull(), T.cleaned_output(F.col("text")))
    return docs.unionByName(more).select("id", clean.alias("clean")).select("id", F.md5("clean").alias("clean_md5"), F.length("clean").cast("long").alias("n"))


def prompt_missing_sections(spark, d):
    more = spark.createDataFrame([(-1 - i, x) for i, x in enumerate(_OUTPUTS)], "id long, text string")
    docs = A.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat(F.col("text"), F.when(F.col("doc_id") % 2 == 0, " SUMMARY: x").otherwise("")).alias("text"))
    return docs.unionByName(more).select("id", F.array_join(T.missing_sections(F.col("text")), ",").alias("missing"))


_TEMPLATE = "Duration {{DURATION}} s at {{FPS}} fps.\nSpeakers: {{SPEAKERS}}\n{{SUBTITLES}}\nFrames: {{FRAME_COUNT}}"


def prompt_render(spark, d):
    u = A.utterances(spark, d)
    line = F.concat(F.lit("["), T.seconds_text(F.col("start_sec")), F.lit("s - "), T.seconds_text(F.col("end_sec")), F.lit("s] "), F.col("speaker"), F.lit(": "), F.trim("text"))
    g = u.withColumn("line", line).groupBy("conv_id").agg(
        F.max("end_sec").alias("dur"), F.array_join(F.sort_array(F.collect_set("speaker")), ", ").alias("speakers"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n").alias("lines"), F.count("*").alias("n")
    )
    values = {"DURATION": T.seconds_text(F.col("dur")), "FPS": T.plain_number(F.lit(2.5) + F.col("conv_id") % 2 * 0.5), "SPEAKERS": F.col("speakers"), "SUBTITLES": F.col("lines"), "FRAME_COUNT": F.col("n").cast("string")}
    return g.select("conv_id", T.filled(F.lit(_TEMPLATE), values).alias("prompt"))


def audible_nullsafe(spark, d):
    """Orders as sources: whether there is sound is true, false or not known; only a clear no is left out."""
    o = A.table(spark, d, "orders")
    sound = F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False)
    return o.withColumn("has_audio", sound).where(~F.col("has_audio").eqNullSafe(F.lit(False))).groupBy("has_audio").agg(F.count("*").alias("sources"))


QUERIES = [shot_overlap_assign, shot_subtitles, sliding_windows, speaker_vote, nearest_label_fill, scene_asof, label_majority_smooth, sentence_gap_merge, srt_render, speaker_archive_rollup, sentence_split, token_count, word_alignment, text_join_cjk, prompt_clean, prompt_missing_sections, prompt_render, audible_nullsafe]

_OVERLAP_SQL = A.SHOTS_SQL + """, v_owned AS (SELECT u.conv_id, u.turn, s.shot_index, u.start_sec, u.end_sec, s.start_sec AS shot_start, s.end_sec AS shot_end, least(u.end_sec, s.end_sec) - greatest(u.start_sec, s.start_sec) AS overlap,
  row_number() OVER (PARTITION BY u.conv_id, u.turn ORDER BY least(u.end_sec, s.end_sec) - greatest(u.start_sec, s.start_sec) DESC, s.shot_index) AS r
  FROM v_utter u JOIN v_shots s ON u.conv_id = s.conv_id AND least(u.end_sec, s.end_sec) - greatest(u.start_sec, s.start_sec) > 0)"""

_outputs_sql = ", ".join("({}, '{}')".format(-1 - i, x.replace("'", "''")) for i, x in enumerate(_OUTPUTS))


def _seconds_sql(x):
    h = f"CAST(round_even(round({x} * 1000) / 10.0::DOUBLE, 0) AS BIGINT)"
    return f"({h} // 100) || '.' || lpad(CAST({h} % 100 AS VARCHAR), 2, '0')"


_seam = rf"regexp_matches(text, '[{_CJK_SQL}]$') OR regexp_matches(nxt, '^[{_CJK_SQL}]')"
_think = "(?is)<(?:think|thinking|reasoning)\\b[^>]*>"

ORACLE_SQL = {
    "shot_overlap_assign": f"WITH {_OVERLAP_SQL} SELECT conv_id, turn, shot_index, round(overlap, 3) AS overlap FROM v_owned WHERE r = 1",
    "shot_subtitles": f"WITH {_OVERLAP_SQL} SELECT conv_id, shot_index, turn, round(greatest(0, start_sec - shot_start), 3) AS rel_start, round(least(end_sec, shot_end) - shot_start, 3) AS rel_end FROM v_owned WHERE r = 1 AND least(end_sec, shot_end) - shot_start > greatest(0, start_sec - shot_start)",
    "sliding_windows": f"WITH {_WINDOWS_SQL} SELECT conv_id, turn, round(w_start, 6) AS w_start, round(w_end, 6) AS w_end FROM v_windows",
    "speaker_vote": f"""WITH {_WINDOWS_SQL}, v_spans AS (SELECT conv_id, turn, end_sec - 0.25 AS s, end_sec + 0.125 AS e FROM v_utter UNION ALL SELECT conv_id, turn + 100, end_sec + 500, end_sec + 501 FROM v_utter),
  v_votes AS (SELECT p.conv_id, p.turn, w.speaker, row_number() OVER (PARTITION BY p.conv_id, p.turn ORDER BY count(*) DESC, w.speaker DESC) AS r FROM v_spans p JOIN v_windows w ON p.conv_id = w.conv_id AND w.w_end > p.s AND w.w_start < p.e GROUP BY p.conv_id, p.turn, w.speaker),
  v_rest AS (SELECT * FROM v_spans p WHERE NOT EXISTS (SELECT 1 FROM v_votes v WHERE v.conv_id = p.conv_id AND v.turn = p.turn)),
  v_near AS (SELECT p.conv_id, p.turn, w.speaker, row_number() OVER (PARTITION BY p.conv_id, p.turn ORDER BY abs((w.w_start + w.w_end) / 2 - (p.s + p.e) / 2), w.window_no) AS r FROM v_rest p LEFT JOIN v_windows w USING (conv_id))
  SELECT conv_id, turn, speaker FROM v_votes WHERE r = 1 UNION ALL SELECT conv_id, turn, coalesce(speaker, 'unknown') FROM v_near WHERE r = 1""",
    "nearest_label_fill": f"""WITH {A.FRAMES_SQL}, v_l AS (SELECT stream, frame_index, CASE WHEN luma_std >= 60 THEN event_type END AS label FROM v_frames),
  v_r AS (SELECT a.stream, a.frame_index, b.label, row_number() OVER (PARTITION BY a.stream, a.frame_index ORDER BY abs(a.frame_index - b.frame_index), b.frame_index) AS r FROM v_l a LEFT JOIN v_l b ON a.stream = b.stream AND b.label IS NOT NULL)
  SELECT stream, frame_index, label FROM v_r WHERE r = 1""",
    "scene_asof": f"""WITH {A.FRAMES_SQL}, v_s AS (SELECT stream, frame_index, event_id % 7 AS base_track, sum(CASE WHEN event_id % 23 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY frame_index) AS scene FROM v_frames),
  v_f AS (SELECT *, min(frame_index) OVER (PARTITION BY stream, base_track, scene) AS f FROM v_s)
  SELECT stream, frame_index, CAST(scene AS BIGINT) AS scene, dense_rank() OVER (PARTITION BY stream ORDER BY f, base_track, scene) - 1 AS track_id FROM v_f""",
    "label_majority_smooth": f"""WITH {A.FRAMES_SQL}, v_n AS (SELECT a.stream, a.frame_index, b.event_type AS label, row_number() OVER (PARTITION BY a.stream, a.frame_index ORDER BY count(*) DESC, b.event_type) AS r
    FROM v_frames a JOIN v_frames b ON a.stream = b.stream AND abs(a.frame_index - b.frame_index) <= 1 GROUP BY a.stream, a.frame_index, b.event_type), v_c AS (SELECT stream, count(*) AS n FROM v_frames GROUP BY stream)
  SELECT f.stream, f.frame_index, CASE WHEN n <= 2 THEN f.event_type ELSE v_n.label END AS smooth_label FROM v_frames f JOIN v_c USING (stream) JOIN v_n ON v_n.stream = f.stream AND v_n.frame_index = f.frame_index AND v_n.r = 1""",
    "sentence_gap_merge": f"""WITH {A.UTTER_SQL}, v_new AS (SELECT *, CASE WHEN cluster <> lag(cluster) OVER w OR start_sec - lag(end_sec) OVER w > 0.8 OR lag(turn) OVER w IS NULL THEN 1 ELSE 0 END AS n FROM v_utter WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
  v_is AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM v_new)
  SELECT conv_id, CAST(island AS BIGINT) AS island, cluster, round(min(start_sec), 3) AS start_sec, round(max(end_sec), 3) AS end_sec, md5(string_agg(text, ' ' ORDER BY turn)) AS text_md5, count(*) AS parts FROM v_is GROUP BY conv_id, island, cluster""",
    "srt_render": f"""WITH {A.UTTER_SQL}, v_b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, CAST(round(start_sec * 1000) AS BIGINT) AS a, CAST(round(end_sec * 1000) AS BIGINT) AS b FROM v_utter)
  SELECT conv_id, string_agg(n || chr(10) || printf('%02d:%02d:%02d,%03d --> %02d:%02d:%02d,%03d', a // 3600000, a // 60000 % 60, a // 1000 % 60, a % 1000, b // 3600000, b // 60000 % 60, b // 1000 % 60, b % 1000) || chr(10) || speaker || ': ' || trim(text) || chr(10), chr(10) ORDER BY turn) AS srt FROM v_b GROUP BY conv_id""",
    "speaker_archive_rollup": f"""WITH {A.UTTER_SQL}, v_d AS (SELECT conv_id, speaker, round(end_sec - start_sec, 3) AS d FROM v_utter WHERE turn % 5 <> 4)
  SELECT conv_id, speaker, count(*) AS count, round(sum(d), 3) AS total_duration, count(*) AS last_seq FROM v_d WHERE speaker IS NOT NULL AND speaker <> 'unknown' AND d BETWEEN 1 AND 30 GROUP BY conv_id, speaker""",
    "sentence_split": f"WITH {_SENTENCES_SQL} SELECT doc_id, len(sentences) AS n, md5(array_to_string(sentences, '|')) AS sentences_md5 FROM v_sentences",
    "token_count": f"WITH {_TEXTS_SQL} SELECT doc_id, {_tokens_sql('text')} AS tokens FROM v_texts",
    "word_alignment": f"""WITH {_SENTENCES_SQL}, v_c AS (SELECT doc_id, unnest(sentences) AS s, unnest(generate_series(0, len(sentences) - 1)) AS sentence FROM v_sentences), v_n AS (SELECT doc_id, sentence, {_tokens_sql('s')} AS n FROM v_c),
  v_e AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY sentence) AS e, sum(n) OVER (PARTITION BY doc_id) AS total FROM v_n)
  SELECT doc_id, sentence, CAST(e - n AS BIGINT) AS "first", CAST(e - 1 AS BIGINT) AS "last" FROM v_e WHERE n > 0 AND doc_id % 10 <> 0
  UNION ALL SELECT doc_id, 0, 0, CAST(coalesce(any_value(total), 0) AS BIGINT) FROM v_sentences LEFT JOIN v_e USING (doc_id) WHERE doc_id % 10 = 0 GROUP BY doc_id""",
    "text_join_cjk": f"""WITH v_c AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations UNION ALL SELECT * FROM (VALUES (-1, 0, '你好'), (-1, 1, 'world'), (-1, 2, ''), (-1, 3, 'hi'), (-1, 4, '世界')) t(conv_id, turn, text)),
  v_n AS (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM v_c)
  SELECT conv_id, turn, md5(CASE WHEN text = '' THEN nxt WHEN nxt = '' THEN text WHEN {_seam} THEN text || nxt ELSE text || ' ' || nxt END) AS joined_md5 FROM v_n WHERE nxt IS NOT NULL""",
    "prompt_clean": rf"""WITH v_t AS (SELECT doc_id AS id, '<think>plan' || chr(10) || substring(text, 1, 40) || '</think>' || chr(10) || '```text' || chr(10) || text || chr(10) || '```<|endoftext|>' AS text FROM documents UNION ALL SELECT * FROM (VALUES {_outputs_sql}) t(id, text)),
  v_1 AS (SELECT id, regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '{_think}.*?</(?:think|thinking|reasoning)>', '', 'g'), '<\|(?:im_start|im_end|endoftext|eot_id|start_header_id|end_header_id)\|>', '', 'g') AS t FROM v_t),
  v_2 AS (SELECT id, regexp_replace(regexp_replace(regexp_replace(t, '(?s)^\s*```[a-zA-Z0-9_-]*\s*(.*?)\s*```\s*$', '\1'), '{_think}.*', ''), '^\s+|\s+$', '', 'g') AS t FROM v_1)
  SELECT id, md5(t) AS clean_md5, length(t) AS n FROM v_2""",
    "prompt_missing_sections": f"""WITH v_t AS (SELECT doc_id AS id, text || CASE WHEN doc_id % 2 = 0 THEN ' SUMMARY: x' ELSE '' END AS text FROM documents UNION ALL SELECT * FROM (VALUES {_outputs_sql}) t(id, text))
  SELECT id, array_to_string(list_filter({T.SECTIONS}, lambda h: NOT contains(lower(text), h)), ',') AS missing FROM v_t""",
    "prompt_render": f"""WITH {A.UTTER_SQL}, v_g AS (SELECT conv_id, max(end_sec) AS dur, array_to_string(list_sort(list_distinct(list(speaker))), ', ') AS speakers, string_agg('[' || {_seconds_sql('start_sec')} || 's - ' || {_seconds_sql('end_sec')} || 's] ' || speaker || ': ' || trim(text), chr(10) ORDER BY turn) AS lines, count(*) AS n FROM v_utter GROUP BY conv_id)
  SELECT conv_id, 'Duration ' || {_seconds_sql('dur')} || ' s at ' || CASE WHEN conv_id % 2 = 0 THEN '2.5' ELSE '3' END || ' fps.' || chr(10) || 'Speakers: ' || speakers || chr(10) || lines || chr(10) || 'Frames: ' || n AS prompt FROM v_g""",
    "audible_nullsafe": "SELECT CASE o_orderstatus WHEN 'F' THEN true END AS has_audio, count(*) AS sources FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1",
}
