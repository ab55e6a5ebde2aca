"""One query for each rule that works on a row, or on a small group, of any relation."""

from __future__ import annotations

from pyspark.sql import functions as F

from shotlake.functions import geometry as G
from shotlake.functions import text as T
from shotlake.functions import vectors as V
from shotlake.operators import frames as FR
from shotlake.operators import identity as ID
from shotlake.operators import intervals as IV
from shotlake.operators import registry as R
from shotlake.operators import transcript as TR
from shotlake.plans import adapters as A
from shotlake.sources import manifests as MF
from shotlake.sources import media as MD


def _orders(spark, d):
    return A.table(spark, d, "orders").withColumn("k", F.col("o_orderkey"))


def _picked(key, values):
    """The value at key modulo their number."""
    return F.get(F.array(*(F.lit(v).cast("string") for v in values)), F.pmod(key, F.lit(len(values))).cast("int"))


def _picked_sql(key, values):
    return "([" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + f"])[1 + {key} % {len(values)}]"


def rate_parse(spark, d):
    k = F.col("k")
    value = F.when(k % 5 == 0, _picked(k / 5, _RATES)).otherwise(F.concat(k.cast("string"), F.lit("/"), (k % 1002).cast("string")))
    return _orders(spark, d).select("o_orderkey", T.rate(value).alias("rate"))


_RATES = ["30000/1001", "24", "25/0", "n/a", "", None, "60/1"]


def metadata_completion(spark, d):
    k = F.col("k")
    probes = _orders(spark, d).select("o_orderkey", _picked(k, ["30000/1001", "0/0", None, "25"]).alias("rate"), F.when(k % 3 != 0, k % 900).alias("frame_count"), F.when(k % 4 != 0, (k % 700) / 8.0).alias("duration_sec"))
    return MD.completed_metadata(probes).select("o_orderkey", "fps", "frame_count", "duration_sec")


def image_similarity(spark, d):
    e = A.table(spark, d, "embeddings")
    return e.select("vec_id", V.pixel_similarity(F.slice("embedding", 1, 16), F.slice("embedding", 17, 16)).alias("similarity"))


def vector_angle(spark, d):
    e, k = A.table(spark, d, "embeddings"), F.col("vec_id")
    a = F.when(k % 7 == 0, F.transform(F.slice("embedding", 1, 3), lambda x: x * 0)).otherwise(F.slice("embedding", 1, 3))
    return e.select("vec_id", V.angle_degrees(a, F.slice("embedding", 4, 3)).alias("degrees"))


def cosine_of_unlike_sizes(spark, d):
    e, k = A.table(spark, d, "embeddings"), F.col("vec_id")
    b = F.when(k % 7 == 0, F.lit(None)).when(k % 5 == 0, F.slice("embedding", 33, 31)).otherwise(F.slice("embedding", 33, 32))
    return e.select("vec_id", V.cosine_or_mismatch(F.slice("embedding", 1, 32), b).alias("cosine"))


def unit_vectors(spark, d):
    e = A.table(spark, d, "embeddings")
    return e.select("vec_id", F.posexplode(V.normalized(F.slice("embedding", 1, 4))).alias("place", "value")).withColumn("place", F.col("place").cast("long"))


def audio_level(spark, d):
    e, k = A.table(spark, d, "embeddings"), F.col("vec_id")
    samples = F.when(k % 9 == 0, F.transform("embedding", lambda x: x * 0)).when(k % 9 == 1, F.slice("embedding", 1, 0)).otherwise(F.transform("embedding", lambda x: x / 4))
    return e.select("vec_id", V.audio_level_dbfs(samples).alias("dbfs"))


def audio_clips(spark, d):
    k = F.col("vec_id")
    e = A.table(spark, d, "embeddings").select("vec_id", "embedding", (k % 11 / 8.0 - 0.25).alias("start_sec"), (k % 17 / 8.0).alias("end_sec"), F.lit(48).alias("rate"))
    clip = V.clip_samples(F.col("embedding"), "start_sec", "end_sec", "rate")
    return e.select("vec_id", F.size(clip).cast("long").alias("n"), F.get(clip, F.lit(0)).cast("double").alias("first"), F.get(clip, F.size(clip) - 1).cast("double").alias("last"))


def person_boxes(spark, d):
    k = F.col("p_partkey")
    face = F.struct((k * 37 % 600).cast("double").alias("x1"), (k * 53 % 340).cast("double").alias("y1"), (k * 37 % 600 + k % 41).cast("double").alias("x2"), (k * 53 % 340 + F.col("p_size")).cast("double").alias("y2"))
    p = A.table(spark, d, "part").select(k.alias("part"), face.alias("face"))
    return p.select("part", G.person_box_from_face(F.col("face"), F.lit(640.0), F.lit(360.0)).alias("b")).select("part", "b.*")


def croppable_boxes(spark, d):
    k = F.col("p_partkey")
    p = A.table(spark, d, "part").select(k.alias("part"), F.when(k % 9 != 0, F.struct((k % 50).alias("x1"), (k % 30).alias("y1"), (k % 50 + k % 64).alias("x2"), (k % 30 + k % 128).alias("y2"))).alias("box"))
    return p.where(G.croppable(F.col("box"))).select("part")


def spoken_regions(spark, d):
    u = A.utterances(spark, d)
    return IV.kept_regions(u.where(IV.spoken(u)), 2.0).select("conv_id", "turn")


def embeddable_faces(spark, d):
    k = F.col("p_partkey")
    faces = A.table(spark, d, "part").select(F.col("p_brand").alias("stream"), (k % 5).alias("frame_index"), F.col("p_size").alias("owner"), k.alias("face_no"), F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), (k % 61).cast("double").alias("x2"), (k % 47).cast("double").alias("y2"), (k % 10 / 10.0).alias("score"))
    return TR.embeddable_faces(faces, 20.0, 0.3).select("stream", "frame_index", "owner", "face_no")


def describable_shots(spark, d):
    shots = A.table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_nationkey") % 3 == 0, "invalid").otherwise("ok").alias("status"))
    return MF.describable(shots)


def first_orders(spark, d):
    return MF.first_items(_orders(spark, d).select("o_orderkey", "o_orderdate"), 25, "o_orderdate", "o_orderkey").select("o_orderkey")


def prompt_labels(spark, d):
    k = F.col("k")
    text = F.concat(F.lit("<Picture "), k % 9, F.lit("> with <Audio "), k % 7, F.lit("> and <Subject "), k % 2, F.lit("> <Picture "), k % 3, F.lit("> <picture 9>"))
    return _orders(spark, d).select("o_orderkey", F.array_join(F.sort_array(TR.forbidden_labels(text)), ",").alias("labels"))


def numbers_as_text(spark, d):
    k = F.col("k")
    x = F.when(k % 3 == 0, k / 8.0).otherwise((k % 40).cast("double"))
    return _orders(spark, d).select("o_orderkey", T.plain_number(x).alias("plain"), T.short_number(x).alias("short"), T.seconds_text(k / 1000.0).alias("seconds"))


_NAMES = ["Shot 12.mp4", "a:b?.MP4", "", "clip007.mov", "ünï.mkv", ".hidden", "x.y.z", "  .mp4", None, "dir/10.avi"]
_STEMS = ["song_(Vocals).wav", "song_(Instrumental).wav", "x_no_reverb.wav", "x_reverb.wav", "inst_1.wav", "no_vocals.wav", "other.wav", "VOCAL.WAV", "No Reverb x.wav", "noise.wav", "piano vocal.wav"]
_LANGS = ["auto", "ZH", " english ", "Ja", None, "german", "none", "", "FRENCH", "Chinese"]


def file_names(spark, d):
    k, name = F.col("k"), _picked(F.col("k"), _NAMES)
    return _orders(spark, d).select("o_orderkey", T.safe_stem(name).alias("stem"), T.subtitle_name(F.coalesce(name, F.lit("none")), F.when(k % 4 != 0, F.concat(F.lit("shot_"), k % 10)).otherwise("")).alias("subtitles"), T.natural_key(F.coalesce(name, F.lit(""))).alias("sort_key"), T.stem_kind(_picked(k, _STEMS)).alias("kind"))


def settings_names(spark, d):
    k = F.col("k")
    return _orders(spark, d).select("o_orderkey", T.language_name(_picked(k, _LANGS)).alias("language"), T.mode_name(_picked(k, ["storyboard", " FRAMES", "x", None])).alias("mode"), T.used_mode(_picked(k, ["storyboard", "frames", None]), k % 5 != 0).alias("used"), T.safe_speaker(_picked(k, ["a/b", " ", None, 'q"?', "speaker_1"])).alias("speaker"), T.data_uri(F.encode(F.col("o_orderkey").cast("string"), "UTF-8")).alias("uri"))


def speaker_labels(spark, d):
    return TR.renumbered_speakers(A.utterances(spark, d), ["conv_id"]).select("conv_id", "turn", "label")


def source_results(spark, d):
    """Conversations as sources: one in seven has no audio, one in five no region, one in three no text."""
    u, k = A.utterances(spark, d), F.col("conv_id")
    sources = A.table(spark, d, "conversations").select(k.alias("stream")).distinct().withColumn("has_audio", F.when(F.col("stream") % 7 == 0, False).when(F.col("stream") % 2 == 0, True))
    regions = u.where(k % 5 != 0).select(k.alias("stream"), "turn")
    said = u.where((k % 5 != 0) & (k % 3 != 0) & (k % 7 != 0)).select(k.alias("stream"), "speaker")
    return TR.results_with_reason(sources, regions, said).withColumn("speakers", F.array_join("speakers", ","))


def durations_and_cuts(spark, d):
    k = F.col("k")
    start, end = (k % 100) / 4.0, (k % 90) / 4.0
    stated = F.when(k % 3 == 0, F.lit(None).cast("double")).when(k % 3 == 1, F.lit(0.0)).otherwise((k % 50) / 8.0)
    return _orders(spark, d).select("o_orderkey", TR.shot_duration(stated, start, end).alias("duration"), TR.accepted_cut(F.when(k % 6 != 0, k % 16 / 32.0), F.lit(0.25)).alias("accepted"))


def cluster_audio(spark, d):
    r = A.records(spark, d).select("stream", F.col("person").alias("label"), F.col("record").alias("window_no"), F.when(F.col("record") % 5 != 0, F.slice("embedding", 1, 3)).otherwise(F.slice("embedding", 1, 0)).alias("samples"))
    s = F.col("samples")
    return TR.representative_audio(r).select("stream", "label", F.size(s).cast("long").alias("n"), F.get(s, F.lit(0)).cast("double").alias("first"), F.get(s, F.size(s) - 1).cast("double").alias("last"))


def status_counts(spark, d):
    return R.counts_by(_orders(spark, d).select(F.col("o_orderpriority").alias("source"), F.col("o_orderstatus").alias("status")), ["source"], "status")


def stems_of_jobs(spark, d):
    """Orders as jobs, and their first line as the separated stem where it was returned."""
    jobs = _orders(spark, d).select(F.col("o_orderkey").alias("stem"), F.col("o_orderstatus").alias("status"))
    stems = A.table(spark, d, "lineitem").where("l_linenumber = 1 and l_returnflag = 'R'").select(F.col("l_orderkey").alias("stem"), F.col("l_partkey").alias("vocals"))
    return MF.jobs_with_stems(jobs, stems, ["vocals"])


def probe_documents(spark, d):
    k = F.col("k")
    json = F.when(k % 7 == 0, F.lit("{no json")).otherwise(F.concat(F.lit('{"streams": [{"codec_type": "audio"}, {"codec_type": "video", "avg_frame_rate": "30/1", "nb_frames": "'), F.when(k % 3 == 0, F.lit("N/A")).otherwise((k % 500).cast("string")), F.lit('", "width": '), k % 1920, F.lit(', "height": 10}], "format": {"duration": "'), (k % 90).cast("string"), F.lit('.5"}}')))
    return MD.parsed_probes(_orders(spark, d).select(k.alias("stem"), json.alias("json")))


def shot_speakers(spark, d):
    """Speakers of spans of seventeen seconds, by when an utterance starts."""
    u = A.utterances(spark, d).select("conv_id", F.floor(F.col("start_sec") / 17.0).alias("shot"), F.when(F.col("turn") % 5 == 0, " ").otherwise(F.col("speaker")).alias("speaker"))
    return IV.shot_speakers(u, ["conv_id", "shot"]).withColumn("speakers", F.array_join("speakers", ","))


def source_status(spark, d):
    """Customers as sources: many have no frame."""
    sources = A.table(spark, d, "customer").select(F.col("c_custkey").alias("stream"))
    return FR.source_status(sources, A.quality(spark, d)).select("stream", "frames", "status", "reason")


def unknown_track_names(spark, d):
    r = A.records(spark, d)
    return ID.unknown_tracks(r.withColumn("person", F.when(F.col("track_id") % 3 != 0, F.col("person"))))


def anchored_faces(spark, d):
    k = F.col("p_partkey")
    p = A.table(spark, d, "part").select(F.col("p_brand").alias("stream"), (F.col("p_size") % 10).alias("frame_index"), k.alias("face_no"), (k * 37 % 900).alias("x1"), (k * 53 % 500).alias("y1"), (k * 37 % 900 + 3 + k % 17).alias("x2"), (k * 53 % 500 + 2 + k % 13).alias("y2"))
    boxes = p.where("face_no % 4 = 0").select("stream", "frame_index", "x1", "y1", (F.col("x2") + 40).alias("x2"), (F.col("y2") + 60).alias("y2"))
    return ID.anchored_faces(p.where("face_no % 4 <> 0"), boxes, 1000.0, 600.0)


QUERIES = [
    probe_documents, shot_speakers, source_status, unknown_track_names, anchored_faces,
    rate_parse, metadata_completion, image_similarity, vector_angle, cosine_of_unlike_sizes, unit_vectors, audio_level, audio_clips, person_boxes, croppable_boxes, spoken_regions, embeddable_faces, describable_shots,
    first_orders, prompt_labels, numbers_as_text, file_names, settings_names, speaker_labels, source_results, durations_and_cuts, cluster_audio, status_counts, stems_of_jobs,
]

_E = "(SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"
_SUM = "list_sum(list_transform(generate_series(1, len({a})), lambda i: {f}))"
_RATE = "coalesce(TRY_CAST(split_part({v}, '/', 1) AS DOUBLE) / nullif(CASE WHEN contains({v}, '/') THEN TRY_CAST(split_part({v}, '/', 2) AS DOUBLE) ELSE 1.0 END, 0), 0.0)"

ORACLE_SQL = {
    "probe_documents": """SELECT o_orderkey AS stem, CASE WHEN ok THEN '30/1' END AS rate, CASE WHEN ok AND o_orderkey % 3 <> 0 THEN o_orderkey % 500 END AS frame_count, CASE WHEN ok THEN o_orderkey % 90 + 0.5::DOUBLE END AS duration_sec,
  CASE WHEN ok THEN o_orderkey % 1920 END AS width, CASE WHEN ok THEN 10 END AS height, CASE WHEN ok THEN true END AS has_audio FROM (SELECT o_orderkey, o_orderkey % 7 <> 0 AS ok FROM orders)""",
    "shot_speakers": f"WITH {A.UTTER_SQL} SELECT conv_id, CAST(floor(start_sec / 17.0) AS BIGINT) AS shot, coalesce(array_to_string(list_sort(list_distinct(list(speaker) FILTER (WHERE turn % 5 <> 0))), ','), '') AS speakers FROM v_utter GROUP BY 1, 2",
    "source_status": f"""WITH {A.QUALITY_SQL}, s AS (SELECT stream, count(*) AS frames, avg(CASE WHEN bad THEN 1 ELSE 0 END) > 0.9 AS inv, bool_and(is_black) AS b, bool_and(is_white) AS w, bool_and(is_low_info) AS l FROM v_quality GROUP BY stream)
  SELECT c_custkey AS stream, coalesce(frames, 0) AS frames, CASE WHEN frames IS NULL OR inv THEN 'invalid' ELSE 'ok' END AS status,
    CASE WHEN frames IS NULL THEN 'no_frames' WHEN inv THEN CASE WHEN b THEN 'all_frames_black' WHEN w THEN 'all_frames_white' WHEN l THEN 'all_frames_low_info' ELSE 'invalid_quality' END END AS reason FROM (SELECT DISTINCT c_custkey FROM customer) LEFT JOIN s ON stream = c_custkey""",
    "unknown_track_names": f"WITH {A.RECORDS_SQL}, t AS (SELECT stream, track_id, min(frame_index) AS f FROM v_records WHERE track_id % 3 = 0 GROUP BY 1, 2) SELECT stream, track_id, 'track_' || lpad(CAST(row_number() OVER (PARTITION BY stream ORDER BY f, track_id) AS VARCHAR), 4, '0') AS name FROM t",
    "rate_parse": f"WITH v AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN {_picked_sql('(o_orderkey // 5)', _RATES)} ELSE o_orderkey || '/' || o_orderkey % 1002 END AS v FROM orders) SELECT o_orderkey, {_RATE.format(v='v')} AS rate FROM v",
    "metadata_completion": f"""WITH v AS (SELECT o_orderkey, {_picked_sql('o_orderkey', ['30000/1001', '0/0', None, '25'])} AS v, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 900 END AS f, CASE WHEN o_orderkey % 4 <> 0 THEN (o_orderkey % 700) / 8.0::DOUBLE END AS t FROM orders),
  r AS (SELECT *, CASE WHEN {_RATE.format(v='v')} > 0 THEN {_RATE.format(v='v')} ELSE 25.0 END AS fps FROM v), n AS (SELECT *, CASE WHEN f > 0 THEN f ELSE CAST(round_even(coalesce(t, 0) * fps, 0) AS BIGINT) END AS frame_count FROM r)
  SELECT o_orderkey, fps, frame_count, CASE WHEN t > 0 THEN t ELSE frame_count / fps END AS duration_sec FROM n""",
    "image_similarity": f"SELECT vec_id, 1 - {_SUM.format(a='v[1:16]', f='abs(v[i] - v[16 + i])')} / 16 / 255 AS similarity FROM {_E}",
    "vector_angle": f"""WITH p AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN [0.0::DOUBLE, 0, 0] ELSE v[1:3] END AS a, v[4:6] AS b FROM {_E}),
  s AS (SELECT vec_id, {_SUM.format(a='a', f='a[i] * b[i]')} AS ab, sqrt({_SUM.format(a='a', f='a[i] * a[i]')}) * sqrt({_SUM.format(a='b', f='b[i] * b[i]')}) AS n FROM p)
  SELECT vec_id, CASE WHEN n < 1e-9 THEN 0.0 ELSE degrees(acos(greatest(-1.0, least(1.0, ab / n)))) END AS degrees FROM s""",
    "cosine_of_unlike_sizes": f"""WITH p AS (SELECT vec_id, v[1:32] AS a, CASE WHEN vec_id % 7 = 0 THEN NULL WHEN vec_id % 5 = 0 THEN v[33:63] ELSE v[33:64] END AS b FROM {_E}),
  s AS (SELECT *, {_SUM.format(a='a', f='a[i] * b[i]')} AS ab, sqrt({_SUM.format(a='a', f='a[i] * a[i]')}) * sqrt({_SUM.format(a='b', f='b[i] * b[i]')}) AS n FROM p)
  SELECT vec_id, CASE WHEN b IS NULL OR len(b) <> 32 THEN -1.0 WHEN n > 1e-9 THEN ab / n ELSE 0.0 END AS cosine FROM s""",
    "unit_vectors": f"WITH p AS (SELECT vec_id, v[1:4] AS a FROM {_E}), s AS (SELECT *, sqrt({_SUM.format(a='a', f='a[i] * a[i]')}) AS n FROM p) SELECT vec_id, i - 1 AS place, CASE WHEN n > 1e-8 THEN a[i] / n ELSE a[i] END AS value FROM s, (SELECT unnest(generate_series(1, 4)) AS i)",
    "audio_level": f"""WITH s AS (SELECT vec_id, sqrt({_SUM.format(a='v', f='v[i] / 4 * (v[i] / 4)')} / 64) AS rms FROM {_E})
  SELECT vec_id, CASE WHEN vec_id % 9 > 1 AND rms > 0 THEN 20 * log10(greatest(rms, 1 / 32768.0::DOUBLE)) END AS dbfs FROM s""",
    "audio_clips": f"""WITH b AS (SELECT vec_id, v, least(greatest(CAST(round_even((vec_id % 11 / 8.0::DOUBLE - 0.25) * 48, 0) AS BIGINT), 0), 64) AS lo, least(greatest(CAST(round_even(vec_id % 17 / 8.0::DOUBLE * 48, 0) AS BIGINT), 0), 64) AS hi FROM {_E})
  SELECT vec_id, greatest(hi - lo, 0) AS n, CASE WHEN hi > lo THEN v[lo + 1] END AS first, CASE WHEN hi > lo THEN v[hi] END AS last FROM b""",
    "person_boxes": """WITH f AS (SELECT p_partkey AS part, CAST(p_partkey * 37 % 600 AS DOUBLE) AS x1, CAST(p_partkey * 53 % 340 AS DOUBLE) AS y1, CAST(p_partkey % 41 AS DOUBLE) AS fw, CAST(p_size AS DOUBLE) AS fh FROM part),
  h AS (SELECT *, fh / 0.8::DOUBLE * greatest(1.0, fh / greatest(fw, 1e-9)) AS h FROM f), w AS (SELECT *, greatest(1.6::DOUBLE * fw, 0.35::DOUBLE * h) AS w, (x1 + (x1 + fw)) / 2 AS cx, y1 - 0.25::DOUBLE * fh AS top FROM h),
  b AS (SELECT part, greatest(0.0, cx - w / 2) AS x1, greatest(0.0, top) AS y1, least(640.0, cx + w / 2) AS x2, least(360.0, top + h) AS y2 FROM w), ok AS (SELECT *, x2 - x1 >= 8 AND y2 - y1 >= 8 AS ok FROM b)
  SELECT part, CASE WHEN ok THEN x1 END AS x1, CASE WHEN ok THEN y1 END AS y1, CASE WHEN ok THEN x2 END AS x2, CASE WHEN ok THEN y2 END AS y2 FROM ok""",
    "croppable_boxes": "SELECT p_partkey AS part FROM part WHERE p_partkey % 9 <> 0 AND p_partkey % 64 >= 32 AND p_partkey % 128 >= 64",
    "spoken_regions": f"WITH {A.UTTER_SQL} SELECT conv_id, turn FROM v_utter WHERE trim(text) <> '' AND start_sec >= 0 AND end_sec > start_sec AND end_sec - start_sec >= 2.0",
    "embeddable_faces": """WITH f AS (SELECT p_brand AS stream, p_partkey % 5 AS frame_index, p_size AS owner, p_partkey AS face_no, p_partkey % 10 / 10.0::DOUBLE AS score FROM part WHERE least(p_partkey % 61, p_partkey % 47) >= 20 AND p_partkey % 10 >= 3)
  SELECT stream, frame_index, owner, face_no FROM f QUALIFY row_number() OVER (PARTITION BY stream, frame_index, owner ORDER BY score DESC, face_no) = 1""",
    "describable_shots": "WITH s AS (SELECT s_suppkey, CASE WHEN s_nationkey % 3 = 0 THEN 'invalid' ELSE 'ok' END AS status FROM supplier) SELECT * FROM s WHERE status <> 'invalid' OR NOT EXISTS (SELECT 1 FROM s WHERE status <> 'invalid')",
    "first_orders": "SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 25",
    "prompt_labels": """WITH t AS (SELECT o_orderkey, '<Picture ' || o_orderkey % 9 || '> with <Audio ' || o_orderkey % 7 || '> and <Subject ' || o_orderkey % 2 || '> <Picture ' || o_orderkey % 3 || '> <picture 9>' AS t FROM orders)
  SELECT o_orderkey, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(t, '<(?:Picture|Audio|Subject|Video) \\d+>')), lambda x: NOT regexp_full_match(x, '<Picture [1-6]>|<Audio [1-5]>'))), ',') AS labels FROM t""",
    "numbers_as_text": """WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey / 8.0::DOUBLE ELSE CAST(o_orderkey % 40 AS DOUBLE) END AS x, CAST(round_even(o_orderkey / 10.0::DOUBLE, 0) AS BIGINT) AS h FROM orders)
  SELECT o_orderkey, CASE WHEN x = floor(x) THEN CAST(CAST(x AS BIGINT) AS VARCHAR) ELSE rtrim(printf('%.3f', x), '0') END AS plain, rtrim(rtrim(printf('%.3f', x), '0'), '.') AS short, h // 100 || '.' || lpad(CAST(h % 100 AS VARCHAR), 2, '0') AS seconds FROM x""",
    "file_names": f"""WITH n AS (SELECT o_orderkey, {_picked_sql('o_orderkey', _NAMES)} AS n, CASE WHEN o_orderkey % 4 <> 0 THEN 'shot_' || o_orderkey % 10 ELSE '' END AS shot, lower({_picked_sql('o_orderkey', _STEMS)}) AS s FROM orders),
  b AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_extract(n, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1'), '[\\\\/:*?"<>|]', '_', 'g')) AS stem FROM n)
  SELECT o_orderkey, CASE WHEN stem = '' THEN 'video' ELSE stem END AS stem,
    CASE WHEN lower(coalesce(n, 'none')) LIKE '%.mp4' THEN left(n, length(n) - 4) || '.srt' ELSE CASE WHEN shot = '' THEN 'shot' ELSE shot END || '.srt' END AS subtitles,
    array_to_string(list_transform(regexp_extract_all(lower(coalesce(n, '')), '\\d+|\\D+'), lambda p: CASE WHEN regexp_matches(p, '^\\d') THEN lpad(p, 20, '0') ELSE p END), '') AS sort_key,
    CASE WHEN contains(s, 'no_reverb') OR contains(s, 'no reverb') THEN 'vocals' WHEN contains(s, 'vocal') AND NOT contains(s, 'no') THEN 'vocals'
      WHEN contains(s, 'instrument') OR contains(s, 'no_vocal') OR contains(s, 'no vocal') OR starts_with(s, 'inst') OR contains(s, 'reverb') THEN 'instrumental' END AS kind FROM b""",
    "settings_names": f"""WITH v AS (SELECT o_orderkey, lower(trim(coalesce({_picked_sql('o_orderkey', _LANGS)}, 'auto'))) AS l, lower(trim({_picked_sql('o_orderkey', ['storyboard', ' FRAMES', 'x', None])})) AS m, {_picked_sql('o_orderkey', ['storyboard', 'frames', None])} AS u, trim(coalesce({_picked_sql('o_orderkey', ['a/b', ' ', None, 'q"?', 'speaker_1'])}, '')) AS s FROM orders)
  SELECT o_orderkey, CASE WHEN l IN ('auto', 'none', 'null', '') THEN NULL WHEN l IN ('zh', 'chinese') THEN 'Chinese' WHEN l IN ('en', 'english') THEN 'English' WHEN l IN ('ja', 'japanese') THEN 'Japanese' ELSE upper(l[1]) || l[2:] END AS language,
    CASE WHEN m IN ('storyboard', 'frames') THEN m ELSE 'storyboard' END AS mode, CASE WHEN u = 'frames' OR o_orderkey % 5 = 0 THEN 'frames' ELSE 'storyboard' END AS used,
    translate(CASE WHEN s = '' THEN 'unknown' ELSE s END, '\\/:*?"<>|', '_________') AS speaker, 'data:image/png;base64,' || base64(encode(CAST(o_orderkey AS VARCHAR))) AS uri FROM v""",
    "speaker_labels": f"WITH {A.UTTER_SQL}, f AS (SELECT *, min(start_sec) OVER (PARTITION BY conv_id, speaker) AS first FROM v_utter) SELECT conv_id, turn, '(S' || dense_rank() OVER (PARTITION BY conv_id ORDER BY first, speaker) || ')' AS label FROM f",
    "source_results": f"""WITH {A.UTTER_SQL}, s AS (SELECT conv_id AS stream, any_value(CASE WHEN conv_id % 7 = 0 THEN false WHEN conv_id % 2 = 0 THEN true END) AS has_audio FROM conversations GROUP BY conv_id),
  t AS (SELECT conv_id AS stream, count(*) AS n, array_to_string(list_sort(list_distinct(list(speaker))), ',') AS who FROM v_utter WHERE conv_id % 5 <> 0 AND conv_id % 3 <> 0 AND conv_id % 7 <> 0 GROUP BY conv_id)
  SELECT s.stream, coalesce(n, 0) AS segments, coalesce(who, '') AS speakers, CASE WHEN n > 0 THEN NULL WHEN has_audio = false THEN 'no_audio' WHEN s.stream % 5 = 0 THEN 'no_speech' ELSE 'empty_transcript' END AS reason FROM s LEFT JOIN t USING (stream)""",
    "durations_and_cuts": """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 AND o_orderkey % 50 <> 0 THEN (o_orderkey % 50) / 8.0::DOUBLE ELSE greatest(0.0, (o_orderkey % 90) / 4.0::DOUBLE - (o_orderkey % 100) / 4.0::DOUBLE) END AS duration,
  o_orderkey % 6 <> 0 AND abs(o_orderkey % 16 / 32.0::DOUBLE - 0.25) <= 0.1 AS accepted FROM orders""",
    "cluster_audio": f"""WITH {A.RECORDS_SQL}, c AS (SELECT stream, person AS label, record, embedding FROM v_records WHERE record % 5 <> 0)
  SELECT stream, label, 3 * count(*) AS n, CAST(arg_min(embedding[1], record) AS DOUBLE) AS first, CAST(arg_max(embedding[3], record) AS DOUBLE) AS last FROM c GROUP BY stream, label""",
    "status_counts": "SELECT o_orderpriority AS source, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1, 2",
    "stems_of_jobs": "SELECT o_orderkey AS stem, o_orderstatus AS status, l_partkey AS vocals, l_partkey IS NOT NULL AS separated FROM orders LEFT JOIN (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber = 1 AND l_returnflag = 'R') ON l_orderkey = o_orderkey",
}
