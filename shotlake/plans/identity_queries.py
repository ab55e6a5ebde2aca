"""Queries on tracks, persons, speakers' voice prints, boxes and media names."""

from __future__ import annotations

from pyspark.sql import functions as F

from shotlake.functions import geometry as G
from shotlake.functions import text as T
from shotlake.operators import identity as ID
from shotlake.operators import registry as R
from shotlake.plans import adapters as A
from shotlake.sources import manifests as MF

LOW, HIGH = 0.15, 0.20  # the fixture's vectors are far apart; the defaults would join nothing



def track_features(spark, d):
    f = ID.track_features(A.records(spark, d))
    return f.select("stream", "track_id", F.posexplode("feature").alias("pos", "x")).select("stream", "track_id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


def conflict_pairs(spark, d):
    return ID.conflict_pairs(A.records(spark, d))


def _pairs(spark, d):
    r = A.records(spark, d)
    f = ID.track_features(r)
    return f, ID.conflict_pairs(r), ID.similar_pairs(f, ID.conflict_pairs(r), LOW)


def similarity_pairs(spark, d):
    return _pairs(spark, d)[2].withColumn("similarity", F.round("similarity", 6))


def identity_cluster(spark, d):
    f, conflicts, pairs = _pairs(spark, d)
    return ID.clustered_tracks(f, pairs, conflicts, HIGH)


def greedy_cluster(spark, d):
    r = A.records(spark, d)
    return ID.greedy_clusters(r.select("stream", F.col("record").alias("window_no"), F.when(F.col("record") % 13 != 0, F.col("embedding")).alias("embedding")), 0.30)


def near_dup_suppress(spark, d):
    r = ID.record_scores(A.records(spark, d), ["stream", "person"])
    thumb = F.array(F.col("record") % 5, F.col("record") % 3).cast("array<double>")
    return ID.distinct_records(r.withColumn("thumb", thumb).withColumn("embedding", F.when(F.col("record") % 4 != 0, F.col("embedding"))), 0.10, 0.995)


def person_metadata(spark, d):
    return ID.person_metadata(A.records(spark, d)).withColumn("tracks_merged", F.array_join("tracks_merged", ",")).withColumn("time_start", F.round("time_start", 6)).withColumn("time_end", F.round("time_end", 6))


def topk_per_person(spark, d):
    r = ID.record_scores(A.records(spark, d), ["stream", "person"])
    return ID.top_k(r, ["stream", "person"], 3).select("stream", "person", "record", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


def voiceprint_match(spark, d):
    """Every row as a sample, and every twentieth as a registered centre, so the registry grows with the table."""
    e = A.table(spark, d, "embeddings")
    centers = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("center_id"), F.col("embedding").alias("center"))
    out = R.nearest_center(e.select(F.col("vec_id").alias("sample_id"), "embedding"), centers)
    return out.withColumn("similarity", F.round("similarity", 6))


def voiceprint_registry(spark, d):
    e = A.table(spark, d, "embeddings")
    samples = e.select(F.col("vec_id").alias("seq"), F.concat(F.lit("v"), F.col("label").cast("string")).alias("video"), F.col("vec_id").alias("cluster"), F.slice("embedding", 1, 32).alias("cam_emb"), F.when(F.col("vec_id") % 3 != 0, F.slice("embedding", 33, 32)).alias("eres_emb"))
    return R.matched(samples, 0.2, 0.25)


def face_owner_containment(spark, d):
    """Parts as face centres and boxes of one frame for each brand."""
    p = A.table(spark, d, "part")
    faces = p.where("p_partkey % 2 = 0").select(F.col("p_brand").alias("frame"), F.col("p_partkey").alias("face_no"), (F.col("p_partkey") * 37 % 100).cast("double").alias("x"), (F.col("p_partkey") * 53 % 100).cast("double").alias("y"))
    x1, y1 = (F.col("p_partkey") * 11 % 80).cast("double"), (F.col("p_partkey") * 7 % 80).cast("double")
    boxes = p.where("p_partkey % 2 = 1").select(F.col("p_brand").alias("frame"), F.col("p_partkey").alias("box_no"), x1.alias("x1"), y1.alias("y1"), (x1 + 5 + F.col("p_size")).alias("x2"), (y1 + 5 + F.col("p_size")).alias("y2"))
    return ID.owners(faces, boxes, ["frame"])


def crop_and_level(spark, d):
    """Parts as detections: a keypoint i is seen where the part key allows it."""
    k = F.col("p_partkey")
    points = F.transform(F.sequence(F.lit(0), F.lit(16)), lambda i: F.struct((k * (i + 3) % 640).cast("double").alias("x"), (k * (i + 5) % 360).cast("double").alias("y"), ((k + i * 7) % 17 / 16.0).alias("conf")))
    box = F.struct((k % 300).cast("double").alias("x1"), (k % 200).cast("double").alias("y1"), (k % 300 + F.col("p_size") * 3).cast("double").alias("x2"), (k % 200 + F.col("p_size") * 5).cast("double").alias("y2"))
    p = A.table(spark, d, "part").select(k.alias("part"), points.alias("points"), box.alias("box"))
    rect = G.crop_rect(F.col("box"), F.col("points"), 0.9, 0.05, F.lit(640).cast("long"), F.lit(360).cast("long"))
    return p.select("part", rect.alias("r"), G.pose_level(F.col("points"), 0.97).alias("level")).select("part", "r.x1", "r.y1", "r.x2", "r.y2", "level")


def fit_frame_size(spark, d):
    k = F.col("p_partkey")
    p = A.table(spark, d, "part").select(k.alias("part"), (k * 37 % 5000).alias("w"), (k * 91 % 3000).alias("h"))
    return p.select("part", G.fitted_frame(F.col("w"), F.col("h"), 1920).alias("s"), G.scaled_long_side(F.greatest("w", F.lit(1)), F.greatest("h", F.lit(1)), 960).alias("l")).select("part", "s.width", "s.height", F.col("l.width").alias("long_width"), F.col("l.height").alias("long_height"))


def grid_layout(spark, d):
    k = F.col("p_partkey")
    g = G.grid_cell(100 + k % 1800, 50 + k % 1000, k % 9, 3, 3, 4096, 12, 20)
    return A.table(spark, d, "part").select(k.alias("part"), g.alias("g")).select("part", "g.*")


def skip_processed(spark, d):
    o = A.table(spark, d, "orders")
    return MF.unprocessed(o.select(F.col("o_orderkey").alias("stem")), o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("stem"), F.lit("complete").alias("status")))


def selection_semi(spark, d):
    o = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("position"), "o_custkey")
    return MF.selected(o, "position", "1,3,9-5,100-120,999999999")


def media_path_norm(spark, d):
    url = F.regexp_replace("url", r"[?#].*\z", "")
    p = A.table(spark, d, "pages").select("page_id", F.concat(url, F.lit(".v"), F.col("page_id") % 12, F.lit(".mp4")).alias("path"))
    return p.select("page_id", T.safe_stem(F.col("path")).alias("stem"), T.natural_key(F.col("path")).alias("sort_key"), T.safe_speaker(F.col("path")).alias("speaker"), T.subtitle_name(F.col("path"), F.lit("s")).alias("srt"), T.stem_kind(F.concat(F.lit("x_"), F.element_at(F.array(*map(F.lit, ["vocals", "no_vocals", "instrumental", "reverb", "no_reverb", "drums"])), (F.col("page_id") % 6 + 1).cast("int")))).alias("kind"))


QUERIES = [track_features, conflict_pairs, similarity_pairs, identity_cluster, greedy_cluster, near_dup_suppress, person_metadata, topk_per_person, voiceprint_match, voiceprint_registry, face_owner_containment, crop_and_level, fit_frame_size, grid_layout, skip_processed, selection_semi, media_path_norm]

_FEATURE_SQL = A.RECORDS_SQL + """, v_have AS (SELECT *, max(CASE WHEN face_low THEN 0 ELSE 1 END) OVER (PARTITION BY stream, track_id) AS any_good FROM v_records WHERE embedding IS NOT NULL),
v_main AS (SELECT * FROM v_have WHERE (CASE WHEN face_low THEN 0 ELSE 1 END) = any_good),
v_flat AS (SELECT stream, track_id, unnest(embedding)::DOUBLE AS x, unnest(generate_series(0, len(embedding) - 1)) AS pos FROM v_main),
v_mean AS (SELECT stream, track_id, pos, avg(x) AS x FROM v_flat GROUP BY stream, track_id, pos),
v_norm AS (SELECT stream, track_id, sqrt(sum(x * x)) AS n FROM v_mean GROUP BY stream, track_id),
v_feature AS (SELECT stream, track_id, pos, x / n AS x FROM v_mean JOIN v_norm USING (stream, track_id) WHERE n > 1e-9),
v_seen AS (SELECT DISTINCT stream, frame_index, track_id FROM v_records),
v_conflict AS (SELECT DISTINCT a.stream, a.track_id AS a, b.track_id AS b FROM v_seen a JOIN v_seen b ON a.stream = b.stream AND a.frame_index = b.frame_index AND a.track_id < b.track_id)"""
_SCORE_SQL = A.RECORDS_SQL + """, v_score AS (SELECT *, CASE WHEN max(sharpness) OVER w > 0 THEN greatest(0, sharpness) / max(sharpness) OVER w ELSE 0 END * conf * coalesce(nullif(face_score, 0), 1) AS score FROM v_records WINDOW w AS (PARTITION BY stream, person))"""

ORACLE_SQL = {
    "track_features": f"WITH {_FEATURE_SQL} SELECT stream, track_id, pos, round(x, 6) AS x FROM v_feature",
    "conflict_pairs": f"WITH {_FEATURE_SQL} SELECT stream, a, b FROM v_conflict",
    "similarity_pairs": f"WITH {_FEATURE_SQL}, v_sim AS (SELECT p.stream, p.track_id AS a, q.track_id AS b, sum(p.x * q.x) / (sqrt(sum(p.x * p.x)) * sqrt(sum(q.x * q.x))) AS s FROM v_feature p JOIN v_feature q ON p.stream = q.stream AND p.pos = q.pos AND p.track_id < q.track_id GROUP BY 1, 2, 3) SELECT stream, a, b, round(s, 6) AS similarity FROM v_sim ANTI JOIN v_conflict USING (stream, a, b) WHERE s >= {LOW}",
    "person_metadata": f"""WITH {A.RECORDS_SQL}, v_p AS (SELECT stream, person, count(*) AS num_images, array_to_string(list_sort(list_distinct(list(track_id))), ',') AS tracks_merged, round(min(time_sec), 6) AS time_start, round(max(time_sec), 6) AS time_end, min(frame_index) AS frame_start, max(frame_index) AS frame_end,
    {', '.join(f"count(*) FILTER (WHERE level = '{x}') AS n_{x}" for x in ID.LEVEL_NAMES)}, (array_agg(record ORDER BY face_size DESC, crop_w * crop_h DESC, record))[1] AS representative FROM v_records GROUP BY stream, person)
  SELECT *, 'person_' || lpad(CAST(row_number() OVER (PARTITION BY stream ORDER BY num_images DESC, frame_start, person) AS VARCHAR), 3, '0') AS person_id FROM v_p""",
    "topk_per_person": f"WITH {_SCORE_SQL} SELECT * FROM (SELECT stream, person, record, row_number() OVER (PARTITION BY stream, person ORDER BY score DESC, record) AS rank, round(score, 6) AS score FROM v_score) WHERE rank <= 3",
    "voiceprint_match": """WITH f AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(generate_series(0, len(embedding) - 1)) AS pos FROM embeddings), n AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM f GROUP BY vec_id),
  s AS (SELECT a.vec_id AS sample_id, b.vec_id AS center_id, sum(a.x * b.x) AS dot FROM f a JOIN f b ON a.pos = b.pos AND b.vec_id % 20 = 0 GROUP BY 1, 2),
  r AS (SELECT sample_id, center_id, dot / (p.n * q.n) AS similarity, row_number() OVER (PARTITION BY sample_id ORDER BY dot / (p.n * q.n) DESC, center_id) AS k FROM s JOIN n p ON p.vec_id = sample_id JOIN n q ON q.vec_id = center_id)
  SELECT sample_id, center_id, round(similarity, 6) AS similarity FROM r WHERE k = 1""",
    "face_owner_containment": """WITH f AS (SELECT p_brand AS frame, p_partkey AS face_no, p_partkey * 37 % 100 AS x, p_partkey * 53 % 100 AS y FROM part WHERE p_partkey % 2 = 0),
  b AS (SELECT p_brand AS frame, p_partkey AS box_no, p_partkey * 11 % 80 AS x1, p_partkey * 7 % 80 AS y1, p_partkey * 11 % 80 + 5 + p_size AS x2, p_partkey * 7 % 80 + 5 + p_size AS y2 FROM part WHERE p_partkey % 2 = 1),
  r AS (SELECT f.frame, face_no, box_no, row_number() OVER (PARTITION BY f.frame, face_no ORDER BY (x2 - x1) * (y2 - y1), box_no) AS k FROM f JOIN b ON f.frame = b.frame AND x BETWEEN x1 AND x2 AND y BETWEEN y1 AND y2)
  SELECT frame, face_no, box_no FROM r WHERE k = 1""",
    "crop_and_level": """WITH k AS (SELECT p_partkey AS part, p_size, i, p_partkey * (i + 3) % 640 AS x, p_partkey * (i + 5) % 360 AS y, (p_partkey + i * 7) % 17 / 16.0::DOUBLE AS conf FROM part, (SELECT unnest(generate_series(0, 16)) AS i)),
  b AS (SELECT part, least(min(part % 300), min(x) FILTER (WHERE conf >= 0.9))::DOUBLE AS x1, least(min(part % 200), min(y) FILTER (WHERE conf >= 0.9))::DOUBLE AS y1, greatest(min(part % 300 + p_size * 3), max(x) FILTER (WHERE conf >= 0.9))::DOUBLE AS x2, greatest(min(part % 200 + p_size * 5), max(y) FILTER (WHERE conf >= 0.9))::DOUBLE AS y2,
    CASE WHEN bool_or(conf >= 0.97 AND i IN (15, 16)) THEN 'full_body' WHEN bool_or(conf >= 0.97 AND i IN (13, 14)) THEN 'upper_body' WHEN bool_or(conf >= 0.97 AND i IN (11, 12)) THEN 'torso' WHEN bool_or(conf >= 0.97 AND i IN (5, 6)) THEN 'chest' WHEN bool_or(conf >= 0.97 AND i <= 4) THEN 'head' ELSE 'unknown' END AS level FROM k GROUP BY part),
  m AS (SELECT part, level, (x2 - x1) * 0.05::DOUBLE AS mx, (y2 - y1) * 0.05::DOUBLE AS my, x1, y1, x2, y2 FROM b),
  r AS (SELECT part, level, greatest(0, CAST(round_even(x1 - mx, 0) AS BIGINT)) AS x1, greatest(0, CAST(round_even(y1 - my, 0) AS BIGINT)) AS y1, least(640, CAST(round_even(x2 + mx, 0) AS BIGINT)) AS x2, least(360, CAST(round_even(y2 + my, 0) AS BIGINT)) AS y2 FROM m)
  SELECT part, CASE WHEN x2 - x1 >= 1 AND y2 - y1 >= 1 THEN x1 END AS x1, CASE WHEN x2 - x1 >= 1 AND y2 - y1 >= 1 THEN y1 END AS y1, CASE WHEN x2 - x1 >= 1 AND y2 - y1 >= 1 THEN x2 END AS x2, CASE WHEN x2 - x1 >= 1 AND y2 - y1 >= 1 THEN y2 END AS y2, level FROM r""",
    "fit_frame_size": """WITH p AS (SELECT p_partkey AS part, greatest(2, p_partkey * 37 % 5000) AS w, greatest(2, p_partkey * 91 % 3000) AS h, greatest(1, p_partkey * 37 % 5000) AS lw, greatest(1, p_partkey * 91 % 3000) AS lh FROM part),
  s AS (SELECT *, least(1.0::DOUBLE, (CASE WHEN w >= h THEN 1920 ELSE 1080 END)::DOUBLE / w, (CASE WHEN w >= h THEN 1080 ELSE 1920 END)::DOUBLE / h) AS f, least(1.0::DOUBLE, 960.0::DOUBLE / greatest(lw, lh)) AS g FROM p),
  z AS (SELECT *, CASE WHEN f < 1 THEN CAST(round_even(w * f, 0) AS BIGINT) ELSE w END AS a, CASE WHEN f < 1 THEN CAST(round_even(h * f, 0) AS BIGINT) ELSE h END AS b FROM s)
  SELECT part, greatest(2, a - a % 2) AS width, greatest(2, b - b % 2) AS height, greatest(1, CAST(round_even(lw * g, 0) AS BIGINT)) AS long_width, greatest(1, CAST(round_even(lh * g, 0) AS BIGINT)) AS long_height FROM z""",
    "grid_layout": """WITH p AS (SELECT p_partkey AS part, 100 + p_partkey % 1800 AS w, 50 + p_partkey % 1000 AS h, p_partkey % 9 AS i FROM part), s AS (SELECT *, least(1.0::DOUBLE, 4096.0::DOUBLE / greatest(3 * w + 64, 3 * h + 64)) AS f FROM p),
  z AS (SELECT part, i, greatest(1, CAST(round_even(w * f, 0) AS BIGINT)) AS cw, greatest(1, CAST(round_even(h * f, 0) AS BIGINT)) AS ch, CAST(round_even(12 * f, 0) AS BIGINT) AS g, CAST(round_even(20 * f, 0) AS BIGINT) AS m FROM s)
  SELECT part, m + i % 3 * (cw + g) AS x, m + i // 3 * (ch + g) AS y, cw AS width, ch AS height, 3 * cw + 2 * g + 2 * m AS canvas_width, 3 * ch + 2 * g + 2 * m AS canvas_height FROM z""",
    "skip_processed": "SELECT o_orderkey AS stem FROM orders WHERE o_orderstatus <> 'F'",
    "selection_semi": "SELECT o_orderkey AS position, o_custkey FROM orders WHERE o_orderkey IN (1, 3) OR o_orderkey BETWEEN 5 AND 9 OR o_orderkey BETWEEN 100 AND 120",
    "media_path_norm": r"""WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') || '.v' || page_id % 12 || '.mp4' AS path, 'x_' || (['vocals', 'no_vocals', 'instrumental', 'reverb', 'no_reverb', 'drums'])[1 + page_id % 6] AS f FROM pages)
  SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(.)\.[^.]*$', '\1'), '[\\/:*?"<>|]', '_', 'g')) AS stem,
    array_to_string(list_transform(regexp_extract_all(lower(path), '[0-9]+|[^0-9]+'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN lpad(x, 20, '0') ELSE x END), '') AS sort_key,
    translate(trim(path), '\/:*?"<>|', '_________') AS speaker, regexp_replace(path, '(?i)\.mp4$', '') || '.srt' AS srt,
    CASE WHEN contains(f, 'no_reverb') THEN 'vocals' WHEN contains(f, 'vocal') AND NOT contains(f, 'no') THEN 'vocals' WHEN contains(f, 'instrument') OR contains(f, 'no_vocal') OR starts_with(f, 'inst') OR contains(f, 'reverb') THEN 'instrumental' END AS kind FROM p""",
}
