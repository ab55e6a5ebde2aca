"""Queries on frame quality, trimming, sampling, storyboards, cuts, segments and motion."""

from __future__ import annotations

from pyspark.sql import functions as F

from shotlake.operators import frames as FR
from shotlake.operators import motion as M
from shotlake.operators import segments as S
from shotlake.plans import adapters as A

FPS = 25.0


def frame_quality_scores(spark, d):
    return A.quality(spark, d).select("stream", "frame_index", "sharpness_median", "quality_score", "is_black", "is_white", "is_blur", "is_low_info", "bad")


_LITERAL = "(-1, 3.0, 2.0, 1.0), (-2, 250.0, 1.0, 1.0), (-3, 128.0, 5.0, 9.0)"


def frame_invalid_reason(spark, d):
    more = spark.sql(f"SELECT CAST(s AS BIGINT) AS stream, i AS frame_index, CAST(m AS DOUBLE) AS luma_mean, CAST(sd AS DOUBLE) AS luma_std, CAST(sh AS DOUBLE) AS sharpness FROM VALUES {_LITERAL} AS t(s, m, sd, sh) LATERAL VIEW explode(sequence(0L, 9L)) x AS i")
    q = FR.scored(A.frames(spark, d).select("stream", "frame_index", "luma_mean", "luma_std", "sharpness").unionByName(more))
    return FR.stream_status(q).withColumn("bad_ratio", F.round("bad_ratio", 6))


def _ranges(spark, d):
    return FR.valid_range(A.quality(spark, d))


def valid_range_trim(spark, d):
    return _ranges(spark, d)


def uniform_sample_frames(spark, d):
    n = A.frames(spark, d).groupBy("stream").agg((F.count("*") / FPS).alias("duration_sec"))
    return FR.uniform_samples(_ranges(spark, d).where("status = 'ok'").join(n, "stream"))


def storyboard_cells(spark, d):
    ranges = _ranges(spark, d).where("status = 'ok'").withColumn("fps", F.lit(FPS))
    return FR.storyboard(A.quality(spark, d), ranges).withColumn("target", F.round("target", 6)).withColumn("cell", F.col("cell").cast("long"))


def window_best_frame(spark, d):
    return FR.window_best(A.frames(spark, d), FPS).withColumn("time_sec", F.round("time_sec", 6))


def candidate_group_best(spark, d):
    return FR.group_best(A.frames(spark, d), 2.0).withColumn("time_sec", F.round("time_sec", 6))


def cut_adaptive_ratio(spark, d):
    return FR.cut_scores(A.frames(spark, d)).withColumn("ratio", F.round("ratio", 6))


def _streams(spark, d):
    """(stream, total, fps, cuts): cuts are the frames whose number in events is a multiple of nine."""
    f = A.frames(spark, d)
    return f.groupBy("stream").agg(F.count("*").alias("total"), F.lit(FPS).alias("fps"), F.sort_array(F.collect_list(F.when(F.col("event_id") % 9 == 0, F.col("frame_index")))).alias("cuts"))


_USABLE_SQL = """v_a AS (SELECT *, success AND inlier_ratio >= 0.3 AS ua FROM v_pairs), v_b AS (SELECT *, CASE WHEN count(*) FILTER (WHERE ua) OVER (PARTITION BY stream) < 2 THEN success ELSE ua END AS ub FROM v_a),
  v_m AS (SELECT stream, quantile_cont(greatest(scale_step, 1e-9), 0.5) AS med, count(*) AS nb FROM v_b WHERE ub GROUP BY stream),
  v_c AS (SELECT b.*, nb, ub AND abs(ln(greatest(scale_step, 1e-9) / med)) < 0.25 AS uc FROM v_b b LEFT JOIN v_m USING (stream)),
  v_u AS (SELECT *, CASE WHEN nb >= 3 AND count(*) FILTER (WHERE uc) OVER (PARTITION BY stream) >= 2 THEN uc ELSE ub END AS use, sqrt(tx * tx + ty * ty) AS step FROM v_c),"""

#: Affine (a b x / c d y) and homography h0 .. h8 so far, pair by pair.
_PRODUCT_SQL = A.PAIRS_SQL + ", " + _USABLE_SQL.rstrip().rstrip(",") + """, v_s AS (SELECT stream, pair_no, coalesce(use, false) AS use, event_id % 5 <> 0 AS flat, scale_step * cos(angle) AS c, scale_step * sin(angle) AS s, tx, ty, (event_id % 7) / 100.0::DOUBLE AS g1, (event_id % 3) / 1000.0::DOUBLE AS g7 FROM v_u),
  v_p AS (SELECT DISTINCT stream, CAST(-1 AS BIGINT) AS pair_no, 1.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS x, 0.0::DOUBLE AS cc, 1.0::DOUBLE AS d, 0.0::DOUBLE AS y, 1.0::DOUBLE AS h0, 0.0::DOUBLE AS h1, 0.0::DOUBLE AS h2, 0.0::DOUBLE AS h3, 1.0::DOUBLE AS h4, 0.0::DOUBLE AS h5, 0.0::DOUBLE AS h6, 0.0::DOUBLE AS h7, 1.0::DOUBLE AS h8 FROM v_s
    UNION ALL SELECT p.stream, s.pair_no,
      CASE WHEN use THEN c * a - s * cc ELSE a END, CASE WHEN use THEN c * b - s * d ELSE b END, CASE WHEN use THEN c * x - s * y + tx ELSE x END,
      CASE WHEN use THEN s * a + c * cc ELSE cc END, CASE WHEN use THEN s * b + c * d ELSE d END, CASE WHEN use THEN s * x + c * y + ty ELSE y END,
      CASE WHEN use AND flat THEN h0 + g1 * h3 + tx / 10 * h6 ELSE h0 END, CASE WHEN use AND flat THEN h1 + g1 * h4 + tx / 10 * h7 ELSE h1 END, CASE WHEN use AND flat THEN h2 + g1 * h5 + tx / 10 * h8 ELSE h2 END,
      CASE WHEN use AND flat THEN h3 + ty / 10 * h6 ELSE h3 END, CASE WHEN use AND flat THEN h4 + ty / 10 * h7 ELSE h4 END, CASE WHEN use AND flat THEN h5 + ty / 10 * h8 ELSE h5 END,
      CASE WHEN use AND flat THEN g7 * h3 + h6 ELSE h6 END, CASE WHEN use AND flat THEN g7 * h4 + h7 ELSE h7 END, CASE WHEN use AND flat THEN g7 * h5 + h8 ELSE h8 END
    FROM v_p p JOIN v_s s ON s.stream = p.stream AND s.pair_no = p.pair_no + 1),
  v_total AS (SELECT *, sqrt(a * a + cc * cc) AS cum_scale, degrees(atan2(cc, a)) AS cum_rotation_deg, a * 640 + b * 360 + x - 640 AS cum_tx, cc * 640 + d * 360 + y - 360 AS cum_ty FROM v_p WHERE pair_no >= 0)"""

_CUT_LIST_SQL = A.FRAMES_SQL + """, v_content AS (SELECT stream, frame_index, abs(luma_mean - coalesce(lag(luma_mean) OVER (PARTITION BY stream ORDER BY frame_index), luma_mean)) AS content FROM v_frames),
  v_mean AS (SELECT *, CASE WHEN count(*) OVER w > 1 THEN (sum(content) OVER w - content) / (count(*) OVER w - 1) ELSE 0 END AS m FROM v_content WINDOW w AS (PARTITION BY stream ORDER BY frame_index ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
  v_cut AS (SELECT stream, frame_index FROM v_mean WHERE content >= 15 AND CASE WHEN m > 1e-9 THEN content / m ELSE 255.0 END >= 4.5),
  v_taken AS (SELECT DISTINCT stream, CAST(0 AS BIGINT) AS c FROM v_frames UNION ALL SELECT t.stream, min(k.frame_index) FROM v_taken t JOIN v_cut k ON k.stream = t.stream AND k.frame_index >= t.c + 5 GROUP BY t.stream, t.c),
  v_list AS (SELECT stream, total, list_sort(list_distinct(list_concat(list(c), [any_value(total)]))) AS cuts FROM v_taken JOIN (SELECT stream, count(*) AS total FROM v_frames GROUP BY stream) USING (stream) GROUP BY stream, total)"""


_CUTS_SQL = A.FRAMES_SQL + """, v_streams AS (SELECT stream, count(*) AS total, coalesce(list(frame_index ORDER BY frame_index) FILTER (WHERE event_id % 9 = 0), []) AS cuts FROM v_frames GROUP BY stream),
v_bounds AS (SELECT stream, total, cuts, unnest(list_sort(list_distinct(list_concat([0, total], list_filter(cuts, lambda c: c > 0 AND c < total))))) AS b FROM v_streams),
v_intervals AS (SELECT * FROM (SELECT stream, total, cuts, b AS s, lead(b) OVER (PARTITION BY stream ORDER BY b) AS e FROM v_bounds) WHERE e IS NOT NULL),
v_counts AS (SELECT *, greatest(1, CAST(ceil((e - s) / 6.0) AS BIGINT)) AS n FROM v_intervals),
v_parts AS (SELECT stream, total, cuts, s + CAST(round_even(k * (e - s) / CAST(n AS DOUBLE), 0) AS BIGINT) AS start, s + CAST(round_even((k + 1) * (e - s) / CAST(n AS DOUBLE), 0) AS BIGINT) AS "end" FROM v_counts, LATERAL (SELECT unnest(generate_series(0, n - 1)) AS k))"""


def segment_split_over_max(spark, d):
    return S.split_over(S.intervals(_streams(spark, d)), 6).select("stream", "start", "end")


def segment_method_label(spark, d):
    return S.labelled(S.split_over(S.intervals(_streams(spark, d)), 6)).groupBy("stream", "method").agg(F.count("*").alias("segments"), F.sum(F.col("end") - F.col("start")).alias("frames"))


def cut_list(spark, d):
    return S.cut_list(A.frames(spark, d), FPS, "low", 0.2).select("stream", "total", F.array_join("cuts", ",").alias("cuts"))


def segment_subdetect(spark, d):
    f = A.frames(spark, d)
    return S.subdetected(S.cut_list(f, FPS, "low", 0.2), f, 0.4, "high", 0.12).select("stream", "total", F.array_join("cuts", ",").alias("cuts"))


def segment_whole(spark, d):
    return S.whole(_streams(spark, d))


def segment_build(spark, d):
    return S.built(_streams(spark, d), min_sec=0.2, max_sec=0.6)


def pair_motion_aggregate(spark, d):
    out = M.motion_summary(A.pairs(spark, d), diagonal=100.0)
    return out.select("stream", "pairs", "usable", *(F.round(c, 6).alias(c) for c in out.columns if c not in ("stream", "pairs", "usable")))


def cumulative_transform(spark, d):
    out = M.cumulative_transform(M.usable_pairs(A.pairs(spark, d)), 1280.0, 720.0)
    return out.select("stream", "pair_no", "cum_scale", "cum_rotation_deg", "cum_tx", "cum_ty")


def cumulative_homography(spark, d):
    out = M.cumulative_transform(M.usable_pairs(A.pairs(spark, d)), 1280.0, 720.0)
    return out.select("stream", "pair_no", *(F.get("cum_homography", F.lit(i)).alias(f"h{i}") for i in (0, 1, 2, 5, 7)))


def motion_totals(spark, d):
    return M.motion_totals(A.pairs(spark, d), 1280.0, 720.0)


def run_stats_rollup(spark, d):
    """Runs by status and stages by time: event types stand for stages."""
    e = A.table(spark, d, "events")
    return e.groupBy(F.col("event_type").alias("stage")).agg(F.round(F.sum("value"), 4).alias("seconds"), F.count("*").alias("calls"), F.round(F.min("value"), 6).alias("shortest"), F.round(F.max("value"), 6).alias("longest"))


def rate_candidates(spark, d):
    """Streams at six candidates a second in groups of three, from a start that differs and, of every third, for two seconds."""
    shots = A.frames(spark, d).groupBy("stream").agg(F.count("*").alias("frames")).select("stream", "frames", F.lit(25.0).alias("fps"), (F.col("stream") % 4 / 8.0).alias("start_sec"), F.when(F.col("stream") % 3 == 0, 2.0).alias("duration_sec"))
    return FR.rate_candidates(shots, 2.0, 3)


QUERIES = [frame_quality_scores, frame_invalid_reason, valid_range_trim, uniform_sample_frames, storyboard_cells, window_best_frame, candidate_group_best, cut_adaptive_ratio, segment_split_over_max, segment_method_label, cut_list, segment_subdetect, segment_whole, segment_build, pair_motion_aggregate, cumulative_transform, cumulative_homography, motion_totals, run_stats_rollup, rate_candidates]

ORACLE_SQL = {
    "frame_quality_scores": f"WITH {A.QUALITY_SQL} SELECT stream, frame_index, sharpness_median, quality_score, is_black, is_white, is_blur, is_low_info, bad FROM v_quality",
    "frame_invalid_reason": "WITH "
    + A.QUALITY_SQL.replace("FROM events)", f"FROM events UNION ALL SELECT s, 0, '', i, m, sd, sh FROM (VALUES {_LITERAL}) t(s, m, sd, sh), (SELECT unnest(generate_series(0, 9)) AS i))")
    + """ SELECT stream, count(*) AS frames, round(avg(CASE WHEN bad THEN 1 ELSE 0 END), 6) AS bad_ratio, CASE WHEN avg(CASE WHEN bad THEN 1 ELSE 0 END) > 0.9 THEN 'invalid' ELSE 'ok' END AS status,
  CASE WHEN avg(CASE WHEN bad THEN 1 ELSE 0 END) > 0.9 THEN CASE WHEN bool_and(is_black) THEN 'all_frames_black' WHEN bool_and(is_white) THEN 'all_frames_white' WHEN bool_and(is_low_info) THEN 'all_frames_low_info' ELSE 'invalid_quality' END END AS reason
  FROM v_quality GROUP BY stream""",
    "valid_range_trim": f"WITH {A.RANGES_SQL} SELECT stream, valid_start, valid_end, status FROM v_ranges",
    "uniform_sample_frames": f"""WITH {A.RANGES_SQL}, v_k AS (SELECT *, greatest(2, least(CASE WHEN n / 25.0 < 1 THEN 7 WHEN n / 25.0 <= 3 THEN 10 ELSE 14 END, valid_end - valid_start + 1)) AS k FROM v_ranges WHERE status = 'ok')
  SELECT DISTINCT stream, CASE WHEN valid_end <= valid_start THEN valid_start WHEN i = k - 1 THEN valid_end ELSE CAST(round_even(valid_start + i * ((valid_end - valid_start) / CAST(k - 1 AS DOUBLE)), 0) AS BIGINT) END AS frame_index
  FROM v_k, LATERAL (SELECT unnest(generate_series(0, k - 1)) AS i)""",
    "storyboard_cells": f"""WITH {A.RANGES_SQL}, v_targets AS (SELECT stream, valid_start AS a, valid_end AS b, i AS cell, CASE WHEN valid_end <= valid_start THEN CAST(valid_start AS DOUBLE) WHEN i = 8 THEN CAST(valid_end AS DOUBLE) ELSE valid_start + i * ((valid_end - valid_start) / 8.0::DOUBLE) END AS target
    FROM v_ranges, (SELECT unnest(generate_series(0, 8)) AS i) WHERE status = 'ok' AND (valid_end > valid_start OR i = 0)),
  v_found AS (SELECT t.stream, cell, target, f.frame_index, row_number() OVER (PARTITION BY t.stream, cell ORDER BY bad, sharpness DESC, f.frame_index) AS r
    FROM v_targets t JOIN v_quality f ON f.stream = t.stream AND f.frame_index BETWEEN greatest(a, least(b, ceil(target - 1.25))) AND greatest(a, least(b, floor(target + 1.25))))
  SELECT stream, cell, round(target, 6) AS target, max(frame_index) OVER (PARTITION BY stream ORDER BY cell) AS frame_index FROM v_found WHERE r = 1""",
    "window_best_frame": f"""WITH {A.QUALITY_SQL}, v_best AS (SELECT stream, frame_index // 25 AS "window", frame_index, row_number() OVER (PARTITION BY stream, frame_index // 25 ORDER BY sharpness DESC, frame_index) AS r
    FROM v_quality WHERE frame_index % 25 IN (0, 6, 12, 18, 24) AND NOT is_black AND NOT is_white AND NOT is_low_info)
  SELECT stream, "window", frame_index, round(frame_index / 25.0::DOUBLE, 6) AS time_sec FROM v_best WHERE r = 1""",
    "candidate_group_best": f"""WITH {A.FRAMES_SQL}, v_best AS (SELECT stream, frame_index // 3 AS "group", frame_index, row_number() OVER (PARTITION BY stream, frame_index // 3 ORDER BY sharpness DESC, frame_index) AS r FROM v_frames)
  SELECT stream, "group", frame_index, round("group" / 2.0::DOUBLE, 6) AS time_sec FROM v_best WHERE r = 1""",
    "cut_adaptive_ratio": f"""WITH {A.FRAMES_SQL}, v_content AS (SELECT stream, frame_index, abs(luma_mean - coalesce(lag(luma_mean) OVER (PARTITION BY stream ORDER BY frame_index), luma_mean)) AS content FROM v_frames),
  v_mean AS (SELECT *, CASE WHEN count(*) OVER w > 1 THEN (sum(content) OVER w - content) / (count(*) OVER w - 1) ELSE 0 END AS m FROM v_content WINDOW w AS (PARTITION BY stream ORDER BY frame_index ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
  v_ratio AS (SELECT *, CASE WHEN m > 1e-9 THEN content / m WHEN content >= 15 THEN 255.0 ELSE 0.0 END AS ratio FROM v_mean)
  SELECT stream, frame_index, content, round(ratio, 6) AS ratio, ratio >= 3.0 AND content >= 15 AS is_cut FROM v_ratio""",
    "cut_list": f"WITH RECURSIVE {_CUT_LIST_SQL} SELECT stream, total, array_to_string(cuts, ',') AS cuts FROM v_list",
    "segment_subdetect": f"""WITH RECURSIVE {_CUT_LIST_SQL}, v_long AS (SELECT * FROM (SELECT stream, c AS s, lead(c) OVER (PARTITION BY stream ORDER BY c) AS e FROM (SELECT stream, unnest(cuts) AS c FROM v_list)) WHERE e - s > 10),
  v_in AS (SELECT f.stream, s, e, f.frame_index, abs(luma_mean - coalesce(lag(luma_mean) OVER (PARTITION BY f.stream, s ORDER BY f.frame_index), luma_mean)) AS content FROM v_frames f JOIN v_long l ON f.stream = l.stream AND f.frame_index >= s AND f.frame_index < e),
  v_m2 AS (SELECT *, CASE WHEN count(*) OVER w > 1 THEN (sum(content) OVER w - content) / (count(*) OVER w - 1) ELSE 0 END AS m FROM v_in WINDOW w AS (PARTITION BY stream, s ORDER BY frame_index ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
  v_k2 AS (SELECT stream, s, frame_index FROM v_m2 WHERE content >= 15 AND frame_index > s AND CASE WHEN m > 1e-9 THEN content / m ELSE 255.0 END >= 2.0),
  v_g2 AS (SELECT DISTINCT stream, s, s AS c FROM v_k2 UNION ALL SELECT g.stream, g.s, min(k.frame_index) FROM v_g2 g JOIN v_k2 k ON k.stream = g.stream AND k.s = g.s AND k.frame_index >= g.c + 3 GROUP BY g.stream, g.s, g.c)
  SELECT stream, any_value(total) AS total, array_to_string(list_sort(list_distinct(list_concat(any_value(cuts), coalesce(list(c) FILTER (WHERE c IS NOT NULL), [])))), ',') AS cuts FROM v_list LEFT JOIN v_g2 USING (stream) GROUP BY stream""",
    "segment_whole": f"""WITH {_CUTS_SQL} SELECT stream, 1 AS index, 'shot_0001' AS shot_id, 0 AS start_frame, total AS end_frame, 0.0 AS start_sec, total / 25.0::DOUBLE AS end_sec, total / 25.0::DOUBLE AS duration_sec, false AS below_min, 'none' AS method, 0 AS split_iterations, false AS fallback, 1 AS detected_shot_count FROM v_streams""",
    "segment_split_over_max": f'WITH {_CUTS_SQL} SELECT stream, start, "end" FROM v_parts WHERE "end" > start',
    "segment_method_label": f"""WITH {_CUTS_SQL} SELECT stream, CASE WHEN len(cuts) < 2 THEN 'equal_split' WHEN len(list_filter(cuts, lambda c: c > start AND c < "end")) > 0 THEN 'merge'
    WHEN (start IN (0, total) OR list_contains(cuts, start)) AND ("end" IN (0, total) OR list_contains(cuts, "end")) THEN 'pyscenedetect_adaptive' ELSE 'equal_split' END AS method, count(*) AS segments, CAST(sum("end" - start) AS BIGINT) AS frames
  FROM v_parts WHERE "end" > start GROUP BY 1, 2""",
    "pair_motion_aggregate": f"""WITH {A.PAIRS_SQL}, {_USABLE_SQL}
  v_t AS (SELECT *, lag(tx) OVER w AS px, lag(ty) OVER w AS py FROM v_u WHERE use AND step > 2.0 WINDOW w AS (PARTITION BY stream ORDER BY pair_no)),
  v_turn AS (SELECT stream, sum(CASE WHEN step * sqrt(px * px + py * py) < 1e-9 THEN 0 ELSE degrees(acos(greatest(-1, least(1, (tx * px + ty * py) / (step * sqrt(px * px + py * py)))))) END) AS turn FROM v_t WHERE px IS NOT NULL GROUP BY stream)
  SELECT stream, count(*) AS pairs, count(*) FILTER (WHERE use) AS usable, round(avg(match_count), 6) AS avg_match_count, round(avg(inlier_count) FILTER (WHERE success), 6) AS avg_inlier_count, round(avg(inlier_ratio) FILTER (WHERE success), 6) AS avg_inlier_ratio,
    round(avg(CASE WHEN inlier_ratio < 0.3 THEN 1.0 ELSE 0.0 END) FILTER (WHERE success), 6) AS low_inlier_rate, round(avg(CASE WHEN success THEN 0.0 ELSE 1.0 END), 6) AS match_fail_rate,
    round(coalesce(sum(abs(ln(greatest(scale_step, 1e-9)))) FILTER (WHERE use), 0), 6) AS zoom_path, round(coalesce(sum(abs(rotation_step_deg)) FILTER (WHERE use), 0), 6) AS rotation_path_deg, round(coalesce(sum(step) FILTER (WHERE use), 0), 6) AS translation_path,
    round(coalesce(any_value(turn), 0), 6) AS direction_change_deg, round(coalesce(max(step / (100.0 + 1e-9)) FILTER (WHERE success), 0), 6) AS max_translation_step_norm, round(coalesce(max(flow_magnitude) FILTER (WHERE success), 0), 6) AS max_flow_magnitude,
    round(avg(perspective_error) FILTER (WHERE success), 6) AS perspective_avg, round(avg(flow_magnitude) FILTER (WHERE success), 6) AS flow_magnitude_avg, round(avg(h_inlier_ratio) FILTER (WHERE success), 6) AS h_inlier_ratio_avg, round(min(h_inlier_ratio) FILTER (WHERE success), 6) AS h_inlier_ratio_min, round(avg(parallax_cv) FILTER (WHERE success), 6) AS parallax_cv_avg,
    round(avg(center_inlier_ratio) FILTER (WHERE success), 6) AS center_inlier_ratio_mean, round(stddev_pop(center_inlier_ratio) FILTER (WHERE success), 6) AS center_inlier_ratio_std
  FROM v_u LEFT JOIN v_turn USING (stream) GROUP BY stream""",
    "cumulative_transform": f"WITH RECURSIVE {_PRODUCT_SQL} SELECT stream, pair_no, cum_scale, cum_rotation_deg, cum_tx, cum_ty FROM v_total",
    "cumulative_homography": f"WITH RECURSIVE {_PRODUCT_SQL} SELECT stream, pair_no, h0, h1, h2, h5, h7 FROM v_total",
    "motion_totals": f"""WITH RECURSIVE {_PRODUCT_SQL}, v_path AS (SELECT stream, coalesce(sum(step) FILTER (WHERE use), 0) AS path, max(pair_no) AS pair_no FROM v_u GROUP BY stream),
  v_end AS (SELECT *, sqrt(cum_tx * cum_tx + cum_ty * cum_ty) AS moved, sqrt(1280.0::DOUBLE * 1280 + 720 * 720) AS diag FROM v_total JOIN v_path USING (stream, pair_no))
  SELECT stream, cum_scale AS scale_total, cum_rotation_deg AS rotation_deg_total, cum_tx AS tx_total, cum_ty AS ty_total, moved / (diag + 1e-9) AS translation_norm, path / (moved + 1e-9) AS translation_path_ratio,
    abs(ln(greatest(cum_scale, 1e-9))) / 0.1 AS score_zoom, abs(cum_rotation_deg) / 3.0 AS score_rotation, moved / (diag + 1e-9) / 0.03 AS score_translation FROM v_end""",
    "run_stats_rollup": "SELECT event_type AS stage, round(sum(value), 4) AS seconds, count(*) AS calls, round(min(value), 6) AS shortest, round(max(value), 6) AS longest FROM events GROUP BY event_type",
    "rate_candidates": f"""WITH {A.FRAMES_SQL}, v_shots AS (SELECT stream, count(*) AS frames, stream % 4 / 8.0::DOUBLE AS start, CASE WHEN stream % 3 = 0 THEN 2.0::DOUBLE END AS most FROM v_frames GROUP BY stream),
  v_slots AS (SELECT *, unnest(generate_series(0, CAST(floor(least(frames / 25.0::DOUBLE - start, coalesce(most, 1e9)) * 6 + 0.5) AS BIGINT) - 1)) AS slot FROM v_shots)
  SELECT stream, slot // 3 AS "group", slot, least(greatest(CAST(ceil(start * 25) AS BIGINT), CAST(ceil((slot + 0.5::DOUBLE) * 25 / 6 + start * 25) AS BIGINT) - 1), frames - 1) AS frame_index FROM v_slots""",
}
