"""Queries on feature matches and the motions that they give."""

from __future__ import annotations

from pyspark.sql import functions as F

from shotlake.operators import matching as MT
from shotlake.plans import adapters as A


def feature_matches(spark, d):
    """Labels stand for frames of one stream; each is matched with the next."""
    e = A.table(spark, d, "embeddings")
    descriptors = e.select(F.lit(0).alias("stream"), F.col("label").alias("frame_index"), F.col("vec_id").alias("number"), F.col("embedding").alias("descriptor"))
    pairs = e.select(F.lit(0).alias("stream"), F.col("label").alias("frame_i"), ((F.col("label") + 1) % 10).alias("frame_j")).distinct()
    return MT.matched(descriptors, pairs, 0.97).select("frame_i", "frame_j", "number_i", "number_j", F.round("distance", 6).alias("distance"))


#: Order lines as matches: a supplier is a pair of frames with a planted motion, three in ten are no match, and some suppliers have few lines or scales out of range.
_MATCHES_SQL = """v_lines AS (SELECT l_suppkey AS s, l_orderkey AS o, l_partkey AS p, l_linenumber AS n, CAST((l_orderkey * 37 + l_linenumber * 211) % 1280 AS DOUBLE) AS x, CAST((l_partkey * 53 + l_linenumber * 97) % 720 AS DOUBLE) AS y FROM lineitem WHERE l_suppkey % 13 <> 4 OR l_orderkey % 100 = 0),
v_planted AS (SELECT *, CASE WHEN s % 11 = 5 THEN 2.5 ELSE 0.9 + (s % 21) / CAST(100 AS DOUBLE) END AS scale, radians(CAST(s % 17 - 8 AS DOUBLE)) AS turn, CAST(s % 31 - 15 AS DOUBLE) AS dx, CAST(s % 23 - 11 AS DOUBLE) AS dy FROM v_lines),
v_moved AS (SELECT *, scale * cos(turn) * x - scale * sin(turn) * y + dx AS u, scale * sin(turn) * x + scale * cos(turn) * y + dy AS v, (o + n) % 10 < 3 AS wrong FROM v_planted)"""


def pair_motion(spark, d):
    A.table(spark, d, "lineitem").createOrReplaceTempView("_pair_motion_lines")
    rows = spark.sql("WITH " + _MATCHES_SQL.replace("FROM lineitem", "FROM _pair_motion_lines") + " SELECT 0 AS stream, s AS pair_no, x AS x_i, y AS y_i, IF(wrong, u + 40 + p % 200, u) AS x_j, IF(wrong, v - 60 - o % 100, v) AS y_j FROM v_moved")
    out = MT.motions(rows, rows.select("stream", "pair_no").distinct(), 1280.0, 720.0)
    return out.select("pair_no", "success", "match_count", "inlier_count", *(F.round(c, 6).alias(c) for c in ("inlier_ratio", "scale_step", "rotation_step_deg", "tx", "ty", "flow_magnitude", "parallax_cv", "center_inlier_ratio")))


QUERIES = [feature_matches, pair_motion]

ORACLE_SQL = {
    "feature_matches": """WITH v_d AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
v_n AS (SELECT a.label AS frame_i, b.label AS frame_j, a.vec_id AS number_i, b.vec_id AS number_j, list_distance(a.e, b.e) AS distance FROM v_d a JOIN v_d b ON b.label = (a.label + 1) % 10),
v_r AS (SELECT *, row_number() OVER w AS r, lead(distance) OVER w AS second FROM v_n WINDOW w AS (PARTITION BY frame_i, frame_j, number_i ORDER BY distance, number_j))
SELECT frame_i, frame_j, number_i, number_j, round(distance, 6) AS distance FROM v_r WHERE r = 1 AND distance < 0.97 * second""",
    "pair_motion": f"""WITH {_MATCHES_SQL}, v_points AS (SELECT *, CASE WHEN wrong THEN u + 40 + p % 200 ELSE u END AS xj, CASE WHEN wrong THEN v - 60 - o % 100 ELSE v END AS yj FROM v_moved),
v_flow AS (SELECT *, sqrt((xj - x) * (xj - x) + (yj - y) * (yj - y)) AS flow, x BETWEEN 320 AND 960 AND y BETWEEN 180 AND 540 AS middle FROM v_points),
v_sums AS (SELECT s, any_value(scale) AS scale, any_value(turn) AS turn, any_value(dx) AS dx, any_value(dy) AS dy, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE NOT wrong) AS DOUBLE) AS good, CAST(count(*) FILTER (WHERE middle) AS DOUBLE) AS m, CAST(count(*) FILTER (WHERE middle AND NOT wrong) AS DOUBLE) AS mg,
  quantile_cont(flow, 0.5) AS med, avg(flow) AS mean, stddev_pop(flow) AS sd FROM v_flow GROUP BY s),
v_ok AS (SELECT *, n >= 8 AND good >= 8 AND scale BETWEEN 0.5 AND 2 AS ok FROM v_sums)
SELECT s AS pair_no, ok AS success, CASE WHEN ok THEN n ELSE 0.0 END AS match_count, CASE WHEN ok THEN good ELSE 0.0 END AS inlier_count, round(CASE WHEN ok THEN good / n ELSE 0.0 END, 6) AS inlier_ratio, round(CASE WHEN ok THEN scale ELSE 1.0 END, 6) AS scale_step, round(CASE WHEN ok THEN degrees(turn) ELSE 0.0 END, 6) AS rotation_step_deg,
  round(CASE WHEN ok THEN scale * cos(turn) * 640 - scale * sin(turn) * 360 + dx - 640 ELSE 0.0 END, 6) AS tx, round(CASE WHEN ok THEN scale * sin(turn) * 640 + scale * cos(turn) * 360 + dy - 360 ELSE 0.0 END, 6) AS ty,
  round(CASE WHEN ok THEN med / (sqrt(1280 * 1280 + 720 * 720) + 1e-9) ELSE 0.0 END, 6) AS flow_magnitude, round(CASE WHEN ok THEN sd / (mean + 1e-9) ELSE 0.0 END, 6) AS parallax_cv, round(CASE WHEN ok THEN CASE WHEN m > 0 THEN mg / m ELSE good / n END ELSE 0.0 END, 6) AS center_inlier_ratio FROM v_ok""",
}
