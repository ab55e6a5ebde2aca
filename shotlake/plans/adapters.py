"""Fixture tables as the relations that operators take, each with the same view in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shotlake.operators import frames as FR


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


FRAMES_SQL = """v_frames AS (
  SELECT user_id AS stream, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_index,
    CAST(event_id * 37 % 256 AS DOUBLE) AS luma_mean, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS luma_std, value AS sharpness
  FROM events)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as frames at 25 a second: a user is a stream."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("stream"),
        "event_id",
        "event_type",
        (F.row_number().over(order) - 1).cast("long").alias("frame_index"),
        (F.col("event_id") * 37 % 256).cast("double").alias("luma_mean"),
        F.get_json_object("props", "$.k").cast("double").alias("luma_std"),
        F.col("value").alias("sharpness"),
    )


QUALITY_SQL = (
    FRAMES_SQL
    + """, v_median AS (SELECT stream, quantile_cont(sharpness, 0.5) AS sharpness_median FROM v_frames GROUP BY stream),
v_flags AS (SELECT f.*, m.sharpness_median, luma_mean < 15 AND luma_std < 10 AS is_black, luma_mean > 240 AND luma_std < 10 AS is_white, luma_std < 8 AS is_low_info,
    sharpness < 0.4 * sharpness_median AS is_blur FROM v_frames f JOIN v_median m USING (stream)),
v_quality AS (SELECT *, is_black OR is_white OR is_low_info OR is_blur AS bad,
    greatest(0, least(1, 1 - abs(luma_mean - 128) / 128)) * greatest(0, least(1, luma_std / 60)) * CASE WHEN sharpness_median > 0 THEN greatest(0, least(1, sharpness / (1.5 * sharpness_median))) ELSE 0 END AS quality_score FROM v_flags)"""
)


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FR.scored(frames(spark, sf_dir))


RANGES_SQL = (
    QUALITY_SQL
    + """, v_near AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY stream ORDER BY frame_index ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS nxt,
    sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY stream ORDER BY frame_index ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS prv FROM v_quality),
v_ends AS (SELECT stream, coalesce(min(CASE WHEN NOT bad AND nxt >= 3 THEN frame_index END), min(CASE WHEN NOT bad THEN frame_index END), min(frame_index)) AS a,
    coalesce(max(CASE WHEN NOT bad AND prv >= 3 THEN frame_index END), max(CASE WHEN NOT bad THEN frame_index END), max(frame_index)) AS b,
    (array_agg(frame_index ORDER BY quality_score DESC, frame_index))[1] AS best, min(frame_index) AS first_frame, max(frame_index) AS last_frame,
    avg(CASE WHEN bad THEN 1 ELSE 0 END) > 0.9 AS invalid, count(*) AS n FROM v_near GROUP BY stream),
v_ranges AS (SELECT stream, n, CASE WHEN invalid THEN first_frame WHEN abs(b - a) < 2 THEN best ELSE least(a, b) END AS valid_start,
    CASE WHEN invalid THEN last_frame WHEN abs(b - a) < 2 THEN best ELSE greatest(a, b) END AS valid_end, CASE WHEN invalid THEN 'invalid' ELSE 'ok' END AS status FROM v_ends)"""
)

UTTER_SQL = """v_turns AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, length(coalesce(text, '')) * 1000 // 15 AS dur_ms, (turn % 3) * 500 AS gap_ms FROM conversations),
v_utter AS (SELECT conv_id, turn, role AS speaker, text, length(text) % 2 AS cluster,
    (sum(dur_ms + gap_ms) OVER (PARTITION BY conv_id ORDER BY turn) - dur_ms - gap_ms) / 1000.0::DOUBLE AS start_sec,
    (sum(dur_ms + gap_ms) OVER (PARTITION BY conv_id ORDER BY turn) - gap_ms) / 1000.0::DOUBLE AS end_sec FROM v_turns)"""


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations laid end to end: fifteen characters a second, and a pause of up to a second after a turn."""
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("speaker"), text.alias("text"), F.floor(F.length(text) * 1000 / 15).alias("_d"), ((F.col("turn") % 3) * 500).alias("_g"), (F.length(text) % 2).cast("long").alias("cluster"))
    end = F.sum(F.col("_d") + F.col("_g")).over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = rows.withColumn("start_sec", (end - F.col("_d") - F.col("_g")) / F.lit(1000.0)).withColumn("end_sec", (end - F.col("_g")) / F.lit(1000.0))
    return rows.select("conv_id", "turn", "speaker", "text", "cluster", "start_sec", "end_sec")


SHOTS_SQL = (
    UTTER_SQL
    + """, v_total AS (SELECT conv_id, max(end_sec) AS total FROM v_utter GROUP BY conv_id),
v_shots AS (SELECT conv_id, k AS shot_index, k * 17.0::DOUBLE AS start_sec, least((k + 1) * 17.0::DOUBLE, total) AS end_sec FROM v_total, LATERAL (SELECT unnest(generate_series(0, CAST(ceil(total / 17.0) AS BIGINT) - 1)) AS k))"""
)


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shots of seventeen seconds over each conversation's utterances."""
    total = utterances(spark, sf_dir).groupBy("conv_id").agg(F.max("end_sec").alias("total"))
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("total") / 17.0) - 1))
    return total.where("total > 0").select("conv_id", "total", k.alias("shot_index")).select("conv_id", "shot_index", (F.col("shot_index") * 17.0).alias("start_sec"), F.least((F.col("shot_index") + 1) * 17.0, "total").alias("end_sec"))


RECORDS_SQL = """v_records AS (SELECT label AS stream, vec_id AS record, vec_id % 40 AS track_id, vec_id % 50 AS frame_index, (vec_id % 50) / 25.0::DOUBLE AS time_sec, embedding,
    CASE WHEN vec_id % 11 = 0 THEN NULL ELSE (vec_id % 7) / 7.0::DOUBLE END AS face_score, CAST(20 + vec_id % 90 AS DOUBLE) AS face_size, vec_id % 3 = 0 AS face_low,
    0.5 + (vec_id % 50) / 100.0::DOUBLE AS conf, CAST(vec_id * 13 % 101 AS DOUBLE) AS sharpness, (['full_body','upper_body','torso','chest','head','unknown'])[1 + vec_id % 6] AS level,
    CAST(vec_id % 8 AS BIGINT) AS person, CAST(10 + vec_id % 60 AS DOUBLE) AS crop_w, CAST(30 + vec_id % 70 AS DOUBLE) AS crop_h FROM embeddings)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as person records: a label is a stream, with forty tracks over fifty frames."""
    v = F.col("vec_id")
    levels = F.array(*map(F.lit, ["full_body", "upper_body", "torso", "chest", "head", "unknown"]))
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("stream"),
        v.alias("record"),
        (v % 40).alias("track_id"),
        (v % 50).alias("frame_index"),
        ((v % 50) / 25.0).alias("time_sec"),
        "embedding",
        F.when(v % 11 == 0, F.lit(None).cast("double")).otherwise((v % 7) / 7.0).alias("face_score"),
        (20 + v % 90).cast("double").alias("face_size"),
        (v % 3 == 0).alias("face_low"),
        (0.5 + (v % 50) / 100.0).alias("conf"),
        (v * 13 % 101).cast("double").alias("sharpness"),
        F.get(levels, (v % 6).cast("int")).alias("level"),
        (v % 8).alias("person"),
        F.struct(F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), (10 + v % 60).cast("double").alias("x2"), (30 + v % 70).cast("double").alias("y2")).alias("crop"),
    )


PAIRS_SQL = (
    FRAMES_SQL
    + """, v_pairs AS (SELECT stream, frame_index AS pair_no, event_id % 9 <> 0 AS success, CAST(event_id % 200 AS DOUBLE) AS match_count, CAST(event_id % 120 AS DOUBLE) AS inlier_count,
    (event_id * 7 % 100) / 100.0::DOUBLE AS inlier_ratio, 0.9::DOUBLE + (event_id * 31 % 41) / 100.0::DOUBLE AS scale_step, (event_id % 13) / 2.0::DOUBLE - 3 AS rotation_step_deg,
    CAST(event_id * 17 % 61 AS DOUBLE) - 30 AS tx, CAST(event_id * 29 % 47 AS DOUBLE) - 23 AS ty, CAST(luma_std AS DOUBLE) AS flow_magnitude, (event_id * 3 % 100) / 100.0::DOUBLE AS center_inlier_ratio,
    (event_id * 11 % 90) / 30.0::DOUBLE AS perspective_error, (event_id * 19 % 100) / 100.0::DOUBLE AS h_inlier_ratio, (event_id * 23 % 70) / 70.0::DOUBLE AS parallax_cv, radians((event_id % 13) / 2.0::DOUBLE - 3) AS angle, event_id FROM v_frames)"""
)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as matched pairs of neighbouring frames."""
    e = F.col("event_id")
    scale, turn = 0.9 + (e * 31 % 41) / 100.0, F.radians((e % 13) / 2.0 - 3)
    tx, ty = (e * 17 % 61).cast("double") - 30, (e * 29 % 47).cast("double") - 23
    return frames(spark, sf_dir).select(
        "stream",
        F.col("frame_index").alias("pair_no"),
        (e % 9 != 0).alias("success"),
        (e % 200).cast("double").alias("match_count"),
        (e % 120).cast("double").alias("inlier_count"),
        ((e * 7 % 100) / 100.0).alias("inlier_ratio"),
        scale.alias("scale_step"),
        ((e % 13) / 2.0 - 3).alias("rotation_step_deg"),
        tx.alias("tx"),
        ty.alias("ty"),
        F.col("luma_std").alias("flow_magnitude"),
        ((e * 11 % 90) / 30.0).alias("perspective_error"),
        ((e * 19 % 100) / 100.0).alias("h_inlier_ratio"),
        ((e * 23 % 70) / 70.0).alias("parallax_cv"),
        ((e * 3 % 100) / 100.0).alias("center_inlier_ratio"),
        F.array(scale * F.cos(turn), -scale * F.sin(turn), tx, scale * F.sin(turn), scale * F.cos(turn), ty).alias("affine"),
        F.when(e % 5 != 0, F.array(F.lit(1.0), (e % 7) / 100.0, tx / 10, F.lit(0.0), F.lit(1.0), ty / 10, F.lit(0.0), (e % 3) / 1000.0, F.lit(1.0))).alias("homography"),
    )
