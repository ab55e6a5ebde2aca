"""Aggregates over matched frame pairs (stream, pair_no, success, match_count, inlier_count, inlier_ratio, scale_step, rotation_step_deg, tx, ty, flow_magnitude, center_inlier_ratio, affine)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-9


def usable_pairs(pairs: DataFrame, low_inlier: float = 0.3, most_log: float = 0.25) -> DataFrame:
    """pairs with usable: successful with enough inliers (all successful if fewer than two have), without outliers of scale if three or more remain and two stay."""
    w = Window.partitionBy("stream")
    ok = F.col("success")
    out = pairs.withColumn("_a", ok & (F.col("inlier_ratio") >= low_inlier))
    out = out.withColumn("_b", F.when(F.sum(F.col("_a").cast("int")).over(w) < 2, ok).otherwise(F.col("_a")))
    scale = F.greatest("scale_step", F.lit(EPS))
    out = out.withColumn("_m", F.percentile(F.when(F.col("_b"), scale), F.lit(0.5)).over(w)).withColumn("_n", F.sum(F.col("_b").cast("int")).over(w))
    out = out.withColumn("_c", F.col("_b") & (F.abs(F.ln(scale / F.col("_m"))) < most_log))
    trimmed = (F.col("_n") >= 3) & (F.sum(F.col("_c").cast("int")).over(w) >= 2)
    return out.withColumn("usable", F.coalesce(F.when(trimmed, F.col("_c")).otherwise(F.col("_b")), F.lit(False))).drop("_a", "_b", "_c", "_m", "_n")


def motion_summary(pairs: DataFrame, diagonal: float, low_inlier: float = 0.3) -> DataFrame:
    """One row for each stream: means over successful pairs, failure rate, and path lengths over usable ones."""
    pairs = usable_pairs(pairs, low_inlier)
    ok, use = F.col("success"), F.col("usable")
    step = F.sqrt(F.col("tx") * F.col("tx") + F.col("ty") * F.col("ty"))
    turning = Window.partitionBy("stream", "_turns").orderBy("pair_no")
    pairs = pairs.withColumn("_step", step).withColumn("_turns", use & (step > 0.02 * diagonal))
    px, py = F.lag("tx").over(turning), F.lag("ty").over(turning)
    both = step * F.sqrt(px * px + py * py)
    angle = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("tx") * px + F.col("ty") * py) / both))))
    pairs = pairs.withColumn("_angle", F.when(F.col("_turns") & px.isNotNull(), F.when(both < EPS, F.lit(0.0)).otherwise(angle)))
    when = lambda c, x: F.when(c, x)
    return pairs.groupBy("stream").agg(
        F.count("*").alias("pairs"),
        F.avg("match_count").alias("avg_match_count"),
        F.avg(when(ok, F.col("inlier_count"))).alias("avg_inlier_count"),
        F.avg(when(ok, F.col("inlier_ratio"))).alias("avg_inlier_ratio"),
        F.avg(when(ok, (F.col("inlier_ratio") < low_inlier).cast("int"))).alias("low_inlier_rate"),
        F.avg((~ok).cast("int")).alias("match_fail_rate"),
        *(F.avg(when(ok, F.col(c))).alias(name) for c, name in (("perspective_error", "perspective_avg"), ("flow_magnitude", "flow_magnitude_avg"), ("h_inlier_ratio", "h_inlier_ratio_avg"), ("parallax_cv", "parallax_cv_avg")) if c in pairs.columns),
        *([F.min(when(ok, F.col("h_inlier_ratio"))).alias("h_inlier_ratio_min")] if "h_inlier_ratio" in pairs.columns else []),
        F.count(when(use, 1)).alias("usable"),
        F.coalesce(F.sum(when(use, F.abs(F.ln(F.greatest("scale_step", F.lit(EPS)))))), F.lit(0.0)).alias("zoom_path"),
        F.coalesce(F.sum(when(use, F.abs("rotation_step_deg"))), F.lit(0.0)).alias("rotation_path_deg"),
        F.coalesce(F.sum(when(use, F.col("_step"))), F.lit(0.0)).alias("translation_path"),
        F.coalesce(F.sum("_angle"), F.lit(0.0)).alias("direction_change_deg"),
        F.coalesce(F.max(when(ok, F.col("_step") / (diagonal + EPS))), F.lit(0.0)).alias("max_translation_step_norm"),
        F.coalesce(F.max(when(ok, F.col("flow_magnitude"))), F.lit(0.0)).alias("max_flow_magnitude"),
        F.avg(when(ok, F.col("center_inlier_ratio"))).alias("center_inlier_ratio_mean"),
        F.stddev_pop(when(ok, F.col("center_inlier_ratio"))).alias("center_inlier_ratio_std"),
    )


def _step(affine, flat, usable, step, h):
    """The products (affine, homography) after one more pair."""
    if not usable:
        return affine, flat
    affine = np.vstack([np.asarray(step, np.float64).reshape(2, 3), [0, 0, 1]]) @ affine
    return affine, flat if h is None else np.asarray(h, np.float64).reshape(3, 3) @ flat


BLOCK = 4096  # numbers of pairs that are multiplied in one task


def cumulative_transform(pairs: DataFrame, width: float, height: float) -> DataFrame:
    """(stream, pair_no, cum_scale, cum_rotation_deg, cum_tx, cum_ty, cum_homography): the ordered products of the usable steps so far.

    pairs has affine, a row-major 2x3, and may have homography, a row-major 3x3,
    which is passed over where null.  Displacement is that of the frame's centre.
    A scan in two levels: the products of blocks of BLOCK pair numbers, the products of the
    blocks before each, and from there on inside each block.  So a
    long stream is many tasks; only its blocks' products, a row each, meet in one.
    """
    homography = F.col("homography") if "homography" in pairs.columns else F.lit(None)
    rows = pairs.select("stream", F.col("pair_no").cast("long"), F.coalesce("usable", F.lit(False)).alias("usable"), F.col("affine").cast("array<double>"), homography.cast("array<double>").alias("homography"))
    rows = rows.withColumn("block", F.floor(F.col("pair_no") / BLOCK))
    key = f"stream {dict(rows.dtypes)['stream']}, block long"
    center = np.array([width / 2, height / 2, 1.0])

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        state = np.eye(3), np.eye(3)
        for row in pdf.sort_values("pair_no")[["usable", "affine", "homography"]].itertuples(index=False):
            state = _step(*state, *row)
        return pd.DataFrame({"stream": pdf["stream"].iloc[:1], "block": pdf["block"].iloc[:1], "flat": [state[0].ravel().tolist()], "deep": [state[1].ravel().tolist()]})

    def before(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, out, affine, flat = pdf.sort_values("block"), [], np.eye(3), np.eye(3)
        for a, h in zip(pdf.flat, pdf.deep, strict=True):
            out.append((affine.ravel().tolist(), flat.ravel().tolist()))
            affine, flat = np.asarray(a).reshape(3, 3) @ affine, np.asarray(h).reshape(3, 3) @ flat
        return pd.DataFrame({"stream": pdf["stream"].to_numpy(), "block": pdf["block"].to_numpy(), "flat": [x for x, _ in out], "deep": [x for _, x in out]})

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, out = pdf.sort_values("pair_no"), []
        affine, flat = (np.asarray(pdf[c].iloc[0]).reshape(3, 3) for c in ("flat", "deep"))
        for row in pdf[["usable", "affine", "homography"]].itertuples(index=False):
            affine, flat = _step(affine, flat, *row)
            moved = affine @ center - center
            out.append((math.hypot(affine[0, 0], affine[1, 0]), math.degrees(math.atan2(affine[1, 0], affine[0, 0])), moved[0], moved[1], flat.reshape(-1).tolist()))
        found = pd.DataFrame(out, columns=["cum_scale", "cum_rotation_deg", "cum_tx", "cum_ty", "cum_homography"], index=pdf.index)
        return pd.concat([pdf[["stream", "pair_no"]], found], axis=1)

    state = f"{key}, flat array<double>, deep array<double>"
    totals = rows.groupBy("stream", "block").applyInPandas(product, state)
    carried = totals.groupBy("stream").applyInPandas(before, state).withColumnRenamed("stream", "_stream")
    both = rows.join(carried.withColumnRenamed("block", "_block"), F.col("stream").eqNullSafe(F.col("_stream")) & (F.col("block") == F.col("_block"))).drop("_stream", "_block")
    return both.groupBy("stream", "block").applyInPandas(inside, f"{key.split(',')[0]}, pair_no long, cum_scale double, cum_rotation_deg double, cum_tx double, cum_ty double, cum_homography array<double>")


def motion_totals(pairs: DataFrame, width: float, height: float) -> DataFrame:
    """One row for each stream, on top of motion_summary: where its usable steps lead in all, and scores of zoom, rotation and translation (1: noticeable)."""
    diagonal = math.hypot(width, height)
    last = cumulative_transform(usable_pairs(pairs), width, height).groupBy("stream").agg(F.max_by(F.struct("cum_scale", "cum_rotation_deg", "cum_tx", "cum_ty"), "pair_no").alias("t"))
    step = F.sqrt(F.col("tx") * F.col("tx") + F.col("ty") * F.col("ty"))
    path = usable_pairs(pairs).groupBy("stream").agg(F.coalesce(F.sum(F.when(F.col("usable"), step)), F.lit(0.0)).alias("path"))
    moved = F.sqrt(F.col("t.cum_tx") * F.col("t.cum_tx") + F.col("t.cum_ty") * F.col("t.cum_ty"))
    norm = moved / (diagonal + EPS)
    return last.join(path, "stream").select(
        "stream",
        F.col("t.cum_scale").alias("scale_total"),
        F.col("t.cum_rotation_deg").alias("rotation_deg_total"),
        F.col("t.cum_tx").alias("tx_total"),
        F.col("t.cum_ty").alias("ty_total"),
        norm.alias("translation_norm"),
        (F.col("path") / (moved + EPS)).alias("translation_path_ratio"),
        (F.abs(F.ln(F.greatest("t.cum_scale", F.lit(EPS)))) / 0.10).alias("score_zoom"),
        (F.abs("t.cum_rotation_deg") / 3.0).alias("score_rotation"),
        (norm / 0.03).alias("score_translation"),
    )
