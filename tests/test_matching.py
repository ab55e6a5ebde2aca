"""Feature matches and motions of pairs of frames against plain restatements and planted motions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shotlake.operators import matching as MT
from shotlake.operators import motion as M


def plain_matches(frames, pairs, ratio):
    out = []
    for i, j in pairs:
        a, b = frames.get(i, []), frames.get(j, [])
        if len(a) < 2 or len(b) < 2:
            continue
        for n, x in a:
            near = sorted((math.dist(x, y), m) for m, y in b)
            if near[0][0] < ratio * near[1][0]:
                out.append((i, j, n, near[0][1], round(near[0][0], 9)))
    return sorted(out)


@pytest.mark.parametrize("tile", [7, 1024])
def test_matches_equal_two_nearest_by_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(MT, "TILE", tile)
    rng = np.random.default_rng(4)
    base = rng.integers(-9, 9, (60, 8)).astype(float)
    frames = {k: [(n, (base[n] + rng.normal(0, 0.3, 8) * (n % 3)).tolist()) for n in rng.permutation(60)[: 60 - 4 * k].tolist()] for k in range(5)}
    frames[0] += [(100, frames[1][0][1]), (101, frames[1][0][1])]  # two alike: nothing in frame 1 is far enough behind the first
    frames[5], frames[6] = [(1, base[0].tolist())], []
    rows = [("s", k, n, x) for k, f in frames.items() for n, x in f] + [("s", 0, None, base[0].tolist()), ("s", 0, 7000, None)]
    df = spark.createDataFrame(rows, "stream string, frame_index long, number long, descriptor array<double>").repartition(3)
    pairs = [(0, 1), (1, 0), (2, 3), (3, 4), (4, 5), (5, 4), (4, 6), (8, 9)]
    wanted = spark.createDataFrame([("s", *p) for p in [*pairs, (0, 1)]], "stream string, frame_i long, frame_j long")
    got = sorted((r.frame_i, r.frame_j, r.number_i, r.number_j, round(r.distance, 9)) for r in MT.matched(df, wanted, 0.75).collect())
    assert got == plain_matches(frames, pairs, 0.75) and len(got) > 60
    assert MT.matched(df.where("false"), wanted).count() == 0


def test_binary_descriptors_match_by_hamming_distance(spark):
    rng = np.random.default_rng(5)
    a = rng.integers(0, 256, (40, 32), np.uint8)
    b = a.copy()
    b[:, 3] ^= 1
    df = spark.createDataFrame([("s", f, n, bytes(x)) for f, rows in ((0, a), (1, b)) for n, x in enumerate(rows)], "stream string, frame_index long, number long, descriptor binary")
    got = MT.matched(df, spark.createDataFrame([("s", 0, 1)], "stream string, frame_i long, frame_j long")).collect()
    assert sorted(r.number_i for r in got) == list(range(40)) and all(r.number_i == r.number_j and r.distance == 1.0 for r in got)


def planted(rng, scale, degrees, tx, ty, n, outliers, warp=0.0):
    p = rng.uniform((0, 0), (1280, 720), (n, 2))
    c, s = scale * math.cos(math.radians(degrees)), scale * math.sin(math.radians(degrees))
    q = p @ np.array([[c, s], [-s, c]]) + (tx, ty)
    q /= 1 + warp * p[:, :1]
    bad = rng.permutation(n)[: int(n * outliers)]
    q[bad] = rng.uniform((0, 0), (1280, 720), (len(bad), 2))
    far = np.hypot(*(q[bad] - (p[bad] @ np.array([[c, s], [-s, c]]) + (tx, ty))).T) > 10
    return p, q, n - len(bad), far.all()


@pytest.fixture(scope="module")
def motions_found(spark):
    rng = np.random.default_rng(8)
    motion = {0: (1.0, 0, 12, -7), 1: (1.1, 5, -30, 20), 2: (0.7, -40, 100, 60), 3: (1.9, 170, 900, 700), 4: (1.0, 0, 0, 0)}
    rows, want = [], {}
    for k, (scale, degrees, tx, ty) in motion.items():
        p, q, inliers, apart = planted(rng, scale, degrees, tx, ty, 300, 0.3)
        assert apart
        want[k] = (scale, degrees, tx, ty, inliers)
        rows += [("s", k, *map(float, (*a, *b))) for a, b in zip(p, q, strict=True)]
    for k, (scale, n, outliers) in {10: (1.0, 7, 0), 11: (2.5, 100, 0), 12: (0.4, 100, 0), 13: (1.0, 100, 1.0), 14: (1.0, 8, 0)}.items():
        p, q, *_ = planted(rng, scale, 0, 5, 5, n, outliers)
        rows += [("s", k, *map(float, (*a, *b))) for a, b in zip(p, q, strict=True)]
    rows += [("s", 15, 5.0, 5.0, 6.0, 6.0)] * 20 + [("s", 0, None, 1.0, 1.0, 1.0), ("s", 0, math.nan, 1.0, 1.0, 1.0)]
    matches = spark.createDataFrame(rows, "stream string, pair_no long, x_i double, y_i double, x_j double, y_j double")
    pairs = spark.createDataFrame([("s", k) for k in [*motion, 10, 11, 12, 13, 14, 15, 16]], "stream string, pair_no long")
    return matches, pairs, want, {r.pair_no: r for r in MT.motions(matches, pairs, 1280, 720).collect()}


def test_planted_motions_are_found_among_outliers(motions_found):
    *_, want, got = motions_found
    for k, (scale, degrees, tx, ty, inliers) in want.items():
        r = got[k]
        c, s = scale * math.cos(math.radians(degrees)), scale * math.sin(math.radians(degrees))
        assert r.success and (r.match_count, r.inlier_count) == (300, inliers)
        assert np.allclose(r.affine, [c, -s, tx, s, c, ty], atol=1e-6) and math.isclose(r.scale_step, scale, abs_tol=1e-9) and math.isclose(r.rotation_step_deg, degrees, abs_tol=1e-7)
        assert np.allclose((r.tx, r.ty), (c * 640 - s * 360 + tx - 640, s * 640 + c * 360 + ty - 360), atol=1e-6)
        assert np.allclose(np.array(r.homography), [c, -s, tx, s, c, ty, 0, 0, 1], atol=1e-4) and r.h_inlier_ratio >= inliers / 300 and r.perspective_error < 1e-6
        assert 0.5 < r.center_inlier_ratio < 0.9


def test_pairs_without_a_motion_fail(motions_found):
    *_, got = motions_found
    assert {k: r.success for k, r in got.items() if k >= 10} == {10: False, 11: False, 12: False, 13: False, 14: True, 15: False, 16: False}
    failed = got[11]
    assert (failed.match_count, failed.inlier_count, failed.scale_step, failed.tx, failed.affine, failed.homography) == (0, 0, 1, 0, None, None)


def test_motions_are_the_same_for_any_partitioning_and_parts(spark, motions_found, monkeypatch):
    matches, pairs, _, want = motions_found
    numbers = lambda r: [round(x, 6) if isinstance(x, float) else [round(y, 4) for y in x] if isinstance(x, list) else x for x in r]
    monkeypatch.setattr(MT, "PART", 41)
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        got = {r.pair_no: r for r in MT.motions(matches.repartition(7), pairs, 1280, 720).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert {k: numbers(r) for k, r in got.items()} == {k: numbers(r) for k, r in want.items()}


def test_a_warped_plane_shows_as_perspective(spark):
    p, q, *_ = planted(np.random.default_rng(3), 1.0, 2, 3, 4, 400, 0.0, warp=1e-5)
    matches = spark.createDataFrame([("s", 0, *map(float, (*a, *b))) for a, b in zip(p, q, strict=True)], "stream string, pair_no long, x_i double, y_i double, x_j double, y_j double")
    r = MT.motions(matches, matches.select("stream", "pair_no").distinct(), 1280, 720).first()
    assert r.success and r.h_inlier_ratio == 1.0 and r.perspective_error > 2e-4
    moved = np.array([*p[5], 1]) @ np.array(r.homography).reshape(3, 3).T
    assert np.allclose(moved[:2] / moved[2], q[5], atol=1e-3)


def test_motions_go_on_to_the_summary(spark, motions_found):
    matches, pairs, *_ = motions_found
    out = M.motion_summary(MT.motions(matches, pairs.where("pair_no < 15"), 1280, 720), math.hypot(1280, 720)).first()
    assert out.pairs == 10 and math.isclose(out.match_fail_rate, 0.4) and out.usable >= 3
    assert M.motion_totals(MT.motions(matches, pairs.where("pair_no in (0, 1, 4)"), 1280, 720), 1280, 720).count() == 1
    assert MT.motions(matches, pairs.where("false"), 1280, 720).count() == 0
    assert MT.motions(matches.where("false"), pairs, 1280, 720).where(F.col("success")).count() == 0


@pytest.mark.parametrize("block", [3, 64])
def test_products_over_blocks_equal_one_fold(spark, monkeypatch, block):
    monkeypatch.setattr(M, "BLOCK", block)
    rng = np.random.default_rng(block)
    rows = []
    for stream, n in ((0, 200), (1, 1), (2, 64), (None, 7)):
        for k in range(n):
            t, z = rng.normal(0, 0.05), 1 + rng.normal(0, 0.01)
            step = [z * math.cos(t), -z * math.sin(t), *rng.normal(0, 3, 1).tolist(), z * math.sin(t), z * math.cos(t), *rng.normal(0, 3, 1).tolist()]
            rows.append((stream, k, None if k % 11 == 5 else k % 7 != 3, step, None if k % 5 == 0 else (np.eye(3) + rng.normal(0, 1e-3, (3, 3))).ravel().tolist()))
    df = spark.createDataFrame(rows, "stream long, pair_no long, usable boolean, affine array<double>, homography array<double>").repartition(5)
    got = {(r.stream, r.pair_no): r for r in M.cumulative_transform(df, 640, 480).collect()}
    assert len(got) == len(rows)
    state, now = {}, None
    for stream, k, usable, step, h in rows:
        a, g = state.get(stream, (np.eye(3), np.eye(3)))
        if usable:
            a = np.array([*step, 0, 0, 1]).reshape(3, 3) @ a
            g = g if h is None else np.array(h).reshape(3, 3) @ g
        state[stream], now = (a, g), got[stream, k]
        moved = a @ (320, 240, 1) - (320, 240, 1)
        assert np.allclose([now.cum_scale, now.cum_tx, now.cum_ty, *now.cum_homography], [math.hypot(a[0, 0], a[1, 0]), moved[0], moved[1], *g.ravel()], atol=1e-9)


def test_one_long_stream_is_many_tasks(spark):
    n = 60_000
    turn = F.pi() / 5000
    pairs = spark.range(n).select(F.lit("s").alias("stream"), F.col("id").alias("pair_no"), F.lit(True).alias("usable"), F.array(F.cos(turn), -F.sin(turn), F.lit(0.0), F.sin(turn), F.cos(turn), F.lit(0.0)).alias("affine"))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = M.cumulative_transform(pairs, 100, 100).withColumn("task", F.spark_partition_id()).cache()
        largest = out.groupBy("task").count().agg(F.max("count"), F.count("*")).first()
        last = out.where(F.col("pair_no") == n - 1).first()
        out.unpersist()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert largest[1] >= 4 and largest[0] <= n / 2 and abs(last.cum_scale - 1) < 1e-9 and abs(abs(last.cum_rotation_deg) - 0) < 1e-6
