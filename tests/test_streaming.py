from datetime import datetime, timedelta

import numpy as np

from shotlake.operators.registry import Registry
from shotlake.streaming import live

T0 = datetime(2024, 1, 1)


def run(query_df, spark, name, mode="append"):
    q = query_df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
        return spark.table(name).collect()
    finally:
        q.stop()


def test_window_best_drops_late_frames(spark, tmp_path):
    def put(n, rows):
        spark.createDataFrame([(1, i, T0 + timedelta(seconds=s), 100.0, 50.0, q) for i, s, q in rows], "stream int, frame_index long, ts timestamp, luma_mean double, luma_std double, sharpness double").coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))

    put(0, [(0, 0.1, 5.0), (1, 0.5, 9.0), (2, 0.9, 9.0), (3, 1.2, 1.0)])
    schema = spark.read.parquet(str(tmp_path / "in/0")).schema
    frames = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = live.live_window_best(frames, "1 second", "2 seconds").writeStream.outputMode("append").format("memory").queryName("best").start()
    try:
        q.processAllAvailable()
        put(1, [(9, 30.0, 1.0)])
        q.processAllAvailable()
        put(2, [(10, 0.2, 99.0), (11, 60.0, 1.0)])  # the first is far behind the watermark
        q.processAllAvailable()
        got = {r.window_start.second: r.frame_index for r in spark.table("best").collect()}
    finally:
        q.stop()
    assert got[0] == 1 and got[1] == 3


def test_registries_as_keyed_state_equal_a_fold_and_go_on_after_a_restart(spark, tmp_path):
    rng = np.random.default_rng(5)
    people = rng.normal(size=(5, 6))
    rows = [(f"lib{i % 3}", i, f"v{i % 4}", None if i % 8 == 5 else (i if i != 23 else 20), None if i == 9 else (people[i % 5] + 0.3 * rng.normal(size=6)).tolist(), (people[i % 5] + 0.2 * rng.normal(size=6)).tolist() if i % 2 else None) for i in range(45)]
    schema = "library string, seq long, video string, cluster long, cam_emb array<double>, eres_emb array<double>"
    want = {}
    registries = {f"lib{k}": Registry() for k in range(3)}
    for library, seq, video, cluster, cam, eres in rows:
        want[seq] = (library, registries[library].match(cam, eres, video, cluster))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.STORE)
    try:
        for n in range(3):  # each time the query starts again from its checkpoint
            spark.createDataFrame(rows[15 * n : 15 * n + 15], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
            source = spark.readStream.schema(spark.createDataFrame(rows, schema).schema).parquet(str(tmp_path / "in/*"))
            q = live.live_registry(source).writeStream.option("checkpointLocation", str(tmp_path / "check")).format("parquet").start(str(tmp_path / "out"))
            try:
                q.processAllAvailable()
            finally:
                q.stop()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == 45 and {r.seq: (r.library, r.speaker_id) for r in got} == want


def samples_of(spark, n=40):
    rng = np.random.default_rng(8)
    people = rng.normal(size=(6, 8))
    rows = [(i, f"v{i % 4}", i if i % 9 else None, (people[i % 6] + 0.3 * rng.normal(size=8)).tolist() if i != 7 else None, (people[i % 6][:4] + 0.2 * rng.normal(size=4)).tolist() if i % 2 else None) for i in range(n)]
    return rows, "seq long, video string, cluster long, cam_emb array<double>, eres_emb array<double>"


def test_registry_in_two_runs_equals_one_and_running_again_changes_nothing(spark, tmp_path):
    from shotlake.operators import registry as R

    rows, schema = samples_of(spark)
    whole = {r.seq: r.speaker_id for r in R.matched(spark.createDataFrame(rows, schema)).collect()}
    path, got = str(tmp_path / "registry"), {}
    for part in (rows[:17], rows[17:]):
        got |= {r.seq: r.speaker_id for r in R.resolve(spark.createDataFrame(part, schema).repartition(3), path).collect()}
    assert got == whole and len(set(whole.values()) - {None}) > 2 and whole[7] is None
    version, speakers, seen = R.load(spark, path)
    before = sorted((r.speaker_id, r.samples, tuple(r.videos)) for r in speakers.collect())
    named = [r for r in rows if r[2] is not None]
    again = {r.seq: r.speaker_id for r in R.resolve(spark.createDataFrame(named, schema), path).collect()}
    assert again == {s: whole[s] for s, *_ in named}
    version_now, speakers, _ = R.load(spark, path)
    assert (version, version_now) == (2, 3) and sorted((r.speaker_id, r.samples, tuple(r.videos)) for r in speakers.collect()) == before
    assert R.resolve(spark.createDataFrame([], schema), path).count() == 0


def test_registry_tables_follow_a_stream(spark, tmp_path):
    from shotlake.operators import registry as R

    rows, schema = samples_of(spark)
    for n in range(2):
        spark.createDataFrame(rows[20 * n : 20 * n + 20], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    source = spark.readStream.schema(spark.createDataFrame(rows, schema).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = live.live_resolved(source, str(tmp_path / "registry"), str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {r.seq: r.speaker_id for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r.seq: r.speaker_id for r in R.matched(spark.createDataFrame(rows, schema)).collect()}


def test_nearest_center_in_blocks_equals_one_pass(spark):
    from shotlake.operators import registry as R

    rng = np.random.default_rng(3)
    c = [(i, rng.normal(size=5).tolist()) for i in range(23)] + [(90, [0.0] * 5)]
    x = [(i, rng.normal(size=5).tolist()) for i in range(40)] + [(91, [0.0] * 5)]
    centers, samples = spark.createDataFrame(c, "center_id long, center array<double>"), spark.createDataFrame(x, "sample_id long, embedding array<double>")
    cos = lambda a, b: float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))) if np.linalg.norm(a) * np.linalg.norm(b) > 1e-9 else 0.0
    want = {i: max(((cos(a, b), -k) for k, b in c)) for i, a in x}
    for most in (100_000, 7):
        got = {r.sample_id: (r.similarity, -r.center_id) for r in R.nearest_center(samples, centers, most).collect()}
        assert set(got) == set(want) and all(got[i][1] == want[i][1] and abs(got[i][0] - want[i][0]) < 1e-9 for i in want)
    assert R.nearest_center(samples, centers.where("false")).count() == 0
