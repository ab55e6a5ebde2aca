import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shotlake import config
from shotlake.functions import geometry as G
from shotlake.functions import text as T
from shotlake.functions import vectors as V
from shotlake.operators import identity as ID
from shotlake.operators import segments as SG
from shotlake.plans import adapters as A
from shotlake.plans import stages
from shotlake.sources import manifests as MF
from shotlake.sources import media as MD
from tests.compare import SF


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_vectors(spark):
    a = lambda *x: F.array(*map(F.lit, x)).cast("array<float>")
    r = one(
        spark,
        V.cosine(a(1.0, 0.0), a(1.0, 1.0)),
        V.cosine(F.lit(None).cast("array<float>"), a(1.0)),
        V.cosine(a(0.0), a(1.0)),
        V.cosine_or_mismatch(a(1.0), a(1.0, 2.0)),
        V.normalized(a(3.0, 4.0)),
        V.pixel_similarity(a(0.0, 0.0), a(255.0, 0.0)),
        V.angle_degrees(a(1.0, 0.0), a(0.0, 1.0)),
        V.audio_level_dbfs(a(0.0, 0.0)),
        V.audio_level_dbfs(a(1.0, -1.0)),
    )
    assert math.isclose(r[0], math.sqrt(0.5)) and r[1] == 0 and r[2] == 0 and r[3] == -1
    assert r[4] == [0.6000000000000001, 0.8] or np.allclose(r[4], [0.6, 0.8])
    assert r[5] == 0.5 and math.isclose(r[6], 90) and r[7] is None and r[8] == 0


def test_clip_samples_rounds_to_even_and_clamps(spark):
    df = spark.createDataFrame([([0.0, 1.0, 2.0, 3.0], 0.25, 0.75, 10), ([0.0, 1.0], 0.5, 0.1, 10)], "x array<float>, a double, b double, sr int")
    assert [r[0] for r in df.select(V.clip_samples(F.col("x"), "a", "b", "sr")).collect()] == [[2.0, 3.0], []]


def test_boxes(spark):
    box = lambda *v: F.struct(*(F.lit(float(x)).alias(n) for x, n in zip(v, ("x1", "y1", "x2", "y2"), strict=True)))
    r = one(spark, G.iou(box(0, 0, 2, 2), box(1, 0, 3, 2)), G.rect_area(box(3, 0, 1, 5)), G.person_box_from_face(box(40, 40, 60, 60), F.lit(200.0), F.lit(200.0)), G.person_box_from_face(box(0, 0, 1, 1), F.lit(200.0), F.lit(200.0)))
    assert math.isclose(r[0], 1 / 3) and r[1] == 0 and r[2].y1 == 35 and r[3] is None


def test_text_rules(spark):
    lit = F.lit
    r = one(
        spark,
        T.language_name(lit("ZH")), T.language_name(lit("auto")), T.language_name(lit("french")), T.mode_name(lit("x")), T.plain_number(lit(2.0)), T.plain_number(lit(2.5)), T.rate(lit("30000/1001")), T.rate(lit("bad")), T.rate(lit("1/0")),
        T.srt_time(lit(3661.0015)), T.safe_stem(lit("/a/b:c.mp4")), T.safe_stem(lit("/a/")), T.safe_speaker(lit(None).cast("string")), T.subtitle_name(lit("x.MP4"), lit("s")), T.subtitle_name(lit(None).cast("string"), lit("s")), T.data_uri(lit(b"ab")), T.seconds_text(lit(2.345)),
    )
    assert list(r)[:6] == ["Chinese", None, "French", "storyboard", "2", "2.5"]
    assert math.isclose(r[6], 30000 / 1001) and r[7] == 0 and r[8] == 0
    assert list(r)[9:] == ["01:01:01,002", "b_c", "video", "unknown", "x.srt", "s.srt", "data:image/png;base64,YWI=", "2.34"]


def test_sentences_of_a_text_that_holds_the_mark(spark):
    m = "\ufdd0"
    texts = [f"One{m} two. Three{m}0{m}1 four!", f"{m}. {m}", f"a.{m} b.", m * 3, f"x{m}1. y{m}", "plain. text", ""]

    def plain(text):
        out, now, i = [], "", 0
        while i < len(text):
            now += text[i]
            ends = text[i] in T.SENTENCE_END + "\n" or (text[i] == "." and (i + 1 == len(text) or text[i + 1].isspace() or text[i + 1] in "\"'”’)]}】》"))
            i += 1
            if ends:
                while i < len(text) and text[i] in "\"'”’)]}】》":
                    now, i = now + text[i], i + 1
                out, now = [*out, now], ""
        return [s for s in [*out, now] if s.strip()]

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(T.sentences(F.col("t"))).collect()] == [plain(t) for t in texts]


@pytest.mark.parametrize("rate", [24.0, 25.0, 60.0])
def test_the_least_scene_length_follows_the_rate_of_the_stream(spark, rate):
    rng = np.random.default_rng(3)
    luma = np.repeat(rng.permutation(40) * 6.0, 16)  # a new level every 16 frames
    frames = spark.createDataFrame([(s, i, float(x), 50.0, 9.0) for s in ("a", "b") for i, x in enumerate(luma)], "stream string, frame_index long, luma_mean double, luma_std double, sharpness double")
    streams = spark.createDataFrame([("a", len(luma), rate), ("b", len(luma), None)], "stream string, total long, fps double")
    out = stages.run({"frames": frames, "streams": streams}, {"persons": {"enabled": False}})["cuts"].collect()
    for r in out:
        fps = rate if r.stream == "a" else 25.0
        gaps = np.diff(r.cuts[:-1])
        least = max(1, round(0.5 * fps))
        assert len(gaps) > 5 and gaps.min() >= least and gaps.min() < least + 16
    cuts = {r.stream: r.cuts for r in SG.cut_list(frames, streams.where("stream = 'a'")).collect()}
    assert cuts == {"a": next(r.cuts for r in out if r.stream == "a"), "b": next(r.cuts for r in SG.cut_list(frames, 25.0).collect() if r.stream == "b")}


def test_stems_of_folders_take_the_last_of_either_kind(spark):
    kinds = {"a_(Vocals).wav": "vocals", "a_(No Vocals).wav": "instrumental", "a_no_vocals.wav": "instrumental", "Inst.wav": "instrumental", "my_instrumental.wav": "instrumental", "x_(No Reverb).wav": "vocals", "x_no_reverb": "vocals", "x_(Reverb)": "instrumental", "novel_vocals": None, "drums": None, "": None}
    df = spark.createDataFrame(list(kinds.items()), "n string, k string")
    assert [r.n for r in df.where(~T.stem_kind(F.col("n")).eqNullSafe(F.col("k"))).collect()] == []
    files = [("a", 0, "vocals.wav"), ("a", 1, "inst.wav"), ("a", 2, "no_reverb.wav"), ("a", 9, "drums.wav"), ("b", 0, "reverb.wav"), ("b", 0, "instrument.wav"), ("c", 0, "x")]
    rows = MD.stems_of_folders(spark.createDataFrame(files, "folder string, position int, name string").repartition(3)).collect()
    assert {r.folder: (r.vocals, r.instrumental) for r in rows} == {"a": ("no_reverb.wav", "inst.wav"), "b": (None, "reverb.wav"), "c": (None, None)}


def test_natural_order(spark):
    names = ["clip10.mp4", "clip2.mp4", "Clip1.mp4"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.orderBy(T.natural_key(F.col("n"))).collect()] == ["Clip1.mp4", "clip2.mp4", "clip10.mp4"]


def test_wav_round_trip_and_errors(spark, tmp_path):
    x = np.array([0.0, 0.5, -0.5, 1.5], np.float32)
    (tmp_path / "a.wav").write_bytes(MD.wav_bytes(x, 8000))
    (tmp_path / "b.wav").write_bytes(b"no wave")
    rows = {r.path.rpartition("/")[2]: r for r in MD.read_wav(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert rows["a.wav"].sample_rate == 8000 and np.allclose(rows["a.wav"].samples, np.clip(x, -1, 1), atol=1e-4)
    assert rows["b.wav"].status == "error" and rows["b.wav"].samples is None
    df = spark.createDataFrame([([0.0, 0.25], 8000)], "x array<float>, sr int")
    assert df.select(MD.wav_column("x", "sr")).first()[0] == MD.wav_bytes([0.0, 0.25], 8000)


def test_listing_is_by_extension_in_any_case(spark, tmp_path):
    for n in ("v2.MP4", "v10.mp4", "n.txt"):
        (tmp_path / n).write_bytes(b"x")
    assert [r.stem for r in MD.list_media(spark, str(tmp_path)).orderBy("sort_key").collect()] == ["v2", "v10"]


def test_metadata_fills_in(spark):
    df = spark.createDataFrame([("a", "0/0", 50, 0.0), ("b", "10", 0, 2.0)], "stem string, rate string, frame_count long, duration_sec double")
    got = {r.stem: (r.fps, r.frame_count, r.duration_sec) for r in MD.completed_metadata(df).collect()}
    assert got == {"a": (25.0, 50, 2.0), "b": (10.0, 20, 2.0)}


def test_gray_measures():
    g = np.array([[0, 0, 0], [0, 9, 0], [0, 0, 0]], np.uint8)
    mean, std, sharp = MD.gray_measures(g)
    lap = np.array([[0, 18, 0], [18, -36, 18], [0, 18, 0]], float)
    assert mean == 1 and math.isclose(std, g.std()) and math.isclose(sharp, lap.var())
    assert MD.shrunk(np.full((4, 8), 7, np.uint8), 4).tolist() == [[7] * 4] * 2


def test_frame_measures_column(spark):
    image = (2, 2, 3, bytes([10] * 12))
    df = spark.createDataFrame([(image,)], "image struct<height:int,width:int,channels:int,data:binary>")
    assert df.select(MD.frame_measures().alias("m")).first().m.asDict() == {"luma_mean": 10.0, "luma_std": 0.0, "sharpness": 0.0}


def test_provider_is_made_in_the_worker(spark):
    class Twice:
        def rows(self, batch):
            return pd.DataFrame({"id": batch.id * 2})

    assert sorted(r.id for r in MD.provided(spark.range(3), Twice, "id long").collect()) == [0, 2, 4]


def test_manifests(spark, tmp_path):
    assert MF.parse_selection("1, 5-3") == [(1, 1), (3, 5)]
    ok = spark.createDataFrame([(1, "ok"), (2, "invalid")], "i int, status string")
    assert [r.i for r in MF.describable(ok).collect()] == [1]
    assert MF.describable(ok.where("i = 2")).count() == 1 and MF.describable(ok.where("i = 3")).count() == 0
    assert [r.i for r in MF.first_items(ok, 1, "i").collect()] == [1]
    MF.write_documents(ok, str(tmp_path / "j"), "i")
    assert MF.read_documents(spark, str(tmp_path / "j"), "status string, i int").count() == 2
    MF.write_texts(ok, str(tmp_path / "t"), "i", "status")
    MF.write_debug_csv(ok.withColumn("x", F.lit(1 / 3)), str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first().x == "0.333333"
    odd = spark.createDataFrame([(1, 0.25, 2.0, True), (2, None, float("nan"), None)], "i int, x double, y double, b boolean")
    assert [tuple(r) for r in MF.debug_lines(odd, {"x": "%.4f", "i": "%03d"}).orderBy("i").collect()] == [("001", "0.2500", "2.000000", 1), ("002", None, None, None)]


def test_templates_fall_back_and_modes_default(spark, tmp_path):
    files = {"storyboard": "a.md", "frames": "b.md"}
    assert {tuple(r) for r in MF.templates(spark, str(tmp_path / "none"), files, " x ").collect()} == {("storyboard", "x"), ("frames", "x")}
    (tmp_path / "a.md").write_text("\n 一 {fps}\n\nend\u3000\n")
    (tmp_path / "c.md").write_text("other")
    got = MF.templates(spark, str(tmp_path), files, "none")
    assert {tuple(r) for r in got.collect()} == {("storyboard", "一 {fps}\n\nend"), ("frames", "none")}
    shots = spark.createDataFrame([(1, " Frames "), (2, None), (3, "other"), (4, "storyboard")], "i int, mode string")
    assert {r.i: r.template for r in MF.prompted(shots, got).collect()} == {1: "none", 2: "一 {fps}\n\nend", 3: "一 {fps}\n\nend", 4: "一 {fps}\n\nend"}


def test_config(tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"asr": {"language": "en"}}))
    got = config.load(str(p))
    assert got["asr"]["language"] == "en" and got["asr"]["merge_gap_sec"] == 0.8
    p.write_text("{")
    assert config.load(str(p)) == config.DEFAULTS and config.load() is not config.DEFAULTS


def test_suppression_and_association_by_stream(spark):
    df = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 10.0, 10.0, 0.9, 5), (1, 0, 1, 1.0, 0.0, 10.0, 10.0, 0.5, None), (1, 1, 0, 1.0, 0.0, 11.0, 10.0, 0.5, None)], "stream int, frame_index long, det_no int, x1 double, y1 double, x2 double, y2 double, conf double, track_id long")
    kept = ID.suppressed(df)
    assert kept.count() == 2
    assert [r.track_id for r in ID.associated(kept, 100.0).orderBy("frame_index").collect()] == [5, 5]


def test_stage_graph(spark):
    frames = A.frames(spark, SF)
    streams = frames.groupBy("stream").agg(F.count("*").alias("total"), F.lit(25.0).alias("fps"), F.array().cast("array<long>").alias("cuts"))
    made = []

    def materialize(name, df):
        made.append(name)
        return df

    out = stages.run({"frames": frames, "streams": streams}, {"persons": {"enabled": False}}, materialize)
    assert made == ["cuts", "segments", "quality", "ranges", "storyboard"]
    assert out["storyboard"].groupBy("stream").count().where("count <> 9").count() == 0
    assert out["segments"].where("not below_min and (duration_sec > 15.000001 or duration_sec < 0.999999)").count() == 0


def test_cumulative_transform_is_the_ordered_product(spark):
    from shotlake.operators import motion as M

    rng = np.random.default_rng(15)
    rows = [(s, n, bool(rng.random() < 0.7), rng.normal(size=6).tolist()) for s in (1, 2) for n in range(8)]
    df = spark.createDataFrame(rows, "stream int, pair_no long, usable boolean, affine array<double>").repartition(3)
    got = {(r.stream, r.pair_no): r for r in M.cumulative_transform(df, 640.0, 360.0).collect()}
    for s in (1, 2):
        total = np.eye(3)
        for _, n, usable, m in (r for r in rows if r[0] == s):
            if usable:
                total = np.vstack([np.reshape(m, (2, 3)), [0, 0, 1]]) @ total
            r, moved = got[s, n], total @ [320, 180, 1] - [320, 180, 1]
            assert np.allclose([r.cum_scale, r.cum_rotation_deg, r.cum_tx, r.cum_ty], [np.hypot(total[0, 0], total[1, 0]), np.degrees(np.arctan2(total[1, 0], total[0, 0])), *moved[:2]])


def test_owners_equal_all_pairs_without_making_them(spark):
    rng = np.random.default_rng(16)
    faces = [(int(rng.integers(3)), i, float(x), float(y)) for i, (x, y) in enumerate(rng.integers(-60, 60, (300, 2)) / 2)] + [(0, 300, None, 1.0), (9, 301, 0.0, 0.0), (None, 302, 0.0, 0.0)]
    boxes = [(int(rng.integers(3)), i, float(x), float(y), float(x + w), float(y + h)) for i, (x, y, w, h) in enumerate(zip(*rng.integers(-40, 30, (2, 300)), *np.floor(2 ** rng.uniform(-2, 6, (2, 300))), strict=True))]
    boxes += [(0, 300, 5.0, 5.0, -5.0, -5.0), (1, 301, -1e300, -1e300, 1e300, 1e300), (2, 302, None, 0.0, 9.0, 9.0), (0, 303, -1e-30, -1e-30, 1.0, 1.0)]
    f = spark.createDataFrame(faces, "frame int, face_no long, x double, y double")
    b = spark.createDataFrame(boxes, "frame int, box_no long, x1 double, y1 double, x2 double, y2 double")
    want = {}
    for frame, n, x, y in faces:
        hits = [((x2 - x1) * (y2 - y1), k) for g, k, x1, y1, x2, y2 in boxes if g == frame and None not in (x, x1) and x1 <= x <= x2 and y1 <= y <= y2]
        if hits:
            want[frame, n] = min(hits)[1]
    assert {(r.frame, r.face_no): r.box_no for r in ID.owners(f, b, ["frame"]).collect()} == want and len(want) > 100


def test_face_owners_read_the_whole_table(spark, tmp_path):
    rows = [("b", k, 5 + k % 40) for k in range(1990, 2300)]
    spark.createDataFrame(rows, "p_brand string, p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    from shotlake.plans import identity_queries

    boxes = [(k * 11 % 80, k * 7 % 80, 5 + s, k) for _, k, s in rows if k % 2]
    want = {k: min(hits)[1] for _, k, _ in rows if k % 2 == 0 if (hits := [(s * s, n) for x, y, s, n in boxes if x <= k * 37 % 100 <= x + s and y <= k * 53 % 100 <= y + s])}
    assert {r.face_no: r.box_no for r in identity_queries.face_owner_containment(spark, str(tmp_path)).collect()} == want and max(want) > 2000
