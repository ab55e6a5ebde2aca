"""Raw videos and audio through providers and stages, from the source to the prompt."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from shotlake.functions import text as T
from shotlake.operators import frames as FR
from shotlake.operators import identity as ID
from shotlake.operators import intervals as IV
from shotlake.operators import transcript as TR
from shotlake.plans import stages
from shotlake.sources import media as M
from tests import providers as P
from shotlake.sources import raw


def scene(rng, n, level):
    """n frames of 24 x 32 with a bright block that moves, on a ground of some level."""
    out = (level + rng.integers(-25, 25, (n, 24, 32))).clip(0, 180).astype(np.uint8)
    for i in range(n):
        out[i, 4:14, 2 + i % 10 : 12 + i % 10] = 250
    return out


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng, at = np.random.default_rng(1), tmp_path_factory.mktemp("media")
    for name, levels in (("a", (40, 140, 60)), ("b", (90,))):
        frames = np.concatenate([scene(rng, 40, x) for x in levels])
        (at / f"{name}.rawv").write_bytes(raw.raw_video(frames, 10.0))
    (at / "c.rawv").write_bytes(raw.raw_video(rng.integers(0, 255, (5, 8, 6, 3)).astype(np.uint8), 25.0))
    t = np.arange(8000 * 6) / 8000
    tone = np.where((t % 3 > 0.5) & (t % 3 < 2.5), 0.3 * np.sin(2 * np.pi * np.where(t < 3, 200, 900) * t), 0)
    (at / "a.wav").write_bytes(M.wav_bytes(tone, 8000))
    (at / "b.wav").write_bytes(M.wav_bytes(np.zeros(8000), 8000))
    return str(at)


def test_frame_scan_reads_only_what_is_wanted(spark, folder):
    frames = raw.read_raw_frames(spark, folder, split=16 * 24 * 32)
    assert {(r.stream, r.n) for r in frames.groupBy("stream").agg(F.count("*").alias("n")).collect()} == {("a", 120), ("b", 40), ("c", 5)}
    some = frames.where("stream = 'a' and frame_index >= 30 and frame_index < 40")
    assert sorted(r.frame_index for r in some.collect()) == list(range(30, 40)) and some.rdd.getNumPartitions() == 8  # of one file
    assert "Filter (" not in some._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.frame_index for r in frames.where("stream in ('a', 'b') and frame_index in (0, 50, 119)").collect()) == [0, 0, 50, 119]
    assert frames.where("frame_index > 500").count() == 0
    r = frames.where("stream = 'c' and frame_index = 3").first()
    assert (r.height, r.width, r.channels, len(r.data), r.fps) == (8, 6, 3, 144, 25.0)
    small = raw.read_raw_frames(spark, folder, gray=True, long_side=16).where("stream = 'a'").first()
    assert (small.height, small.width, small.channels, len(small.data)) == (12, 16, 1, 192)


FILTERS = ["{c} = 3", "{c} <> 3", "not ({c} = 3)", "{c} in (1, 3)", "{c} in (1, null)", "{c} not in (1, 3)", "{c} not in (1, null)", "{c} is null", "{c} is not null", "{c} <=> 3", "not ({c} <=> 3)", "{c} <=> null", "{c} > 3", "{c} >= 3", "{c} < 3", "{c} <= 3", "not ({c} > 3)", "{c} > 1 and {c} <> 4", "{c} = 1 or {c} = 4", "{c} = null", "{c} between 2 and 4 and {c} not in (3)", "{c} in (3, 90, -1) and {c} > 3"]


def test_every_filter_on_raw_frames_gives_the_rows_of_the_filter_in_spark(spark, folder):
    whole = spark.createDataFrame(raw.read_raw_frames(spark, folder).drop("data").collect(), raw.SCHEMA.removesuffix(", data binary")).cache()
    texts = ["stream <> 'a'", "stream in ('a', null)", "stream not in ('a')", "stream like 'a%'", "not (stream like '%b')", "stream is null", "stream > 'a' and frame_index < 2", "fps = 25.0", "width <> 32"]
    for where in [f.format(c="frame_index") for f in FILTERS] + texts:
        got, want = (sorted(map(repr, df.where(where).collect())) for df in (raw.read_raw_frames(spark, folder, split=5000).drop("data"), whole))
        assert got == want, where


def test_cut_short_and_foreign_files_are_refused(spark, tmp_path):
    (tmp_path / "x.rawv").write_bytes(raw.raw_video(np.zeros((3, 4, 4), np.uint8), 25.0)[:-5])
    with pytest.raises(Exception, match="cut short"):
        raw.read_raw_frames(spark, str(tmp_path)).collect()
    (tmp_path / "x.rawv").write_bytes(b"no video")
    with pytest.raises(Exception, match="not a raw video"):
        raw.read_raw_frames(spark, str(tmp_path)).collect()


def test_providers_are_deterministic_and_take_odd_input():
    assert P.available({"here": ["json"], "gone": ["no_such_module_x"]}) == {"here": (True, []), "gone": (False, ["no_such_module_x"])}
    rng = np.random.default_rng(2)
    x = np.concatenate([np.zeros(4000), rng.normal(0, 0.2, 4000), np.zeros(8000)]).astype(np.float32)
    got = P.EnergyRegions().rows(pd.DataFrame({"stream": ["s", "empty", "none"], "sample_rate": [8000, 8000, None], "samples": [x, x[:0], None]}))
    assert got.stream.tolist() == ["s"] and abs(got.start_sec[0] - 0.5) < 0.03 and abs(got.end_sec[0] - 1.0) < 0.03
    stems = P.SmoothStems().rows(pd.DataFrame({"stream": ["s"], "samples": [x]}))
    assert np.allclose(stems.vocals[0] + stems.instrumental[0], x, atol=1e-6)
    prints = P.BandPrint().rows(pd.DataFrame({"stream": ["s"] * 3, "region_no": [0, 1, 2], "samples": [x, np.zeros(9000), None]}))
    assert abs(np.linalg.norm(prints.embedding[0]) - 1) < 1e-9 and prints.embedding[1] is None and prints.embedding[2] is None
    image = np.zeros((20, 30), np.uint8)
    image[2:8, 3:9], image[12:18, 20:29], image[0, 29] = 255, 220, 255
    frame = pd.DataFrame({"stream": ["s"], "frame_index": [0], "height": [20], "width": [30], "data": [image.tobytes()]})
    boxes = P.BrightBoxes().rows(frame)
    assert boxes[["x1", "y1", "x2", "y2"]].values.tolist() == [[20, 12, 29, 18], [3, 2, 9, 8]]
    assert np.array_equal(P.PatchPrint().rows(frame).embedding[0], P.PatchPrint().rows(frame).embedding[0])
    answer = P.SectionChat().rows(pd.DataFrame({"key": ["k"], "prompt": ["p"]})).answer[0]
    assert all(line in answer for line in T.SECTIONS)


def test_from_source_to_prompt(spark, folder):
    gray = raw.read_raw_frames(spark, folder, gray=True).where("stream in ('a', 'b')")
    image = F.struct("height", "width", "channels", "data")
    frames = gray.withColumn("image", image).select("stream", "frame_index", M.frame_measures("image").alias("m")).select("stream", "frame_index", "m.*").cache()
    streams = gray.groupBy("stream").agg(F.count("*").alias("total"), F.first("fps").alias("fps"))
    out = stages.run({"frames": frames, "streams": streams}, {"persons": {"enabled": False}, "segmentation": {"max_segment_sec": 8.0}})

    segments = out["segments"].orderBy("stream", "index").collect()
    by = {s: [r for r in segments if r.stream == s] for s in ("a", "b")}
    assert [(r.start_frame, r.end_frame) for r in by["a"]] == [(0, 40), (40, 80), (80, 120)] and {r.method for r in by["a"]} == {"pyscenedetect_adaptive"}
    for parts in by.values():  # no gap, no overlap, all of the stream, within the bounds
        assert parts[0].start_frame == 0 and all(x.end_frame == y.start_frame for x, y in zip(parts, parts[1:], strict=False))
        assert all(r.below_min or 1.0 <= r.duration_sec <= 8.0 for r in parts)
    off = stages.run({"frames": frames, "streams": streams}, {"segmentation": {"enabled": False}, "persons": {"enabled": False}})
    assert [(r.stream, r.method, r.end_frame) for r in off["segments"].orderBy("stream").collect()] == [("a", "none", 120), ("b", "none", 40)]

    cells = out["storyboard"].collect()
    assert {r.stream for r in cells} == {"a", "b"} and all(len({r.cell for r in cells if r.stream == s}) == 9 for s in "ab")
    wanted = out["storyboard"].select("stream", "frame_index")
    assert M.needed_frames(gray, wanted).count() == wanted.distinct().count()

    boxes = M.provided(gray, P.BrightBoxes, P.BrightBoxes.schema)
    assert boxes.groupBy("stream", "frame_index").count().count() == 160
    prints = M.provided(gray, P.PatchPrint, P.PatchPrint.schema)
    assert prints.where("size(embedding) = 16").count() == 160

    audio = M.read_wav(spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(folder)).select(F.regexp_extract("path", r"([^/]*)\.wav\z", 1).alias("stream"), "sample_rate", "samples")
    regions = M.provided(audio, P.EnergyRegions, P.EnergyRegions.schema).cache()
    assert [(r.stream, round(r.start_sec, 1), round(r.end_sec, 1)) for r in regions.orderBy("start_sec").collect()] == [("a", 0.5, 2.5), ("a", 3.5, 5.5)]
    said = TR.sentence_spans(M.provided(regions, P.PitchWords, P.PitchWords.schema))
    assert said.where("timed").count() == said.count() >= 2
    voices = M.provided(regions, P.BandPrint, P.BandPrint.schema)
    named = ID.greedy_clusters(voices.select("stream", F.col("region_no").alias("window_no"), "embedding"), 0.55)
    assert named.select("label").distinct().count() == 2

    shots = out["segments"].select("stream", F.col("index").alias("shot_index"), "start_sec", "end_sec")
    said = said.withColumn("index", F.row_number().over(Window.partitionBy("stream").orderBy("start_sec")))
    lines = IV.assigned_by_overlap(said.select("stream", "index", "start_sec", "end_sec"), shots, "stream", "index").join(said.select("stream", "index", "text"), ["stream", "index"])
    spoken = lines.groupBy("stream", "shot_index").agg(F.concat_ws(" ", F.sort_array(F.collect_list("text"))).alias("subtitles"))
    prompts = shots.join(spoken, ["stream", "shot_index"], "left").select(F.concat_ws("/", "stream", "shot_index").alias("key"), T.filled(F.lit("{{SECONDS}}s: {{SUBTITLES}}"), {"SECONDS": T.seconds_text(F.col("end_sec") - F.col("start_sec")), "SUBTITLES": F.coalesce("subtitles", F.lit("none"))}).alias("prompt"))
    answers = M.provided(prompts, P.SectionChat, P.SectionChat.schema).withColumn("clean", T.cleaned_output(F.col("answer"))).collect()
    assert len(answers) == len(segments) and all(r.clean for r in answers)
    assert spark.createDataFrame([(r.clean,) for r in answers], "t string").where(F.size(T.missing_sections(F.col("t"))) > 0).count() == 0
    assert FR.stream_status(out["quality"]).where("status = 'ok'").count() == 2
