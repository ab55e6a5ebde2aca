"""Frames and audio that a table asks for, read by byte range; and what stages record of themselves."""

import io
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from shotlake.plans import stages
from shotlake.sources import documents as D
from shotlake.sources import raw
from shotlake.sources import slices as S
from shotlake.sources.media import gray_measures
from shotlake.sources.outputs import Outputs


class Counted(io.BytesIO):
    """A file that notes what is read of it, and fails when told to."""

    reads, fails = [], 0

    def read(self, n=-1):
        Counted.reads.append(n)
        if Counted.fails:
            Counted.fails -= 1
            raise OSError("lost")
        return super().read(n)


def test_near_ranges_are_read_in_one_go_and_once_more_if_that_fails():
    data = bytes(range(256)) * 400
    places = [(0, 10), (5, 30), (40, 50), (90_000, 90_010), (102_395, 102_500)]
    Counted.reads, Counted.fails = [], 1
    got = list(S.ranges_read(lambda: Counted(data), places, gap=100))
    assert got == [data[a:b] for a, b in places] and Counted.reads == [50, 50, 10, 105]
    Counted.fails = 2
    with pytest.raises(OSError):
        list(S.ranges_read(lambda: Counted(data), places[:1]))
    Counted.reads, Counted.fails = [], 0
    list(S.ranges_read(lambda: Counted(data), [(i * 100, i * 100 + 100) for i in range(100)], most=1000))
    assert Counted.reads == [1000] * 10


def test_frames_that_a_table_names(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(1)
    videos = {"a": rng.integers(0, 256, (300, 8, 6, 3), np.uint8), "b": rng.integers(0, 256, (5, 4, 4), np.uint8)}
    for name, frames in videos.items():
        (tmp_path / f"{name}.rawv").write_bytes(raw.raw_video(frames, 24.0))
    monkeypatch.setattr(S, "STRETCH", 100)
    wanted = spark.createDataFrame([("a", i) for i in (0, 1, 7, 150, 150, 299, 300, -1)] + [("b", 4), ("b", None), (None, 1)], "stream string, frame_index long").repartition(3)
    rows = S.frames_at(wanted, str(tmp_path)).collect()
    assert sorted((r.stream, r.frame_index) for r in rows) == [("a", 0), ("a", 1), ("a", 7), ("a", 150), ("a", 299), ("b", 4)]
    assert all(bytes(r.data) == videos[r.stream][r.frame_index].tobytes() and r.fps == 24.0 for r in rows)
    whole = {(r.stream, r.frame_index): bytes(r.data) for r in raw.read_raw_frames(spark, str(tmp_path), gray=True, long_side=4).collect()}
    small = S.frames_at(wanted, str(tmp_path), gray=True, long_side=4).collect()
    assert len(small) == 6 and all(bytes(r.data) == whole[r.stream, r.frame_index] for r in small)
    assert S.frames_at(wanted.where("false"), str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="missing"):
        S.frames_at(spark.createDataFrame([("missing", 1)], "stream string, frame_index long"), str(tmp_path)).count()


def wav(samples, rate, channels=1):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(samples.astype("<i2").tobytes())
    return out.getvalue()


def test_bytes_read_of_audio_follow_the_slices():
    samples = np.random.default_rng(2).integers(-30000, 30000, 2_000_000)
    data = wav(samples, 8000)
    Counted.reads, Counted.fails = [], 0
    layout = S.wav_layout(Counted(data))
    assert layout == {"rate": 8000, "channels": 1, "width": 2, "begin": 44, "bytes": 4_000_000} and sum(Counted.reads) < 100
    Counted.reads = []
    places = [(44 + 2 * i, 44 + 2 * i + 1600) for i in range(0, 2_000_000, 400_000)]
    list(S.ranges_read(lambda: Counted(data), places))
    assert sum(Counted.reads) == 5 * 1600


def test_slices_of_audio_equal_those_of_the_whole_file(spark, tmp_path):
    rng = np.random.default_rng(3)
    one, two = rng.integers(-30000, 30000, 40_000), rng.integers(-30000, 30000, (30_000, 2))
    (tmp_path / "one.wav").write_bytes(wav(one, 8000))
    odd = wav(two, 16_000, 2)
    (tmp_path / "two.wav").write_bytes(odd[:12] + b"LIST\x03\x00\x00\x00abc\x00" + odd[12:])  # another chunk first, of odd size
    (tmp_path / "bad.wav").write_bytes(b"no audio")
    spans = [("one.wav", 0.0, 1.0), ("one.wav", 4.9, 99.0), ("one.wav", 2.0, 1.0), ("one.wav", 0.00006249, 0.0002), ("one.wav", None, 0.5), ("one.wav", -1.0, 0.25), ("two.wav", 0.5, 0.75), ("two.wav", 0.5, 0.75), ("bad.wav", 0.0, 1.0), ("gone.wav", 0.0, 1.0)]
    wanted = spark.createDataFrame([(f, s, e, i) for i, (f, s, e) in enumerate(spans)], "file string, start_sec double, end_sec double, shot int").repartition(4)
    rows = {r.shot: r for r in S.audio_slices(wanted, str(tmp_path)).collect()}
    assert len(rows) == len(spans) and rows[8].content is None and "not a WAV" in rows[8].reason and rows[9].content is None and rows[9].reason
    for i, (file, start, end) in enumerate(spans[:8]):
        data, rate = (one, 8000) if file == "one.wav" else (two, 16_000)
        a, b = (min(max(round((t or 0.0) * rate), 0), len(data)) for t in (start, end))
        with wave.open(io.BytesIO(rows[i].content)) as w:
            assert (w.getframerate(), w.getnchannels(), w.getsampwidth()) == (rate, 1 if data.ndim == 1 else 2, 2)
            assert w.readframes(w.getnframes()) == data[a : max(a, b)].astype("<i2").tobytes()
    root = str(tmp_path / "out")
    cut = S.audio_slices(wanted.where("shot < 3"), str(tmp_path)).select(F.format_string("clip/%04d.wav", "shot").alias("path"), "content")
    D.write_files(cut, root)
    assert {r.path: bytes(r.content) for r in D.read_files(spark, root).collect()} == {f"clip/{i:04d}.wav": bytes(rows[i].content) for i in range(3)}


def test_stages_record_their_rows_and_seconds(spark, tmp_path):
    frames = spark.range(200).select((F.col("id") % 2).alias("stream"), F.floor(F.col("id") / 2).alias("frame_index"), (F.col("id") % 7 * 30.0).alias("luma_mean"), F.lit(50.0).alias("luma_std"), (F.col("id") % 11).cast("double").alias("sharpness"))
    streams = spark.createDataFrame([(0, 100, 25.0), (1, 100, 25.0)], "stream long, total long, fps double")
    records = []
    relations = {"frames": frames, "streams": streams}
    out = stages.run(relations, {"persons": {"enabled": False}}, stages.written(str(tmp_path)), lambda *r: records.append(r))
    assert [r[0] for r in records] == ["cuts", "segments", "quality", "ranges", "storyboard"]
    assert {name: rows for name, _, rows in records} == {name: out[name].count() for name in (r[0] for r in records)} and records[2][2] == 200
    stages.run(relations, {"persons": {"enabled": False}}, stages.written(str(tmp_path)), lambda *r: records.append(r))
    timing = stages.stage_timing(spark, records).collect()
    assert {r.stage: (r.calls, r.rows) for r in timing}["quality"] == (2, 400) and [r.seconds for r in timing] == sorted((r.seconds for r in timing), reverse=True)


def test_stages_run_again_for_some_streams_leave_the_others(spark, tmp_path):
    frames = spark.range(300).select((F.col("id") % 3).alias("stream"), F.floor(F.col("id") / 3).alias("frame_index"), (F.col("id") % 7 * 30.0).alias("luma_mean"), F.lit(50.0).alias("luma_std"), (F.col("id") % 11).cast("double").alias("sharpness"))
    streams = spark.createDataFrame([(i, 100, 25.0) for i in range(3)], "stream long, total long, fps double")
    cfg, root = {"persons": {"enabled": False}}, str(tmp_path)
    first = stages.run({"frames": frames, "streams": streams}, cfg, stages.written_by_source(root, streams))
    whole = {n: sorted(map(tuple, first[n].collect())) for n in ("quality", "storyboard")}
    some = streams.where("stream = 1")
    darker = frames.where("stream = 1").withColumn("luma_mean", F.col("luma_mean") / 2)
    again = stages.run({"frames": darker, "streams": some}, cfg, stages.written_by_source(root, some))
    for name, old in whole.items():
        now = sorted(map(tuple, Outputs(spark, f"{root}/{name}", first[name].schema).read().collect()))
        of = first[name].columns.index("stream")
        assert [r for r in now if r[of] != 1] == [r for r in old if r[of] != 1]
        assert sorted(map(tuple, again[name].collect())) == [r for r in now if r[of] == 1]


def test_headers_are_probed(spark, tmp_path):
    (tmp_path / "a.rawv").write_bytes(raw.raw_video(np.zeros((50, 8, 6, 3), np.uint8), 25.0))
    with wave.open(str(tmp_path / "b.wav"), "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(8000), w.writeframes(b"\0" * 4 * 12_000)
    (tmp_path / "c.rawv").write_bytes(b"other")
    files = spark.createDataFrame([("a.rawv", 1), ("b.wav", 2), ("c.rawv", 3), ("none.wav", 4), (None, 5)], "file string, fps int")
    got = {r.file: r for r in S.probed(files, str(tmp_path)).collect()}
    assert tuple(got["a.rawv"])[1:] == (6, 8, 3, 25.0, 50, None, 2.0, None)
    assert tuple(got["b.wav"])[1:] == (None, None, 2, None, None, 8000, 1.5, None)
    assert all(got[x].reason and got[x].duration_sec is None for x in ("c.rawv", "none.wav", None))


def test_the_sharpest_candidates_are_extracted(spark, tmp_path):
    rng = np.random.default_rng(5)
    video = np.stack([(128 + rng.integers(-1, 2, (12, 16, 3)) * (i * 7 % 11) * 5).astype(np.uint8) for i in range(48)])
    (tmp_path / "a.rawv").write_bytes(raw.raw_video(video, 24.0))
    shots = spark.createDataFrame([("a", 0, 24.0, 48, None, None), ("a", 1, 24.0, 48, 0.5, 0.75), ("a", 2, 24.0, 48, 3.0, None), ("a", 3, 0.0, 48, None, None)], "stream string, shot int, fps double, frames long, start_sec double, duration_sec double")

    def sharpness(i):
        return gray_measures(S.to_gray(video[i]))[2]

    def plain(start, length, rate, n):
        """Each slot by walking the frames."""
        inside = [i for i in range(48) if start - 1e-9 <= i / 24 < start + length - 1e-9]
        slots = []
        for k in range(int(length * rate * n + 0.5)):
            before = [i for i in inside if (i / 24 - start) * rate * n < k + 0.5 - 1e-9]
            slots.append((before or inside[:1])[-1])
        groups = [slots[i : i + n] for i in range(0, len(slots), n)]
        return [max(g, key=sharpness) for g in groups]

    for rate, n in ((2, 3), (5, 2), (1, 1)):
        rows = S.extracted(shots, str(tmp_path), rate, n, key=("stream", "shot")).orderBy("shot", "name").collect()
        for shot, start, length in ((0, 0.0, 2.0), (1, 0.5, 0.75)):
            mine = [r for r in rows if r.shot == shot]
            assert [r.frame_index for r in mine] == plain(start, length, rate, n)
            assert [(r.name, r.time_sec) for r in mine] == [(f"frame_{i + 1:05d}.png", round(i / rate, 3)) for i in range(len(mine))]
            assert all(bytes(r.data) == video[r.frame_index].tobytes() for r in mine)
        assert {r.shot for r in rows} == {0, 1}
    few = S.extracted(shots, str(tmp_path), 2, 3, most=1, most_side=8, key=("stream", "shot")).collect()
    assert [(r.height, r.width) for r in few] == [(4, 4), (4, 4)]  # a frame of 8 x 4 holds 16 x 12 as 5 x 4, made even
