"""Documents on disk: commits, aborts, replaced folders, and what transcripts and shots are written as."""

import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

from shotlake.sources import documents as D


def files(root, hidden=False):
    found = {os.path.relpath(os.path.join(d, n), root): open(os.path.join(d, n), "rb").read() for d, _, names in os.walk(root) for n in names}
    return {k: v for k, v in found.items() if hidden or not k.startswith("_")}


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "path string, content string").repartition(3)


def test_documents_are_written_read_back_and_replaced_by_folder(spark, tmp_path):
    root = str(tmp_path / "out")
    D.write_files(rows(spark, ("a/x.json", "1"), ("a/y/z.txt", "grüße"), ("b/x.json", None)), root)
    assert files(root) == {"a/x.json": b"1", "a/y/z.txt": "grüße".encode(), "b/x.json": b""}
    assert {(r.path, bytes(r.content)) for r in D.read_files(spark, root).collect()} == {x for x in files(root).items() if x[1]}
    assert [r.path for r in D.read_files(spark, root, "*.txt").collect()] == ["a/y/z.txt"]
    D.write_files(rows(spark, ("a/x.json", "2"), ("c/n", "3")), root)
    assert files(root)["a/x.json"] == b"2" and len(files(root)) == 4
    D.write_files(rows(spark, ("a/new", "4")), root, replace=True)
    assert files(root) == {"a/new": b"4", "b/x.json": b"", "c/n": b"3"}
    D.write_files(rows(spark, ("q", "r")).where("false"), root, replace=True)
    assert len(files(root)) == 3


@pytest.mark.parametrize("path", ["../x", "/x", "a//b", "_writing/x", "", None, "a/.", "a\\b"])
def test_paths_stay_below_the_root(spark, tmp_path, path):
    with pytest.raises(Exception, match="not a path"):
        D.write_files(rows(spark, (path, "1"), ("fine", "2")), str(tmp_path / "out"))
    assert files(str(tmp_path / "out")) == {}


def test_doubled_paths_and_failed_runs_leave_what_was_there(spark, tmp_path):
    root = str(tmp_path / "out")
    D.write_files(rows(spark, ("a/x", "1")), root)
    with pytest.raises(Exception, match="two documents"):
        D.write_files(rows(spark, ("a/x", "2"), ("b/y", "3"), ("a/x", "4")), root, replace=True)
    broken = rows(spark, *((f"n/{i}", "5") for i in range(50))).withColumn("content", F.when(F.col("path") == "n/31", F.raise_error(F.lit("stop"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="stop"):
        D.write_files(broken, root, replace=True)
    assert files(root) == {"a/x": b"1"}


def test_lost_and_repeated_attempts_leave_one_file(spark, tmp_path):
    root = str(tmp_path)
    writer = D.DocumentsWriter({"path": root})
    batch = spark.createDataFrame([("a/x", b"1"), ("b", b"2")], D.SCHEMA).toArrow().to_batches()
    lost, again = writer.write(iter(batch)), writer.write(iter(batch))
    half = D.DocumentsWriter({"path": root})
    half.run = writer.run

    def cut():
        yield batch[0]
        raise RuntimeError("executor lost")

    with pytest.raises(RuntimeError):
        half.write(cut())
    assert lost.folder != again.folder
    writer.commit([again, None])
    assert files(root) == {"a/x": b"1", "b": b"2"}
    assert issubclass(D.Documents, DataSource)


def test_a_replacement_that_is_cut_short_loses_no_bytes(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    D.write_files(rows(spark, ("a/x", "old")), root)
    writer = D.DocumentsWriter({"path": root, "replace": "true"})
    message = writer.write(iter(spark.createDataFrame([("a/x", b"new")], D.SCHEMA).toArrow().to_batches()))
    monkeypatch.setattr(D.os.path, "dirname", lambda p: (_ for _ in ()).throw(RuntimeError("driver lost")))
    with pytest.raises(RuntimeError):
        writer.commit([message])
    monkeypatch.undo()
    assert {b"old", b"new"} <= set(files(root, hidden=True).values())
    D.tidied(root)
    assert files(root, hidden=True) == {"a/x": b"old"}
    D.write_files(rows(spark, ("a/y", "newer")), root, replace=True)
    assert files(root, hidden=True) == {"a/y": b"newer"}


def test_transcripts_and_shots_as_documents(spark, tmp_path):
    root = str(tmp_path)
    sources = spark.createDataFrame([("s", "in/clip one.mp4", 9.87654), ("t", "silent.mov", None)], "stream string, file string, duration_sec double")
    said = [("s", 2, 3.0, 5.5, "bob", "two"), ("s", 1, 0.5, 2.0, "ann", "one"), ("s", 3, 5.0, 9.0, None, " three "), ("s", 4, 20.0, 21.0, "ann", "")]
    segments = spark.createDataFrame(said, "stream string, index int, start_sec double, end_sec double, speaker string, text string")
    shots = spark.createDataFrame([("s", 1, "shot_0001", "seg_0001.mp4", 0.0, 4.0), ("s", 2, "shot_0002", None, 4.0, 8.0), ("t", 1, "shot_0001", "seg_0001.mp4", 0.0, 1.0)], "stream string, shot_index int, shot_id string, file string, start_sec double, end_sec double")
    D.write_files(D.transcript_documents(sources, segments), root)
    D.write_files(D.shot_documents(sources, shots, segments), root)
    out = files(root)
    assert set(out) == {f"{s}/{n}" for s, names in {"clip one": ["transcript.json", "clip one.srt", "shot_0001/asr.json", "shot_0001/seg_0001.srt", "shot_0002/asr.json", "shot_0002/shot_0002.srt"], "silent": ["transcript.json", "silent.srt", "shot_0001/asr.json", "shot_0001/seg_0001.srt"]}.items() for n in names}
    whole = json.loads(out["clip one/transcript.json"])
    assert whole["schema_version"] == "1.0" and whole["source"] == {"file": "in/clip one.mp4", "duration_sec": 9.877}
    assert (whole["speaker_count"], whole["speakers"], [s["index"] for s in whole["segments"]], whole["segments"][2]["speaker"]) == (2, ["ann", "bob"], [1, 2, 3, 4], None)
    assert json.loads(out["silent/transcript.json"])["segments"] == [] and out["silent/silent.srt"] == b""
    assert out["clip one/clip one.srt"].decode().split("\n\n")[0] == "1\n00:00:00,500 --> 00:00:02,000\nann: one"
    shot = json.loads(out["clip one/shot_0002/asr.json"])
    assert (shot["shot_id"], shot["shot_start_sec"], shot["text"], [s["text"] for s in shot["segments"]]) == ("shot_0002", 4.0, "two\n three ", ["two", " three "])
    assert out["clip one/shot_0002/shot_0002.srt"].decode() == "1\n00:00:00,000 --> 00:00:01,500\nbob: two\n\n2\n00:00:01,000 --> 00:00:04,000\nunknown: three\n"
    assert json.loads(out["silent/shot_0001/asr.json"])["segments"] == []
    back = D.read_files(spark, root, "asr.json").select(F.from_json(F.col("content").cast("string"), "shot_id string, segments array<struct<text:string>>").alias("d")).select("d.shot_id", F.size("d.segments").alias("n"))
    assert sorted(map(tuple, back.collect())) == [("shot_0001", 0), ("shot_0001", 1), ("shot_0002", 2)]


def test_files_are_deleted_once_they_have_been_read(spark, tmp_path):
    root = str(tmp_path)
    D.write_files(rows(spark, ("a/x", "1"), ("a/y", "2"), ("b/x", "3")), root)
    gone = D.delete_files(spark.createDataFrame([("a/x",), ("a/x",), ("b/none",), ("b/x",)], "path string"), root)
    assert sorted(map(tuple, gone.collect())) == [("a/x", True), ("b/none", False), ("b/x", True)]
    assert files(root) == {"a/y": b"2"}
    with pytest.raises(Exception, match="not a path"):
        D.delete_files(spark.createDataFrame([("../x",)], "path string"), root).collect()
