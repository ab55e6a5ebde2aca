"""Files on disk as a sink: one document for each row, committed as a whole, and the documents of transcripts.

Data source "documents": rows (path string, content binary).  A task writes its
documents into a folder of its own attempt under <root>/_writing-<run>/ and at
the end a list of them.  When all tasks are done, the driver has the listed ones renamed to
<root>/<path>, a task's list at a time; what lost or repeated attempts have
written is never listed in a commit message, and goes with the folder.  An aborted
run leaves no document; a task that outlives it may leave its folder, which tidied() removes.
Rows that name the same path are an error before anything is renamed, in one task or in several.

With replace=true, a first folder of paths (a source, say) that the run writes
into is replaced whole: what was there moves to <root>/_gone-<run>/ first, and
that is deleted after the commit, so a run that is cut short loses no bytes, and
tidied() puts back what it had not yet replaced.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from shotlake.functions import text as T
from shotlake.operators import intervals as IV

SCHEMA = "path string, content binary"
THREADS = 32


def _open(uri: str):
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri.removeprefix("file:"))


def checked(path: str | None) -> str:
    """path, if it is a relative one below the root that hides nothing."""
    parts = (path or "").split("/")
    if not all(parts) or any(p in (".", "..") for p in parts) or parts[0].startswith("_") or "\\" in path or "\0" in path:
        raise ValueError(f"not a path for a document: {path!r}")
    return path


@dataclass
class Written(WriterCommitMessage):
    folder: str  # of the attempt
    documents: int


class DocumentsWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.root, self.replace = options["path"].rstrip("/"), options.get("replace", "false").lower() == "true"
        self.run = uuid.uuid4().hex

    def write(self, iterator):
        folder = f"_writing-{self.run}/{uuid.uuid4().hex}"
        fs, root = _open(self.root)
        fs.create_dir(f"{root}/{folder}", recursive=True)
        names = []
        for batch in iterator:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                with fs.open_output_stream(f"{root}/{folder}/{len(names)}", compression=None) as out:
                    out.write(content.as_buffer() if content.is_valid else b"")
                names.append(checked(path))
        with fs.open_output_stream(f"{root}/{folder}/names", compression=None) as out:
            out.write("\n".join(map(json.dumps, names)).encode())
        return Written(folder, len(names))

    def _names(self, fs, root: str, folder: str) -> list[str]:
        with fs.open_input_file(f"{root}/{folder}/names") as file:
            return [json.loads(x) for x in file.read().decode().split("\n") if x]

    def commit(self, messages):
        fs, root = _open(self.root)
        folders = [m.folder for m in messages if m is not None and m.documents]
        with ThreadPoolExecutor(THREADS) as pool:
            seen, tops = set(), set()
            for names in pool.map(lambda f: self._names(fs, root, f), folders):
                for name in names:
                    mark = hashlib.blake2b(name.encode(), digest_size=12).digest()  # so many bytes for each document of the run
                    if mark in seen:
                        self._remove(fs, root, "_writing")
                        raise ValueError(f"two documents for {name}")
                    seen.add(mark)
                tops.update(n.split("/", 1)[0] for n in names)
            if self.replace:
                fs.create_dir(f"{root}/_gone-{self.run}", recursive=True)
                list(pool.map(lambda top: self._away(fs, root, top), tops))

            def placed(folder):
                for i, name in enumerate(self._names(fs, root, folder)):
                    fs.create_dir(os.path.dirname(f"{root}/{name}"), recursive=True)
                    fs.move(f"{root}/{folder}/{i}", f"{root}/{name}")

            list(pool.map(placed, folders))
        self._remove(fs, root, "_writing")
        self._remove(fs, root, "_gone")

    def _away(self, fs, root: str, top: str) -> None:
        if fs.get_file_info(f"{root}/{top}").type != pafs.FileType.NotFound:
            fs.move(f"{root}/{top}", f"{root}/_gone-{self.run}/{top}")

    def _remove(self, fs, root: str, what: str) -> None:
        at = f"{root}/{what}-{self.run}"
        if fs.get_file_info(at).type == pafs.FileType.Directory:
            fs.delete_dir(at)

    def abort(self, messages):
        fs, root = _open(self.root)
        self._remove(fs, root, "_writing")


class Documents(DataSource):
    @classmethod
    def name(cls):
        return "documents"

    def schema(self):
        return SCHEMA

    def writer(self, schema, overwrite):
        return DocumentsWriter(self.options)


def write_files(df: DataFrame, root: str, replace: bool = False) -> None:
    """The rows (path, content) as files below root; replace gives up what the folders of the first level held before."""
    spark = df.sparkSession
    spark.dataSource.register(Documents)
    rows = df.select("path", F.col("content").cast("binary").alias("content"))
    rows.write.format("documents").mode("append").option("path", root).option("replace", str(replace).lower()).save()


def tidied(root: str) -> None:
    """Removes what runs that were cut short have left below root, and puts back folders that they took away and did not replace.  No run may be going on."""
    fs, at = _open(root.rstrip("/"))
    for info in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True)):
        if info.base_name.startswith("_gone-"):
            for old in fs.get_file_info(pafs.FileSelector(info.path)):
                if fs.get_file_info(f"{at}/{old.base_name}").type == pafs.FileType.NotFound:
                    fs.move(old.path, f"{at}/{old.base_name}")
        if info.base_name.startswith(("_gone-", "_writing-")):
            fs.delete_dir(info.path)


def delete_files(df: DataFrame, root: str) -> DataFrame:
    """(path, existed) for each of df's paths, which are deleted below root when the result is evaluated; to be done once all who read them are through.

    A path that is not there is no error, so a task that runs twice does no harm
    but that it may then say false.
    """

    def run(batches):
        fs, at = _open(root.rstrip("/"))
        for batch in batches:
            paths = [checked(p) for p in batch.column(0).to_pylist()]
            found = [x.type == pafs.FileType.File for x in fs.get_file_info([f"{at}/{p}" for p in paths])]
            for path, there in zip(paths, found, strict=True):
                if there:
                    try:
                        fs.delete_file(f"{at}/{path}")
                    except FileNotFoundError:
                        pass
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(found, pa.bool_())], ["path", "existed"])

    return df.select("path").distinct().mapInArrow(run, "path string, existed boolean")


def read_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, content) of the committed files below root whose name fits pattern; what begins with _ or a dot is not looked at, and Spark's file scan passes over empty files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    top = "file:" + os.path.abspath(root.removeprefix("file://").removeprefix("file:")) if "://" not in root or root.startswith("file:") else root
    below = F.substring("path", len(top.rstrip("/")) + 2, 1 << 20)
    return files.select(below.alias("path"), "content").where(~F.col("path").rlike(r"(^|/)[_.]"))


def _srt(rows: Column) -> Column:
    """Subtitle blocks of an array of structs (start_sec, end_sec, speaker, text), numbered from 1, a blank line between."""
    return F.concat_ws("\n", F.transform(rows, lambda s, i: T.srt_block(i + 1, s["start_sec"], s["end_sec"], s["speaker"], s["text"])))


SEGMENT = ("index", "start_sec", "end_sec", "speaker", "text")


def transcript_documents(sources: DataFrame, segments: DataFrame) -> DataFrame:
    """(path, content): for each of sources (stream, file, duration_sec) its transcript.json and its subtitles <stream>.srt.

    segments has (stream, index, start_sec, end_sec, speaker, text).  A source
    without any has an empty list and empty subtitles.  Segments are in order of index, speakers distinct and sorted.
    """
    said = segments.groupBy("stream").agg(F.array_sort(F.collect_list(F.struct(*SEGMENT))).alias("segments"), F.sort_array(F.collect_set(F.nullif(F.col("speaker"), F.lit("")))).alias("speakers"))
    none = lambda c: F.slice(F.array(*c), 1, 0)
    rows = sources.join(said, "stream", "left").withColumn("speakers", F.coalesce("speakers", none([F.lit("")])))
    rows = rows.withColumn("segments", F.coalesce("segments", F.array().cast(said.schema["segments"].dataType)))
    document = F.to_json(F.struct(F.lit("1.0").alias("schema_version"), F.struct("file", F.round("duration_sec", 3).alias("duration_sec")).alias("source"), F.size("speakers").alias("speaker_count"), "speakers", "segments"), {"ignoreNullFields": "false"})
    stem = T.safe_stem(F.col("file"))
    files = F.array(F.struct(F.concat_ws("/", stem, F.lit("transcript.json")).alias("path"), document.alias("content")), F.struct(F.concat_ws("/", stem, F.concat(stem, F.lit(".srt"))).alias("path"), _srt(F.col("segments")).alias("content")))
    return rows.select(F.explode(files).alias("f")).select("f.path", F.col("f.content").cast("binary").alias("content"))


def shot_documents(sources: DataFrame, shots: DataFrame, segments: DataFrame) -> DataFrame:
    """(path, content): for each of shots (stream, shot_index, shot_id, file, start_sec, end_sec) its asr.json and its subtitles.

    A segment is in the shot that it overlaps most.  Its times in the document
    are the source's, in the subtitles those from the shot's start, cut to the shot; empty ones go.
    """
    placed = IV.assigned_by_overlap(segments, shots, "stream", "index").select("stream", "index", "shot_index")
    own = segments.join(placed, ["stream", "index"]).groupBy("stream", "shot_index").agg(F.array_sort(F.collect_list(F.struct(*SEGMENT))).alias("segments"))
    rows = shots.join(own, ["stream", "shot_index"], "left").join(sources.select("stream", F.col("file").alias("source")), "stream")
    rows = rows.withColumn("segments", F.coalesce("segments", F.array().cast(own.schema["segments"].dataType)))
    start, end = F.col("start_sec"), F.col("end_sec")
    inside = F.filter(F.transform("segments", lambda s: F.struct(F.greatest(F.lit(0.0), s["start_sec"] - start).alias("start_sec"), (F.least(end, s["end_sec"]) - start).alias("end_sec"), s["speaker"].alias("speaker"), s["text"].alias("text"))), lambda s: s["end_sec"] > s["start_sec"])
    clean = F.transform("segments", lambda s: F.struct(*(s[c].alias(c) for c in SEGMENT[1:])))
    text = F.concat_ws("\n", F.filter(F.transform("segments", lambda s: s["text"]), lambda t: t != ""))
    document = F.to_json(F.struct(F.lit("1.0").alias("schema_version"), "source", "shot_id", F.round("start_sec", 3).alias("shot_start_sec"), F.round("end_sec", 3).alias("shot_end_sec"), text.alias("text"), clean.alias("segments")), {"ignoreNullFields": "false"})
    folder = F.concat_ws("/", T.safe_stem(F.col("source")), F.col("shot_id"))
    files = F.array(F.struct(F.concat_ws("/", folder, F.lit("asr.json")).alias("path"), document.alias("content")), F.struct(F.concat_ws("/", folder, T.subtitle_name(F.col("file"), F.col("shot_id"))).alias("path"), _srt(inside).alias("content")))
    return rows.select(F.explode(files).alias("f")).select("f.path", F.col("f.content").cast("binary").alias("content"))
