"""Where the operators of this subpackage keep what they read more than once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.  Where it is unset, a new local one stands in, under a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        found = _own.setdefault(app, "") or "file://" + tempfile.mkdtemp(prefix="shotlake-")
        _own[app] = found
    return found.rstrip("/")


def modest_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lowers the rows of an Arrow batch, so that one of texts takes a few MB on either side of the worker's pipe."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def kept(df: DataFrame, what: str) -> DataFrame:
    """df, written to the shared folder and read again: lineage ends here and lost executors cost nothing.

    Shuffle files of the write are removed when it ends, as nothing reads them any more.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, what)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what kept() has written, once nothing reads it any more; other tables are left alone."""
    for df in tables:
        path = getattr(df, "kept_at", None)
        if path:
            sc = df.sparkSession.sparkContext
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI or path, for workers; Spark's own readers are used wherever rows will do."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "file:///" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def write_atomically(uri: str, chunks) -> int:
    """Writes chunks of bytes to a new name and renames it to uri at the end; bytes written."""
    fs, path = filesystem(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    at, n = f"{path}.{uuid.uuid4().hex}", 0
    with fs.open_output_stream(at, compression=None) as out:
        for chunk in chunks:
            out.write(chunk)
            n += len(chunk)
    fs.move(at, path)
    return n
