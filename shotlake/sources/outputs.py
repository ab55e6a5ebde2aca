"""Outputs of sources kept by run: a run can be made again for some sources, or drop them, without touching the others.

    <root>/rows/_run=<n>/    the rows of run n, as Parquet
    <root>/lists/_run=<n>/   the sources that run n has done: key, gone

A run writes its rows first and its list last, and counts once the list's job has
committed.  What a source has is the rows of the last run that lists it, or
nothing where that one says gone.  So a run that is cut short at any point
changes nothing, and nobody has to delete before writing.  compacted() rewrites
runs that hold rows of no use and deletes them after that.

One writer at a time for each root.  Rows whose key is null belong to no source
and are not kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

RUN = "_run"


def _folders(spark: SparkSession, path: str) -> dict[int, str]:
    """run -> folder of those below path, with whatever they hold."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(sc._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
    return {int(n.removeprefix(f"{RUN}=")): f"{path}/{n}" for n in names if n.startswith(f"{RUN}=")}


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at path."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(sc._jsc.hadoopConfiguration()).exists(at)


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


@dataclass
class Outputs:
    """The outputs below root: rows of schema, whose column key names their source."""

    spark: SparkSession
    root: str
    schema: StructType
    key: str = "stream"

    def __post_init__(self):
        self.root = self.root.rstrip("/")
        if RUN in self.schema.names or self.key not in self.schema.names:
            raise ValueError(f"rows need the column {self.key} and must not have {RUN}")

    def _committed(self) -> list[int]:
        return sorted(n for n, path in _folders(self.spark, f"{self.root}/lists").items() if exists(self.spark, f"{path}/_SUCCESS"))

    def _next(self) -> int:
        return 1 + max([0, *_folders(self.spark, f"{self.root}/lists"), *_folders(self.spark, f"{self.root}/rows")])

    def _read(self, what: str, runs: list[int], schema: StructType) -> DataFrame:
        """What runs hold, with _run."""
        there = _folders(self.spark, f"{self.root}/{what}")
        paths = [there[n] for n in runs if n in there]
        whole = StructType([*schema.fields]).add(RUN, "long")
        if not paths:
            return self.spark.createDataFrame([], whole)
        return self.spark.read.schema(whole).option("basePath", f"{self.root}/{what}").parquet(*paths)

    def _lists(self, runs: list[int]) -> DataFrame:
        return self._read("lists", runs, StructType([self.schema[self.key]]).add("gone", "boolean"))

    def _newest(self, runs: list[int]) -> DataFrame:
        """(key, _run, gone) of each source's last run."""
        return self._lists(runs).groupBy(self.key).agg(F.max(RUN).alias(RUN), F.max_by("gone", RUN).alias("gone"))

    def _dead(self, runs: list[int]) -> dict[int, float]:
        """run -> the share of its sources that it lists to no use, for those that have any; a row a run reaches the driver."""
        alive = self._newest(runs).where("not gone").select(self.key, RUN, F.lit(True).alias("alive"))
        shares = self._lists(runs).join(alive, [self.key, RUN], "left").groupBy(RUN).agg(F.avg(F.when(F.col("alive"), 0).otherwise(1)).alias("dead"))
        return {r[RUN]: r["dead"] for r in shares.where("dead > 0").collect()}

    def done(self) -> DataFrame:
        """(key) of each source that has outputs, were they no rows."""
        return self._newest(self._committed()).where("not gone").select(self.key)

    def pending(self, sources: DataFrame, overwrite: bool = False) -> DataFrame:
        """The sources to be run: those without outputs, or all with overwrite."""
        return sources if overwrite else sources.join(self.done(), self.key, "left_anti")

    def write(self, rows: DataFrame, sources: DataFrame | None = None) -> int:
        """rows as the outputs of sources, in place of any that they had; the number of the run.

        A source without rows has been done and has none; rows of other sources are left out.
        Without sources, they are those of rows.
        """
        rows, n = rows.select(*self.schema.names).where(F.col(self.key).isNotNull()), self._next()
        if sources is not None:
            rows = rows.join(sources.select(self.key).distinct(), self.key, "left_semi").select(*self.schema.names)
        rows.write.mode("errorifexists").parquet(f"{self.root}/rows/{RUN}={n}")
        listed = self._read("rows", [n], self.schema) if sources is None else sources
        self._list(listed.select(self.key, F.lit(False).alias("gone")), n)
        return n

    def drop(self, sources: DataFrame) -> int:
        """sources have no outputs any more; their rows stay on disk until compacted()."""
        n = self._next()
        self._list(sources.select(self.key, F.lit(True).alias("gone")), n)
        return n

    def _list(self, listed: DataFrame, n: int) -> None:
        listed.where(F.col(self.key).isNotNull()).distinct().write.mode("errorifexists").parquet(f"{self.root}/lists/{RUN}={n}")

    def read(self) -> DataFrame:
        """The rows that count.  Runs whose sources have not been run again since are scanned as they are; only the others meet the lists."""
        runs = self._committed()
        dead = self._dead(runs)
        whole = self._read("rows", [n for n in runs if n not in dead], self.schema)
        part = self._read("rows", [n for n in runs if n in dead], self.schema)
        out = part.join(self._newest(runs).where("not gone").select(self.key, RUN), [self.key, RUN], "left_semi") if dead else part
        return whole.select(*self.schema.names).unionByName(out.select(*self.schema.names))

    def compacted(self, least: float = 0.0) -> list[int]:
        """Rewrites the runs of which more than the share least is of no use as one new run, and deletes them; their numbers.

        The new run's list is committed before anything is deleted, and older
        runs go first, so what read() gives is the same before, after, and
        wherever this is cut short.  Folders of runs that never committed go too.
        """
        runs = self._committed()
        old = sorted(n for n, share in self._dead(runs).items() if share > least)
        if old:
            n, newest = self._next(), self._newest(runs).where(F.col(RUN).isin(old))
            alive = newest.where("not gone")
            # A source that is gone is named again where a run that stays lists it.
            gone = newest.where("gone").join(self._lists([r for r in runs if r not in old]), self.key, "left_semi")
            moved = self._read("rows", old, self.schema).join(alive.select(self.key, RUN), [self.key, RUN], "left_semi")
            moved.select(*self.schema.names).write.mode("errorifexists").parquet(f"{self.root}/rows/{RUN}={n}")
            self._list(alive.unionByName(gone).select(self.key, "gone"), n)
        committed = self._committed()
        for what in ("lists", "rows"):
            for n, path in sorted(_folders(self.spark, f"{self.root}/{what}").items()):
                if n not in committed:
                    _delete(self.spark, path)
        for n in old:
            _delete(self.spark, f"{self.root}/lists/{RUN}={n}")
            _delete(self.spark, f"{self.root}/rows/{RUN}={n}")
        return old
