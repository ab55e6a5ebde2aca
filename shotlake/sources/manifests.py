"""Which sources are done, which items are chosen, and reading and writing documents."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotlake.functions import text as T
from shotlake.sources.outputs import exists


def unprocessed(sources: DataFrame, manifest: DataFrame, key: str = "stem") -> DataFrame:
    """sources without those whose manifest row says complete; a manifest row is written after all of a source's outputs."""
    return sources.join(manifest.where("status = 'complete'").select(key).distinct(), key, "left_anti")


def parse_selection(expression: str) -> list[tuple[int, int]]:
    """Ranges of a selection such as 1,3,5-8; reversed ranges are turned round."""
    out = []
    for part in filter(None, (x.strip() for x in expression.split(","))):
        m = re.fullmatch(r"(\d+)(?:\s*-\s*(\d+))?", part)
        if not m:
            raise ValueError(f"not a selection: {part}")
        a, b = int(m[1]), int(m[2] or m[1])
        out.append((min(a, b), max(a, b)))
    return out


def selected(df: DataFrame, position: str, expression: str) -> DataFrame:
    """Rows whose 1-based position the selection names; it becomes a predicate, so it reaches the scan."""
    test = F.lit(False)
    for a, b in parse_selection(expression):
        test = test | F.col(position).between(a, b)
    return df.where(test)


def chosen_items(items: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    return items.join(chosen.select(*keys).distinct(), keys, "left_semi")


def jobs_with_stems(jobs: DataFrame, stems: DataFrame, columns: list[str], key: str = "stem") -> DataFrame:
    """jobs with the columns of their separated stems and separated, false where there are none; every job stays."""
    return jobs.join(stems.withColumn("separated", F.lit(True)).select(key, *columns, "separated"), key, "left").withColumn("separated", F.coalesce("separated", F.lit(False)))


def describable(shots: DataFrame) -> DataFrame:
    """Shots that are not invalid; all of them if every one is."""
    any_ok = shots.agg(F.coalesce(F.max(F.col("status") != "invalid"), F.lit(False)).alias("_any"))
    return shots.crossJoin(F.broadcast(any_ok)).where((F.col("status") != "invalid") | ~F.col("_any")).drop("_any")


def first_items(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows overall; a top-n, not a full sort."""
    return df.orderBy(*order).limit(n)


def write_documents(df: DataFrame, path: str, key: str) -> None:
    """One JSON document a line for each row, in a folder for each key value."""
    df.write.mode("overwrite").partitionBy(key).json(path)


def write_texts(df: DataFrame, path: str, key: str, text: str) -> None:
    df.select(key, F.col(text).alias("value")).write.mode("overwrite").partitionBy(key).text(path)


def read_documents(spark, path: str, schema: str) -> DataFrame:
    """JSON documents; what does not parse is null, as is a missing field."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def debug_lines(df: DataFrame, patterns: dict[str, str] | None = None) -> DataFrame:
    """df with its doubles as text: six decimals, or as patterns says of a column (such as %.4f); booleans become 1 and 0.  Null and NaN stay empty."""
    patterns = patterns or {}

    def shown(name: str, kind: str):
        c = F.col(name)
        if kind == "boolean":
            c, kind = c.cast("int"), "int"
        if name in patterns or kind in ("double", "float"):
            return F.when(c.isNotNull() & ~F.isnan(c) if kind in ("double", "float") else c.isNotNull(), F.format_string(patterns.get(name, "%.6f"), c)).alias(name)
        return c.alias(name)

    return df.select(*(shown(c, t) for c, t in df.dtypes))


def write_debug_csv(df: DataFrame, path: str, patterns: dict[str, str] | None = None) -> None:
    """The columns as debug_lines shows them, with a header."""
    debug_lines(df, patterns).write.mode("overwrite").option("header", True).csv(path)


def templates(spark: SparkSession, folder: str, files: dict[str, str], fallback: str = "") -> DataFrame:
    """(mode, template) for each mode of files: the text of the file of that name in folder, or fallback where there is none, without blanks at the ends."""
    wanted = spark.createDataFrame([*files.items()], "mode string, name string")
    if exists(spark, folder):
        names = "{" + ",".join(sorted(set(files.values()))) + "}"
        read = spark.read.format("binaryFile").option("pathGlobFilter", names).load(folder)
        found = read.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("content").cast("string").alias("text"))
        wanted = wanted.join(found, "name", "left")
    else:
        wanted = wanted.withColumn("text", F.lit(None).cast("string"))
    return wanted.select("mode", F.regexp_replace(F.coalesce("text", F.lit(fallback)), r"(?U)^\s+|\s+$", "").alias("template"))


def prompted(shots: DataFrame, texts: DataFrame, mode: str = "mode") -> DataFrame:
    """shots with the template of their mode, where an unknown mode is the default one; texts has a row a mode, so it is broadcast."""
    named = texts.select(F.col("mode").alias("_mode"), "template")
    return shots.join(F.broadcast(named), T.mode_name(F.coalesce(F.col(mode), F.lit(""))) == F.col("_mode"), "left").drop("_mode")
