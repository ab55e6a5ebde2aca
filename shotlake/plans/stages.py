"""The stages from frames to prompts as one graph; each reads relations and gives one.

Branches that do not depend on each other (identity; speech) share only the
segments, so a scheduler may run them side by side.  A stage's output is written
by the caller (`materialize`), and its manifest row after it, so a run that is
cut short starts again at the first stage that is not complete.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from shotlake import config as C
from shotlake.operators import frames as FR
from shotlake.operators import identity as ID
from shotlake.operators import intervals as IV
from shotlake.operators import segments as SG
from shotlake.sources.outputs import Outputs

Relations = dict[str, DataFrame]


@dataclass(frozen=True)
class Stage:
    name: str
    needs: tuple[str, ...]
    make: Callable[[Relations, dict], DataFrame]
    enabled: Callable[[dict], bool] = lambda cfg: True


def _rules(cfg: dict) -> FR.QualityRules:
    q, t = cfg["frame_quality"], cfg["trim"]
    return FR.QualityRules(q["black_mean"], q["black_std"], q["white_mean"], q["white_std"], q["low_info_std"], invalid_share=t["invalid_black_ratio"], tolerance=t["trim_tolerance_frames"], min_valid=t["min_valid_frames"])


def _segments(r: Relations, cfg: dict) -> DataFrame:
    s = cfg["segmentation"]
    if not s["enabled"]:
        return SG.whole(r["streams"])
    cuts = r["cuts"]
    if s["long_shot_subdetect"] and "frames" in r:
        cuts = SG.subdetected(cuts, r["frames"], s["max_segment_sec"], s["long_shot_subdetect_sensitivity"], s["min_scene_len_sec"])
    return SG.built(cuts, s["min_segment_sec"], s["max_segment_sec"], s["max_split_iterations"])


def _cuts(r: Relations, cfg: dict) -> DataFrame:
    """The streams' own cuts, where they bring some, else those found in their frames."""
    s, streams = cfg["segmentation"], r["streams"]
    if "cuts" in streams.columns or "frames" not in r:
        return streams.select("stream", "total", "fps", "cuts")
    found = SG.cut_list(r["frames"], streams, s["sensitivity"], s["min_scene_len_sec"]).select("stream", "cuts")
    return streams.select("stream", "total", "fps").join(found, "stream", "left")


def _ranges(r: Relations, cfg: dict) -> DataFrame:
    return FR.valid_range(r["quality"], _rules(cfg)).join(r["streams"].select("stream", "fps"), "stream")


def _storyboard(r: Relations, cfg: dict) -> DataFrame:
    ref = cfg["reference"]
    return FR.storyboard(r["quality"], r["ranges"].where("status = 'ok'"), ref["grid_rows"] * ref["grid_cols"], ref["select_tolerance_ms"])


def _persons(r: Relations, cfg: dict) -> DataFrame:
    p = cfg["persons"]
    f, conflicts = ID.track_features(r["records"]), ID.conflict_pairs(r["records"])
    clusters = ID.clustered_tracks(f, ID.similar_pairs(f, conflicts, p["low"]), conflicts, p["high"])
    return r["records"].join(clusters, ["stream", "track_id"], "left").withColumnRenamed("cluster", "person")


STAGES = [
    Stage("cuts", ("streams",), _cuts, lambda cfg: cfg["segmentation"]["enabled"]),
    Stage("segments", ("streams",), _segments),
    Stage("quality", ("frames",), lambda r, cfg: FR.scored(r["frames"], _rules(cfg))),
    Stage("ranges", ("quality", "streams"), _ranges),
    Stage("storyboard", ("quality", "ranges"), _storyboard),
    Stage("shot_transcript", ("transcript", "segments"), lambda r, cfg: IV.assigned_by_overlap(r["transcript"], r["segments"].select("stream", F.col("index").alias("shot_index"), "start_sec", "end_sec"), "stream", "index")),
    Stage("persons", ("records",), _persons, lambda cfg: cfg["persons"]["enabled"]),
]


def run(relations: Relations, cfg: dict | None = None, materialize: Callable[[str, DataFrame], DataFrame] = lambda name, df: df, record: Callable[[str, float, int], None] | None = None) -> Relations:
    """relations and what the stages make of them; a stage whose inputs are not there, or that cfg turns off, is left out.

    record is told each stage's name, seconds and rows, once materialize, which
    has to write then, has done so; rows are counted while they are written.
    """
    cfg, out = C.merged(C.DEFAULTS, cfg or {}), dict(relations)
    for stage in STAGES:
        if stage.name not in out and stage.enabled(cfg) and all(n in out for n in stage.needs):
            began, made = time.monotonic(), stage.make(out, cfg)
            if record is None:
                out[stage.name] = materialize(stage.name, made)
                continue
            seen = Observation()
            out[stage.name] = materialize(stage.name, made.observe(seen, F.count("*").alias("rows")))
            record(stage.name, time.monotonic() - began, seen.get["rows"])
    return out


def written(path: str) -> Callable[[str, DataFrame], DataFrame]:
    """A materialize for run(): each stage's table below path, replaced as a whole and read back."""

    def materialize(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{path}/{name}")

    return materialize


def written_by_source(path: str, streams: DataFrame) -> Callable[[str, DataFrame], DataFrame]:
    """A materialize for run(): each stage's rows as the outputs of streams, below path; those of other streams stay as they are.

    What later stages read is what the table now has of streams.
    """

    def materialize(name: str, df: DataFrame) -> DataFrame:
        out = Outputs(df.sparkSession, f"{path}/{name}", df.schema)
        out.write(df, streams)
        return out.read().join(streams.select("stream").distinct(), "stream", "left_semi").select(*df.columns)

    return materialize


def stage_timing(spark: SparkSession, records: list[tuple[str, float, int]]) -> DataFrame:
    """(stage, seconds, calls, rows) of what run() has recorded, the longest first."""
    rows = spark.createDataFrame(records, "stage string, seconds double, rows long")
    return rows.groupBy("stage").agg(F.sum("seconds").alias("seconds"), F.count("*").alias("calls"), F.sum("rows").alias("rows")).orderBy(F.desc("seconds"), "stage")
