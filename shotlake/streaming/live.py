"""Operators over unbounded input: the best frame of event-time windows, and the speaker registry, as keyed state or as tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from shotlake.operators import frames as FR
from shotlake.operators.registry import Registry, resolve


def live_window_best(frames: DataFrame, width: str = "1 second", late: str = "10 seconds", rules: FR.QualityRules = FR.RULES) -> DataFrame:
    """(stream, window, frame_index, sharpness) per event-time window once the watermark passes it; frames need ts, and later ones are dropped.

    ts may be timestamp_ntz, which watermarks refuse, so it is cast (the session is in UTC).
    """
    seen = FR.flags(frames.withColumn("ts", F.col("ts").cast("timestamp")), rules).where("not is_black and not is_white and not is_low_info")
    best = seen.withWatermark("ts", late).groupBy("stream", F.window("ts", width)).agg(F.max_by(F.struct("frame_index", "sharpness"), F.struct("sharpness", -F.col("frame_index"))).alias("b"))
    return best.select("stream", F.col("window.start").alias("window_start"), "b.frame_index", "b.sharpness")


class _Speakers(StatefulProcessor):
    """A library's speakers, and what each (video, cluster) was taken for, as map state; a batch reads the speakers and writes those that it changes."""

    def __init__(self, cam_threshold: float, eres_threshold: float):
        self.thresholds = cam_threshold, eres_threshold

    def init(self, handle) -> None:
        self.speakers = handle.getMapState("speakers", "speaker_id string", "number long, cam array<double>, eres array<double>, samples long, videos array<string>")
        self.seen = handle.getMapState("seen", "video string, cluster long", "speaker_id string")

    def handleInputRows(self, key, rows, timers):
        pdf = pd.concat(list(rows)).sort_values("seq")
        numbered = sorted((value[0], name[0], value) for name, value in self.speakers.iterator()) if self.speakers.exists() else []
        registry = Registry(*self.thresholds)
        for _, name, (_, cam, eres, samples, videos) in numbered:
            registry.speakers[name] = {"cam": np.asarray(cam), "eres": None if eres is None else np.asarray(eres), "samples": samples, "videos": list(videos)}
        out, changed = [], set()
        for r in pdf.itertuples():
            at = None if pd.isna(r.cluster) or r.video is None else (r.video, int(r.cluster))
            if at is not None and self.seen.containsKey(at):
                out.append((key[0], r.seq, r.video, r.cluster, self.seen.getValue(at)[0]))
                continue
            name = registry.match(r.cam_emb, r.eres_emb, r.video)
            if name is not None:
                changed.add(name)
                if at is not None:
                    self.seen.updateValue(at, (name,))
            out.append((key[0], r.seq, r.video, r.cluster, name))
        number = {name: i for i, name in enumerate(registry.speakers)}
        for name in changed:
            s = registry.speakers[name]
            self.speakers.updateValue((name,), (number[name], [float(x) for x in s["cam"]], None if s["eres"] is None else [float(x) for x in s["eres"]], int(s["samples"]), list(s["videos"])))
        yield pd.DataFrame(out, columns=["library", "seq", "video", "cluster", "speaker_id"]).astype({"cluster": "Int64"})

    def close(self) -> None:
        pass


STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def live_registry(samples: DataFrame, cam_threshold: float = 0.30, eres_threshold: float = 0.55) -> DataFrame:
    """(library, seq, video, cluster, speaker_id) for each sample (library, seq, video, cluster, cam_emb, eres_emb) as it comes.

    A library is a registry of its own, and its state is keyed by it, so
    libraries go side by side; within one each decision depends on those before, by seq in a
    batch and by arrival between batches.  A (video, cluster) that was seen
    keeps its speaker.  Map state needs a store that can hold it, so
    spark.sql.streaming.stateStore.providerClass must be STORE.
    """
    keyed = samples.select(F.col("library").cast("string").alias("library"), F.col("seq").cast("long"), F.col("video").cast("string"), F.col("cluster").cast("long"), F.col("cam_emb").cast("array<double>"), F.col("eres_emb").cast("array<double>"))
    return keyed.groupBy("library").transformWithStateInPandas(_Speakers(cam_threshold, eres_threshold), "library string, seq long, video string, cluster long, speaker_id string", "Append", "None")


def live_resolved(samples: DataFrame, path: str, sink: str, cam_threshold: float = 0.30, eres_threshold: float = 0.55):
    """A stream writer that resolves each micro-batch by the registry under path and appends (seq, video, cluster, speaker_id) to sink, by batch.

    Speakers and what was seen are tables, not operator state, so they outlive
    the query and are shared with batch runs.  A batch that is given again
    replaces its own output and finds its samples seen.
    """

    def take(batch: DataFrame, number: int) -> None:
        resolve(batch, path, cam_threshold, eres_threshold).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return samples.writeStream.foreachBatch(take)
