"""Tracks, conflicts, similarity, order-dependent clustering, near-copy suppression and person tables.

What depends on an order of decisions is a fold over one stream at a time
(`applyInPandas`); everything else is DataFrame expressions keyed by stream.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotlake.functions import geometry as G
from shotlake.functions import vectors as V

LEVEL_NAMES = ["full_body", "upper_body", "torso", "chest", "head", "unknown"]


def track_features(records: DataFrame) -> DataFrame:
    """(stream, track_id, feature, best): the unit mean of embeddings of good faces, or of poor ones where there is none, and the best single one."""
    w = Window.partitionBy("stream", "track_id")
    have = records.where("embedding is not null").withColumn("_good", ~F.coalesce("face_low", F.lit(False)))
    main = have.withColumn("_any", F.max("_good").over(w)).where("_good = _any")
    best = main.groupBy("stream", "track_id").agg(F.max_by("embedding", F.struct((F.coalesce("face_score", F.lit(0.0)) * F.coalesce("face_size", F.lit(0.0))).alias("k"), (-F.col("record")).alias("r"))).alias("best"))
    means = main.select("stream", "track_id", F.posexplode(V.doubles("embedding")).alias("pos", "x")).groupBy("stream", "track_id", "pos").agg(F.avg("x").alias("x"))
    feature = means.groupBy("stream", "track_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("feature"))
    feature = feature.where(V.norm("feature") > 1e-9).withColumn("feature", V.normalized("feature"))
    return best.join(feature, ["stream", "track_id"], "left").select("stream", "track_id", "feature", "best")


def conflict_pairs(records: DataFrame) -> DataFrame:
    """(stream, a, b), a < b: tracks seen in one frame. Pairs are those of the few tracks of a frame."""
    seen = records.select("stream", "frame_index", "track_id").distinct()
    a, b = seen.withColumnRenamed("track_id", "a"), seen.withColumnRenamed("track_id", "b")
    return a.join(b, ["stream", "frame_index"]).where("a < b").select("stream", "a", "b").distinct()


TILE = 1000  # tracks of a stream that one task compares with as many others


def similar_pairs(features: DataFrame, conflicts: DataFrame, low: float) -> DataFrame:
    """(stream, a, b, similarity), a < b: tracks of one stream with a cosine of at least low and no conflict.

    A stream with many tracks is compared tile by tile, so no task has all of its pairs.
    """
    f = features.where("feature is not null").select("stream", "track_id", "feature")
    tiles = f.groupBy("stream").agg(F.ceil(F.count("*") / TILE).alias("_t"))
    f = f.join(tiles, "stream").withColumn("_own", F.pmod(F.xxhash64("track_id"), F.col("_t"))).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_t") - 1)))
    a = f.select("stream", F.col("_own").alias("_i"), F.col("_other").alias("_j"), F.col("track_id").alias("a"), F.col("feature").alias("_x"))
    b = f.select("stream", F.col("_other").alias("_i"), F.col("_own").alias("_j"), F.col("track_id").alias("b"), F.col("feature").alias("_y"))
    pairs = a.join(b, ["stream", "_i", "_j"]).where("a < b").select("stream", "a", "b", V.cosine("_x", "_y").alias("similarity")).where(F.col("similarity") >= low)
    return pairs.join(conflicts, ["stream", "a", "b"], "left_anti")


def fold_tracks(tracks: list[int], pairs: list[tuple[float, int, int, bool]], conflicts: set[tuple[int, int]], high: float) -> dict[int, int]:
    """Cluster number of each track. pairs: (similarity, a, b, whether the best faces agree), strongest first; clusters join unless two members conflict."""
    group = {t: [t] for t in tracks}
    where = {t: t for t in tracks}
    for similarity, a, b, faces in pairs:
        x, y = where[a], where[b]
        if x == y or not (similarity >= high or faces):
            continue
        if any((min(p, q), max(p, q)) in conflicts for p in group[x] for q in group[y]):
            continue
        for t in group[y]:
            where[t] = x
        group[x] += group.pop(y)
    return {t: i for i, members in enumerate(group.values()) for t in members}


def clustered_tracks(features: DataFrame, pairs: DataFrame, conflicts: DataFrame, high: float = 0.45) -> DataFrame:
    """(stream, track_id, cluster): agglomerative merging over similar pairs, strongest first, under conflicts."""
    best = features.select("stream", "track_id", "best")
    p = pairs.join(best.select("stream", F.col("track_id").alias("a"), F.col("best").alias("_x")), ["stream", "a"]).join(best.select("stream", F.col("track_id").alias("b"), F.col("best").alias("_y")), ["stream", "b"])
    p = p.select("stream", F.lit("pair").alias("kind"), "a", "b", "similarity", (F.col("_x").isNotNull() & F.col("_y").isNotNull() & (V.cosine("_x", "_y") >= high)).alias("faces"))
    nodes = features.where("feature is not null").select("stream", F.lit("track").alias("kind"), F.col("track_id").alias("a"))
    rows = p.unionByName(nodes, allowMissingColumns=True).unionByName(conflicts.select("stream", F.lit("conflict").alias("kind"), "a", "b"), allowMissingColumns=True)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kind = {k: g for k, g in pdf.groupby("kind")}
        tracks = sorted(kind["track"].a.tolist()) if "track" in kind else []
        pairs = sorted(((-s, a, int(b), bool(f)) for s, a, b, f in kind["pair"][["similarity", "a", "b", "faces"]].itertuples(index=False))) if "pair" in kind else []
        bans = {(a, int(b)) for a, b in kind["conflict"][["a", "b"]].itertuples(index=False)} if "conflict" in kind else set()
        out = fold_tracks(tracks, [(-s, a, b, f) for s, a, b, f in pairs], bans, high)
        return pd.DataFrame({"stream": pdf.stream.iloc[0], "track_id": list(out), "cluster": list(out.values())}, columns=["stream", "track_id", "cluster"])

    stream = dict(features.dtypes)["stream"]
    return rows.groupBy("stream").applyInPandas(run, f"stream {stream}, track_id long, cluster int")


def fold_greedy(vectors: list[np.ndarray], threshold: float) -> list[int]:
    """Cluster of each vector: the most similar centre if similar enough, else a new one; centres are unit means of unit members."""
    unit = lambda v: v / n if (n := np.linalg.norm(v)) > 1e-8 else v
    sums: list[np.ndarray] = []
    centres: list[np.ndarray] = []
    sizes: list[int] = []
    out = []
    for v in vectors:
        v = unit(np.asarray(v, np.float64))
        scores = np.stack(centres) @ v if centres else np.zeros(0)
        best = int(scores.argmax()) if len(scores) else -1
        if best >= 0 and scores[best] >= threshold:
            sums[best] = sums[best] + v
            sizes[best] += 1
            centres[best] = unit(sums[best] / sizes[best])
        else:
            best = len(centres)
            sums.append(v)
            sizes.append(1)
            centres.append(v)
        out.append(best)
    return out


def greedy_clusters(df: DataFrame, threshold: float = 0.55) -> DataFrame:
    """(stream, window_no, label): first come, first served by window_no; windows without an embedding take the label of the nearest that has one, 0 if none has."""
    from shotlake.operators.intervals import filled_by_nearest

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("window_no")
        labels = np.full(len(pdf), np.nan)
        have = pdf.embedding.notna().to_numpy()
        labels[have] = fold_greedy(pdf.embedding[have].tolist(), threshold)
        return pd.DataFrame({"stream": pdf.stream, "window_no": pdf.window_no, "label": pd.Series(labels, index=pdf.index).astype("Int64")})

    stream = dict(df.dtypes)["stream"]
    labels = df.select("stream", "window_no", "embedding").groupBy("stream").applyInPandas(run, f"stream {stream}, window_no long, label long")
    return filled_by_nearest(labels, "stream", "window_no", "label").withColumn("label", F.coalesce("label", F.lit(0)).cast("int"))


def fold_distinct(records: list[tuple], threshold: float, pixel_threshold: float) -> list[int]:
    """Places of the (embedding, thumb) records, best first, that are no near copy of one kept before."""
    kept: list[int] = []
    cos = lambda a, b: float(a @ b / s) if (s := np.linalg.norm(a) * np.linalg.norm(b)) > 1e-9 else 0.0
    for i, (e, t) in enumerate(records):
        def copy(j: int) -> bool:
            f, u = records[j]
            if e is not None and f is not None:
                return cos(e, f) > threshold
            return e is None and f is None and 1 - np.abs(t - u).mean() / 255 > pixel_threshold

        if not any(copy(j) for j in kept):
            kept.append(i)
    return kept


def distinct_records(df: DataFrame, threshold: float = 0.92, pixel_threshold: float = 0.995, most: int = 300) -> DataFrame:
    """(stream, person, record, rank) kept of records (stream, person, record, score, embedding, thumb): best first, near copies of better ones out, the first `most`."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "record"], ascending=[False, True])
        array = lambda x: None if x is None else np.asarray(x, np.float64)
        kept = fold_distinct([(array(e), array(t)) for e, t in zip(pdf.embedding, pdf.thumb, strict=True)], threshold, pixel_threshold)[:most]
        out = pdf.iloc[kept]
        return pd.DataFrame({"stream": out.stream, "person": out.person, "record": out.record, "rank": np.arange(1, len(out) + 1)})

    types = dict(df.dtypes)
    return df.select("stream", "person", "record", "score", "embedding", "thumb").groupBy("stream", "person").applyInPandas(run, f"stream {types['stream']}, person {types['person']}, record long, rank int")


def record_scores(df: DataFrame, group: list[str]) -> DataFrame:
    """df with score: sharpness over the group's largest, times confidence, times face score (none or 0 counts as 1)."""
    largest = F.max("sharpness").over(Window.partitionBy(*group))
    relative = F.when(largest > 0, F.greatest(F.lit(0.0), F.col("sharpness")) / largest).otherwise(F.lit(0.0))
    return df.withColumn("score", relative * F.col("conf") * F.coalesce(F.nullif("face_score", F.lit(0.0)), F.lit(1.0)))


def top_k(df: DataFrame, group: list[str], k: int = 300) -> DataFrame:
    """The k best rows of each group by score, the lower record on ties, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("score"), "record"))).where(F.col("rank") <= k)


def person_metadata(df: DataFrame) -> DataFrame:
    """One row for each (stream, person): counts, tracks, ranges, zero-filled level histogram, representative record, and an id by most images, then first frame."""
    area = G.rect_area(F.col("crop"))
    out = df.groupBy("stream", "person").agg(
        F.count("*").alias("num_images"),
        F.sort_array(F.collect_set("track_id")).alias("tracks_merged"),
        F.min("time_sec").alias("time_start"),
        F.max("time_sec").alias("time_end"),
        F.min("frame_index").alias("frame_start"),
        F.max("frame_index").alias("frame_end"),
        *(F.count(F.when(F.col("level") == level, 1)).alias(f"n_{level}") for level in LEVEL_NAMES),
        F.max_by("record", F.struct(F.coalesce("face_size", F.lit(0.0)).alias("f"), area.alias("a"), (-F.col("record")).alias("r"))).alias("representative"),
    )
    order = Window.partitionBy("stream").orderBy(F.desc("num_images"), "frame_start", "person")
    return out.withColumn("person_id", F.format_string("person_%03d", F.row_number().over(order)))


def unknown_tracks(records: DataFrame) -> DataFrame:
    """(stream, track_id, name) of the tracks that no person has: track_0001 and on, by their first frame."""
    seen = records.groupBy("stream", "track_id").agg(F.min("frame_index").alias("_first"), F.max("person").alias("_person")).where("_person is null")
    order = Window.partitionBy("stream").orderBy("_first", "track_id")
    return seen.select("stream", "track_id", F.format_string("track_%04d", F.row_number().over(order)).alias("name"))


def fold_anchors(boxes: list[tuple], faces: list[tuple]) -> list[int]:
    """Places of the faces (x, y, box to add) that lie in no box, each adding its own; one without a box adds nothing."""
    held, out = list(boxes), []
    for i, (x, y, box) in enumerate(faces):
        if box is None or any(a <= x <= c and b <= y <= d for a, b, c, d in held):
            continue
        held.append(box)
        out.append(i)
    return out


def anchored_faces(faces: DataFrame, boxes: DataFrame, width: float, height: float) -> DataFrame:
    """(stream, frame_index, face_no, x1, y1, x2, y2): a person's box for each face (face_no, x1 .. y2) whose centre no box of its frame holds, by face_no.

    A box that is added holds later faces, so this is a fold over the few faces of a frame.
    """
    face = F.struct(*(F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")))
    box = F.array("x1", "y1", "x2", "y2").cast("array<double>")
    rows = faces.select("stream", "frame_index", F.col("face_no").cast("long"), box.alias("at"), G.person_box_from_face(face, F.lit(float(width)), F.lit(float(height))).alias("b"))
    rows = rows.select("stream", "frame_index", "face_no", "at", F.when(F.col("b").isNotNull(), F.array("b.x1", "b.y1", "b.x2", "b.y2")).alias("person"))
    rows = rows.unionByName(boxes.select("stream", "frame_index", F.lit(None).cast("long").alias("face_no"), box.alias("at"), F.lit(None).cast("array<double>").alias("person")))
    stream = dict(rows.dtypes)["stream"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        seen = pdf[pdf.face_no.notna()].sort_values("face_no")
        centers = [((a[0] + a[2]) / 2, (a[1] + a[3]) / 2, None if p is None else tuple(p)) for a, p in zip(seen["at"], seen["person"], strict=True)]
        new = seen.iloc[fold_anchors([tuple(a) for a in pdf[pdf.face_no.isna()]["at"]], centers)]
        out = pd.DataFrame({"stream": new.stream, "frame_index": new.frame_index, "face_no": new.face_no.astype("int64")})
        return out.assign(**{c: [p[i] for p in new.person] for i, c in enumerate(("x1", "y1", "x2", "y2"))})

    return rows.groupBy("stream", "frame_index").applyInPandas(run, f"stream {stream}, frame_index {dict(rows.dtypes)['frame_index']}, face_no long, x1 double, y1 double, x2 double, y2 double")


def owners(faces: DataFrame, boxes: DataFrame, key: list[str]) -> DataFrame:
    """(key, face_no, box_no): the smallest box that holds a face's centre, the first on ties.

    A box lies in at most four cells of a grid whose step is the power of two
    above its long side; a centre meets the boxes of its cell in each grid that
    its frame has.  Equal centres, and equal boxes, are looked at once.
    """
    side = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    # Rounding must not hide a cell between a box's ends; what no grid suits is in one cell.
    grid = F.when(side < 2.0**30, F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.lit(1.0), side * 1.001)))).cast("int")).otherwise(F.lit(31))

    def cell(x) -> Column:
        return F.when(F.col("_grid") < 31, F.floor(F.col(x) / F.pow(F.lit(2.0), "_grid"))).otherwise(F.lit(0).cast("long"))

    area = F.greatest(F.lit(0.0), F.col("x2") - F.col("x1")) * F.greatest(F.lit(0.0), F.col("y2") - F.col("y1"))
    b = boxes.where("x1 <= x2 and y1 <= y2").groupBy(*key, "x1", "y1", "x2", "y2").agg(F.min(F.struct("box_no"))["box_no"].alias("box_no")).withColumn("_grid", grid)
    grids = b.select(*key, "_grid").distinct()
    b = b.withColumn("_cx", F.explode(F.array_distinct(F.array(cell("x1"), cell("x2"))))).withColumn("_cy", F.explode(F.array_distinct(F.array(cell("y1"), cell("y2")))))
    points = faces.where("x is not null and y is not null").select(*key, "x", "y").distinct().join(grids, key).withColumn("_cx", cell("x")).withColumn("_cy", cell("y"))
    held = points.join(b, [*key, "_grid", "_cx", "_cy"]).where("x between x1 and x2 and y between y1 and y2")
    best = held.groupBy(*key, "x", "y").agg(F.min(F.struct(area.alias("a"), F.col("box_no").alias("n"))).alias("_best"))
    return faces.join(best, [*key, "x", "y"]).groupBy(*key, "face_no").agg(F.min("_best")["n"].alias("box_no"))


def fold_suppress(boxes: np.ndarray, scores: np.ndarray, most: float) -> list[int]:
    """Places of boxes kept, best first, that overlap no better one by more than `most`."""
    order, kept = np.argsort(-scores, kind="stable"), []
    while len(order):
        i, order = order[0], order[1:]
        kept.append(int(i))
        x1, y1 = np.maximum(boxes[i, :2], boxes[order, :2]).T
        x2, y2 = np.minimum(boxes[i, 2:], boxes[order, 2:]).T
        inner = np.clip(x2 - x1, 0, None) * np.clip(y2 - y1, 0, None)
        size = lambda b: np.clip(b[..., 2] - b[..., 0], 0, None) * np.clip(b[..., 3] - b[..., 1], 0, None)
        union = size(boxes[i]) + size(boxes[order]) - inner
        order = order[np.where(union > 0, inner / np.where(union > 0, union, 1), 0) <= most]
    return kept


def suppressed(df: DataFrame, most: float = 0.4) -> DataFrame:
    """Detections (stream, frame_index, det_no, x1, y1, x2, y2, conf) without those that overlap a better one of their frame."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("det_no").reset_index(drop=True)
        return pdf.iloc[fold_suppress(pdf[["x1", "y1", "x2", "y2"]].to_numpy(float), pdf.conf.to_numpy(float), most)]

    return df.groupBy("stream", "frame_index").applyInPandas(run, df.schema)


def fold_association(detections: list[tuple], diagonal: float, max_age: int = 8, max_distance: float = 0.25, max_ratio: float = 2.0, evict: int = 8) -> list[int]:
    """Track of each detection (frame_index, order, (x1, y1, x2, y2), track or None) in order: its own, else the nearest recent one of like height, else a new negative number.

    Ages are in the unit of frame_index, so pass sampled steps where frames are sampled.
    """
    recent: dict[int, tuple[int, tuple]] = {}
    out, frame, seen = [], None, {}
    for index, order, box, track in detections:
        if index != frame:
            recent = {k: v for k, v in (recent | seen).items() if index - v[0] <= evict}
            frame, seen = index, {}
        if track is None:
            height, best = max(1.0, box[3] - box[1]), None
            for known, (at, other) in recent.items():
                tall = max(1.0, other[3] - other[1])
                if index - at > max_age or max(height, tall) / min(height, tall) > max_ratio:
                    continue
                away = math.hypot((box[0] + box[2] - other[0] - other[2]) / 2, (box[1] + box[3] - other[1] - other[3]) / 2) / diagonal
                if away < max_distance and (best is None or away < best[0]):
                    best = away, known
            track = best[1] if best else -(index + 1) * 10000 - order
        out.append(track)
        seen[track] = index, box
    return out


def associated(df: DataFrame, diagonal: float, **rules) -> DataFrame:
    """df (stream, frame_index, det_no, x1, y1, x2, y2, track_id) with track_id filled from recent tracks; an ordered fold over each stream."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["frame_index", "det_no"]).reset_index(drop=True)
        rows = [(r.frame_index, r.det_no, (r.x1, r.y1, r.x2, r.y2), None if pd.isna(r.track_id) else int(r.track_id)) for r in pdf.itertuples()]
        pdf["track_id"] = pd.array(fold_association(rows, diagonal, **rules), "Int64")
        return pdf

    return df.groupBy("stream").applyInPandas(run, df.schema)
