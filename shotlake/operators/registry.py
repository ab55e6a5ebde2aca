"""The registry of speakers over all sources: matching voice prints and updating centres."""

from __future__ import annotations

import functools
import itertools
import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from shotlake.functions import vectors as V

STATE = "speaker_id string, number long, cam_center array<double>, eres_center array<double>, samples long, videos array<string>"
SEEN = "video string, cluster long, speaker_id string"


def _norm(v: np.ndarray) -> float:
    """np.linalg.norm of one vector, bit by bit, in less time."""
    return math.sqrt(v.dot(v))


def _unit(v) -> np.ndarray:
    v = np.asarray(v, np.float64)
    n = _norm(v)
    return v / n if n > 1e-8 else v


def _cosine(a, b) -> float:
    if a is None or b is None or len(a) != len(b):
        return -1.0
    scale = _norm(a) * _norm(b)
    return float(np.dot(a, b) / scale) if scale > 1e-9 else 0.0


BATCH = 256  # samples whose products with all centres are made at once
GROUP = 32  # speakers that share a bound
FEW = 512  # speakers that are looked at without bounds


class _Directions:
    """The speakers' centres over their norms as rows, by place; odd once one has another length than the first."""

    def __init__(self):
        self.cam, self.eres, self.odd = None, None, False

    def put(self, place: int, cam: np.ndarray, eres: np.ndarray | None) -> None:
        self.cam = np.zeros((2 * GROUP, len(cam))) if self.cam is None else self.cam
        if place == len(self.cam):
            self.cam, self.eres = np.concatenate([self.cam, np.zeros_like(self.cam)]), None if self.eres is None else np.concatenate([self.eres, self._none(place, self.eres.shape[1])])
        if eres is not None and self.eres is None:
            self.eres = self._none(len(self.cam), len(eres) + 1)
        self.odd = self.odd or len(cam) != self.cam.shape[1] or (eres is not None and len(eres) + 1 != self.eres.shape[1])
        if not self.odd:
            self.cam[place] = self._over_norm(cam)
            if eres is not None:
                self.eres[place] = [*self._over_norm(eres), 0.0]

    @staticmethod
    def _none(n: int, width: int) -> np.ndarray:
        """Rows whose product with any sample's is below zero."""
        return np.concatenate([np.zeros((n, width - 1)), np.full((n, 1), -2.0)], axis=1)

    @staticmethod
    def _over_norm(v: np.ndarray) -> np.ndarray:
        n = _norm(v)
        return v / n if n > 1e-9 else np.zeros(len(v))

    def takes(self, cam: np.ndarray, eres: np.ndarray | None) -> bool:
        """Whether products with a sample are cosines."""
        return not self.odd and len(cam) == self.cam.shape[1] and _norm(cam) > 0.5 and (eres is None or self.eres is None or len(eres) + 1 == self.eres.shape[1] and _norm(eres) > 0.5)

    def scores(self, cam: np.ndarray, eres: np.ndarray | None, at) -> np.ndarray:
        """Scores with the speakers at some places, but for rounding; where the second print's cosine is all but 0, that of the first."""
        like = self.cam[at] @ cam
        if eres is None or self.eres is None:
            return like
        other = self.eres[at] @ np.append(eres, 1.0)
        return np.where(other >= 1e-9, other, like)

    def bounds(self, cams: np.ndarray, eres: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        """The highest score of each sample in each group of the first n speakers; eres are the second prints of samples `of`."""
        width, parts = -(-n // GROUP) * GROUP, []
        for a in range(0, width, 4096):
            at = slice(a, min(width, a + 4096))
            like = cams @ self.cam[at].T
            if len(of) and self.eres is not None:
                other = np.append(eres, np.ones((len(of), 1)), axis=1) @ self.eres[at].T
                like[of] = np.where(other >= 1e-9, other, like[of])
            parts.append(like.reshape(len(cams), -1, GROUP).max(axis=2))
        return np.concatenate(parts, axis=1)


@dataclass
class Registry:
    """Speakers in the order of their numbers; a sample of (video, cluster) counts once, so running again changes nothing.

    speakers may be filled from outside, but their centres move in match and match_all only.
    """

    cam_threshold: float = 0.30
    eres_threshold: float = 0.55
    speakers: dict[str, dict] = field(default_factory=dict)
    seen: dict[tuple, str] = field(default_factory=dict)
    _names: list[str] = field(default_factory=list, init=False, repr=False, compare=False)
    _rows: _Directions = field(default_factory=_Directions, init=False, repr=False, compare=False)

    def match(self, cam, eres=None, video: str | None = None, cluster=None) -> str | None:
        """The speaker of a sample, new if none is like it; None for a sample without a voice print."""
        return self.match_all([(cam, eres, video, cluster)])[0]

    def match_all(self, samples: list[tuple]) -> list[str | None]:
        """match of each (cam, eres, video, cluster), in order.

        A decision moves or adds one centre.  So bounds are made for a batch of samples and groups of
        speakers by products of matrices, and then each sample looks at speakers that were moved or added since, and
        at groups that may hold one as like as the best so far.  _cosine decides.
        """
        out = []
        for a in range(0, len(samples), BATCH):
            batch = [(None if cam is None else _unit(cam), None if eres is None else _unit(eres), *rest) for cam, eres, *rest in samples[a : a + BATCH]]
            self._follow()
            n, moved, bounds = len(self._names), {}, {}
            if n > FEW:
                fit = [i for i, (cam, eres, *_) in enumerate(batch) if cam is not None and self._rows.takes(cam, eres)]
                of = [k for k, i in enumerate(fit) if batch[i][1] is not None]
                if fit:
                    second = np.stack([batch[fit[k]][1] for k in of]) if of else np.zeros((0, 0))
                    bounds = dict(zip(fit, self._rows.bounds(np.stack([batch[i][0] for i in fit]), second, np.array(of, np.int64), n), strict=True))
            out += [self._taken(*sample, n, moved, bounds.get(i)) for i, sample in enumerate(batch)]
        return out

    def _follow(self) -> None:
        """Takes in speakers that were put from outside."""
        for name in itertools.islice(self.speakers, len(self._names), None) if len(self.speakers) > len(self._names) else ():
            self._rows.put(len(self._names), self.speakers[name]["cam"], self.speakers[name]["eres"])
            self._names.append(name)

    def _best(self, cam: np.ndarray, eres: np.ndarray | None, n: int, moved: dict, bounds: np.ndarray | None) -> tuple[int | None, float, float]:
        """(place, cosine by cam, by eres) of the first speaker with the highest score."""
        best = (-1.0, None, -1.0, -1.0)

        def look(places, scores) -> None:
            nonlocal best
            for k in np.argsort(-scores):
                if scores[k] < best[0] - 1e-9:
                    return
                decide(int(places[k]))

        def decide(place: int) -> None:
            nonlocal best
            s = self.speakers[self._names[place]]
            like = _cosine(cam, s["cam"]), _cosine(eres, s["eres"])
            score = like[1] if like[1] >= 0 else like[0]
            if score > best[0] or (score == best[0] and best[1] is not None and place < best[1]):
                best = (score, place, *like)

        if bounds is not None and not self._rows.odd:
            if moved:
                places = np.fromiter(moved, np.int64, len(moved))
                look(places, self._rows.scores(cam, eres, places))
            while bounds[g := int(bounds.argmax())] >= best[0] - 1e-9 and bounds[g] > -np.inf:
                at = slice(g * GROUP, min(n, (g + 1) * GROUP))
                bounds[g] = -np.inf
                look(range(at.start, at.stop), self._rows.scores(cam, eres, at))
        elif self._names and self._rows.takes(cam, eres):
            look(range(len(self._names)), self._rows.scores(cam, eres, slice(0, len(self._names))))
        if best[0] <= 1e-8:  # products do not tell the sign
            for place in range(len(self._names)):
                decide(place)
        return best[1:]

    def _taken(self, cam: np.ndarray | None, eres: np.ndarray | None, video: str | None, cluster, n: int, moved: dict, bounds: np.ndarray | None) -> str | None:
        if cam is None:
            return None
        if cluster is not None and (video, cluster) in self.seen:
            return self.seen[video, cluster]
        place, like_cam, like_eres = self._best(cam, eres, n, moved, bounds)
        if place is not None and like_cam >= self.cam_threshold and (like_eres < 0 or like_eres >= self.eres_threshold):
            name = self._names[place]
            s = self.speakers[name]
            for key, sample in (("cam", cam), ("eres", eres)):
                if sample is not None:
                    s[key] = sample if s[key] is None else _unit((s[key] * s["samples"] + sample) / (s["samples"] + 1))
            s["samples"] += 1
            self._rows.put(place, s["cam"], s["eres"])
        else:
            name, place = f"speaker_{len(self.speakers) + 1}", len(self._names)
            s = self.speakers[name] = {"cam": cam, "eres": eres, "samples": 1, "videos": []}
            self._follow()
        moved[place] = None
        if video and video not in s["videos"]:
            s["videos"].append(video)
        if cluster is not None:
            self.seen[video, cluster] = name
        return name


def _folded(samples: DataFrame, start: Registry, cam_threshold: float, eres_threshold: float) -> DataFrame:
    """Rows of FOLDED: kind 'sample' for each of samples (seq, video, cluster, cam_emb, eres_emb) in order of seq, then kind 'speaker' for each speaker.

    Each decision depends on all before, so samples stream through one task in
    order; it holds the speakers, never the samples.
    """
    known = {k: {**v, "videos": list(v["videos"])} for k, v in start.speakers.items()}
    columns = [c.split()[0] for c in FOLDED.split(", ")]

    def run(frames):
        registry = Registry(cam_threshold, eres_threshold, {k: {**v, "videos": list(v["videos"])} for k, v in known.items()})
        for pdf in frames:
            names = registry.match_all([(r.cam_emb, r.eres_emb, r.video, None if pd.isna(r.cluster) else r.cluster) for r in pdf.itertuples()])
            out = [("sample", r.seq, r.video, r.cluster, name, None, None, None, None) for r, name in zip(pdf.itertuples(), names, strict=True)]
            yield pd.DataFrame(out, columns=columns)
        rest = [("speaker", i, None, None, name, s["cam"], s["eres"], s["samples"], s["videos"]) for i, (name, s) in enumerate(registry.speakers.items())]
        yield pd.DataFrame(rest, columns=columns)

    rows = samples.select(F.col("seq").cast("long"), F.col("video").cast("string"), F.col("cluster").cast("long"), "cam_emb", "eres_emb")
    return rows.repartition(1).sortWithinPartitions("seq").mapInPandas(run, FOLDED)


FOLDED = "kind string, seq long, video string, cluster long, speaker_id string, cam_center array<double>, eres_center array<double>, samples long, videos array<string>"


def matched(samples: DataFrame, cam_threshold: float = 0.30, eres_threshold: float = 0.55) -> DataFrame:
    """(seq, video, cluster, speaker_id) of samples (seq, video, cluster, cam_emb, eres_emb), by seq, from an empty registry."""
    return _folded(samples, Registry(), cam_threshold, eres_threshold).where("kind = 'sample'").select("seq", "video", "cluster", "speaker_id")


def load(spark: SparkSession, path: str) -> tuple[int, DataFrame, DataFrame]:
    """(version, speakers, seen) of the newest version under path that was written whole; version 0 and empty tables if there is none."""
    try:
        version = spark.read.schema("version long").parquet(f"{path}/versions").agg(F.max("version")).first()[0] or 0
    except AnalysisException:
        version = 0
    if not version:
        return 0, spark.createDataFrame([], STATE), spark.createDataFrame([], SEEN)
    return version, spark.read.schema(STATE).parquet(f"{path}/speakers-{version}"), spark.read.schema(SEEN).parquet(f"{path}/seen-{version}")


def resolve(samples: DataFrame, path: str, cam_threshold: float = 0.30, eres_threshold: float = 0.55) -> DataFrame:
    """(seq, video, cluster, speaker_id) of samples, by the registry under path, which is brought up to date.

    A (video, cluster) that an earlier call has seen keeps its speaker and changes
    nothing, so a batch may be given again.  A new version becomes current by a
    row in versions, written after its tables; what is cut short leaves the old one.
    """
    spark = samples.sparkSession
    version, speakers, seen = load(spark, path)
    start = Registry(cam_threshold, eres_threshold)
    for r in speakers.orderBy("number").toLocalIterator():
        start.speakers[r["speaker_id"]] = {"cam": np.asarray(r["cam_center"]), "eres": None if r["eres_center"] is None else np.asarray(r["eres_center"]), "samples": r["samples"], "videos": r["videos"]}
    key = ["video", "cluster"]
    rows = samples.select(F.col("seq").cast("long").alias("seq"), F.col("video").cast("string").alias("video"), F.col("cluster").cast("long").alias("cluster"), "cam_emb", "eres_emb")
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"o.{c}")) for c in key]
    known = rows.alias("s").join(seen.alias("o"), same).select("s.seq", "s.video", "s.cluster", "o.speaker_id")
    fresh = rows.alias("s").join(seen.alias("o"), same, "left_anti")
    at = f"{path}/folded-{version + 1}"
    _folded(fresh, start, cam_threshold, eres_threshold).write.mode("overwrite").parquet(at)
    folded = spark.read.schema(FOLDED).parquet(at)
    folded.where("kind = 'speaker'").select("speaker_id", F.col("seq").alias("number"), "cam_center", "eres_center", "samples", "videos").write.mode("overwrite").parquet(f"{path}/speakers-{version + 1}")
    new = folded.where("kind = 'sample'").select("seq", *key, "speaker_id")
    seen.unionByName(new.where("cluster is not null and speaker_id is not null").select(*key, "speaker_id")).dropDuplicates(key).write.mode("overwrite").parquet(f"{path}/seen-{version + 1}")
    out = known.unionByName(new)
    out.write.mode("overwrite").parquet(f"{path}/out-{version + 1}")
    spark.createDataFrame([(version + 1,)], "version long").coalesce(1).write.mode("append").parquet(f"{path}/versions")
    return spark.read.schema(out.schema).parquet(f"{path}/out-{version + 1}")


def counts_by(runs: DataFrame, key: list[str], status: str) -> DataFrame:
    """(key, status, n): how many of each status there are."""
    return runs.groupBy(*key, status).agg(F.count("*").alias("n"))


PIVOTS = 256  # at most
BLOCK = 4 << 20  # bytes of the vectors on either side that meet in a task
LEAST = 1024  # samples of a block, if there are more
PAIRS = 1 << 20  # pairs whose products are held at once
SLACK = 1e-7  # of angles


def _column(rows: pa.Table, name: str) -> np.ndarray:
    return np.asarray(rows.column(name).combine_chunks())


def _vectors(column: pa.Array, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of one length as rows, and over their norms."""
    x = np.asarray(column.flatten(), np.float64).reshape(len(norm), -1)
    return x, x / norm[:, None]


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1, 1))


def _runs(rows: np.ndarray, columns: int):
    """rows in parts that have at most PAIRS pairs with so many columns."""
    step = max(1, PAIRS // max(1, columns))
    return (rows[i : i + step] for i in range(0, len(rows), step))


class _Lists:
    """The centres of a block, by pivot and angle to it."""

    def __init__(self, rows: pa.Table):
        pivot, at = _column(rows, "pivot"), _column(rows, "angle")
        rows = rows.take(np.lexsort((at, pivot)))
        self.ids, self.norm, self.at, pivot = (_column(rows, c) for c in ("center_id", "norm", "angle", "pivot"))
        self.raw, self.unit = _vectors(rows.column("center").combine_chunks(), self.norm)
        self.pivots, first = np.unique(pivot, return_index=True)
        self.places = dict(zip(self.pivots.tolist(), zip(first, np.append(first[1:], len(pivot)), strict=True), strict=True))


def _nearest(raw: np.ndarray, unit: np.ndarray, norm: np.ndarray, best: np.ndarray, lists: _Lists, angles: np.ndarray):
    """(row, place in lists, similarity, pairs) of each row's most similar centre, the first on ties, and with how many it was compared.

    angles are those to the pivots of lists.  Products choose, sums in the order of the components decide.
    """
    top, looked, found = np.full(len(raw), -np.inf), np.zeros(len(raw), np.int64), []

    def kept(i: np.ndarray, j: np.ndarray, like: np.ndarray) -> None:
        near = like >= top[i] - 1e-9
        found.append((i[near], j[near], like[near]))

    for k, pivot in enumerate(lists.pivots.tolist()):
        a, b = lists.places[pivot]
        low = a + np.searchsorted(lists.at[a:b], angles[:, k] - best - SLACK)
        high = a + np.searchsorted(lists.at[a:b], angles[:, k] + best + SLACK, "right")
        rows = np.flatnonzero(high > low)
        if not len(rows):
            continue
        wide = high[rows] - low[rows]
        a, b = low[rows].min(), high[rows].max()
        if 4 * wide.sum() >= len(rows) * (b - a):
            for part in _runs(rows, b - a):
                like = unit[part] @ lists.unit[a:b].T
                top[part] = np.maximum(top[part], like.max(1))
                i, j = np.nonzero(like >= top[part, None] - 1e-9)
                kept(part[i], a + j, like[i, j])
            looked[rows] += b - a
        else:
            looked[rows] += wide
            for part in _runs(rows, max(wide.max(), unit.shape[1] * int(wide.mean() + 1))):
                n = high[part] - low[part]
                i = np.repeat(part, n)
                j = np.arange(len(i)) + np.repeat(low[part] - (np.cumsum(n) - n), n)
                like = np.einsum("ij,ij->i", unit[i], lists.unit[j])
                np.maximum.at(top, i, like)
                kept(i, j, like)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), looked
    i, j, like = map(np.concatenate, zip(*found, strict=True))
    near = like >= top[i] - 1e-9
    i, j = i[near], j[near]
    exact = np.zeros(len(i))
    for c in range(0, len(i), 65536):
        p, q = i[c : c + 65536], j[c : c + 65536]
        for x, y in zip(raw[p].T, lists.raw[q].T, strict=True):
            exact[c : c + 65536] += x * y
        exact[c : c + 65536] /= norm[p] * lists.norm[q]
    order = np.lexsort((lists.ids[j], -exact, i))
    first = order[np.append(True, np.diff(i[order]) > 0)]
    return i[first], j[first], exact[first], looked


def nearest_center(samples: DataFrame, centers: DataFrame, pivots: int | None = None, pairs: Observation | None = None) -> DataFrame:
    """(sample_id, center_id, similarity): the most similar centre by cosine, the first on ties.

    An exact search by the triangle inequality of angles.  Each centre belongs
    to the nearest of some pivots, which are centres drawn by a hash, the square root of their
    number and PIVOTS at most.  A sample first meets centres of its own
    nearest pivot.  Then it meets those of all pivots, and there only centres
    whose angle to the pivot differs from the sample's by no more than the best
    angle so far, as no other can be nearer.  Samples and centres meet in blocks of a bounded size, as
    matrix products where the bounds leave much.  pairs, an Observation, gets as
    `pairs` how many are compared in this second round, own lists included.
    Centres that are equal count as one, the first.

    A null embedding or centre, or one with a null component, takes no part; nor does a centre of another length
    than the sample's, or a vector whose norm is not finite.  The similarity with a vector of norm 1e-9 or less is 0.
    """
    valid = lambda df, c: df.where(F.col(c).isNotNull() & F.forall(c, lambda x: x.isNotNull()))
    asked = valid(samples.select(F.col("sample_id").cast("long").alias("sample_id"), V.doubles("embedding").alias("embedding")), "embedding").withColumn("norm", V.norm("embedding")).withColumn("dim", F.size("embedding"))
    known = valid(centers.select(F.col("center_id").cast("long").alias("center_id"), V.doubles("center").alias("center")), "center").withColumn("norm", V.norm("center")).withColumn("dim", F.size("center"))
    # Without a direction: the first such centre of each length has similarity 0 with all, and all have it with such a sample.
    blank = known.where("norm <= 1e-9").groupBy("dim").agg(F.min("center_id").alias("center_id"))
    first = known.groupBy("dim").agg(F.min("center_id").alias("center_id"))
    still = asked.where("norm <= 1e-9").join(first, "dim").unionByName(asked.where("norm > 1e-9").join(blank, "dim")).select("sample_id", "center_id", F.lit(0.0).alias("similarity"), F.lit(0).cast("long").alias("pairs"))

    found = [still]
    aimed, live = (df.where(F.col("norm").between(1e-9, np.finfo(float).max) & (F.col("norm") > 1e-9)) for df in (known, asked))
    aimed = aimed.groupBy("center", "norm", "dim").agg(F.min("center_id").alias("center_id"))
    sizes = {r["dim"]: r["count"] for r in live.groupBy("dim").count().collect()}
    for dim, n in aimed.groupBy("dim").count().orderBy("dim").collect():  # a registry has prints of one length, or of a few
        if dim not in sizes:
            continue
        most = min(pivots or PIVOTS, max(1, math.isqrt(n)))
        drawn = aimed.where(F.col("dim") == dim).orderBy(F.xxhash64("center_id"), "center_id").limit(most).select("center").toPandas()["center"]
        middle = np.stack(drawn.to_list())
        middle = middle / np.linalg.norm(middle, axis=1, keepdims=True)
        found.append(_by_pivots(live.where(F.col("dim") == dim), aimed.where(F.col("dim") == dim), middle, sizes[dim]))
    every = functools.reduce(DataFrame.unionByName, found)
    every = every if pairs is None else every.observe(pairs, F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))
    return every.groupBy("sample_id").agg(F.max_by(F.struct("center_id", "similarity"), F.struct("similarity", -F.col("center_id"))).alias("b")).select("sample_id", "b.*")


def _by_pivots(asked: DataFrame, known: DataFrame, pivots: np.ndarray, n_asked: int) -> DataFrame:
    """(sample_id, center_id, similarity, pairs): the nearest centre of each sample in each block of centres that may have the nearest of all."""
    dim = pivots.shape[1]
    most = max(64, BLOCK // (8 * dim))
    slots = max(1, -(-n_asked // most), min(64, n_asked // LEAST))

    def placed(df: DataFrame, number: str, vector: str) -> DataFrame:
        """With the nearest pivot and the angle to it."""

        def run(batches):
            for batch in batches:
                _, unit = _vectors(batch.column(1), np.asarray(batch.column(2)))
                angles = _angles(unit, pivots)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(angles.argmin(axis=1).astype(np.int32)), pa.array(angles.min(axis=1))], [number, vector, "norm", "pivot", "angle"])

        return df.select(number, vector, "norm").mapInArrow(run, f"{number} long, {vector} array<double>, norm double, pivot int, angle double")

    listed = placed(known, "center_id", "center")
    reach = {r["pivot"]: r for r in listed.groupBy("pivot").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count("*").alias("n")).collect()}  # a row for each pivot
    low, high = (np.array([reach[i][c] if i in reach else none for i in range(len(pivots))]) for c, none in (("low", np.inf), ("high", -np.inf)))
    # Short lists share a block, a long one has several.
    begin, parts, blocks, room = [0] * len(pivots), [1] * len(pivots), 0, 0
    for i in sorted(reach):
        n = reach[i]["n"]
        parts[i] = -(-n // most)
        if n > room:
            blocks, room = blocks + parts[i], most if parts[i] == 1 else 0
        begin[i], room = blocks - parts[i], max(0, room - n)
    holds = np.zeros((len(pivots), blocks), np.float32)
    for i in reach:
        holds[i, begin[i] : begin[i] + parts[i]] = 1

    of = lambda values: F.get(F.lit(values), F.col("pivot"))
    key = ["block", "slot"]
    sent = listed.withColumn("block", of(begin) + F.pmod(F.xxhash64("center_id"), of(parts)).cast("int")).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    own = placed(asked, "sample_id", "embedding").withColumn("block", of(begin)).withColumn("slot", F.pmod(F.xxhash64("sample_id"), F.lit(slots)).cast("int"))

    def bounded(rows: pa.Table, known: pa.Table) -> pa.Table:
        """Samples with a bound of their best angle, and the blocks that may have a nearer centre than that."""
        if not rows.num_rows:
            return pa.table({"sample_id": pa.array([], pa.int64()), "embedding": pa.array([], pa.list_(pa.float64())), "norm": pa.array([], pa.float64()), "best": pa.array([], pa.float64()), "blocks": pa.array([], pa.list_(pa.int32())), "slot": pa.array([], pa.int32())})
        norm, pivot, best = _column(rows, "norm"), _column(rows, "pivot"), _column(rows, "angle").copy()  # a pivot is a centre
        _, unit = _vectors(rows.column("embedding").combine_chunks(), norm)
        lists = _Lists(known) if known.num_rows else None
        for p, (a, b) in lists.places.items() if lists else ():
            for part in _runs(np.flatnonzero(pivot == p), b - a):
                best[part] = np.minimum(best[part], np.arccos(np.clip((unit[part] @ lists.unit[a:b].T).max(1), -1, 1)))
        angles = _angles(unit, pivots)
        near = (np.maximum(angles - high, low - angles) <= best[:, None] + SLACK) & np.isfinite(low)
        row, block = np.nonzero(near.astype(np.float32) @ holds)
        ends = np.searchsorted(row, np.arange(len(norm) + 1)).astype(np.int32)
        return pa.table({"sample_id": rows.column("sample_id"), "embedding": rows.column("embedding"), "norm": norm, "best": best, "blocks": pa.ListArray.from_arrays(pa.array(ends), pa.array(block.astype(np.int32))), "slot": rows.column("slot")})

    def met(rows: pa.Table, known: pa.Table) -> pa.Table:
        if not rows.num_rows or not known.num_rows:
            return pa.table({"sample_id": pa.array([], pa.int64()), "center_id": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64()), "pairs": pa.array([], pa.int64())})
        norm, lists = _column(rows, "norm"), _Lists(known)
        raw, unit = _vectors(rows.column("embedding").combine_chunks(), norm)
        i, j, like, looked = _nearest(raw, unit, norm, _column(rows, "best"), lists, _angles(unit, pivots[lists.pivots]))
        return pa.table({"sample_id": _column(rows, "sample_id")[i], "center_id": lists.ids[j], "similarity": like, "pairs": looked[i]})

    near = own.groupBy(*key).cogroup(sent.groupBy(*key)).applyInArrow(bounded, "sample_id long, embedding array<double>, norm double, best double, blocks array<int>, slot int")
    near = near.select("sample_id", "embedding", "norm", "best", "slot", F.explode("blocks").alias("block"))
    return near.groupBy(*key).cogroup(sent.groupBy(*key)).applyInArrow(met, "sample_id long, center_id long, similarity double, pairs long")
