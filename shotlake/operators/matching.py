"""Feature matching between frames, and the motion of a pair of frames by sampling consensus.

Matching: a frame's descriptors are dealt into tiles of a bounded size.  For
each wanted pair of frames, tiles of the one meet tiles of the other, a matrix
product gives all distances of two tiles, and each descriptor keeps its two
nearest; the two nearest of all tiles decide by their ratio.

Motion: minimal samples are the matches with the least seeded hashes, so they
depend on the matches alone.  Each gives a model in closed form; inliers are
counted for all models of a pair together; the best is fitted again to its
inliers by sums.  Every step folds parts of a bounded size first and then the
parts of a pair, so a pair with very many matches is no task of its own, and
the rows are the same for any partitioning.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

TILE = 1024  # descriptors of a frame that are compared at once
PART = 8192  # matches of a pair that are looked at together
EPS = 1e-9


def _tiled(descriptors: DataFrame, side: str) -> DataFrame:
    """(frame, tile) with the numbers and descriptors in it, for one side of the pairs."""
    sizes = descriptors.groupBy("stream", "frame_index").agg(F.ceil(F.count("*") / TILE).alias("_tiles"))
    dealt = descriptors.join(sizes, ["stream", "frame_index"]).withColumn("_tile", F.pmod(F.xxhash64("number"), F.col("_tiles")))
    rows = dealt.groupBy("stream", "frame_index", "_tile").agg(F.array_sort(F.collect_list(F.struct("number", "descriptor"))).alias("_d"))
    return rows.select("stream", F.col("frame_index").alias(f"frame_{side}"), F.col("_tile").alias(f"tile_{side}"), F.col("_d.number").alias(f"numbers_{side}"), F.col("_d.descriptor").alias(f"descriptors_{side}"))


def _stacked(lists: pa.Array) -> np.ndarray:
    """One tile's descriptors as rows; bits of binary ones become numbers, whose squared distance is Hamming's."""
    flat = lists.flatten()
    if pa.types.is_binary(flat.type):
        rows = [np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8)) for x in flat]
        return np.array(rows, np.float64).reshape(len(rows), -1)
    return np.asarray(flat.flatten(), np.float64).reshape(len(flat), -1)


def nearest_two(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in b, squared distance) of the two rows of b nearest to each row of a, the first on ties; products choose, differences decide."""
    aa, bb = np.square(a).sum(1), np.square(b).sum(1)
    rough = aa[:, None] + bb - 2 * a @ b.T
    k = min(2, len(b))
    slack = 1e-9 * (aa + bb.max()) + 1e-12
    near = rough <= np.partition(rough, k - 1, axis=1)[:, k - 1][:, None] + slack[:, None]
    i, j = np.nonzero(near)
    exact = np.concatenate([np.square(a[i[c : c + 65536]] - b[j[c : c + 65536]]).sum(1) for c in range(0, len(i), 65536)])
    order = np.lexsort((j, exact, i))
    first = np.searchsorted(i[order], np.arange(len(a)))
    at = order[first[:, None] + np.arange(k)]
    return j[at], exact[at]


def matched(descriptors: DataFrame, pairs: DataFrame, ratio: float = 0.75) -> DataFrame:
    """(stream, frame_i, frame_j, number_i, number_j, distance) of the matches of each of pairs (stream, frame_i, frame_j).

    descriptors has (stream, frame_index, number, descriptor), the last an array
    of numbers (Euclidean distance) or binary (square root of Hamming's); null
    descriptors and numbers are left out.  A descriptor of frame_i matches the nearest one of
    frame_j, the lower number on ties, if it is nearer than ratio times the
    second nearest.  A frame with fewer than two descriptors gives no match.
    """
    rows = descriptors.select("stream", "frame_index", F.col("number").cast("long").alias("number"), "descriptor").where("number is not null and descriptor is not null")
    enough = rows.groupBy("stream", "frame_index").agg(F.count("*").alias("_n")).where("_n >= 2").select("stream", "frame_index")
    wanted = pairs.select("stream", "frame_i", "frame_j").distinct()
    for side in "ij":
        wanted = wanted.join(enough.withColumnRenamed("frame_index", f"frame_{side}"), ["stream", f"frame_{side}"], "left_semi")
    met = wanted.join(_tiled(rows, "i"), ["stream", "frame_i"]).join(_tiled(rows, "j"), ["stream", "frame_j"])
    kinds = dict(met.dtypes)

    one = ["stream", "frame_i", "frame_j", "number_i"]

    def run(tiles: pa.Table) -> pa.Table:
        column = lambda c: tiles.column(c).combine_chunks()
        place, gap = nearest_two(_stacked(column("descriptors_i")), _stacked(column("descriptors_j")))
        n, k = place.shape
        own, other = (np.asarray(column(c).flatten()) for c in ("numbers_i", "numbers_j"))
        again = pa.array(np.zeros(n * k, np.int64))
        return pa.table({**{c: column(c).take(again) for c in one[:3]}, "number_i": np.repeat(own, k), "number_j": other[place].ravel(), "gap": gap.ravel()})

    # A group is one row, so that no Arrow batch holds more than two tiles.
    near = met.groupBy(*one[:3], "tile_i", "tile_j").applyInArrow(run, f"stream {kinds['stream']}, frame_i {kinds['frame_i']}, frame_j {kinds['frame_j']}, number_i long, number_j long, gap double")
    place = F.row_number().over(Window.partitionBy(*one).orderBy("gap", "number_j"))
    two = near.withColumn("_k", place).where("_k <= 2").groupBy(*one).agg(F.min(F.when(F.col("_k") == 1, F.col("number_j"))).alias("number_j"), F.min(F.when(F.col("_k") == 1, F.col("gap"))).alias("_best"), F.max(F.when(F.col("_k") == 2, F.col("gap"))).alias("_second"))
    return two.where(F.sqrt("_best") < ratio * F.sqrt("_second")).select(*one, "number_j", F.sqrt("_best").alias("distance"))


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes of 64-bit numbers (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def similarities(p: np.ndarray) -> np.ndarray:
    """Row-major 3x3 similarities through the first two of samples' points p[:, k] = (x, y, u, v)."""
    (x, y, u, v), step = (p[:, 0, c] for c in range(4)), p[:, 1] - p[:, 0]
    with np.errstate(all="ignore"):
        square = step[:, 0] ** 2 + step[:, 1] ** 2
        a, b = (step[:, 0] * step[:, 2] + step[:, 1] * step[:, 3]) / square, (step[:, 0] * step[:, 3] - step[:, 1] * step[:, 2]) / square
    zero, one = np.zeros_like(a), np.ones_like(a)
    return np.stack([a, -b, u - a * x + b * y, b, a, v - b * x - a * y, zero, zero, one], 1)


def _equations(p: np.ndarray) -> np.ndarray:
    """Two linear equations on the nine entries of a homography for each of points (..., 4)."""
    x, y, u, v = np.moveaxis(p, -1, 0)
    zero, one = np.zeros_like(x), np.ones_like(x)
    return np.stack([np.stack([x, y, one, zero, zero, zero, -u * x, -u * y, -u], -1), np.stack([zero, zero, zero, x, y, one, -v * x, -v * y, -v], -1)], -2)


def homographies(p: np.ndarray) -> np.ndarray:
    """Row-major homographies through samples of four points."""
    rows = _equations(p).reshape(len(p), 8, 9)
    h = np.linalg.svd(rows)[2][:, -1]
    with np.errstate(all="ignore"):
        return h / h[:, 8:]


def residuals(models: np.ndarray, p: np.ndarray) -> np.ndarray:
    """[model, point] squared distances between moved and found points."""
    m = models.reshape(-1, 3, 3)
    with np.errstate(all="ignore"):
        moved = m[:, :, 0, None] * p[:, 0] + m[:, :, 1, None] * p[:, 1] + m[:, :, 2, None]
        low = np.maximum(moved[:, 2], EPS)
        out = (moved[:, 0] / low - p[:, 2]) ** 2 + (moved[:, 1] / low - p[:, 3]) ** 2
    return np.where(np.isfinite(out), out, np.inf)


class _Consensus:
    """The steps of the estimate; points are in units of the frame's diagonal, from its centre."""

    def __init__(self, width: float, height: float, threshold: float, samples: int, min_inliers: int):
        self.width, self.height, self.diagonal = width, height, math.hypot(width, height)
        self.reach, self.samples, self.min_inliers = (threshold / self.diagonal) ** 2, samples, min_inliers
        self.seeds = mixed(np.arange(1, samples + 1, dtype=np.uint64))

    def points(self, table: pa.Table) -> np.ndarray:
        """Of a part, which is a table of one row with an array for each column."""
        raw = np.stack([np.asarray(table.column(c)[0].values, np.float64) for c in ("x_i", "y_i", "x_j", "y_j")], 1)
        return (raw - np.array([self.width, self.height] * 2) / 2) / self.diagonal

    def drawn(self, table: pa.Table) -> dict:
        """The four matches of a part with the least hashes, for each sample; fewer are filled up with the largest hash."""
        slot, p = np.asarray(table.column("slot")[0].values).view(np.uint64), self.points(table)
        hashes = mixed(self.seeds[:, None] ^ slot)
        k = min(4, len(p))
        at = np.argsort(hashes, axis=1, kind="stable")[:, :k] if k == len(p) else np.argpartition(hashes, k, axis=1)[:, :k]
        least, points = np.full((self.samples, 4), np.uint64(2**64 - 1)), np.zeros((self.samples, 4, 4))
        least[:, :k], points[:, :k] = np.take_along_axis(hashes, at, 1), p[at]
        return {"hashes": least.ravel().view(np.int64), "points": points.ravel()}

    def models(self, table: pa.Table) -> dict:
        """Similarities and homographies of a pair's samples, from those of its parts."""
        hashes = np.stack([np.asarray(x.values).view(np.uint64).reshape(self.samples, 4) for x in table.column("hashes")], 1).reshape(self.samples, -1)
        points = np.stack([np.asarray(x.values).reshape(self.samples, 4, 4) for x in table.column("points")], 1).reshape(self.samples, -1, 4)
        # Equal hashes are equal matches, or as good as; their points make the order complete.
        order = np.lexsort((*(points[..., c] for c in (3, 2, 1, 0)), hashes), axis=1)[:, :4]
        p = np.take_along_axis(points, order[..., None], 1)
        return {"flat": similarities(p).ravel(), "deep": homographies(p).ravel()}

    def scores(self, table: pa.Table, models: dict) -> dict:
        """Of each model the inliers in a part, and their squared residuals."""
        out, p = {}, self.points(table)
        for kind in ("flat", "deep"):
            r = residuals(models[kind], p)
            inside = r <= self.reach
            out[f"{kind}_n"], out[f"{kind}_r"] = inside.sum(1), np.where(inside, r, 0).sum(1)
        return out

    def best(self, sums: dict, models: dict) -> dict:
        """The model of each kind with the most inliers, least residuals, and the lowest number."""
        out = {}
        for kind in ("flat", "deep"):
            n, r = sums[f"{kind}_n"], np.round(sums[f"{kind}_r"], 12)
            i = np.lexsort((np.arange(len(n)), r, -n))[0]
            out[kind], out[f"{kind}_n"] = models[kind].reshape(-1, 9)[i], n[i : i + 1]
        return out

    def sums(self, table: pa.Table, best: dict) -> dict:
        """What the fits of a part's inliers need."""
        p = self.points(table)
        x, y, u, v = p[residuals(best["flat"], p)[0] <= self.reach].T
        middle = (np.abs(p[:, 0]) <= self.width / 4 / self.diagonal) & (np.abs(p[:, 1]) <= self.height / 4 / self.diagonal)
        rows = _equations(p[residuals(best["deep"], p)[0] <= self.reach]).reshape(-1, 9)
        inside = residuals(best["flat"], p)[0] <= self.reach
        flat = np.array([len(x), x.sum(), y.sum(), u.sum(), v.sum(), (x * x + y * y).sum(), (x * u + y * v).sum(), (x * v - y * u).sum(), middle.sum(), (middle & inside).sum()])
        return {"flat_sums": flat, "deep_sums": (rows.T @ rows).ravel()}

    def fitted(self, sums: dict, best: dict) -> dict:
        """The similarity and homography of the least squares over the inliers."""
        n, x, y, u, v, square, dot, turn, middle, both = sums["flat_sums"]
        spread = square - (x * x + y * y) / max(n, 1)
        with np.errstate(all="ignore"):
            a, b = (dot - (x * u + y * v) / n) / spread, (turn - (x * v - y * u) / n) / spread
            flat = np.array([a, -b, (u - a * x + b * y) / n, b, a, (v - b * x - a * y) / n, 0, 0, 1])
        found = best["deep_n"][0] >= 4
        deep = np.linalg.eigh(sums["deep_sums"].reshape(9, 9))[1][:, 0] if found else best["deep"]
        with np.errstate(all="ignore"):
            deep = deep / deep[8]
        good = n >= max(2, self.min_inliers) and np.isfinite(flat).all()
        return {"flat": flat if good else np.full(9, np.nan), "deep": deep if found and np.isfinite(deep).all() else np.full(9, np.nan), "of": best["flat"], "counts": np.array([n, best["deep_n"][0], middle, both], np.float64)}

    def errors(self, table: pa.Table, fit: dict) -> dict:
        """Squared residuals of both fits over the inliers of the similarity that was found."""
        p = self.points(table)
        p = p[residuals(fit["of"], p)[0] <= self.reach]
        return {"errors": np.array([np.minimum(residuals(fit[k], p)[0], 1e300).sum() if np.isfinite(fit[k]).all() else 0.0 for k in ("flat", "deep")])}

    def in_pixels(self, m: np.ndarray) -> np.ndarray:
        """A model in pixels."""
        to = np.array([[1 / self.diagonal, 0, -self.width / 2 / self.diagonal], [0, 1 / self.diagonal, -self.height / 2 / self.diagonal], [0, 0, 1]])
        out = np.linalg.inv(to) @ m.reshape(3, 3) @ to
        return out / out[2, 2]


def _arrays(columns: dict[str, str]) -> str:
    return ", ".join(f"{k} array<{v}>" for k, v in columns.items())


def motions(matches: DataFrame, pairs: DataFrame, width: float, height: float, threshold: float = 3.0, min_matches: int = 8, min_inliers: int = 8, samples: int = 128) -> DataFrame:
    """The motion of each of pairs (stream, pair_no) by its matches (stream, pair_no, x_i, y_i, x_j, y_j), in the columns that operators.motion takes.

    The similarity with the most matches within threshold pixels among `samples`
    drawn ones is fitted again to these, its inliers; so is a homography of its
    own.  A pair fails with fewer than min_matches matches or min_inliers inliers,
    or with a scale that is no number from 0.5 to 2.  tx and ty are what the frame's centre
    moves by.  A match with a null counts for nothing; repeated ones count each.
    """
    c = _Consensus(width, height, threshold, samples, min_inliers)
    points = ["x_i", "y_i", "x_j", "y_j"]
    key = ["stream", "pair_no"]
    types = dict(pairs.dtypes)
    of_key = ", ".join(f"{k} {types[k]}" for k in key)
    rows = matches.select(*(F.col(k).cast(types[k]).alias(k) for k in key), *(F.col(p).cast("double").alias(p) for p in points))
    rows = rows.where(sum(F.abs(p) for p in points) < 4e9)  # none is null or beyond all frames
    flow = F.sqrt((F.col("x_j") - F.col("x_i")) ** 2 + (F.col("y_j") - F.col("y_i")) ** 2)
    flows = rows.groupBy(*key).agg(F.count("*").alias("n"), F.median(flow).alias("median"), F.avg(flow).alias("mean"), F.stddev_pop(flow).alias("spread"))
    enough = flows.where(F.col("n") >= min_matches)
    dealt = rows.join(enough.select(*key, "n"), key).withColumn("slot", F.xxhash64(*points)).withColumn("part", F.pmod("slot", F.ceil(F.col("n") / PART)))
    dealt = dealt.groupBy(*key, "part").agg(F.array_sort(F.collect_list(F.struct("slot", *points))).alias("m")).select(*key, "part", *(F.col(f"m.{x}").alias(x) for x in ("slot", *points)))

    def named(keys, found: dict) -> pa.Table:
        """One row: the key and an array for each thing found."""
        columns = {k: pa.array([v.as_py()], v.type) for k, v in zip([*key, "part"], keys, strict=False)}
        return pa.table(columns | {k: pa.array([np.asarray(v)]) for k, v in found.items()})

    def read(table: pa.Table, names) -> dict:
        return {k: np.asarray(table.column(k)[0].values) for k in names}

    def added(table: pa.Table, names) -> dict:
        return {k: np.sum([np.asarray(x.values) for x in table.column(k)], axis=0) for k in names}

    # A group is one row, or the few parts of a pair, so no Arrow batch is large.  What later steps need goes along, so each step is made once.
    def of_parts(state: DataFrame, run, out: dict[str, str], on: dict[str, str]) -> DataFrame:
        """Each part together with its pair's state, whose columns on go along."""
        both = dealt.join(state, key)
        return both.groupBy(*key, "part").applyInArrow(lambda keys, table: named(keys, run(table, state := read(table, on)) | state), f"{of_key}, part long, {_arrays(out | on)}")

    def of_pairs(found: DataFrame, run, sums: dict[str, str], on: dict[str, str], out: dict[str, str]) -> DataFrame:
        """What the parts of each pair add up to, with the pair's state."""
        return found.groupBy(*key).applyInArrow(lambda keys, table: named(keys, run(added(table, sums), read(table, on))), f"{of_key}, {_arrays(out)}")

    kinds = {"flat": "double", "deep": "double"}
    drawn = dealt.groupBy(*key, "part").applyInArrow(lambda keys, table: named(keys, c.drawn(table)), f"{of_key}, part long, {_arrays({'hashes': 'long', 'points': 'double'})}")
    models = drawn.groupBy(*key).applyInArrow(lambda keys, table: named(keys, c.models(table)), f"{of_key}, {_arrays(kinds)}")
    counted = {f"{k}_{x}": "long" if x == "n" else "double" for k in kinds for x in "nr"}
    chosen = kinds | {"flat_n": "long", "deep_n": "long"}
    best = of_pairs(of_parts(models, c.scores, counted, kinds), c.best, counted, kinds, chosen)
    summed = {"flat_sums": "double", "deep_sums": "double"}
    fit = kinds | {"of": "double", "counts": "double"}
    fitted = of_pairs(of_parts(best, c.sums, summed, chosen), c.fitted, summed, chosen, fit)
    wrong = {"errors": "double"}
    pixels = lambda sums, fit: sums | {"counts": fit["counts"], "flat": c.in_pixels(fit["flat"]).ravel()[:6], "deep": c.in_pixels(fit["deep"]).ravel()}
    final = of_pairs(of_parts(fitted, c.errors, wrong, fit), pixels, wrong, fit, wrong | kinds | {"counts": "double"})
    return _described(pairs, flows, final, key, c, min_inliers)


def _described(pairs: DataFrame, flows: DataFrame, final: DataFrame, key: list[str], c: _Consensus, min_inliers: int) -> DataFrame:
    """The pairs' rows with their evidence; those of failed ones say so."""
    at = lambda column, i: F.get(column, F.lit(i))
    scale, turn = F.hypot(at("flat", 0), at("flat", 3)), F.degrees(F.atan2(at("flat", 3), at("flat", 0)))
    inliers, middle = at("counts", 0), at("counts", 2)
    ok = F.coalesce((inliers >= min_inliers) & ~F.isnan(scale) & scale.between(0.5, 2.0), F.lit(False))
    flat_there = ~F.isnan(at("deep", 0))
    rms = lambda i: F.sqrt(at("errors", i) / inliers)  # noqa: E731  in diagonals, as they are asked for
    moved = lambda i, size: at("flat", i) * (c.width / 2) + at("flat", i + 1) * (c.height / 2) + at("flat", i + 2) - size / 2

    def when(value: Column, otherwise) -> Column:
        return F.when(ok, value).otherwise(otherwise)

    rows = pairs.select(*key).distinct().join(flows, key, "left").join(final, key, "left")
    return rows.select(
        *key,
        ok.alias("success"),
        when(F.col("n").cast("double"), 0.0).alias("match_count"),
        when(inliers, 0.0).alias("inlier_count"),
        when(inliers / F.col("n"), 0.0).alias("inlier_ratio"),
        when(scale, 1.0).alias("scale_step"),
        when(turn, 0.0).alias("rotation_step_deg"),
        when(moved(0, c.width), 0.0).alias("tx"),
        when(moved(3, c.height), 0.0).alias("ty"),
        when(F.when(flat_there, F.greatest(F.lit(0.0), F.least(F.lit(1.0), rms(0) - rms(1)))).otherwise(0.0), 0.0).alias("perspective_error"),
        when(F.col("median") / (c.diagonal + EPS), 0.0).alias("flow_magnitude"),
        when(at("counts", 1) / F.col("n"), 0.0).alias("h_inlier_ratio"),
        when(F.when(F.col("mean") > EPS, F.col("spread") / (F.col("mean") + EPS)).otherwise(0.0), 0.0).alias("parallax_cv"),
        when(F.when(middle > 0, at("counts", 3) / middle).otherwise(inliers / F.col("n")), 0.0).alias("center_inlier_ratio"),
        F.when(ok, F.col("flat")).alias("affine"),
        F.when(ok & flat_there, F.col("deep")).alias("homography"),
    )
