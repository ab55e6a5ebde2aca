"""Hard negatives of anchor vectors by exact integer inner products, with most pairs left out early.

An anchor's positives are the rows of its label with the highest scores.  The
negatives of a positive are the rows of other labels with the highest scores
among those of a window below the positive's.

All vectors are rotated by an orthogonal matrix whose leading axes hold most of
the table's second moments (PCA without centring).  Partial products over
leading components plus the product of the norms of what remains (Cauchy and
Schwarz), plus slack for the rounding of 32-bit sums, bound a score from both sides.
Pairs that by these bounds cannot be among the best are dropped after each block
of components; those that are left are scored on the integers themselves.  The
rotation therefore decides how soon pairs go, never what is found.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from shotlake.llm import _blocks
from shotlake.llm._store import discard, kept, modest_batches

EXACT = 1 << 16  # pairs whose integer products are made at once
COLUMNS = 8192  # rows of a block that are looked at together


def second_moments(rows: DataFrame, dim: int) -> np.ndarray:
    """The sum over all rows of the outer products of their vectors; tasks add up theirs, then 64 of them, then one."""

    def own(batches):
        total = np.zeros((dim, dim))
        for b in batches:
            x = _blocks.matrix(b.column(0), dim)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    def added(batches):
        total = np.zeros((dim, dim))
        for b in batches:
            for m in b.column(0):
                total += np.frombuffer(m.as_buffer(), np.float64).reshape(dim, dim)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    first = rows.select("vector").mapInArrow(own, "m binary")
    found = first.repartition(64).mapInArrow(added, "m binary").repartition(1).mapInArrow(added, "m binary").first()
    return np.frombuffer(found["m"], np.float64).reshape(dim, dim) if found else np.zeros((dim, dim))


def rotation(moments: np.ndarray) -> np.ndarray:
    """An orthogonal matrix, axes of the largest moments first, as its columns."""
    scale = np.abs(moments).max() if moments.size else 0
    axes = np.linalg.eigh(moments / scale)[1][:, ::-1] if scale and np.isfinite(scale) else np.eye(len(moments))
    return np.linalg.qr(axes)[0]


@dataclass
class Rows:
    """Vectors of a block or batch: integers, rotated components, and norms of what remains after each block of these."""

    ids: np.ndarray
    labels: np.ndarray
    whole: np.ndarray
    turned: np.ndarray  # 32-bit
    rest: list[np.ndarray]
    norm: np.ndarray

    def part(self, a: int, b: int) -> Rows:
        return Rows(self.ids[a:b], self.labels[a:b], self.whole[a:b], self.turned[a:b], [x[a:b] for x in self.rest], self.norm[a:b])


class Bounds:
    """The rotation, cut into blocks of components."""

    def __init__(self, turn: np.ndarray, width: int = 16):
        self.turn, self.dim = turn, len(turn)
        self.cuts = list(range(min(width, self.dim), self.dim, width)) or [self.dim]

    def rows(self, table) -> Rows:
        """Of Arrow columns id, label and vector, in order of label."""
        column = table.column("vector")
        whole = _blocks.matrix(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, self.dim, np.int64)
        ids, labels = (np.asarray(table.column(c)) for c in ("id", "label"))
        order = np.argsort(labels, kind="stable")
        whole = whole[order]
        turned = whole.astype(np.float64) @ self.turn
        squares = np.cumsum(np.square(turned)[:, ::-1], axis=1)[:, ::-1]
        rest = [np.sqrt(squares[:, d]) if d < self.dim else np.zeros(len(whole)) for d in self.cuts]
        return Rows(ids[order], labels[order], whole, turned.astype(np.float32), rest, np.sqrt(squares[:, 0]) if self.dim else np.zeros(len(whole)))

    def steps(self, a: Rows, x: Rows):
        """(low, high) bounds of the scores of all pairs, tighter at each step."""
        slack = (2 * self.dim + 64) * 2.0**-24 * np.outer(a.norm, x.norm).astype(np.float32)
        total, at = np.zeros((len(a.ids), len(x.ids)), np.float32), 0
        for d, mine, other in zip(self.cuts, a.rest, x.rest, strict=True):
            total += a.turned[:, at:d] @ x.turned[:, at:d].T
            at = d
            beyond = np.outer(mine, other).astype(np.float32) * np.float32(1 + 1e-6) + slack
            yield total - beyond, total + beyond


def exact(a: Rows, x: Rows, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The integer inner products of the pairs (i, j)."""
    return np.concatenate([(a.whole[i[k : k + EXACT]] * x.whole[j[k : k + EXACT]]).sum(1) for k in range(0, len(i), EXACT)] or [np.zeros(0, np.int64)])


def _highest(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row; minus infinity where there are fewer."""
    return np.partition(values, -k, axis=1)[:, -k] if values.shape[1] >= k else np.full(len(values), -np.inf, values.dtype)


def _pieces(bounds: Bounds, block: Rows, asked: Rows):
    """(queries, rows, where the queries begin) in pieces of a bounded number of pairs."""
    for c in range(0, len(block.ids), COLUMNS):
        some = block.part(c, c + COLUMNS)
        step = max(1, _blocks.AT_ONCE // len(some.ids))
        for r in range(0, len(asked.ids), step):
            yield asked.part(r, r + step), some, r


def positives(bounds: Bounds, most: int):
    """(anchor, id, score): the `most` first rows of an anchor's label in a block, and more."""

    def run(batches):
        for m in _blocks.meetings(batches, ["part", "asked"], bounds.rows):
            asked = bounds.rows(pa.Table.from_batches([m.queries]))
            found = []
            for label in np.unique(asked.labels):
                mine, other = (x.part(*np.searchsorted(x.labels, [label, label + 1])) for x in (asked, m.block))
                for a, x, _ in _pieces(bounds, other, mine) if len(other.ids) else ():
                    alive = a.ids[:, None] != x.ids
                    for low, high in bounds.steps(a, x):
                        alive &= high >= _highest(np.where(alive, low, -np.inf), most)[:, None]
                    i, j = np.nonzero(alive)
                    found.append({"anchor": a.ids[i], "id": x.ids[j], "score": exact(a, x, i, j)})
                    keep = _blocks.best_of(found[-1], ["anchor"], most)
                    found[-1] = {c: v[keep] for c, v in found[-1].items()}
            if found:
                yield pa.RecordBatch.from_pydict({c: np.concatenate([f[c] for f in found]) for c in ("anchor", "id", "score")})

    return run


def negatives(bounds: Bounds, most: int, lowest: int, highest: int):
    """(anchor, place, id, score): for each positive the `most` first rows in its window in a block, and more."""

    def run(batches):
        for m in _blocks.meetings(batches, ["part", "asked"], bounds.rows):
            asked = bounds.rows(pa.Table.from_batches([m.queries]))
            order = np.argsort(np.asarray(m.queries.column(m.queries.schema.get_field_index("label"))), kind="stable")
            given = m.queries.column(m.queries.schema.get_field_index("scores")).take(pa.array(order))
            sizes = np.asarray(given.value_lengths())
            scores = _blocks.matrix(given, int(sizes.max()), np.int64)
            # Whole numbers s with lowest * p <= 100 * s <= highest * p, by hundreds and the rest, as 100 * p may not fit.
            hundreds, rest = np.divmod(scores, 100)
            floor, ceiling = lowest * hundreds - (-lowest * rest // 100), highest * hundreds + highest * rest // 100
            there = np.arange(scores.shape[1]) < sizes[:, None]
            for a, x, r in _pieces(bounds, m.block, asked):
                unlike = a.labels[:, None] != x.labels
                alive, here = unlike, slice(r, r + len(a.ids))
                for low, high in bounds.steps(a, x):
                    some = np.zeros_like(alive)
                    for k in range(scores.shape[1]):
                        least, top = (np.where(there[here, k], v[here, k], e).astype(np.float64) for v, e in ((floor, np.inf), (ceiling, -np.inf)))
                        inside = alive & (high <= top[:, None])
                        least = np.maximum(least, _highest(np.where(inside, low, -np.inf), most))
                        some |= (low <= top[:, None]) & (high >= least[:, None])
                    alive = alive & some
                i, j = np.nonzero(alive)
                score = exact(a, x, i, j)
                for k in range(scores.shape[1]):
                    fits = there[here, k][i] & (score >= floor[here, k][i]) & (score <= ceiling[here, k][i])
                    found = {"anchor": a.ids[i][fits], "id": x.ids[j][fits], "score": score[fits]}
                    keep = _blocks.best_of(found, ["anchor"], most)
                    if len(keep):
                        yield pa.RecordBatch.from_pydict({"anchor": found["anchor"][keep], "place": np.full(len(keep), k + 1, np.int32), "id": found["id"][keep], "score": found["score"][keep]})

    return run


def hard_negatives(rows: DataFrame, anchors: DataFrame, n_positives: int = 5, n_negatives: int = 3, lowest: int = 50, highest: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows and anchors (id, label, vector of whole numbers).

    An anchor's positives are the n_positives rows with another id and its
    label, higher inner products first, ties by id; a positive's negatives the
    n_negatives rows of another label with lowest * positive score <= 100 *
    score <= highest * positive score, in the same order.  Rows that share an id
    are rows of their own, copies too; anchors that share one are one, that with
    the smallest label and vector.  Vectors count as ending in zeros up to the
    longest.  Rows with a null take no part; empty tables give no rows.
    """
    spark = rows.sparkSession
    modest_batches(spark)
    rows = kept(rows.select("id", "label", "vector").dropna().withColumn("slot", _blocks.slot()), "negatives-rows")
    anchors = kept(anchors.select("id", "label", "vector").dropna().groupBy("id").agg(F.min(F.struct("label", "vector")).alias("x")).select("id", "x.label", "x.vector"), "negatives-anchors")
    n, dim = rows.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    asking, longest = anchors.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    dim = max(dim, longest, 1)
    bounds = Bounds(rotation(second_moments(rows, dim)))
    parts, asked = _blocks.blocks_of(n, dim), max(1, -(-asking * 8 * dim // (4 * _blocks.MOST)))

    def meet(queries: DataFrame, run, schema: str) -> DataFrame:
        there = _blocks.sent(rows.select("id", "label", "vector", F.pmod("slot", F.lit(parts)).cast("int").alias("part")), False, "asked", asked)
        here = _blocks.sent(queries.withColumn("asked", F.pmod(F.xxhash64("id"), F.lit(asked)).cast("int")), True, "part", parts)
        both = there.unionByName(here, allowMissingColumns=True).repartition("part", "asked").sortWithinPartitions("part", "asked", "asks")
        return both.mapInArrow(run, schema)

    def first(found: DataFrame, by: list[str], most: int, rank: str) -> DataFrame:
        """The best of all blocks; Spark keeps each task's best before it shuffles."""
        place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))
        return found.withColumn(rank, place).where(F.col(rank) <= most)

    good = kept(first(meet(anchors, positives(bounds, n_positives), "anchor long, id long, score long"), ["anchor"], n_positives, "place"), "negatives-positives")
    scores = good.groupBy("anchor").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "score"))), lambda x: x["score"]).alias("scores"))
    asks = anchors.join(scores.withColumnRenamed("anchor", "id"), "id")
    bad = first(meet(asks, negatives(bounds, n_negatives, lowest, highest), "anchor long, place int, id long, score long"), ["anchor", "place"], n_negatives, "rank")
    named = good.select("anchor", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = bad.join(named, ["anchor", "place"]).select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    out = kept(out, "negatives")
    discard(rows, anchors, good)
    return out


def whole_numbers(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256) -> DataFrame:
    """(id, label, vector): each component x as floor(scale * x), x as double.

    Rows with a null id, label or vector, or a null or non-finite component,
    are left out; so are those with a component so large that inner products
    could pass a 64-bit integer (at 64 components, 2^28 after scaling).
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & _blocks.finite("vector"))
    largest = F.least(F.sqrt(F.lit(2.0**62) / F.size("vector")), F.lit(2.0**31 - 1))
    rows = rows.where(F.forall("vector", lambda x: F.abs(x * scale) < largest))
    return rows.withColumn("vector", F.transform("vector", lambda x: F.floor(x * scale).cast("int")))
