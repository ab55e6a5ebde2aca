"""Approximate nearest neighbours by cosine: probed lists, scanned in column blocks with hypothesis tests.

Every row belongs to the list of its nearest centre.  Centres are fitted on a
bounded sample of the table, and on the same sample it is counted how many lists, in
order of their centres' nearness to a query, hold the wished share of true
neighbours; so many are probed.  Lists are dealt into blocks of a bounded size.

Unit vectors are rotated by one random orthogonal matrix.  Then the squared
distance over the first d of D components is a Beta(d/2, (D-d)/2) share of the
whole.  Within a probed block, distances add up over blocks of columns; after each,
a pair is given up if so large a partial distance has at most the chance `alpha`
for a pair as near as the query's k-th best so far.  What is left
gets its exact cosine in double precision from the original vectors.

A query's nearest list is scanned first, then rounds of eight times as many
lists, so that most blocks are scanned with a near-final k-th best.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from shotlake.llm import _blocks
from shotlake.llm._store import discard, kept, modest_batches

COLUMNS = 4096  # rows of a block that are looked at together
EXACT = 1 << 15  # pairs whose exact cosines are made at once
LISTS = 1024  # at most


def scaled(x: np.ndarray) -> np.ndarray:
    """Vectors times powers of two that bring their largest component near one, which changes no cosine."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0))[1][:, None])


def cosines(x: np.ndarray, y: np.ndarray, xx: np.ndarray, yy: np.ndarray) -> np.ndarray:
    """Cosines of rows of x with those of y in double precision; xx and yy are the rows' products with themselves.

    Each row is added up in one way, so equal vectors get equal cosines wherever they lie.
    """
    return (x * y).sum(1) / np.sqrt(xx * yy)


def beta_limit(d: int, dim: int, alpha: float) -> float:
    """What a Beta(d/2, (dim-d)/2) variable exceeds with chance alpha, by the trapezoid rule over its arcsine."""
    angle = np.linspace(0, math.pi / 2, 1 << 14)[1:-1]
    log = (d - 1) * np.log(np.sin(angle)) + (dim - d - 1) * np.log(np.cos(angle))
    weight = np.exp(log - log.max())
    beyond = np.cumsum(weight[::-1])[::-1] / weight.sum()
    return float(np.sin(angle[np.searchsorted(-beyond, -alpha)]) ** 2) if beyond[-1] < alpha else 1.0


@dataclass
class Index:
    """What has been fitted: the rotation, centres of the lists, how many lists to probe, and the test's limits."""

    turn: np.ndarray
    centres: np.ndarray
    probes: int
    cuts: list[int]
    limits: list[float]  # the largest share of a distance that the first components may have

    @property
    def dim(self) -> int:
        return len(self.turn)

    def near(self, unit: np.ndarray) -> np.ndarray:
        """Nearness of each vector to each centre."""
        return unit.astype(np.float32) @ self.centres.T


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.square(x).sum(1, keepdims=True))


def fit_centres(unit: np.ndarray, lists: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Unit centres by k-means on the sphere, begun at sample vectors."""
    rng = np.random.default_rng(seed)
    unit = unit.astype(np.float32)
    centres = unit[rng.permutation(len(unit))[:lists]]
    for _ in range(rounds):
        own = np.concatenate([(unit[i : i + 4096] @ centres.T).argmax(1) for i in range(0, len(unit), 4096)])
        order = np.argsort(own, kind="stable")
        at = np.flatnonzero(np.append(True, np.diff(own[order]) > 0))
        centres = centres.copy()
        centres[own[order][at]] = np.add.reduceat(unit[order], at)
        norm = np.sqrt(np.square(centres).sum(1, keepdims=True))
        centres = centres / np.where(norm > 0, norm, 1)
    return centres


def probes_for(unit: np.ndarray, centres: np.ndarray, k: int, recall: float) -> int:
    """How many of the nearest lists hold the share `recall` of the k true neighbours of sample vectors within the sample."""
    unit = unit.astype(np.float32)
    own = np.concatenate([(unit[i : i + 4096] @ centres.T).argmax(1) for i in range(0, len(unit), 4096)])
    k, needed = min(k, len(unit) - 1), []
    if not k:
        return 1
    for asked in np.array_split(np.linspace(0, len(unit) - 1, min(1024, len(unit))).astype(int), 16):
        rank = np.argsort(np.argsort(-(unit[asked] @ centres.T), axis=1, kind="stable"), axis=1)
        near = unit[asked] @ unit.T
        near[np.arange(len(asked)), asked] = -np.inf
        found = np.argpartition(-near, k - 1, axis=1)[:, :k]
        needed.append(rank[np.arange(len(asked))[:, None], own[found]].ravel())
    needed = np.sort(np.concatenate(needed))
    return int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)))]) + 1


def fit(rows: DataFrame, n: int, dim: int, k: int, recall: float, alpha: float, sample: int, seed: int = 7) -> Index:
    """Fits the index on at most `sample` rows, drawn by a hash of the row, each distinct vector once."""
    share = min(1.0, 2.0 * sample / max(1, n))
    drawn = rows.select(F.xxhash64("id", "vector", F.lit(seed)).alias("h"), "vector").where(F.pmod("h", F.lit(1 << 30)) <= int(share * (1 << 30))).orderBy("h").limit(sample)
    some = drawn.select("vector").toArrow().column(0).combine_chunks()
    unit = unit_rows(scaled(np.unique(_blocks.matrix(some, dim), axis=0))) if len(some) else np.zeros((0, dim))
    turn = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))[0]
    width = max(8, -(-dim // 8))
    cuts = [*range(width, dim, width), dim]
    limits = [beta_limit(d, dim, alpha) if d < dim else 1.0 for d in cuts]
    lists = max(1, min(LISTS, len(unit), round(math.sqrt(n) / 4)))
    centres = fit_centres(unit, lists, seed=seed) if len(unit) else np.ones((1, dim), np.float32)
    return Index(turn, centres, probes_for(unit, centres, k, recall) if len(unit) > 1 else 1, cuts, limits)


@dataclass
class Block:
    ids: np.ndarray
    whole: np.ndarray
    own: np.ndarray  # products with themselves
    columns: list[np.ndarray]  # rotated unit vectors, a block of components each
    lengths: list[np.ndarray]  # squared, of the components so far

    def part(self, a: int, b: int) -> Block:
        return Block(self.ids[a:b], self.whole[a:b], self.own[a:b], [x[:, a:b] for x in self.columns], [x[a:b] for x in self.lengths])


def block_of(index: Index, table) -> Block:
    column = table.column("vector")
    whole = scaled(_blocks.matrix(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, index.dim))
    turned = (unit_rows(whole) @ index.turn).astype(np.float32)
    columns = [np.ascontiguousarray(turned[:, a:b].T) for a, b in zip([0, *index.cuts], index.cuts)]  # noqa: B905
    lengths = np.cumsum([np.square(c).sum(0) for c in columns], axis=0)
    return Block(np.asarray(table.column("id")), whole, (whole * whole).sum(1), columns, list(lengths))


def scan(index: Index, block: Block, asked: Block, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, cosine) of the pairs that may be among the k best; least has each query's k-th best cosine so far."""
    slack = np.float32(1e-6 * (8 + index.dim**0.5))
    reach = np.maximum(0, 2 - 2 * least).astype(np.float32)[:, None]  # the squared distance of that cosine
    alive = asked.ids[:, None] != block.ids
    products, rows = np.zeros(alive.shape, np.float32), np.arange(len(block.ids))
    for step, limit in enumerate(index.limits):
        products += asked.columns[step].T @ block.columns[step][:, rows]
        partial = asked.lengths[step][:, None] + block.lengths[step][rows] - 2 * products
        alive &= partial <= limit * reach + slack
        some = alive.any(0)
        if step + 1 < len(index.limits) and 2 * np.count_nonzero(some) < len(rows):  # later columns of given-up rows are not touched
            rows, alive, products = rows[some], alive[:, some], products[:, some]
    if len(rows) > k:
        near = np.where(alive, products, -np.inf)
        alive &= near >= np.partition(near, -k, axis=1)[:, -k][:, None] - slack
    i, j = np.nonzero(alive)
    j = rows[j]
    score = np.concatenate([cosines(asked.whole[i[c : c + EXACT]], block.whole[j[c : c + EXACT]], asked.own[i[c : c + EXACT]], block.own[j[c : c + EXACT]]) for c in range(0, len(i), EXACT)] or [np.zeros(0)])
    good = score >= least[i]
    return i[good], j[good], score[good]


def _listed(index: Index):
    """(id, vector, slot, list) of rows (id, vector, slot)."""

    def run(batches):
        for b in batches:
            near = index.near(unit_rows(scaled(_blocks.matrix(b.column(1), index.dim))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.argmax(1), pa.int32())], ["id", "vector", "slot", "list"])

    return run


def _probing(index: Index, first: int, last: int):
    """Queries (id, vector, least), once for each of their first to last nearest lists."""

    def run(batches):
        for batch in batches:
            for c in range(0, batch.num_rows, 64):
                b = batch.slice(c, 64)
                near = index.near(unit_rows(scaled(_blocks.matrix(b.column(1), index.dim))))
                lists = np.argsort(-near, axis=1, kind="stable")[:, first:last]
                again = b.take(pa.array(np.repeat(np.arange(b.num_rows), lists.shape[1])))
                yield pa.RecordBatch.from_arrays([*again.columns, pa.array(lists.ravel(), pa.int32())], ["id", "vector", "least", "list"])

    return run


def _scanning(index: Index, k: int):
    def run(batches):
        for m in _blocks.meetings(batches, ["list", "part", "asked"], lambda table: block_of(index, table)):
            asked, least = block_of(index, m.queries), np.asarray(m.queries.column(m.queries.schema.get_field_index("least")))
            for c in range(0, len(m.block.ids), COLUMNS):
                some = m.block.part(c, c + COLUMNS)
                step = max(1, _blocks.AT_ONCE // len(some.ids))
                for r in range(0, len(asked.ids), step):
                    i, j, score = scan(index, some, asked.part(r, r + step), least[r : r + step], k)
                    found = {"query": asked.ids[r : r + step][i], "id": some.ids[j], "score": score}
                    keep = _blocks.best_of(found, ["query"], k)
                    if len(keep):
                        yield pa.RecordBatch.from_pydict({c: v[keep] for c, v in found.items()})

    return run


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = 0.99, alpha: float = 1e-5, sample: int = 32768) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows found nearest to each query by cosine, all if there are fewer.

    Ties go to the smaller id.  A query does not meet rows of its own id.  Rows
    that share an id are rows of their own, copies too; queries that share one
    are one, with the smallest of their vectors.  Null, zero and non-finite
    vectors and those with a null component take no part, nor do rows
    without an id; shorter vectors count as ending in zeros.  Empty tables give
    no rows; other columns are left out.

    recall is the share of true neighbours that the probed lists are to hold, as
    measured on the sample of at most `sample` rows; alpha is the chance that a test gives up a
    neighbour.  Every row is indexed, and a query that finds fewer than
    k rows there goes on through all other lists.
    """
    spark = rows.sparkSession
    modest_batches(spark)

    def valid(df: DataFrame) -> DataFrame:
        kind = "array<float>" if df.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
        df = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("vector"))
        return df.where(F.col("id").isNotNull() & _blocks.finite("vector") & F.exists("vector", lambda x: x != 0))

    plain = kept(valid(rows).withColumn("slot", _blocks.slot()), "nearest-rows")
    asks = kept(valid(queries).groupBy("id").agg(F.min("vector").alias("vector")), "nearest-queries")
    n, dim = plain.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    asking, longest = asks.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    index = fit(plain, n, max(dim, longest, 1), k, recall, alpha, sample)
    lists, dim = len(index.centres), index.dim

    listed = kept(plain.mapInArrow(_listed(index), f"id long, vector {plain.schema['vector'].dataType.simpleString()}, slot long, list int"), "nearest-lists")
    sizes = dict(listed.groupBy("list").count().collect())  # at most LISTS rows
    parts = F.element_at(F.array(*(F.lit(max(1, -(-sizes.get(i, 0) * 8 * dim // _blocks.MOST))) for i in range(lists))), F.col("list") + 1)
    asked = max(1, -(-asking * 8 * dim // (4 * _blocks.MOST)))
    there = _blocks.sent(listed.select("id", "vector", "list", F.pmod("slot", parts).cast("int").alias("part")), False, "asked", asked)
    best = None

    def round_of(queries: DataFrame, first: int, last: int) -> None:
        """Scans the queries' first to last nearest lists and adds what it finds to best."""
        nonlocal best
        here = queries.select("id", "vector", "least").mapInArrow(_probing(index, first, last), f"id long, vector {queries.schema['vector'].dataType.simpleString()}, least double, list int")
        here = here.withColumn("asks", F.lit(1)).withColumn("asked", F.pmod(F.xxhash64("id"), F.lit(asked)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
        both = there.unionByName(here, allowMissingColumns=True).repartition("list", "part", "asked").sortWithinPartitions("list", "part", "asked", "asks")
        found = both.mapInArrow(_scanning(index, k), "query long, id long, score double")
        ranked = (found if best is None else found.union(best)).withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
        before, best = best, kept(ranked.drop("rank"), "nearest-found")
        if before is not None:
            discard(before)

    def state() -> DataFrame:
        """Queries with their k-th best cosine so far, and how many rows they have found."""
        if best is None:
            return asks.withColumn("least", F.lit(-2.0)).withColumn("n", F.lit(0).cast("long"))
        so_far = best.groupBy(F.col("query").alias("id")).agg(F.count("*").alias("n"), F.min("score").alias("low"))
        return asks.join(so_far, "id", "left").select("id", "vector", F.when(F.col("n") >= k, F.col("low")).otherwise(-2.0).alias("least"), F.coalesce("n", F.lit(0)).alias("n"))

    first, last = 0, 1
    while first < index.probes:
        round_of(state(), first, min(last, index.probes))
        first, last = min(last, index.probes), last * 8
    if index.probes < lists and n > k:
        few = kept(state().where(F.col("n") < k), "nearest-few")
        if few.limit(1).count():
            round_of(few, index.probes, lists)
        discard(few)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    out = kept(best.select(F.col("query").alias("query_id"), rank.alias("rank"), F.col("id").alias("vec_id"), "score"), "nearest")
    discard(plain, asks, listed, best)
    return out
