"""N-gram Jaccard self-join by universe partition and the pigeonhole principle.

Sets of hashed word n-grams.  Two sets r and s with J >= t differ in at most
H = (1-t)/(1+t) * (|r|+|s|) elements.  A size band k holds the pairs whose
smaller set has a size in [b_k, b_{k+1}), so H is known for the band.  The
universe of hashes is cut into equal ranges ("segments"); r and s are cut with
it.  Segment i is allotted a slack T_i: 0 (the subsets must be equal) or 1
(they may differ by one deletion).  With sum(T_i + 1) > H, some segment of each
qualifying pair meets its slack, so a set is indexed under its segment subsets
and, where T_i = 1, under these with each one element deleted.  The allocation
(how many segments of either kind) is chosen for each band by cost: keys
emitted plus expected accidental meetings.

A band has `spare` more segments than that, so a qualifying pair meets in at
least spare + 1 of them.  All keys have one order, from the most to the least
frequent, and a set leaves out its `spare` first keys of a band.  A pair that
meets in spare + 1 keys still meets in the last of these, so nothing is lost,
while empty subsets and those made of stock phrases, which are the frequent
ones, bring nobody together.

Sets that are equal are one node.  Nodes that share a key are compared in
turns.  In a turn each key has one hub, a node of the component that has most
of the key's nodes, and the nodes of other components are compared with it; the
links found join components.  Turns go on, with other hubs, while the number of
pairs that are still apart falls; then these pairs are compared if their
sketches allow a link.  So a group of near copies costs a few comparisons for
each member, not all pairs, and no link that could join two components is missed.

A sketch has a bit for the parity of each bin of the universe, so two sets
differ in at least as many members as their sketches in bits.  Pairs are first
sifted by sketches of 512 bits, then those of larger sets by sketches of two to four
bits a member, which leave only pairs near the threshold; their texts are fetched
and compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from shotlake.llm._components import components
from shotlake.llm._store import discard, kept, modest_batches
from shotlake.llm._text import U64, mix, mix_int, ngrams, slices, words

EMPTY = np.zeros(0, U64)
TILE = 512  # nodes of a key that one task compares with as many others
STAR = 256  # nodes that are compared with one copy of a hub's text
SEEN = 1 << 18  # nodes that a task remembers, so as to send each once
PARITY = [f"p{i}" for i in range(8)]
SHORT = 32 * len(PARITY)  # members of a set for which these bits are two a member


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted set of hashed n-grams of each text; a text of fewer words has one, of all its words."""
    w = words(column)
    grams = ngrams(w.hash, n)
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        if b - a >= n:
            s = np.sort(grams[a : b - n + 1])
            yield s[np.append(True, s[1:] != s[:-1])]
        elif b > a:
            yield ngrams(w.hash[a:b], int(b - a)) + U64(b - a)
        else:
            yield EMPTY


def node_of(s: np.ndarray) -> int:
    """A 63-bit name of a set, the same for equal sets."""
    return mix_int(int(mix(s).sum(dtype=U64)) + 31 * int(np.bitwise_xor.reduce(mix(s ^ U64(0xABCDEF)))) + len(s)) >> 1


@dataclass(frozen=True)
class Band:
    """The segments for pairs whose smaller set has a size in [low, high)."""

    k: int
    low: int
    high: int
    most: int  # size of the largest partner
    exact: int  # segments with T = 0
    near: int  # segments with T = 1, of double width
    spare: int

    @property
    def cuts(self) -> np.ndarray:
        return _cuts(self.near, self.exact)


@lru_cache(None)
def _cuts(near: int, exact: int) -> np.ndarray:
    widths = np.array([2.0] * near + [1.0] * exact)
    edges = np.cumsum(widths)[:-1] / widths.sum() * 2.0**64
    return np.array([int(x) for x in edges], U64)


def _beyond(mean: float, most: int) -> float:
    """The chance that a Poisson count of this mean is over most."""
    return max(0.0, 1.0 - sum(math.exp(i * math.log(mean) - mean - math.lgamma(i + 1)) for i in range(most + 1)))


@lru_cache(None)
def bands(numerator: int, denominator: int, largest: int) -> tuple[Band, ...]:
    """Bands up to a size, each with its cheapest allocation for t = numerator / denominator."""
    out, low, k = [], 1, 0
    t = numerator / denominator
    while low <= largest:
        high = max(low + 1, int(low / t))
        small = high - 1
        most = small * denominator // numerator
        h = (denominator - numerator) * (small + most) // (denominator + numerator)
        best = None
        for near in sorted({0, h // 2 + 1, *(1 << i for i in range((h // 2 + 1).bit_length()))}):
            exact = max(0, h + 1 - 2 * near)
            for spare in sorted({0, 1, 2, 3, 4, 6, 8, 10, 13, 16, *(h // i for i in (16, 12, 8, 6, 5, 4, 3, 2))}):
                if spare and exact == 0:
                    continue
                fill = low / (2 * near + exact + spare)
                keys = exact + spare + near + (2 * fill * near)
                blank, thin = math.exp(-fill), math.exp(-2 * fill) * (1 + 2 * fill)
                over = _beyond(blank * (exact + spare), spare) if exact else 0.0
                cost = keys * (1 + 200 * (over + near * thin))
                if best is None or cost < best[0]:
                    best = (cost, near, exact + spare, spare)
        out.append(Band(k, low, high, most, best[2], best[1], best[3]) if h else Band(k, low, high, most, 0, 0, 0))
        low, k = high, k + 1
    return tuple(out)


def keys_of(s: np.ndarray, table: tuple[Band, ...], lows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, band, spare): the index keys of a set in its own band and in the band below, where it may be the larger one.

    spare is how many keys of that band may be left out, or -1 for a key of a segment with slack, which never may.
    """
    keys, band_of, spare = [EMPTY], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    own = int(np.searchsorted(lows, len(s), "right")) - 1
    values = mix(s)
    total = np.zeros(len(s) + 1, U64)
    np.cumsum(values, out=total[1:])
    for band in table[max(0, own - 1) : own + 1] if len(s) else ():
        if len(s) > band.most or not band.exact + band.near:
            continue
        edges = np.concatenate(([0], np.searchsorted(s, band.cuts), [len(s)]))
        names = mix(np.arange(len(edges) - 1, dtype=U64) + U64(band.k << 32))
        whole = total[edges[1:]] - total[edges[:-1]]
        keys.append(mix(whole + names))
        spare.append(np.repeat([-1, band.spare], [band.near, band.exact]))
        if band.near:
            inside = slice(0, edges[band.near])
            seg = np.repeat(np.arange(band.near), np.diff(edges[: band.near + 1]))
            keys.append(mix(whole[seg] - values[inside] + names[seg]))
            spare.append(np.full(len(seg), -1))
        band_of.append(np.full(len(keys[-1]) + (band.near + band.exact if band.near else 0), band.k))
    return np.concatenate(keys), np.concatenate(band_of).astype(np.int32), np.concatenate(spare).astype(np.int32)


def parities(s: np.ndarray, bins: int) -> np.ndarray:
    """Bit i tells whether an odd number of members falls in bin i; as 64-bit numbers.

    bins is a power of two, and halving it folds the upper half onto the lower.
    """
    odd = np.bincount((mix(s) & U64(bins - 1)).astype(np.int64), minlength=bins) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def wide(s: np.ndarray) -> np.ndarray | None:
    """Parities of a larger set at two to four bits a member; None for a set for which PARITY has so many."""
    return parities(s, 1 << int(2 * len(s) - 1).bit_length()) if len(s) > SHORT else None


def _nodes(n: int):
    """(id, n_shingles, node) of each row (id, text), and where its node is new to the task its text, packed, and parity bits."""

    def run(batches):
        press, seen = zstandard.ZstdCompressor(level=1), set()
        for b in slices(batches, "text"):
            sets = list(shingle_sets(b.column(1), n))
            nodes = [node_of(s) if len(s) else None for s in sets]
            new, bits, wider = np.zeros(len(sets), bool), np.zeros((len(sets), len(PARITY)), np.int64), [None] * len(sets)
            for i, (node, s) in enumerate(zip(nodes, sets, strict=True)):
                if node is not None and node not in seen:
                    seen.add(node)
                    new[i] = True
                    bits[i], wider[i] = parities(s, 64 * len(PARITY)), wide(s)
            packed = [press.compress(x.as_buffer()) if one else None for x, one in zip(b.column(1).cast(pa.binary()), new, strict=True)]
            parity = [pa.array(np.ascontiguousarray(p), mask=~new) for p in bits.T]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()), pa.array(packed, pa.binary()), *parity, pa.array(wider, pa.list_(pa.int64()))], ["id", "n_shingles", "node", "packed", *PARITY, "wide"])
            if len(seen) > SEEN:
                seen.clear()

    return run


def _keyed(n: int, numerator: int, denominator: int):
    """(key, node, band, spare) of the rows (id, text), a node once in a task."""

    def run(batches):
        table, seen = bands(numerator, denominator, 1 << 14), set()
        for b in slices(batches, "text"):
            lows, found, nodes = np.array([x.low for x in table]), [], []
            for s in shingle_sets(b.column(1), n):
                node = node_of(s) if len(s) else None
                if node is None or node in seen:
                    continue
                seen.add(node)
                if len(s) >= table[-1].low:
                    table = bands(numerator, denominator, 2 * len(s))
                    lows = np.array([x.low for x in table])
                found.append(keys_of(s, table, lows))
                nodes.append(np.full(len(found[-1][0]), node))
            for i in range(0, len(found), 256):
                keys, band, spare = (np.concatenate(x) for x in zip(*found[i : i + 256], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.concatenate(nodes[i : i + 256])), pa.array(band), pa.array(spare)], ["key", "node", "band", "spare"])
            if len(seen) > SEEN:
                seen.clear()

    return run


def _buckets(docs: DataFrame, n: int, numerator: int, denominator: int) -> DataFrame:
    """(key, node): the keys that nodes share, without those that each leaves out."""
    keyed = docs.mapInArrow(_keyed(n, numerator, denominator), "key long, node long, band int, spare int")
    shared = keyed.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.count("*").alias("n"))
    shared = kept(shared.where("first <> last").select("key", "n"), "jaccard-keys")
    ranked = keyed.join(shared, "key").withColumn("place", F.dense_rank().over(Window.partitionBy("node", "band").orderBy(F.desc("n"), "key")))
    buckets = kept(ranked.where("place > spare").select("key", "node").distinct(), "jaccard-buckets")
    discard(shared)
    return buckets


def _verified(pairs: DataFrame, held: DataFrame, n: int, numerator: int, denominator: int) -> DataFrame:
    """pairs (hub, node, star) with linked: whether denominator * |hub & node| >= numerator * |hub | node|, on the sets of their whole texts.

    A hub's text is sent once for each of its stars, and a node's once for each of its pairs.
    """

    def run(batches):
        undo, hub, own = zstandard.ZstdDecompressor(), None, None
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                b = batch.slice(i, 64)
                texts = pa.array([undo.decompress(x.as_buffer()) for x in b.column(3)], pa.binary()).cast(pa.string())
                out = []
                for h, x, s in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), shingle_sets(texts, n), strict=True):
                    if x is None:
                        hub, own = h, s
                        continue
                    if h != hub:
                        raise RuntimeError("a node arrived before its hub")
                    both = len(np.intersect1d(own, s, assume_unique=True))
                    out.append((h, x, denominator * both >= numerator * (len(own) + len(s) - both)))
                columns = list(zip(*out, strict=True)) if out else [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.bool_())], ["hub", "node", "linked"])

    members = pairs.join(held.select("node", "packed"), "node").select("hub", "star", "node", "packed")
    hubs = pairs.select("hub", "star").distinct().join(held.select(F.col("node").alias("hub"), "packed"), "hub").select("hub", "star", F.lit(None).cast("long").alias("node"), "packed")
    return hubs.union(members).repartition("hub", "star").sortWithinPartitions("hub", "star", "node").mapInArrow(run, "hub long, node long, linked boolean")


def _tiled(at: DataFrame, hubs: DataFrame, sketch: DataFrame) -> DataFrame:
    """(bucket, node, component, own, other, sketch): where nodes that are still apart meet, in tiles of a bounded size.

    Nodes meet in each key that they share; a group of near copies shares
    many, so there keys with the same largest component are one bucket, if
    that has no more pairs than its keys have.
    """
    met = at.join(hubs.select("key", "of"), "key")
    width = met.select("of", "node").distinct().groupBy("of").agg(F.count("*").alias("width"))
    pairs = hubs.groupBy("of").agg(F.sum((F.col("n") * F.col("n") - F.col("joined")) / 2).alias("pairs"))
    # The width is attached to keys, which are far fewer than the nodes that meet in them; it is written first, so that Spark can split a component of many keys.
    dense = kept(width.join(pairs, "of").where("width * width / 2 <= pairs").select("of", "width"), "jaccard-widths")
    met = at.join(hubs.select("key", "of", "n").join(dense, "of", "left"), "key")
    bucket = F.when(F.col("width").isNotNull(), F.xxhash64(F.lit("of"), "of")).otherwise(F.xxhash64(F.lit("key"), "key"))
    tiles = F.ceil(F.coalesce("width", "n") / TILE)
    met = met.select(bucket.alias("bucket"), "node", "component", tiles.alias("tiles")).distinct().join(sketch, "node").withColumn("own", F.pmod(F.xxhash64("node"), F.col("tiles")))
    met = kept(met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))), "jaccard-tiles")
    discard(dense)
    return met


def _components(buckets: DataFrame, held: DataFrame, n: int, numerator: int, denominator: int, most_turns: int) -> DataFrame:
    """(node, component) for the nodes of buckets."""
    sketch, wider = held.drop("packed", "wide"), held.where("wide is not null").select("node", "wide", "size")

    # Sketches of two nodes that link differ in no more bits than their sets may differ in members; so no link is lost here.
    differ = sum(F.bit_count(F.col(f"{p}_a").bitwiseXOR(F.col(f"{p}_b"))) for p in PARITY)
    may_link = lambda differ: differ * (denominator + numerator) <= (denominator - numerator) * (F.col("size_a") + F.col("size_b"))
    fits = may_link(differ) & (F.least("size_a", "size_b") * denominator >= numerator * F.greatest("size_a", "size_b"))
    large = (F.least("size_a", "size_b") > SHORT).alias("large")

    def sifted(pairs: DataFrame) -> DataFrame:
        """The pairs (hub, node, large) that also the wide sketches of large sets allow to link, as (hub, node)."""
        half = lambda w: F.shiftright(F.size(w), 1)
        halved = lambda w: F.zip_with(F.slice(w, F.lit(1), half(w)), F.slice(w, half(w) + 1, half(w)), lambda x, y: x.bitwiseXOR(y))
        a, b = (F.when(F.size(x) > F.size(y), halved(F.col(x))).otherwise(F.col(x)) for x, y in (("wide_a", "wide_b"), ("wide_b", "wide_a")))
        apart = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
        side = lambda c: wider.select(F.col("node").alias(c[0]), F.col("wide").alias(f"wide_{c[1]}"), F.col("size").alias(f"size_{c[1]}"))
        both = pairs.where("large").select("hub", "node").join(side(("hub", "a")), "hub").join(side(("node", "b")), "node")
        return pairs.where("not large").select("hub", "node").union(both.where(F.coalesce(may_link(apart), F.lit(True))).select("hub", "node"))  # null: more than one doubling apart, at thresholds below a half

    def sided(df: DataFrame, side: str, *columns: str) -> DataFrame:
        return df.select(*(F.col(c).alias(f"{c}_{side}") for c in ("node", *columns, "size", *PARITY)))

    named = kept(held.select("node", F.col("node").alias("component")), "jaccard-components")
    checked, before = [], None
    for turn in range(most_turns + 1):
        at = buckets.join(named, "node")
        least = F.min(F.struct(F.xxhash64("node", F.lit(turn)), "node"))["node"]
        hubs = at.groupBy("key", "component").agg(F.count("*").alias("n"), least.alias("hub")).groupBy("key")
        hubs = hubs.agg(F.max(F.struct("n", "component", "hub")).alias("x"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("joined"), F.count("*").alias("k"))
        hubs = kept(hubs.where("k > 1").select("key", "x.hub", F.col("x.component").alias("of"), "n", "joined"), "jaccard-hubs")
        rows, apart = hubs.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("joined")) / 2), F.lit(0.0))).first()
        if not rows:
            discard(hubs)
            break
        last = turn == most_turns or apart <= 2 * rows or (turn > 1 and apart > 0.9 * before)
        before = apart
        if last:
            tiled = _tiled(at, hubs, sketch)
            x, y = sided(tiled, "a", "bucket", "component", "own", "other"), sided(tiled, "b", "bucket", "component", "own", "other")
            here = (F.col("bucket_a") == F.col("bucket_b")) & (F.col("own_a") == F.col("other_b")) & (F.col("other_a") == F.col("own_b"))
            pairs = x.join(y, here & (F.col("node_a") < F.col("node_b")) & (F.col("component_a") != F.col("component_b")) & fits).select(F.col("node_a").alias("hub"), F.col("node_b").alias("node"), large).distinct()
        else:
            pairs = at.join(hubs, "key").where("component <> of").groupBy("node", "hub").count()
            if turn == 0:  # the hub with which a node shares most keys
                pairs = pairs.groupBy("node").agg(F.max_by("hub", F.struct("count", "hub")).alias("hub"))
            pairs = pairs.join(sided(sketch, "a"), F.col("node") == F.col("node_a")).join(sided(sketch, "b"), (F.col("hub") == F.col("node_b")) & fits).select("hub", "node", large)
        for past in checked:
            pairs = pairs.join(past.select(F.least("hub", "node").alias("x"), F.greatest("hub", "node").alias("y")), (F.least("hub", "node") == F.col("x")) & (F.greatest("hub", "node") == F.col("y")), "left_anti")
        met = kept(pairs, "jaccard-met")
        pairs = kept(sifted(met), "jaccard-pairs")
        discard(met, *([tiled] if last else []))
        stars = F.pmod(F.xxhash64("node"), F.ceil(F.col("count") / STAR)).alias("star")
        starred = pairs.join(pairs.groupBy("hub").count(), "hub").select("hub", "node", stars)
        checked.append(kept(_verified(starred, held, n, numerator, denominator), "jaccard-links"))
        links = checked[-1].where("linked")
        links = links.join(named.withColumnRenamed("component", "b"), "node").join(named.select(F.col("node").alias("hub"), F.col("component").alias("a")), "hub").select("a", "b")
        joined = components(links)
        old, named = named, kept(named.join(joined.select(F.col("node").alias("component"), F.col("component").alias("into")), "component", "left").select("node", F.coalesce("into", "component").alias("component")), "jaccard-components")
        discard(old, hubs, pairs, joined)
        if last:
            break
    discard(*checked)
    return named


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, numerator: int = 85, denominator: int = 100, most_turns: int = 6) -> DataFrame:
    """(id, n_shingles, component_id) for each row of df.

    Words are runs of non-space bytes with A-Z lower-cased; a text's set holds
    its distinct n-word shingles, or the whole sequence where it has fewer
    words.  Texts link if denominator * |intersection| >= numerator * |union|;
    component_id is the smallest id that links reach.  Null and blank texts
    have an empty set and only reach themselves.  Repeated and null ids give a row
    each, which links by its own text; a group without any id has none;
    other columns of df are left out, so their names cannot clash.
    Shingles are compared by 64-bit hashes.  most_turns bounds the turns
    with hubs, not what is compared.
    """
    modest_batches(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    buckets = _buckets(docs, n, numerator, denominator)
    table = kept(docs.mapInArrow(_nodes(n), f"id long, n_shingles long, node long, packed binary, {', '.join(f'{p} long' for p in PARITY)}, wide array<long>"), "jaccard-nodes")

    # One text for each node that has to be compared.
    held = table.where("packed is not null").join(buckets.select("node").distinct(), "node", "left_semi")
    held = kept(held.select("node", "packed", F.col("n_shingles").alias("size"), *PARITY, "wide").dropDuplicates(["node"]), "jaccard-texts")
    named = _components(buckets, held, n, numerator, denominator, most_turns)

    # Ids are gathered by node, then by component, and only then met with the rows; each step adds up before it shuffles.
    ids = table.where("node is not null").groupBy("node").agg(F.min("id").alias("least")).join(named, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    ids = kept(ids, "jaccard-ids")
    least = ids.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = kept(ids.join(least, "component").select("node", "component_id"), "jaccard-labels")
    rows = table.select("id", "n_shingles", "node")
    out = kept(rows.join(labels, "node", "left").select("id", "n_shingles", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id")), "jaccard-components")
    discard(buckets, table, held, named, ids, labels)
    return out
