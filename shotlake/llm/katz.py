"""Katz back-off language model over words, counted and applied in partitioned tables.

Model.  Every distinct training word belongs to the vocabulary.  Contexts are
the word before, or the start of the text.  Counts r <= 5 are discounted by
Good-Turing: d_r = (r* / r - B) / (1 - B), r* = (r + 1) n_{r+1} / n_r,
B = 6 n_6 / n_1; where that is not in (0, 1), by (r - 1/2) / r.  Then

    P(w | h) = s(h) d_r r / c(h)   if r = c(h w) > 0
             = a(h) P(w)           otherwise
    a(h) = (1 - sum of P over seen w) / (1 - sum of P(w) over seen w)

so the probabilities of each context sum to one exactly.  s(h) is 1, or
c(h) / (c(h) + 1) where no count of h is discounted, which leaves something to
back off to.  An unseen context has a(h) = 1.  P(w) is the same one level down:
what discounting frees there, and one event more, is shared equally by U unseen
words, U = n_1^2 / (2 n_2) (Chao's estimate).  Two levels are kept here: a
third would need each distinct word triple with its own key and the probability
of its suffix, which alone is over three times the input on disk.
shotlake.llm.katz_order has the same model for any order, a row a token.

Tables.  Word counts are partitioned by hash.  Words are numbered from the most
to the least frequent, so a number tells its word's exact count by a short list
of where each count begins.  The corpus is encoded once as numbers: the `cached`
commonest words where the text is, all others by the partition that has them.
Pair counts are partitioned by context, those of very common contexts by pair.
A partition works out its contexts' weights and answers, for the blocks of the
corpus, with sums by text; the `frequent` commonest pairs are looked up where
the text is.  Both caches have a fixed size and change no result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shotlake.llm._store import discard, kept, modest_batches
from shotlake.llm._text import U64, gathered, mix, words

K = 5  # counts up to this are discounted
BITS = 31  # of a word's number in a pair
MASK = (1 << BITS) - 1
UNSEEN, END, START, FIRST = 0, 1, 2, 3  # numbers: unseen words, the end, the start, then words
EXACT_BINS, FINE = 1024, 16
SLICE = 8 << 20
HOT = 1 << 16  # contexts at most whose pairs are spread and whose weights every task has
HELD = 1 << 21  # distinct keys that a task adds up before it sends them


def dense(a: np.ndarray) -> bytes:
    """A sorted integer array as compressed byte planes of its differences."""
    steps = np.diff(a.astype(np.int64), prepend=np.int64(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def undense(raw) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).view(np.int64).reshape(-1), dtype=np.int64)


def press(a: np.ndarray) -> bytes:
    """Any array as compressed byte planes."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a[:, None].view(np.uint8).reshape(-1, a.itemsize).T).tobytes() if len(a) else b"")


def unpress(raw, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).reshape(-1)


def summed(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted values with the sums of their counts."""
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1])[: len(values)])
    return values[first], np.add.reduceat(counts, first) if len(first) else counts


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> U64(33)) * U64(parts) >> U64(31)).astype(np.int64)


def bins(counts: np.ndarray) -> np.ndarray:
    """Exact below EXACT_BINS, then FINE steps for each doubling."""
    return np.where(counts < EXACT_BINS, counts, EXACT_BINS + np.floor(FINE * np.log2(np.maximum(counts, EXACT_BINS) / EXACT_BINS))).astype(np.int64)


def least_bin(found: dict[int, int], most: int) -> int:
    """The smallest bin such that it and those above hold at most `most`."""
    total = 0
    for b in sorted(found, reverse=True):
        total += found[b]
        if total > most:
            return b + 1
    return 0


def lookup(keys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Place of each of at in the sorted keys, or -1."""
    if not len(keys):
        return np.full(len(at), -1)
    i = np.minimum(np.searchsorted(keys, at), len(keys) - 1)
    return np.where(keys[i] == at, i, -1)


def good_turing(n: list[int]) -> np.ndarray:
    """Discounts d_0 .. d_K of counts, from n[r - 1] = how many events have count r."""
    d, cut = np.ones(K + 1), 0.0
    if n[0] and n[K]:
        cut = (K + 1) * n[K] / n[0]
    for r in range(1, K + 1):
        value = ((r + 1) * n[r] / (r * n[r - 1]) - cut) / (1 - cut) if n[r - 1] and n[r] and cut < 1 else 0.0
        d[r] = value if 0 < value < 1 else (r - 0.5) / r
    return d


def unseen_types(n: list[int]) -> int:
    """How many words are taken to be unseen, from how many were seen once and twice."""
    return max(1, n[0] * n[0] // (2 * n[1]) if n[1] else n[0] * (n[0] - 1) // 2)


@dataclass
class Lexicon:
    """The word level: what a number says of its word."""

    hashes: np.ndarray  # of the cached words, sorted
    numbers: np.ndarray  # theirs
    begin: np.ndarray  # ascending numbers at which a count begins
    count: np.ndarray  # that count
    tokens: int  # N, with ends
    types: int  # V, with the end
    texts: int
    discount: np.ndarray
    unseen: float  # P of one unseen word
    total: float

    def counts(self, numbers: np.ndarray) -> np.ndarray:
        """c(w); of the start it is c(h)."""
        at = np.maximum(np.searchsorted(self.begin, numbers, "right") - 1, 0)
        c = self.count[at] if len(self.begin) else np.zeros(len(numbers), np.int64)
        return np.where(numbers >= FIRST, c, np.where(numbers == UNSEEN, 0, self.texts))

    def p(self, numbers: np.ndarray) -> np.ndarray:
        c = self.counts(numbers)
        d = np.where((c <= K) & (numbers != END), self.discount[np.minimum(c, K)], 1.0)
        return np.where(c > 0, d * c / self.total, self.unseen)


def _lexicon(hashes, numbers, begin, count, tokens, types, texts, small) -> Lexicon:
    d = good_turing(small)
    freed = sum(n * r * (1 - d[r]) for r, n in enumerate(small[:K], 1)) + 1.0
    total = tokens + 1.0
    return Lexicon(hashes, numbers, begin, count, tokens, types, texts, d, freed / total / unseen_types(small), total)


def _split(part: np.ndarray, *columns: np.ndarray):
    """(part, columns) by part, in the order given within a part."""
    order = np.argsort(part, kind="stable")
    cut = np.flatnonzero(np.diff(part[order])) + 1
    for rows in np.split(order, cut) if len(order) else []:
        yield int(part[rows[0]]), *(c[rows] for c in columns)


def _rows(rows: list[tuple], schema: pa.Schema):
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _added(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(sorted keys, counts), added up over as many of found as HELD allows."""
    held, size = [], 0
    for keys, counts in found:
        held.append((keys, counts))
        size += len(keys)
        if size > HELD:
            held = [summed(*map(np.concatenate, zip(*held, strict=True)))]
            size = len(held[0][0])
            if size > HELD // 2:
                yield held[0]
                held, size = [], 0
    if held:
        yield summed(*map(np.concatenate, zip(*held, strict=True)))


PAIRS = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
SENT = pa.schema([("part", pa.int32()), ("kind", pa.string()), ("block", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
BACK = pa.schema([("block", pa.int64()), ("kind", pa.string()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
TABLE = "part int, keys binary, counts binary, n long, total long, small array<long>, bin array<long>, bin_n array<long>"


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _counted(pairs: DataFrame, parts: int, what: str) -> DataFrame:
    """One row for each partition: its distinct keys and counts, and how many keys have a count of 1 to K + 1 or of each bin."""

    def run(table: pa.Table) -> pa.Table:
        keys = np.concatenate([undense(x.as_buffer()) for x in table.column("keys")])
        counts = np.concatenate([unpress(x.as_buffer(), np.int64) for x in table.column("counts")])
        keys, counts = summed(keys, counts)
        bin_, bin_n = np.unique(bins(counts), return_counts=True)
        small = [int((counts == r).sum()) for r in range(1, K + 2)]
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "keys": pa.array([dense(keys)], pa.binary()), "counts": pa.array([press(counts)], pa.binary()), "n": [len(keys)], "total": [int(counts.sum())], "small": [small], "bin": [bin_.tolist()], "bin_n": [bin_n.tolist()]})

    return kept(pairs.repartition(parts, "part").groupBy("part").applyInArrow(run, TABLE), what)


def _summary(table: DataFrame) -> tuple[int, int, list[int], dict[int, int]]:
    """Keys, sum of counts, keys by count 1 to K + 1, and keys by bin; sums over partitions."""
    r = table.agg(F.sum("n"), F.sum("total"), *(F.sum(F.col("small")[i]) for i in range(K + 1))).first()
    found = table.select(F.explode(F.arrays_zip("bin", "bin_n")).alias("x")).groupBy("x.bin").agg(F.sum("x.bin_n").alias("n")).collect()
    return r[0] or 0, r[1] or 0, [x or 0 for x in r[2:]], {x.bin: x.n for x in found}


def _parts(docs: DataFrame, text_bytes: int) -> int:
    """Partitions of the tables: about one for each 32 MB of text, and no fewer than the session's."""
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), text_bytes // (32 << 20) + 1)


def _vocabulary(docs: DataFrame, parts: int) -> DataFrame:
    """Counts of the training words, by the partition of their hash."""

    def run(batches):
        def found():
            for b in gathered(batches, "text", SLICE):
                seen, n = np.unique(words(b.column(0)).hash.view(np.int64), return_counts=True)
                yield seen, n.astype(np.int64)

        for keys, counts in _added(found()):
            yield from _rows([(p, dense(k), press(c)) for p, k, c in _split(part_of(mix(keys.view(U64)), parts), keys, counts)], PAIRS)

    return _counted(docs.where("train").select("text").mapInArrow(run, _ddl(PAIRS)), parts, "katz-words")


def _numbered(table: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """Hashes and counts of the words in bin `least` or above, and of the rest (part, count, n, before): how many words of that count earlier partitions have."""

    def common(batches):
        for b in batches:
            for keys, counts in zip(b.column(0), b.column(1), strict=True):
                keys, counts = undense(keys.as_buffer()), unpress(counts.as_buffer(), np.int64)
                big = bins(counts) >= least
                yield pa.RecordBatch.from_arrays([pa.array(keys[big]), pa.array(counts[big])], ["key", "count"])

    def rest(batches):
        for b in batches:
            for part, counts in zip(b.column(0), b.column(1), strict=True):
                counts = unpress(counts.as_buffer(), np.int64)
                count, n = np.unique(counts[bins(counts) < least], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part.as_py(), np.int32)), pa.array(count), pa.array(n.astype(np.int64))], ["part", "count", "n"])

    got = table.select("keys", "counts").mapInArrow(common, "key long, count long").toArrow()
    keys, counts = got.column(0).to_numpy(), got.column(1).to_numpy()
    earlier = Window.partitionBy("count").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_count = table.select("part", "counts").mapInArrow(rest, "part int, count long, n long").withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    return keys, counts, kept(by_count, "katz-numbers")


def _encoded(docs: DataFrame, table: DataFrame, numbers: DataFrame, shared, parts: int) -> DataFrame:
    """(block, ids, train, n_words, numbers): the corpus in blocks of texts, whose words are numbers.

    A block is named by its partition and all its bytes, so it has one name however often its task runs.
    """

    def send(batches):
        lexicon, partition, names = shared.value, TaskContext.get().partitionId(), Counter()
        for b in gathered(batches, "text", SLICE):
            w = words(b.column(2))
            ids = _ids(b.column(0))
            name = xxhash.xxh64_intdigest(ids + w.offsets.tobytes() + b.column(1).to_numpy(zero_copy_only=False).tobytes(), xxhash.xxh64_intdigest(np.ascontiguousarray(w.data)))
            names[name] += 1
            block = int(mix(np.array([name], U64) + mix(np.array([partition << 32 | names[name]], U64)))[0].view(np.int64))
            seen, back = np.unique(w.hash, return_inverse=True)
            at = lookup(lexicon.hashes, seen)
            rare = np.flatnonzero(at < 0)
            number = np.zeros(len(seen), np.int64)
            number[at >= 0] = lexicon.numbers[at[at >= 0]]
            number[rare] = -1 - np.arange(len(rare))  # by place among the rare ones
            local = press(np.diff(w.first).astype(np.int64)) , press(number[back].astype(np.int32))
            head = len(ids).to_bytes(8, "little") + ids + b.column(1).to_numpy(zero_copy_only=False).tobytes()
            rows = [(abs(block) % parts, "local", block, head, *local)]
            hashes = seen[rare].view(np.int64)
            order = np.argsort(hashes)
            for p, k, place in _split(part_of(mix(hashes[order].view(U64)), parts), hashes[order], order):
                rows.append((p, "word", block, dense(k), press(place.astype(np.int32)), b""))
            yield from _rows(rows, SENT)

    sent = docs.select("id", "train", "text").mapInArrow(send, _ddl(SENT))
    starts = numbers.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("count", "before"))).alias("x"))
    starts = table.join(starts, "part", "left").select("part", F.lit("table").alias("kind"), F.lit(0).cast("long").alias("block"), F.col("keys").alias("a"), F.col("counts").alias("b"), F.to_json(F.struct(F.col("x.count").alias("count"), F.col("x.before").alias("before"))).cast("binary").alias("c"))

    def answer(table: pa.Table) -> pa.Table:
        import json

        lexicon = shared.value
        keys, number, out = np.zeros(0, np.int64), np.zeros(0, np.int64), []
        for kind, a, b, c in zip(*(table.column(x) for x in ("kind", "a", "b", "c")), strict=True):
            if kind.as_py() == "table":
                keys, counts, before = undense(a.as_buffer()), unpress(b.as_buffer(), np.int64), json.loads(c.as_py())
                if before.get("count"):
                    at = lookup(np.array(before["count"], np.int64), counts)
                    begin = lexicon.begin[::-1][np.searchsorted(lexicon.count[::-1], counts)] if len(lexicon.begin) else counts
                    # Words of one count are numbered by partition, then by hash.
                    order = np.argsort(counts, kind="stable")
                    first = np.flatnonzero(np.append(True, np.diff(counts[order]) != 0))
                    rank = np.empty(len(counts), np.int64)
                    rank[order] = np.arange(len(counts)) - np.repeat(first, np.diff(np.append(first, len(counts))))
                    number = np.where(at >= 0, begin + np.array(before["before"], np.int64)[np.maximum(at, 0)] + rank, UNSEEN)
        for kind, block, a, b, c in zip(*(table.column(x) for x in ("kind", "block", "a", "b", "c")), strict=True):
            kind = kind.as_py()
            if kind == "local":
                out.append((block.as_py(), kind, a.as_py(), b.as_py(), c.as_py()))
            elif kind == "word":
                at = lookup(keys, undense(a.as_buffer()))
                out.append((block.as_py(), kind, b.as_py(), press(np.where(at >= 0, number[np.maximum(at, 0)] if len(number) else 0, UNSEEN).astype(np.int32)), b""))
        return _table(out, BACK)

    back = sent.unionByName(starts).repartition(parts, "part").groupBy("part").applyInArrow(answer, _ddl(BACK))

    def gather(table: pa.Table) -> pa.Table:
        head, places, values = None, [], []
        for kind, a, b, c in zip(*(table.column(x) for x in ("kind", "a", "b", "c")), strict=True):
            if kind.as_py() == "local":
                head, n_words, number = a.as_py(), b.as_py(), unpress(c.as_buffer(), np.int32).copy()
            else:
                places.append(unpress(a.as_buffer(), np.int32))
                values.append(unpress(b.as_buffer(), np.int32))
        if places:
            rare = np.zeros(sum(map(len, places)), np.int32)
            rare[np.concatenate(places)] = np.concatenate(values)
            number = np.where(number < 0, rare[np.clip(-1 - number, 0, len(rare) - 1)], number)
        size = int.from_bytes(head[:8], "little")
        return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int64()), "ids": pa.array([head[8 : 8 + size]], pa.binary()), "train": pa.array([head[8 + size :]], pa.binary()), "n_words": pa.array([n_words], pa.binary()), "numbers": pa.array([press(number)], pa.binary())})

    return kept(back.repartition(parts, "block").groupBy("block").applyInArrow(gather, "block long, ids binary, train binary, n_words binary, numbers binary"), "katz-corpus")


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema) if rows else schema.empty_table()


def _ids(column: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("id", pa.int64())])) as out:
        out.write_batch(pa.record_batch([column], names=["id"]))
    return sink.getvalue().to_pybytes()


def _pairs(numbers: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, pair) for each word and end of texts: the number before it and its own."""
    n, first = len(n_words), np.append(0, np.cumsum(n_words))
    text = np.repeat(np.arange(n), n_words)
    out = np.full(len(numbers) + 2 * n, END, np.int64)
    out[np.arange(len(numbers)) + 2 * text + 1] = numbers
    out[first[:-1] + 2 * np.arange(n)] = START
    of = np.repeat(np.arange(n), n_words + 2)
    inside = of[1:] == of[:-1]
    return of[1:][inside], (out[:-1] << BITS | out[1:])[inside]


def _pair_parts(keys: np.ndarray, hot: np.ndarray, parts: int) -> np.ndarray:
    """A context's pairs lie in one partition; those of a context with a large share of all text, by pair, in all of them."""
    head = keys >> BITS
    spread = lookup(hot, head) >= 0
    return part_of(mix(np.where(spread, keys, head).astype(U64) + spread.astype(U64)), parts)


@dataclass
class Contexts:
    """s(h) and a(h) of sorted contexts."""

    heads: np.ndarray
    scale: np.ndarray
    back: np.ndarray


def _sums(keys: np.ndarray, counts: np.ndarray, lexicon: Lexicon, discount: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(h, discounted counts of h, P of the words seen after h) of sorted pairs."""
    head, back = np.unique(keys >> BITS, return_inverse=True)
    return head, np.bincount(back, discount[np.minimum(counts, K + 1)] * counts, len(head)), np.bincount(back, lexicon.p(keys & MASK), len(head))


def _contexts(head: np.ndarray, mass: np.ndarray, lower: np.ndarray, lexicon: Lexicon) -> Contexts:
    c = lexicon.counts(head).astype(np.float64)
    seen = mass / np.maximum(c, 1)
    scale = np.where(seen > 1 - 1e-9, c / (c + 1), 1.0)
    return Contexts(head, scale, (1 - scale * seen) / np.maximum(1 - lower, lexicon.unseen))


def _seen(keys: np.ndarray, counts: np.ndarray, contexts: Contexts, lexicon: Lexicon, discount: np.ndarray) -> np.ndarray:
    """log10 P of pairs with these counts, whose contexts are known."""
    head = keys >> BITS
    return np.log10(contexts.scale[lookup(contexts.heads, head)] * discount[np.minimum(counts, K + 1)] * counts / lexicon.counts(head))


def _joined(*some: Contexts) -> Contexts:
    heads = np.concatenate([x.heads for x in some])
    order = np.argsort(heads)
    return Contexts(heads[order], np.concatenate([x.scale for x in some])[order], np.concatenate([x.back for x in some])[order])


def scored(df: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", cached: int = 1 << 19, frequent: int = 1 << 18) -> DataFrame:
    """(id, train, n_tokens, n_known, train_tokens, base_score, score) for each row of df.

    train is a boolean column; null counts as false.  Tokens are the words
    (runs of non-space bytes, A-Z lower-cased) and one end.  base_score is the
    add-half unigram score with exact counts of all words; score is the model's
    log10 probability of the text, each unseen word being one of U.  Null and empty texts
    are the end alone.  Without training texts every word is unseen.  Repeated
    rows and ids, and null ids, are scored each by their own text; other columns are left out.
    cached and frequent bound what is broadcast and change no result.  There may
    be 2^31 distinct training words; more raise an error.
    """
    spark = df.sparkSession
    modest_batches(spark)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(train, F.lit(False)).alias("train"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    texts, size = docs.agg(F.count(F.when(F.col("train"), 1)), F.sum(F.octet_length("text"))).first()
    parts = _parts(docs, size or 0)

    vocabulary = _vocabulary(docs, parts)
    types, tokens, small, found = _summary(vocabulary)
    if types >= MASK - FIRST:
        raise ValueError("more than 2^31 distinct training words")
    keys, counts, numbers = _numbered(vocabulary, least_bin(found, cached))
    order = np.lexsort((keys, -counts))
    common = counts[order]
    begin = {int(c): FIRST + int(np.searchsorted(-common, -c)) for c in np.unique(common)}
    at = FIRST + len(common)
    for r in numbers.groupBy("count").agg(F.sum("n").alias("n")).orderBy(F.desc("count")).collect():
        begin[r["count"]] = at
        at += r["n"]
    steps = sorted(begin.items(), key=lambda x: x[1])
    by_hash = np.argsort(keys[order].view(U64))
    if texts:  # the end is a token of its own
        types, tokens = types + 1, tokens + texts
    lexicon = _lexicon(keys[order].view(U64)[by_hash], (FIRST + np.arange(len(common)))[by_hash], np.array([b for _, b in steps], np.int64), np.array([c for c, _ in steps], np.int64), tokens, types, texts, small)
    shared = spark.sparkContext.broadcast(lexicon)
    corpus = _encoded(docs, vocabulary, numbers, shared, parts)

    # Contexts with more than an eighth of a partition's share of all pairs, or a HOT-th of all where that is more; so they are at most HOT.
    limit = max(1, tokens) / min(8 * parts, HOT)
    hot = np.sort(np.append(FIRST + np.flatnonzero(common > limit), [START] if texts > limit else []).astype(np.int64))

    def count_pairs(batches):
        def found():
            for b in batches:
                for train, n_words, number in zip(*(b.column(i) for i in range(3)), strict=True):
                    n_words = unpress(n_words.as_buffer(), np.int64)
                    mine = np.frombuffer(train.as_buffer(), bool)
                    _, keys = _pairs(unpress(number.as_buffer(), np.int32)[np.repeat(mine, n_words)], n_words[mine])
                    keys, n = np.unique(keys, return_counts=True)
                    yield keys, n.astype(np.int64)

        for keys, counts in _added(found()):
            yield from _rows([(p, dense(k), press(c)) for p, k, c in _split(_pair_parts(keys, hot, parts), keys, counts)], PAIRS)

    pairs = _counted(corpus.select("train", "n_words", "numbers").mapInArrow(count_pairs, _ddl(PAIRS)), parts, "katz-pairs")
    _, _, small, found = _summary(pairs)
    discount = np.append(good_turing(small), 1.0)

    def hot_sums(batches):
        for b in batches:
            for keys, counts in zip(b.column(0), b.column(1), strict=True):
                keys, counts = undense(keys.as_buffer()), unpress(counts.as_buffer(), np.int64)
                mine = lookup(hot, keys >> BITS) >= 0
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _sums(keys[mine], counts[mine], shared.value, discount)], ["head", "mass", "lower"])

    got = pairs.select("keys", "counts").mapInArrow(hot_sums, "head long, mass double, lower double").groupBy("head").agg(F.sum("mass"), F.sum("lower")).orderBy("head").toArrow()
    hot_contexts = _contexts(*(x.to_numpy() for x in got.columns), lexicon)
    least = least_bin(found, frequent)

    def own_contexts(keys: np.ndarray, counts: np.ndarray, lexicon: Lexicon) -> Contexts:
        mine = lookup(hot, keys >> BITS) < 0
        return _joined(_contexts(*_sums(keys[mine], counts[mine], lexicon, discount), lexicon), hot_contexts)

    def frequent_pairs(batches):
        for b in batches:
            for keys, counts in zip(b.column(0), b.column(1), strict=True):
                keys, counts = undense(keys.as_buffer()), unpress(counts.as_buffer(), np.int64)
                contexts, big = own_contexts(keys, counts, shared.value), bins(counts) >= least
                yield pa.RecordBatch.from_arrays([pa.array(keys[big]), pa.array(_seen(keys[big], counts[big], contexts, shared.value, discount))], ["key", "value"])

    got = pairs.select("keys", "counts").mapInArrow(frequent_pairs, "key long, value double").toArrow()
    order = np.argsort(got.column(0).to_numpy())
    near_by = spark.sparkContext.broadcast((got.column(0).to_numpy()[order], got.column(1).to_numpy()[order]))

    def send(batches):
        lexicon, (near_keys, near_values) = shared.value, near_by.value
        for b in batches:
            for block, ids, train, n_words, number in zip(*(b.column(i) for i in range(5)), strict=True):
                n_words, number = unpress(n_words.as_buffer(), np.int64), unpress(number.as_buffer(), np.int32).astype(np.int64)
                block, n = block.as_py(), len(n_words)
                text = np.repeat(np.arange(n), n_words)
                c = lexicon.counts(number)
                base = np.bincount(text, np.log10(c + 0.5), n) + np.log10(lexicon.texts + 0.5) - (n_words + 1) * math.log10(lexicon.tokens + 0.5 * (lexicon.types + 1))
                known = np.bincount(text[c > 0], minlength=n) + (lexicon.texts > 0)
                of, keys = _pairs(number, n_words)
                place = lookup(near_keys, keys)
                score = np.bincount(of[place >= 0], near_values[place[place >= 0]], n).astype(np.float64)
                # Nothing was ever seen after an unseen word, so the word alone counts.
                alone = (place < 0) & (lexicon.counts(keys >> BITS) == 0)
                score += np.bincount(of[alone], np.log10(lexicon.p(keys[alone] & MASK)), n)
                yield from _rows([(abs(block) % parts, "local", block, ids.as_py(), n_words.tobytes() + train.as_py(), base.tobytes() + known.astype(np.int64).tobytes() + score.tobytes())], SENT)
                far = (place < 0) & ~alone
                part, keys, of = _pair_parts(keys[far], hot, parts), keys[far], of[far]
                order = np.argsort(keys, kind="stable")
                rows = []
                for p, k, d in _split(part[order], keys[order], of[order]):
                    first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
                    rows.append((p, "pair", block, dense(k[first]), press(np.diff(np.append(first, len(k))).astype(np.uint32)), press(d.astype(np.uint32))))
                yield from _rows(rows, SENT)

    sent = corpus.mapInArrow(send, _ddl(SENT))
    sent = sent.unionByName(pairs.select("part", F.lit("table").alias("kind"), F.lit(0).cast("long").alias("block"), F.col("keys").alias("a"), F.col("counts").alias("b"), F.lit(b"").alias("c")))

    def answer(table: pa.Table) -> pa.Table:
        lexicon, out = shared.value, []
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for kind, a, b in zip(*(table.column(x) for x in ("kind", "a", "b")), strict=True):
            if kind.as_py() == "table":
                keys, counts = undense(a.as_buffer()), unpress(b.as_buffer(), np.int64)
        contexts = own_contexts(keys, counts, lexicon)
        values = _seen(keys, counts, contexts, lexicon, discount)
        for kind, block, a, b, c in zip(*(table.column(x) for x in ("kind", "block", "a", "b", "c")), strict=True):
            kind = kind.as_py()
            if kind == "local":
                out.append((block.as_py(), kind, a.as_py(), b.as_py(), c.as_py()))
            elif kind == "pair":
                asked, times, text = undense(a.as_buffer()), unpress(b.as_buffer(), np.uint32), unpress(c.as_buffer(), np.uint32).astype(np.int64)
                at, of = lookup(keys, asked), lookup(contexts.heads, asked >> BITS)
                value = np.log10(lexicon.p(asked & MASK)) + (np.where(of >= 0, np.log10(contexts.back[of]), 0.0) if len(contexts.back) else 0.0)
                value[at >= 0] = values[at[at >= 0]]
                total = np.bincount(text, value[np.repeat(np.arange(len(asked)), times)])
                here = np.flatnonzero(np.bincount(text))
                out.append((block.as_py(), kind, dense(here), total[here].tobytes(), b""))
        return _table(out, BACK)

    back = sent.repartition(parts, "part").groupBy("part").applyInArrow(answer, _ddl(BACK))

    def gather(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table.column(c) for c in ("kind", "a", "b", "c")), strict=True))
        _, ids, texts, sums = next(r for r in rows if r[0].as_py() == "local")
        ids = pa.ipc.open_stream(ids.as_buffer()).read_all().column(0).combine_chunks()
        n, raw = len(ids), texts.as_buffer()
        n_words, trained = np.frombuffer(raw, np.int64, n), np.frombuffer(raw, bool, n, 8 * n)
        raw = sums.as_buffer()
        base, known, score = np.frombuffer(raw, np.float64, n), np.frombuffer(raw, np.int64, n, 8 * n), np.frombuffer(raw, np.float64, n, 16 * n).copy()
        for kind, a, b, _ in rows:
            if kind.as_py() == "pair":
                score[undense(a.as_buffer())] += np.frombuffer(b.as_buffer(), np.float64)
        return pa.table({"id": ids, "train": pa.array(trained), "n_tokens": n_words + 1, "n_known": known, "train_tokens": np.full(n, tokens), "base_score": base, "score": score})

    out = back.repartition(parts, "block").groupBy("block").applyInArrow(gather, "id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    out = kept(out, "katz-scores")
    discard(vocabulary, numbers, corpus, pairs)
    return out
