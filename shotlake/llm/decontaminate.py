"""Benchmark decontamination: passages of documents within a small edit distance of a benchmark item.

Texts are words (runs of ASCII letters, digits and non-ASCII bytes, A-Z
lower-cased).  A document holds an item of L words if some run of its words is
within k = floor(share * L) word edits of it, k at most (L - 3) // 3.

* Windows: a run within k edits shares at least L - 2 - 3k word trigrams with
  the item, so only item-sized windows with that many of an item's trigrams go
  on; none that qualifies is lost.  Of an item's trigrams at most 3k are broken,
  so its 3k + 1 rarest among all items are looked up first, and all of them are
  counted only around a place that has one of these.
* CGK embedding: a window is walked in 3L steps; step j writes out the current
  word and a random bit of (j, word) decides whether to move on.  Few edits
  become a small Hamming distance.
* Bit sampling: `repetitions` hash tables, each on `sampled` steps of the walk,
  propose (window, item) pairs.  Repetitions are chosen so that a pair at
  distance k is proposed with at least the target recall, taking `spread`
  differing steps for each edit; equal runs are always proposed.
* Proposed pairs are verified by the edit distance of the item to all runs
  around the window.

Items with equal words are one.  They are collected in blocks of about
block_items, each looked for in one pass over the documents, so what is sent to
workers is bounded.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotlake.llm._store import modest_batches
from shotlake.llm._text import U64, Words, mix, ngrams, slices, words

SEPARATOR = np.ones(256, bool)
SEPARATOR[[c for c in range(256) if c > 127 or chr(c).isalnum()]] = False


def edits_allowed(length: int, share: float) -> int:
    return max(0, min(int(share * length), (length - 3) // 3))


def repetitions_for(share: float, sampled: int, spread: float, recall: float) -> int:
    """Tables needed so that a pair at the largest distance meets in one of them with probability recall."""
    alike = max(0.05, 1 - share * spread / 3) ** sampled
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - alike))) if alike < 1 else 1


@dataclass
class Items:
    """A block of items by length, with the trigrams and the hash-table keys of all of them."""

    ids: list
    texts: list[np.ndarray]  # word hashes
    share: float
    sampled: int
    repetitions: int

    def __post_init__(self):
        rng = np.random.default_rng(97)
        self.lengths = np.array(sorted({len(t) for t in self.texts}), np.int64)
        self.allowed = np.array([edits_allowed(int(n), self.share) for n in self.lengths], np.int64)
        self.gram = np.minimum(3, self.lengths)
        self.kind = np.searchsorted(self.lengths, [len(t) for t in self.texts])
        self.needed = np.maximum(1, self.lengths - self.gram + 1 - self.gram * self.allowed)
        # For each gram length the known grams, and the items that are looked up by gram i as holders[q][at[q][i] : at[q][i + 1]].
        self.grams, self.holders, self.at, self.own = {}, {}, {}, [np.unique(ngrams(t, min(3, len(t)))) for t in self.texts]
        for q in set(self.gram.tolist()):
            mine = [i for i, t in enumerate(self.texts) if min(3, len(t)) == q]
            known, often = np.unique(np.concatenate([self.own[i] for i in mine]), return_counts=True)
            of = []
            for i in mine:
                here = ngrams(self.texts[i], q)
                rare = here[np.lexsort((here, often[np.searchsorted(known, here)]))]
                of += [(g, i) for g in set(rare[: q * int(self.allowed[self.kind[i]]) + 1].tolist())]
            of.sort()
            grams, self.holders[q] = np.array([g for g, _ in of], U64), np.array([i for _, i in of], np.int64)
            self.grams[q], first = np.unique(grams, return_index=True)
            self.at[q] = np.append(first, len(grams))
        self.marked = {}
        for q, known in self.grams.items():  # a first look that a few nanoseconds can take
            self.marked[q] = np.zeros(1 << 20, bool)
            self.marked[q][known >> U64(44)] = True
        steps = 3 * int(self.lengths[-1])
        self.seeds = rng.integers(0, 2**63, (self.repetitions, steps)).astype(U64)
        self.picked = np.zeros((len(self.lengths), self.repetitions, steps), bool)
        for of, n in enumerate(self.lengths.tolist()):
            for r in range(self.repetitions):
                self.picked[of, r, rng.choice(3 * n, min(self.sampled, 3 * n), replace=False)] = True
        flat, start = np.concatenate(self.texts), np.cumsum([0, *map(len, self.texts)])[:-1]
        keys = self.keys(flat, start, self.kind)
        order = np.argsort(keys.reshape(-1), kind="stable")
        self.sorted_keys, self.key_item = keys.reshape(-1)[order], order // self.repetitions

    def keys(self, flat: np.ndarray, start: np.ndarray, of: np.ndarray) -> np.ndarray:
        """[window, table] keys of windows flat[start : start + lengths[of]]."""
        n = self.lengths[of]
        at = np.zeros((len(start), self.repetitions), np.int64)
        acc = np.repeat(mix(n.astype(U64))[:, None], self.repetitions, 1) + np.arange(self.repetitions, dtype=U64)
        last = len(flat) - 1
        for j in range(3 * int(n.max(initial=0))):
            inside = at < n[:, None]
            word = np.where(inside, flat[np.minimum(start[:, None] + at, last)], U64(0))
            picked = self.picked[of, :, j]
            acc[picked] = mix(acc[picked] + word[picked])
            at += (mix(word ^ self.seeds[:, j]) & U64(1)).astype(np.int64) & inside
        return acc


def nearest_run(item: np.ndarray, run: np.ndarray) -> tuple[int, int, int]:
    """(edits, start, end) of the part of run with the fewest word edits to item; the earliest end, then the latest start."""
    cost = np.zeros(len(run) + 1, np.int64)
    start = np.arange(len(run) + 1)
    for i, word in enumerate(item, 1):
        # Two rows of the table of edits; start tells where the part begins.
        diagonal = np.concatenate(([i], cost[:-1] + (run != word)))
        diagonal[0] = cost[0] + 1
        from_diagonal = np.concatenate(([start[0]], start[:-1]))
        up = cost + 1
        better = up < diagonal
        best, origin = np.where(better, up, diagonal), np.where(better, start, from_diagonal)
        offset = np.arange(len(best))
        reached = np.minimum.accumulate(best - offset)
        source = np.maximum.accumulate(np.where(best - offset == reached, offset, 0))
        cost, start = reached + offset, origin[source]
    end = int(cost.argmin())
    return int(cost[end]), int(start[end]), end


def _near(items: Items, q: int, grams: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, item), once each, of the texts that have one of the q-grams by which an item is looked up."""
    place = np.flatnonzero(items.marked[q][grams >> U64(44)])
    known = items.grams[q]
    near = np.minimum(np.searchsorted(known, grams[place]), len(known) - 1)
    good = (known[near] == grams[place]) & (text[place] == text[place + q - 1])
    # A gram that a text repeats brings its items once.
    pairs = np.unique(np.stack([text[place[good]], near[good]], 1), axis=0) if good.any() else np.zeros((0, 2), np.int64)
    out = [np.zeros(0, np.int64)]
    count = items.at[q][pairs[:, 1] + 1] - items.at[q][pairs[:, 1]]
    ends = np.cumsum(count)
    i = 0
    while i < len(pairs):  # of many items with one gram, so many at a time
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + (1 << 20), "right")))
        n = count[i:j]
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out.append(np.unique(np.repeat(pairs[i:j, 0], n) * len(items.texts) + items.holders[q][np.repeat(items.at[q][pairs[i:j, 1]], n) + nth]))
        i = j
    found = np.unique(np.concatenate(out))
    return found // len(items.texts), found % len(items.texts)


def _windows(items: Items, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(first word, item) of the item-sized windows that have enough of the item's grams; they are inside a text unless it is shorter."""
    text_of, begins, whose = w.text_of, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for q in items.grams:
        grams = ngrams(w.hash, q)
        for text, i in zip(*(x.tolist() for x in _near(items, q, grams, text_of)), strict=True):
            n, need, own = len(items.texts[i]), int(items.needed[items.kind[i]]), items.own[i]
            a, b = int(w.first[text]), int(w.first[text + 1])
            here = grams[a : max(a, b - q + 1)]
            at = a + np.flatnonzero(own[np.minimum(np.searchsorted(own, here), len(own) - 1)] == here)
            if len(at) < need:
                continue
            # A window holds hits j to j + need - 1 if it begins in this range.
            left, right = at[need - 1 :] - (n - q), at[: len(at) - need + 1]
            starts = [np.arange(x, y + 1) for x, y in zip(left[left <= right], right[left <= right], strict=True)]
            if starts:
                starts = np.unique(np.maximum(np.minimum(np.concatenate(starts), b - n), a))
                begins.append(starts)
                whose.append(np.full(len(starts), i))
    return np.concatenate(begins), np.concatenate(whose)


def _found(items: Items, w: Words) -> list[tuple[int, int, int, int, int]]:
    """(text, item, first word, end, edits), the nearest run of each item in each text."""
    text, hashes = w.text_of, w.hash
    begin, of_item = _windows(items, w)
    if not len(begin):
        return []
    of = items.kind[of_item]
    proposed: dict[tuple[int, int], list[int]] = {}
    for i in range(0, len(begin), 4096):
        b, o = begin[i : i + 4096], of[i : i + 4096]
        keys = items.keys(hashes, b, o).reshape(-1)
        lo, hi = np.searchsorted(items.sorted_keys, keys, "left"), np.searchsorted(items.sorted_keys, keys, "right")
        for k in np.flatnonzero(hi > lo):
            window = k // items.repetitions
            item = int(of_item[i + window])
            if item in items.key_item[lo[k] : hi[k]]:
                proposed.setdefault((int(text[b[window]]), item), []).append(int(b[window]))
    out = []
    for (t, item), starts in proposed.items():
        words_of = items.texts[item]
        k, n, best = edits_allowed(len(words_of), items.share), len(words_of), None
        a, b = int(w.first[t]), int(w.first[t + 1])
        groups = []
        for s in sorted(set(starts)):
            if groups and s - k <= groups[-1][1]:
                groups[-1][1] = s + n + k
            else:
                groups.append([s - k, s + n + k])
        for lo, hi in groups:
            lo, hi = max(a, lo), min(b, hi)
            edits, begins, end = nearest_run(words_of, hashes[lo:hi])
            if edits <= k and (best is None or edits < best[4]):
                best = (t, item, lo + begins - a, lo + end - a, edits)
        if best:
            out.append(best)
    return out


def _blocks(benchmark: DataFrame, item_text_col: str, share: float, recall: float, sampled: int, spread: float, block_items: int):
    """A broadcast block of distinct items at a time; an item is named by the hash of its text."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_text_col).cast("string").alias("text")).where("text is not null").select(F.xxhash64("text").alias("item"), "text").dropDuplicates(["item"])
    blocks = -(-items.count() // block_items)
    for block in range(blocks):
        rows = items.where(F.pmod("item", F.lit(blocks)) == block).orderBy("item").collect()
        w = words(pa.array([r["text"] for r in rows], pa.string()), space=SEPARATOR)
        texts = [(r["item"], w.hash[a:b].copy()) for r, a, b in zip(rows, w.first[:-1], w.first[1:], strict=True) if b > a]
        if texts:
            yield spark.sparkContext.broadcast(Items([x for x, _ in texts], [x for _, x in texts], share, sampled, repetitions_for(share, sampled, spread, recall)))


def contaminated(
    df: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    share: float = 0.2,
    recall: float = 0.99,
    sampled: int = 3,
    spread: float = 5.0,
    block_items: int = 20_000,
) -> DataFrame:
    """(id, item_id, start_word, end_word, edits) for each document and each item that it holds, its nearest run.

    Null and blank texts hold nothing and null and blank items are in nothing.
    Repeated documents and items give rows each.  Other columns are left out.
    """
    modest_batches(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "id long, item long, start_word long, end_word long, edits long"
    out = df.sparkSession.createDataFrame([], schema)
    for shared in _blocks(benchmark, item_text_col, share, recall, sampled, spread, block_items):
        out = out.union(docs.mapInArrow(_search(shared), schema))
    named = benchmark.select(F.col(item_id_col).cast("long").alias("item_id"), F.xxhash64(F.col(item_text_col).cast("string")).alias("item"))
    return out.join(named, "item").select("id", "item_id", "start_word", "end_word", "edits")


def uncontaminated(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text_col: str = "text", share: float = 0.2, recall: float = 0.99, sampled: int = 3, spread: float = 5.0, block_items: int = 20_000) -> DataFrame:
    """The rows of df whose text holds no item of the benchmark; each is judged on its own text, and all columns stay.

    Null and blank texts stay.
    """
    modest_batches(df.sparkSession)
    spare = "_" * (1 + max(map(len, df.columns), default=0))  # longer than any column, so none clashes
    out = df.withColumn(spare, F.col(text_col).cast("string"))
    for shared in _blocks(benchmark, item_text_col, share, recall, sampled, spread, block_items):
        out = out.mapInArrow(_clean(shared, spare), out.schema)
    return out.select(*df.columns)


def _clean(shared, column: str):
    def run(batches):
        for b in slices(batches, column):
            stays = np.ones(b.num_rows, bool)
            stays[[t for t, *_ in _found(shared.value, words(b.column(b.num_columns - 1), space=SEPARATOR))]] = False
            yield b.filter(pa.array(stays))

    return run


def _search(shared):
    def run(batches):
        items = shared.value
        for b in slices(batches, "text"):
            found = _found(items, words(b.column(1), space=SEPARATOR))
            if found:
                text, item, first, end, edits = (list(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(text)), pa.array([items.ids[i] for i in item], pa.int64()), *(pa.array(x, pa.int64()) for x in (first, end, edits))], ["id", "item", "start_word", "end_word", "edits"])

    return run
