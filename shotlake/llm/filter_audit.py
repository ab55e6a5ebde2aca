"""Audit of how five filters of whole texts interact, over every order in which they can be applied.

Arrow string buffers are scanned as bytes: byte classes are table look-ups, and
differences of their prefix sums at text boundaries count words, capitals, code
points and symbols of each text.  Distinct words come from each text's sorted
word hashes; words next to each other with one hash are compared byte by byte,
and a text where two differ is counted from its words.

The texts leave the scan as a mask of failed filters and a digest.  Everything
after that is counting: copies add up by digest, digests by part and mask, and
the 120 orders are evaluated on a part's at most 32 masks.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from shotlake.llm._store import modest_batches
from shotlake.llm._text import Words, slices, words

FILTERS = "ABCDE"
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#$%&*|")] = True
CAPITAL = np.zeros(256, bool)
CAPITAL[65:91] = True
CONTINUES = (np.arange(256) & 0xC0) == 0x80  # bytes that go on with a code point
COMPARED = 1 << 21  # bytes of words that are compared at once


def _counts(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set in each range of offsets, by prefix sums."""
    sums = np.append(0, np.cumsum(flags, dtype=np.int64))
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _differ(w: Words, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the words numbered a and b differ, byte by byte."""
    sizes = w.end[a] - w.start[a]
    out = sizes != w.end[b] - w.start[b]
    same = np.flatnonzero(~out)
    ends = np.cumsum(sizes[same])
    i = 0
    while i < len(same):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + COMPARED, "right")))
        at, size = same[i:j], sizes[same[i:j]]
        first = np.cumsum(size) - size
        step = np.arange(size.sum()) - np.repeat(first, size)
        odd = w.data[np.repeat(w.start[a[at]], size) + step] != w.data[np.repeat(w.start[b[at]], size) + step]
        out[at] = np.add.reduceat(odd, first) > 0  # no word is empty
        i = j
    return out


def distinct_words(w: Words) -> np.ndarray:
    """The number of distinct words of each text."""
    text = w.text_of
    order = np.lexsort((w.hash, text))
    a, b = order[:-1], order[1:]
    again = (text[a] == text[b]) & (w.hash[a] == w.hash[b])
    out = np.diff(w.first) - np.bincount(text[b[again]], minlength=len(w.first) - 1)
    clash = text[b[again]][_differ(w, a[again], b[again])]
    for t in np.unique(clash):
        out[t] = len({w.data[w.start[i] : w.end[i]].tobytes() for i in range(w.first[t], w.first[t + 1])})
    return out


def masks(column: pa.Array) -> np.ndarray:
    """Bit i is set where a text fails filter FILTERS[i]; the last, which needs other texts, is never set here."""
    w = words(column, lower=False)
    n, points = np.diff(w.first), _counts(~CONTINUES[w.data], w.offsets)
    failed = [n < 200, 100 * distinct_words(w) < 50 * n, 100 * _counts(CAPITAL[w.data], w.offsets) > 3 * points, _counts(SYMBOL[w.data], w.offsets) > 0]
    return sum(x.astype(np.int32) << i for i, x in enumerate(failed))


def scanned(docs: DataFrame) -> DataFrame:
    """(id, part, digest, mask) of each row (id, part, digest, text); the text stays in the task."""

    def run(batches):
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(masks(b.column(3)), pa.int32())], ["id", "part", "digest", "mask"])

    return docs.mapInArrow(run, "id long, part string, digest binary, mask int")


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): the number of rows of each part that fail just these filters, and of those among them so labelled.

    docs has (id, part, text), labels (id, good, toxic), an id once.  Copies are
    added up before they meet, so a text that a third of all rows share is a few
    rows where its digest is looked at.
    """
    texts = docs.withColumn("text", F.coalesce("text", F.lit(""))).select("id", "part", F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)).alias("digest"), "text")
    rows = scanned(texts).groupBy("id", "part", "digest", "mask").count()
    # Rows without an id meet no label, so they are dealt by their texts.
    spread = F.when(F.col("id").isNull(), 1 + F.pmod(F.xxhash64("digest"), F.lit(4096))).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumn("spread", spread).join(labels.withColumn("spread", F.lit(0).cast("long")), ["id", "spread"], "left")
    least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "count")))
    copies = rows.groupBy("digest", "part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    # The smallest id is met first as a struct with its rows; several rows may share it within a group and across groups.
    copies = copies.agg(F.sum("count").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("count")).otherwise(0)).alias("nameless"), least.alias("least"))
    first = F.min("least.id").over(Window.partitionBy("digest"))
    alone = F.col("nameless") + F.when(F.col("least.id") == first, F.col("least.count")).otherwise(0)
    copies = copies.withColumn("alone", alone).select("part", "good", "toxic", F.explode(F.array(F.struct("mask", F.col("alone").alias("n")), F.struct((F.col("mask") + (1 << FILTERS.index("E"))).alias("mask"), (F.col("n") - F.col("alone")).alias("n")))).alias("x"))
    copies = copies.select("part", "x.mask", "x.n", "good", "toxic")
    of = lambda flag: F.sum(F.when(F.col(flag), F.col("n")).otherwise(0))
    return copies.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good").alias("good"), of("toxic").alias("toxic")).where("n > 0")


def _steps() -> Column:
    """(filter_order, step, before, bit) of each step of each order; before has the bits of the filters already applied."""
    out = []
    for order in permutations(range(len(FILTERS))):
        name = "".join(FILTERS[i] for i in order)
        out += [f"named_struct('filter_order', '{name}', 'step', {k + 1}, 'before', {sum(1 << j for j in order[:k])}, 'bit', {1 << i})" for k, i in enumerate(order)]
    return F.expr(f"array({', '.join(out)})")


def audit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """A row for each part (a value of part_col, null as the empty string), order and step: the counts that the step brings about.

    kept counts the rows after the step, removed those that it removes,
    redundant those that fail its filter but went earlier, unique_fails those
    that fail its filter alone; good_lost and toxic_lost those removed whose id
    has a label of quality 1, or of toxic 1.  shapley is what the filter removes,
    summed over all orders, at whatever step.

    Null texts count as empty, and equal each other.  A row without an id has no
    label, and is neither a copy nor what others are copies of.  Rows that share
    an id are rows of their own, and labels of an id add up.  An empty df gives
    no rows.  Other columns are left out.
    """
    modest_batches(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).cast("string").alias("text"))
    flags = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))))
    parts = failures(docs, flags).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("m"))
    rows = parts.select("part", "m", F.explode(_steps()).alias("s")).select("part", "m", "s.*")
    sums = {
        "kept": "IF(x.mask & (before | bit) = 0, x.n, 0L)",
        "removed": "IF(x.mask & before = 0 AND x.mask & bit <> 0, x.n, 0L)",
        "redundant": "IF(x.mask & before <> 0 AND x.mask & bit <> 0, x.n, 0L)",
        "unique_fails": "IF(x.mask = bit, x.n, 0L)",
        "good_lost": "IF(x.mask & before = 0 AND x.mask & bit <> 0, x.good, 0L)",
        "toxic_lost": "IF(x.mask & before = 0 AND x.mask & bit <> 0, x.toxic, 0L)",
        # Of the filters that a row fails, each is the first in as many orders.
        "shapley": "IF(x.mask & bit <> 0, x.n * CAST(120 DIV bit_count(x.mask) AS BIGINT), 0L)",
    }
    return rows.select("part", "filter_order", "step", *(F.expr(f"aggregate(m, 0L, (sum, x) -> sum + {e})").alias(c) for c, e in sums.items()))
