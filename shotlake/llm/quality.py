"""Quality verdicts: base rules, then a log-likelihood ratio of hashed n-grams between trusted text and the whole corpus.

Word unigrams and bigrams are hashed into `buckets` cells.  Two multinomials
are counted over all documents: one over the trusted ones, one over all.  A
document's score is the mean over its n-grams of log p_trusted - log p_corpus.
Documents fall into two halves by a hash of their id, and each half is scored
with the counts of the other, so no document vouches for itself.  The threshold
comes from histograms of the scores of trusted documents and of those labelled
of quality 0, base failures left out: it loses the least share of the one plus
the least share of the other, so no single document sets it.  Without the latter, it
is the score that all but `slack` of the trusted reach.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotlake.llm._filter import maybe_in
from shotlake.llm._store import discard, kept, modest_batches
from shotlake.llm._text import SPACE, U64, Words, _hashes, mix, ngrams, slices, words

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


def _totals(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of flags in each range of offsets."""
    sums = np.append(0, np.cumsum(flags, dtype=np.int64))
    return sums[offsets[1:]] - sums[offsets[:-1]]


def base_stats(w: Words, window: int = 8) -> dict[str, np.ndarray]:
    """The columns BASE for each text of w, whose words must keep their case."""
    n = len(w.first) - 1
    ink = ~SPACE[w.data]
    out = {"n_words": np.diff(w.first), "word_chars": _totals(ink & ((w.data & 0xC0) != 0x80), w.offsets), "n_symbols": _totals(SYMBOL[w.data], w.offsets)}

    # Lines end at \n and at the end of a text.
    brk = np.flatnonzero(w.data == 10)
    end = np.sort(np.concatenate([brk, w.offsets[1:]]))
    start = np.sort(np.concatenate([brk + 1, w.offsets[:-1]]))
    inked = np.append(0, np.cumsum(ink))
    has_word = inked[np.maximum(end, start)] > inked[start]
    start, end = start[has_word], end[has_word]
    line_of = np.searchsorted(w.offsets, start, "right") - 1
    named = mix(_hashes(w.data, start, end) + mix(line_of.astype(U64)))
    _, first = np.unique(named, return_index=True)
    again = np.ones(len(named), bool)
    again[first] = False
    out["n_dup_lines"] = np.bincount(line_of[again], minlength=n)

    text = w.text_of
    grams = ngrams(w.hash, window)
    whole = text[: len(grams)] == text[window - 1 :] if len(grams) else np.zeros(0, bool)
    at = np.flatnonzero(whole)
    _, back, count = np.unique(mix(grams[at] + mix(text[at].astype(U64))), return_inverse=True, return_counts=True)
    twice = at[count[back] > 1]
    cover = np.zeros(len(text) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + window, -1)
    out["n_repeat_words"] = _totals(np.cumsum(cover[:-1]) > 0, w.first)
    return out


def features(w: Words, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of each word and of each pair of neighbouring words."""
    shift, text = U64(64 - (buckets.bit_length() - 1)), w.text_of
    pairs = ngrams(w.hash, 2)
    inside = np.flatnonzero(text[1:] == text[:-1])
    cells = np.concatenate([mix(w.hash) >> shift, mix(pairs[inside] + U64(7)) >> shift]).astype(np.int64)
    return np.concatenate([text, text[inside]]), cells


def counts(docs: DataFrame, buckets: int) -> np.ndarray:
    """[half, bucket] counts over all of docs (half, text)."""

    def run(batches):
        total = np.zeros((2, buckets), np.int64)
        for b in slices(batches, "text"):
            text, cell = features(words(b.column(1), lower=False), buckets)
            total += np.bincount(b.column(0).to_numpy().astype(np.int64)[text] * buckets + cell, minlength=2 * buckets).reshape(2, buckets)
        flat = total.reshape(-1)
        at = np.flatnonzero(flat)
        for i in range(0, len(at), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + (1 << 16)]), pa.array(flat[at[i : i + (1 << 16)]])], ["cell", "n"])

    summed = docs.select("half", "text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(2 * buckets, np.int64)
    out[summed.column("cell").to_numpy()] = summed.column("n").to_numpy()
    return out.reshape(2, buckets)


def of_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose id is in ids, which are distinct, with ids' other columns.

    Texts of others are not moved, but for some that the filter lets through.
    The join sorts and merges whatever the size of ids, so that cost grows evenly with the input.
    """
    return docs.where(maybe_in(docs.sparkSession, "id", ids)).join(ids.hint("merge"), "id")


def ratios(of_all: np.ndarray, of_trusted: np.ndarray, prior: float) -> np.ndarray:
    """[half, bucket] log-likelihood ratios for documents of each half, from the other half's counts."""
    out = np.zeros(of_all.shape)
    for half in (0, 1):
        corpus, trusted = of_all[1 - half], of_trusted[1 - half]
        if trusted.sum():
            logs = [np.log((c + prior) / (c.sum() + prior * len(c))) for c in (trusted, corpus)]
            out[half] = logs[0] - logs[1]
    return out


def _scored(docs: DataFrame, shared, text_col: str, half_col: str, prefix: str = "") -> DataFrame:
    """docs without half_col, its last column, and with BASE and score, their names led by prefix."""
    columns, names = docs.columns[:-1], [prefix + c for c in (*BASE, "score")]
    place = columns.index(text_col)

    def run(batches):
        ratio = shared.value
        for b in slices(batches, text_col):
            w = words(b.column(place), lower=False)
            stats = base_stats(w)
            text, cell = features(w, ratio.shape[1])
            half = b.column(b.num_columns - 1).to_numpy().astype(np.int64)
            n = np.bincount(text, minlength=b.num_rows)
            score = np.bincount(text, weights=ratio[half[text], cell], minlength=b.num_rows) / np.maximum(1, n)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(stats[c].astype(np.int64)) for c in BASE), pa.array(score)], [*columns, *names])

    schema = docs.select(*columns).schema
    for name in names[:-1]:
        schema = schema.add(name, "long")
    return docs.mapInArrow(run, schema.add(names[-1], "double"))


def verdicts(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = 1 << 16, prior: float = 0.5, slack: float = 0.002, min_words: int = 20, most_repeat_percent: int = 30, prefix: str = ""
) -> DataFrame:
    """df with the columns BASE, base_failed, score and kept, led by prefix; they must not be columns of it yet.  text_col is a string.

    labels has (doc_id, quality, toxic); trusted are ids with quality 1 that no
    row calls toxic or of quality 0.  Texts labelled toxic but of quality 1 are on
    neither side.  Null and blank texts have no words and
    fail the base rules.  Without trusted texts all scores are 0 and the base
    rules decide.  Each row is judged on its own text, whether its id repeats or is null.
    df is read three times; of its texts, only those with a label are moved.
    """
    modest_batches(df.sparkSession)
    half = F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(2))
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), half.alias("half"))
    label = labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    sided = kept(label.where("q = 0 or q = 1 and t = 0").select("id", (F.col("q") == 1).alias("trusted")), "quality-labels")
    labelled = kept(of_ids(docs, sided).select("trusted", "text", "half"), "quality-labelled")
    shared = df.sparkSession.sparkContext.broadcast(ratios(counts(docs, buckets), counts(labelled.where("trusted"), buckets), prior))

    def failed(prefix: str = ""):
        return (F.col(f"{prefix}n_words") < min_words) | (100 * F.col(f"{prefix}n_repeat_words") > most_repeat_percent * F.col(f"{prefix}n_words"))

    threshold = _threshold(_scored(labelled, shared, "text", "half").where(~failed()).select("trusted", "score"), slack)
    discard(sided, labelled)
    spare = "_" * (1 + max(map(len, [*df.columns, prefix]), default=0))  # longer than any column, so none clashes
    scored = _scored(df.withColumn(spare, half), shared, text_col, spare, prefix)
    return scored.withColumn(f"{prefix}base_failed", failed(prefix)).withColumn(f"{prefix}kept", ~failed(prefix) & (F.col(f"{prefix}score") >= F.lit(threshold)))


def judged(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rules) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept) for each row of df; see verdicts.  Other columns are left out."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return verdicts(docs, labels, "id", "text", **rules).select("id", *BASE, "base_failed", "score", "kept")


def _threshold(sides: DataFrame, slack: float) -> float:
    """The multiple of 0.001, the lowest on ties, with the least sum of the share of trusted scores below it and the share of the others from it on.

    sides has (trusted, score); scores lie within a few tens, so there are few steps.
    """
    rows = sides.groupBy(F.floor(F.col("score") * 1000).alias("step")).agg(F.count(F.when(F.col("trusted"), 1)).alias("good"), F.count(F.when(~F.col("trusted"), 1)).alias("bad")).orderBy("step").collect()
    good, bad = sum(r["good"] for r in rows), sum(r["bad"] for r in rows)
    if not good:
        return float("-inf")
    below = 0
    if not bad:
        for r in rows:
            below += r["good"]
            if below > slack * good:
                return r["step"] / 1000
    best, at, passed = bad * good, float("-inf"), bad
    for r in rows:
        below += r["good"]
        passed -= r["bad"]
        # Exact in whole numbers: bad * good times the sum of the shares.
        if below * bad + passed * good < best:
            best, at = below * bad + passed * good, (r["step"] + 1) / 1000
    return at
