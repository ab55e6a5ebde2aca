"""Katz back-off of any order, evaluated recursively per token with joins.

The model of shotlake.llm.katz, whose two levels are its first two, with a level
for each order above.  A level's table holds its n-grams' probabilities, and
another its contexts' back-off weights:

    P_k(w | h) = s(h) d_r r / c(h)       if r = c(h w) > 0
               = a(h) P_{k-1}(w | h')    otherwise, h' being h without its first word

A context is made of the last k - 1 tokens, the start of the text counting as
one; where there are fewer, and for contexts that were never seen, the level
below decides.  Tables are built with grouped counts and joins by 64-bit keys,
and a token is a row, so this form is for texts whose tokens may be shuffled once
a level; the query op9 takes the packed form of order 2.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotlake.llm._store import discard, kept, modest_batches
from shotlake.llm._text import U64, gathered, mix_int, ngrams, words
from shotlake.llm.katz import K, good_turing, unseen_types

START, END = U64(mix_int(1)), U64(mix_int(2))


def _grams(order: int):
    """A row for each token of the rows (row, train, text): keys of the n-grams that end with it, and of their contexts, null where the text does not reach back so far."""

    def run(batches):
        for b in gathered(batches, "text"):
            w = words(b.column(2))
            n = np.diff(w.first)
            text = np.repeat(np.arange(len(n)), n + 2)
            ends = np.cumsum(n + 2)
            seq = np.empty(len(text), U64)
            seq[ends - 1], seq[ends - n - 2] = END, START
            inner = np.ones(len(text), bool)
            inner[ends - 1] = inner[ends - n - 2] = False
            seq[inner] = w.hash
            here = np.flatnonzero(np.append(False, text[1:] == text[:-1]))  # all but the starts
            columns = {"row": b.column(0).take(pa.array(text[here])), "train": b.column(1).take(pa.array(text[here])), "is_end": pa.array(np.isin(here, ends - 1)), "g1": pa.array(seq[here].view(np.int64))}
            for k in range(2, order + 1):
                whole, context = ngrams(seq, k), ngrams(seq, k - 1)
                first = here - k + 1
                fits = (first >= 0) & (text[np.maximum(first, 0)] == text[here])
                for name, keys in ((f"g{k}", whole), (f"h{k}", context)):
                    columns[name] = pa.array(keys[np.where(fits, first, 0)].view(np.int64) if len(keys) else np.zeros(len(here), np.int64), mask=~fits)
            yield pa.RecordBatch.from_pydict(columns)

    return run


def _small(counts: DataFrame) -> list[int]:
    """How many rows have each n of 1 to K + 1."""
    found = dict(counts.where(F.col("n") <= K + 1).groupBy("n").count().collect())
    return [found.get(r, 0) for r in range(1, K + 2)]


def _discounted(d: np.ndarray) -> Column:
    """d_n n."""
    return F.when(F.col("n") <= K, F.element_at(F.array(*(F.lit(float(x)) for x in d[1:])), F.least(F.col("n"), F.lit(K)).cast("int")) * F.col("n")).otherwise(F.col("n").cast("double"))


def scored(df: DataFrame, train, order: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, train, n_tokens, score) for each row of df: score is the log10 probability of the text by the model of this order, learned from the rows where train holds.

    Null and empty texts are the end alone; repeated rows and ids, and null ids,
    are scored each by their own text; other columns are left out.
    """
    if order < 1:
        raise ValueError("the order is at least 1")
    modest_batches(df.sparkSession)
    docs = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.coalesce(train, F.lit(False)).alias("train"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    docs = kept(docs, "katz-order-docs")
    schema = "row long, train boolean, is_end boolean, g1 long" + "".join(f", g{k} long, h{k} long" for k in range(2, order + 1))
    tokens = kept(docs.select("row", "train", "text").mapInArrow(_grams(order), schema), "katz-order-tokens")
    seen = tokens.where("train")

    uni = kept(seen.groupBy("g1", "is_end").agg(F.count("*").alias("n")), "katz-order-1")
    small = _small(uni.where("not is_end"))
    total = (uni.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) + 1.0
    d = good_turing(small)
    unseen = (sum(n * r * (1 - d[r]) for r, n in enumerate(small[:K], 1)) + 1.0) / total / unseen_types(small)
    level = kept(uni.select(F.col("g1").alias("g"), (F.when(F.col("is_end"), F.col("n")).otherwise(_discounted(d)) / total).alias("p")), "katz-order-p1")
    tables, scratch = [(level, None)], [docs, tokens, uni, level]
    for k in range(2, order + 1):
        counts = kept(seen.where(f"g{k} is not null").groupBy(F.col(f"g{k}").alias("g"), F.col(f"h{k}").alias("h"), F.col(f"g{k - 1}").alias("below")).agg(F.count("*").alias("n")), f"katz-order-{k}")
        d = good_turing(_small(counts))
        # What was seen at this level was seen at the one below.
        rows = counts.join(tables[-1][0].select(F.col("g").alias("below"), F.col("p").alias("lower")), "below").withColumn("mass", _discounted(d))
        sums = rows.groupBy("h").agg(F.sum("n").alias("c"), F.sum("mass").alias("mass"), F.sum("lower").alias("lower"))
        share = F.col("mass") / F.col("c")
        scale = F.when(share > 1 - 1e-9, F.col("c") / (F.col("c") + 1)).otherwise(1.0)
        backs = kept(sums.select("h", "c", scale.alias("s"), ((1 - scale * share) / F.greatest(1 - F.col("lower"), F.lit(unseen))).alias("a")), f"katz-order-a{k}")
        level = kept(rows.select("g", "h", "mass").join(backs, "h").select("g", (F.col("s") * F.col("mass") / F.col("c")).alias("p")), f"katz-order-p{k}")
        tables.append((level, backs))
        scratch += [counts, backs, level]

    out = tokens
    for k, (level, backs) in enumerate(tables, 1):
        out = out.join(level.select(F.col("g").alias(f"g{k}"), F.col("p").alias(f"p{k}")), f"g{k}", "left")
        out = out if backs is None else out.join(backs.select(F.col("h").alias(f"h{k}"), F.col("a").alias(f"a{k}")), f"h{k}", "left")
    score = F.log10(F.coalesce("p1", F.lit(unseen)))
    for k in range(2, order + 1):
        score = F.when(F.col(f"p{k}").isNotNull(), F.log10(f"p{k}")).otherwise(F.coalesce(F.log10(f"a{k}"), F.lit(0.0)) + score)
    sums = out.groupBy("row").agg(F.count("*").alias("n_tokens"), F.sum(score).alias("score"))
    out = kept(docs.select("row", "id", "train").join(sums, "row").select("id", "train", "n_tokens", "score"), "katz-order")
    discard(*scratch)
    return out
