"""Best-fit packing of token pieces into sequences of a fixed capacity.

The plan is made from the histogram of lengths, which has at most `capacity`
entries however large the corpus is.  Pieces longer than a third of the
capacity fit at most twice into a sequence: from the longest down, each is
matched with the longest other that fits.  The rest go, longest first, into the
smallest gap that holds them.  Equal lengths move in runs, so the plan is a
short table of runs (length, range of ranks, first sequence, pieces per
sequence, offset), and each piece finds its place from its rank among the
pieces of its length.  Ranks come from counts by (length, salt), and a length
has a salt for each SALTED of its pieces, so a common one is spread over many
tasks whose size does not grow.
"""

from __future__ import annotations

import bisect
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shotlake.llm._store import kept, modest_batches
from shotlake.llm._text import slices
from shotlake.llm._tokens import encoder, with_end

SALTED = 1 << 15


@dataclass
class Plan:
    """Runs by (length, first rank); sequences is the number that follows the last sequence."""

    capacity: int
    runs: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)  # length, rank from, rank to, sequence, per sequence, offset
    sequences: int = 0

    def arrays(self) -> dict[int, np.ndarray]:
        out: dict[int, list] = {}
        for length, *run in sorted(self.runs):
            out.setdefault(length, []).append(run)
        return {k: np.array(v, np.int64) for k, v in out.items()}


def plan(histogram: dict[int, int], capacity: int, opened_before: int = 0) -> Plan:
    """A packing of histogram[length] pieces of each length, 1 to capacity, into sequences numbered from opened_before."""
    if any(not 1 <= length <= capacity for length in histogram):
        raise ValueError("lengths must lie between 1 and the capacity")
    p, left, rank = Plan(capacity, sequences=opened_before), {k: v for k, v in histogram.items() if v}, dict.fromkeys(histogram, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: runs of sequences (first, number)
    sizes: list[int] = []  # the gaps that have runs

    def put(length: int, sequence: int, bins: int, each: int, offset: int) -> None:
        p.runs.append((length, rank[length], rank[length] + bins * each, sequence, each, offset))
        rank[length] += bins * each
        left[length] -= bins * each

    def leave(gap: int, sequence: int, bins: int) -> None:
        if gap and bins:
            if not gaps.setdefault(gap, []):
                bisect.insort(sizes, gap)
            gaps[gap].append((sequence, bins))

    def opened(bins: int) -> int:
        p.sequences += bins
        return p.sequences - bins

    large = sorted(k for k in left if 3 * k > capacity)
    for length in reversed(large):
        while left[length]:
            at = bisect.bisect_right(large, min(length, capacity - length)) - 1
            while at >= 0 and left[large[at]] < 1 + (large[at] == length):
                at -= 1
            if at < 0:
                n = left[length]
                first = opened(n)
                put(length, first, n, 1, 0)
                leave(capacity - length, first, n)
            else:
                mate = large[at]
                n = left[length] // 2 if mate == length else min(left[length], left[mate])
                first = opened(n)
                put(length, first, n, 1, 0)
                put(mate, first, n, 1, length)
                leave(capacity - length - mate, first, n)
    for length in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[length]:
            at = bisect.bisect_left(sizes, length)
            gap = sizes[at] if at < len(sizes) else capacity
            each = gap // length
            if at < len(sizes):
                first, bins = gaps[gap].pop()
                if not gaps[gap]:
                    sizes.pop(at)
            else:
                bins = -(-left[length] // each)
                first = opened(bins)
            full = min(bins, left[length] // each)
            if full:
                put(length, first, full, each, capacity - gap)
                leave(gap - each * length, first, full)
            rest = left[length] if full < bins and left[length] < each else 0
            if rest:
                put(length, first + full, 1, rest, capacity - gap)
                leave(gap - rest * length, first + full, 1)
            leave(gap, first + full + bool(rest), bins - full - bool(rest))
    return p


def pieces_of(df: DataFrame, id_col: str, text_col: str, vocabulary: str, capacity: int, end_id: int, with_ids: bool, part_col: str | None = None) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids][, part]) of each text's ids and end_id, cut into pieces of at most capacity."""
    parts_of = [] if part_col is None else ["part"]

    def run(batches):
        encode = encoder(vocabulary)
        for b in slices(batches, "text", 2 << 20):
            ids, offsets = with_end(*encode(b.column(1)), end_id)
            count = -(-np.diff(offsets) // capacity)
            text = np.repeat(np.arange(b.num_rows), count)
            piece = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
            begin = offsets[text] + piece * capacity
            end = np.minimum(begin + capacity, offsets[text + 1])
            raw = memoryview(ids.astype("<u4").tobytes())
            parts = [raw[4 * x : 4 * y] for x, y in zip(begin.tolist(), end.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(text)), pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(end - begin), pa.array([zlib.crc32(x) for x in parts], pa.int64()), *[pa.array(parts, pa.binary())] * with_ids, *[b.column(2).take(pa.array(text)) for _ in parts_of]],
                ["id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, *parts_of],
            )

    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *(F.col(part_col).cast("string").alias(c) for c in parts_of))
    return docs.mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids + ", part string" * len(parts_of))


def pack(pieces: DataFrame, capacity: int, key: list[str], part_col: str | None = None) -> DataFrame:
    """pieces with sequence_id and offset; they need a column length from 1 to capacity.

    key are columns that order the pieces of one length; pieces equal in all of
    them may change places.  pieces is read three times, so pass a written table.
    No sequence holds more than capacity; its pieces lie without gaps from 0.
    Given part_col, a string column, no sequence holds pieces of two parts; null is one of them.
    Each part has its plan, so the driver has a histogram for each.
    """
    part = [] if part_col is None else [part_col]
    histograms: dict[str | None, dict[int, int]] = {}
    for *of, length, n in pieces.groupBy(*part, "length").count().collect():
        histograms.setdefault(of[0] if of else None, {})[length] = n
    plans, opened = {}, 0
    for name in sorted(histograms, key=lambda name: (name is not None, name or "")):
        plans[name] = plan(histograms[name], capacity, opened)
        opened = plans[name].sequences
    shared = pieces.sparkSession.sparkContext.broadcast({k: p.arrays() for k, p in plans.items()})
    most = [sum(h.get(n, 0) for h in histograms.values()) for n in range(1, capacity + 1)]
    salts = F.expr(f"array({', '.join(f'{max(1, -(-n // SALTED))}L' for n in most)})")  # one literal
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*key), F.element_at(salts, F.col("length").cast("int"))))
    counts = salted.groupBy(*part, "length", "_salt").agg(F.count("*").alias("_n"))
    names = [F.col(c).alias("_part") for c in part]
    before = counts.select(*names, F.col("length").alias("_length"), F.col("_salt").alias("_of"), (F.sum("_n").over(Window.partitionBy(*part, "length").orderBy("_salt")) - F.col("_n")).alias("_before"))
    ranked = salted.withColumn("_row", F.row_number().over(Window.partitionBy(*part, "length", "_salt").orderBy(*key)))
    same = (F.col("length") == F.col("_length")) & (F.col("_salt") == F.col("_of"))
    for c in part:
        same &= F.col(c).eqNullSafe(F.col("_part"))
    ranked = ranked.join(before, same)
    ranked = ranked.select(*pieces.columns, (F.col("_before") + F.col("_row") - 1).alias("_rank"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(part, length, rank):
        import pandas as pd

        code, found = pd.factorize(part, use_na_sentinel=False)
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        kind = code * (capacity + 1) + lengths
        sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
        order = np.argsort(kind, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(kind[order])) + 1) if len(order) else []:
            name, size, r = found[code[group[0]]], lengths[group[0]], ranks[group]
            runs = shared.value[None if pd.isna(name) else name][size]
            of = runs[np.searchsorted(runs[:, 0], r, "right") - 1]
            nth = r - of[:, 0]
            sequence[group], offset[group] = of[:, 2] + nth // of[:, 3], of[:, 4] + nth % of[:, 3] * size
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    name = F.col(part_col) if part else F.lit(None).cast("string")
    return ranked.withColumn("_place", place(name, "length", "_rank")).select(*pieces.columns, "_place.sequence_id", "_place.offset")


def packed_documents(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, with_ids: bool = False, part_col: str | None = None) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids][, part], sequence_id, offset) for every piece of every text.

    Null and empty texts are the end id alone.  Repeated ids are packed as
    separate rows.  Other columns of df are left out.  An empty df gives no rows.
    Given part_col, a sequence holds texts of one value of it only, which is in part.
    """
    modest_batches(df.sparkSession)
    columns = ["id", "piece", "start", "length", "ids_crc32"]
    pieces = kept(pieces_of(df, id_col, text_col, vocabulary, capacity, end_id, with_ids, part_col), "pieces")
    return pack(pieces, capacity, columns, None if part_col is None else "part")
