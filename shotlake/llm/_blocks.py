"""Queries against all rows of a vector table, in blocks that meet by key.

Rows are dealt into blocks of a bounded size, whatever their ids, and queries
into others.  Both are sent to the keys (block, queries' block), a row once for
each block of the other side, so every pair meets in one task; there the rows of
a block come first and are held, and the queries pass by in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 16 << 20  # bytes of a block of rows, at 8 a component
LEAST = 2048  # rows of a block, if there are more
AT_ONCE = 1 << 19  # pairs of a query and a row that are looked at together


def finite(vector: str) -> Column:
    """Whether a vector is not null and has no null or non-finite component."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def slot() -> Column:
    """A number for each row by which rows are dealt into blocks, copies too; to be written before it is used."""
    return F.xxhash64(F.monotonically_increasing_id())


def blocks_of(n: int, dim: int) -> int:
    """Into how many blocks n rows go: enough to keep them small, and to keep some dozens of tasks busy."""
    most = max(1, MOST // (8 * max(1, dim)))
    return max(1, -(-n // most), min(64, n // LEAST))


def matrix(column: pa.Array, dim: int, dtype=np.float64) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    sizes, flat = np.asarray(column.value_lengths()), np.asarray(column.flatten())
    if (sizes == dim).all():
        return flat.reshape(-1, dim).astype(dtype)
    out = np.zeros((len(sizes), dim), dtype)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


@dataclass
class Meeting:
    """A batch of queries, and what has been made of the rows of the block that they meet."""

    block: object
    queries: pa.RecordBatch


def meetings(batches: Iterator[pa.RecordBatch], keys: list[str], made: Callable[[pa.Table], object]) -> Iterator[Meeting]:
    """Goes through batches sorted by keys and by whether they are queries (column asks)."""
    now, rows, block = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.stack([batch.column(batch.schema.get_field_index(k)).to_numpy().astype(np.int64) for k in (*keys, "asks")])
        edges = np.append(np.flatnonzero(np.append(True, (marks[:, 1:] != marks[:, :-1]).any(0))), batch.num_rows)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            key, asks = tuple(marks[:-1, a]), marks[-1, a]
            if key != now:
                now, rows, block = key, [], None
            if not asks:
                rows.append(batch.slice(a, b - a))
            elif rows or block is not None:
                if block is None:
                    block, rows = made(pa.Table.from_batches(rows)), []
                yield Meeting(block, batch.slice(a, b - a))


def best_of(found: dict[str, np.ndarray], by: list[str], most: int) -> np.ndarray:
    """Which entries are among the `most` first of their group: higher scores first, then smaller ids."""
    order = np.lexsort((found["id"], -found["score"], *(found[c] for c in reversed(by))))
    group = np.stack([found[c][order] for c in by])
    new = np.append(True, (group[:, 1:] != group[:, :-1]).any(0))[: len(order)]
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - first < most]


def sent(rows: DataFrame, asks: bool, other: str, blocks: int) -> DataFrame:
    """The rows, once for each block of the other side, which goes to the column other."""
    return rows.withColumn("asks", F.lit(int(asks))).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
