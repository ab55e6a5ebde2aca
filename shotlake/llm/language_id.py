"""Language identification by cross-parsing: how few phrases of labelled text cover a text.

For each language a suffix automaton of a bounded sample of its labelled text
recognises every substring of the sample.  A text is parsed from left to right
into phrases, each the longest that occurs in the sample (or one unseen byte).
A phrase takes log2 of the sample's size in bits to point at, so phrases times
that, the cross-parsing entropy times the text's length, compares samples of
unlike sizes; the language with the least wins.

All blocks of all texts of a batch step through the automata together with array
operations.  Each block is first parsed from its own start and beyond its end to
the end of the last phrase.  Then it is parsed again from where the block before
ended its last phrase, until both parses begin a phrase at the same byte, from
which on they are the same.  So phrases cross blocks and the count is that of
one parse of the whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from shotlake.llm._store import modest_batches
from shotlake.llm._text import slices, utf8

#: Bytes as they are compared: A-Z lower-cased, ASCII other than letters as a space.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[[c for c in range(128) if not chr(c).isalpha()]] = 32
UNSEEN = 0  # the symbol of bytes that no sample has
LEAST = 1024  # a shorter sample counts as one of so many bytes


def folded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes with each run of spaces as one, and where each text now begins."""
    data = FOLD[data]
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32)
    keep[offsets[offsets < len(data)]] = True  # a text does not depend on the one before
    return data[keep], np.append(0, np.cumsum(keep))[offsets]


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of each state of the suffix automaton of text; state 0 is the start."""
    moves, link, length, last = [{}], [-1], [0], 0
    for c in text:
        new = len(moves)
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        p, last = last, new
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p < 0:
            continue
        q = moves[p][c]
        if length[q] == length[p] + 1:
            link[new] = q
            continue
        copy = len(moves)
        moves.append(dict(moves[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        while p >= 0 and moves[p].get(c) == q:
            moves[p][c] = copy
            p = link[p]
        link[q] = link[new] = copy
    return moves


@dataclass
class Model:
    languages: list[str]
    symbols: np.ndarray  # of each folded byte
    width: int
    tables: list[np.ndarray]  # state * width + symbol -> next state * width * 2, and 1 if a phrase begins with this byte
    bits: np.ndarray  # to point at a place of each sample


def fit(samples: dict[str, bytes]) -> Model:
    """A model of samples by language."""
    texts = {k: folded(np.frombuffer(v, np.uint8), np.zeros(1, np.int64))[0].tobytes() for k, v in sorted(samples.items()) if v}
    seen = sorted(set(b"".join(texts.values())))
    symbols = np.full(256, UNSEEN, np.uint8 if len(seen) < 254 else np.uint16)
    symbols[seen] = np.arange(len(seen)) + 1
    width, tables = len(seen) + 1, []
    for text in texts.values():
        moves = suffix_automaton(text)
        table = np.empty((len(moves), width), np.int32)
        start = np.zeros(width, np.int64)
        for c, to in moves[0].items():
            start[symbols[c]] = to
        # A byte that cannot extend a phrase begins the next; one that cannot begin a phrase is one by itself.
        table[:] = start * width * 2 + 1
        for state, to in enumerate(moves[1:], 1):
            for c, target in to.items():
                table[state, symbols[c]] = target * width * 2
        tables.append(table.reshape(-1))
    return Model(list(texts), symbols, width, tables, np.array([np.log2(max(len(t), LEAST)) for t in texts.values()]))


def _parse(table: np.ndarray, symbols: np.ndarray, at: np.ndarray, state: np.ndarray, stop: np.ndarray, end: np.ndarray, met: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Parses on from each of at until a phrase begins at stop or later, or where met holds, or to end: where that is, and how many phrases begin before."""
    lanes, out, begun = np.flatnonzero(at < end), end.copy(), np.zeros(len(at), np.int64)
    at, state = at[lanes], state[lanes]
    while len(lanes):
        moved = table[state + symbols[at]]
        begins = (moved & 1).astype(bool)
        halt = begins & (at >= stop[lanes] if met is None else (at >= stop[lanes]) | met[at])
        out[lanes[halt]] = at[halt]
        begun[lanes] += begins & ~halt
        at += 1
        state = moved >> 1
        if halt.any() or (at >= end[lanes]).any():
            on = ~halt & (at < end[lanes])
            lanes, at, state = lanes[on], at[on], state[on]
    return out, begun


@dataclass
class Blocks:
    """The blocks [begin, stop) of texts that end at end, and their bytes' places and symbols step by step, longest block first."""

    text: np.ndarray
    begin: np.ndarray
    stop: np.ndarray
    end: np.ndarray
    symbols: np.ndarray

    def __post_init__(self):
        size = self.stop - self.begin
        self.order = np.argsort(-size, kind="stable")
        self.live = np.searchsorted(-size[self.order], -np.arange(size.max(initial=0)), "left")  # blocks longer than t
        at = self.begin[self.order]
        self.places = [at[:n] + t for t, n in enumerate(self.live.tolist())]
        self.steps = [self.symbols[x] for x in self.places]
        self.places = np.concatenate(self.places) if self.places else np.zeros(0, np.int64)


def _begun(table: np.ndarray, blocks: Blocks) -> np.ndarray:
    """Phrases that begin in each block."""
    state, found = np.zeros(len(blocks.order), np.int32), []
    for now in blocks.steps:
        n = len(now)
        moved = table[state[:n] + now]
        found.append(moved & 1)
        state[:n] = moved >> 1
    marks = np.zeros(len(blocks.symbols) + 1, bool)  # where phrases begin in the blocks' own parses
    marks[blocks.places] = np.concatenate(found) if found else False
    ran = np.empty_like(state)
    ran[blocks.order] = state
    begin, stop, end = blocks.begin, blocks.stop, blocks.end
    own_leave, _ = _parse(table, blocks.symbols, stop, ran, stop, end)
    before = np.append(0, np.cumsum(marks))
    count, entered, leave = before[stop] - before[begin], begin.copy(), own_leave.copy()
    later = np.flatnonzero(blocks.text[1:] == blocks.text[:-1]) + 1
    while len(todo := later[leave[later - 1] != entered[later]]):
        entered[todo] = leave[todo - 1]
        through = entered[todo] >= stop[todo]  # a phrase covers the whole block
        count[todo[through]], leave[todo[through]] = 0, entered[todo[through]]
        todo = todo[~through]
        meet, fresh = _parse(table, blocks.symbols, entered[todo], np.zeros(len(todo), np.int32), stop[todo], end[todo], marks)
        same = meet < stop[todo]
        count[todo] = fresh + np.where(same, before[stop[todo]] - before[np.minimum(meet, stop[todo])], 0)
        leave[todo] = np.where(same, own_leave[todo], meet)
    return count


def phrases(model: Model, column: pa.Array, block: int) -> np.ndarray:
    """Number of phrases of each text for each language."""
    data, offsets = folded(*utf8(column))
    length = np.diff(offsets)
    number = -(-length // block)
    text = np.repeat(np.arange(len(length)), number)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)
    begin, end = offsets[text] + nth * block, offsets[text + 1]
    blocks = Blocks(text, begin, np.minimum(begin + block, end), end, model.symbols[data].astype(np.int32))
    out = np.zeros((len(length), len(model.languages)), np.int64)
    for j, table in enumerate(model.tables):
        out[:, j] = np.bincount(text, weights=_begun(table, blocks), minlength=len(length))
    return out


def sample(df: DataFrame, text_col: str, lang_col: str, sample_bytes: int = 16384, row_chars: int = 512) -> dict[str, bytes]:
    """At most sample_bytes of labelled text for each language: distinct beginnings of rows, drawn by their hash.

    A row gives its first row_chars characters.  Copies share a hash and count
    once, so they neither fill a sample nor keep other rows, or their own
    language, out of it.  The driver gets the beginnings that the sample holds,
    and one more for each language at most.
    """
    labelled = df.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(lang_col).alias("lang"), F.substring(text_col, 1, row_chars).alias("text"))
    labelled = labelled.withColumn("drawn", F.xxhash64("text", F.lit("language sample")))
    sizes = labelled.groupBy("lang").agg(F.approx_count_distinct("drawn"), F.avg(F.length("text"))).collect()
    if not sizes:
        return {}
    # Four times as much as is taken, so that the estimates need not be close.
    limit = F.create_map(*(F.lit(x) for lang, n, mean in sizes for x in (lang, int(min(1.0, 4 * sample_bytes / (n * mean)) * 2**30))))
    drawn = labelled.where(F.pmod("drawn", F.lit(2**30)) <= limit[F.col("lang")]).distinct()
    before = F.sum(F.length("text")).over(Window.partitionBy("lang").orderBy("drawn", "text").rowsBetween(Window.unboundedPreceding, -1))
    texts: dict[str, list[str]] = {}
    for r in sorted(drawn.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < sample_bytes).collect(), key=lambda r: (r["lang"], r["drawn"], r["text"])):
        texts.setdefault(r["lang"], []).append(r["text"])
    return {k: "\n".join(v).encode()[:sample_bytes] for k, v in texts.items()}


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", block: int = 512) -> DataFrame:
    """df with lang_pred and score (0.5: two languages alike, towards 1: clear), replacing columns of these names.

    A text that is null or without a letter is "und" with score 0; so is every
    text if there is no language.  Ties go to the first language by name.  With
    one language only the score is 1.  Other columns and repeated rows stay.
    """
    modest_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    columns = [c for c in df.columns if c.lower() not in ("lang_pred", "score")]
    spare = "_" * (1 + max(map(len, columns), default=0))  # longer than any column, so none clashes

    def run(batches):
        model = shared.value
        for b in slices(batches, f"{spare}text", 2 << 20):
            found = phrases(model, b.column(b.num_columns - 2), block) * model.bits
            usable = np.array(b.column(b.num_columns - 1).to_pylist(), bool) & bool(model.languages)
            if model.languages:
                best = found.argmin(axis=1)
                ordered = np.sort(found, axis=1)
                score = ordered[:, 1] / np.maximum(1e-9, ordered[:, 0] + ordered[:, 1]) if found.shape[1] > 1 else np.ones(len(found))
                names = [model.languages[i] if ok else "und" for i, ok in zip(best.tolist(), usable.tolist(), strict=True)]
            else:
                names, score = ["und"] * b.num_rows, np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(names, pa.string()), pa.array(np.where(usable, score, 0.0))], [*b.schema.names[:-2], "lang_pred", "score"])

    text = F.col(text_col).cast("string")
    schema = df.select(*columns).schema.add("lang_pred", "string").add("score", "double")
    return df.select(*columns, text.alias(f"{spare}text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias(f"{spare}letters")).mapInArrow(run, schema)


def held_out(id_col: str, folds: int, fold: int):
    """Whether crc32 of the id as text leaves that remainder; a null id does not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def identified(df: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_bytes: int = 16384, row_chars: int = 512, block: int = 512) -> DataFrame:
    """df with lang_pred and score, learned from the labelled rows of train."""
    return predict(df, fit(sample(train, text_col, lang_col, sample_bytes, row_chars)), id_col, text_col, block)
