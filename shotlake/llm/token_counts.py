"""Word-piece token counts in time linear in the text, without building the pieces.

The vocabulary is a trie over bytes.  A node v whose string is a piece pops one
piece and continues at the root; any other node pops the pieces that greedy
longest match is bound to take from its string and continues at the node of what
is left: its failure link.  Links and popped counts are computed once, breadth
first, from the parent's.  A word then costs one move per byte plus one failure
move per popped group, with no look back.  All distinct words of a batch move
together with array operations; the few that are left when others have ended, as
a very long word is, go on alone from the node that they have reached.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotlake.llm._store import modest_batches
from shotlake.llm._text import slices, words

ROOT, NONE = 0, -1
FEW = 8  # words that go on alone


class Automaton:
    def __init__(self, pieces: list[bytes]):
        children: list[dict[int, int]] = [{}]
        depth, final, parent, by = [0], [False], [NONE], [0]
        for piece in pieces:
            at = ROOT
            for c in piece:
                if c not in children[at]:
                    children[at][c] = len(children)
                    children.append({})
                    final.append(False)
                    parent.append(at)
                    by.append(c)
                    depth.append(depth[at] + 1)
                at = children[at][c]
            final[at] = at != ROOT
        fail, pops = [NONE] * len(children), [0] * len(children)
        for v in np.argsort(depth, kind="stable")[1:].tolist():
            if final[v]:
                fail[v], pops[v] = ROOT, 1
                continue
            z, popped = fail[parent[v]], pops[parent[v]]
            while z != NONE and by[v] not in children[z]:
                popped += pops[z]
                z = fail[z]
            if z != NONE:
                fail[v], pops[v] = children[z][by[v]], popped
        keys = np.array([v * 256 + c for v, to in enumerate(children) for c in to], np.int64)
        order = np.argsort(keys)
        self.keys, self.to = keys[order], np.array([t for to in children for t in to.values()], np.int64)[order]
        self.fail, self.pops = np.array(fail, np.int64), np.array(pops, np.int64)
        self.children = children

    def _move(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        key = node * 256 + byte
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], NONE) if len(self.keys) else np.full(len(node), NONE)

    def counts(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Pieces of each word data[start:end]; a word that greedy longest match cannot cover counts as one."""
        size = end - start
        order = np.argsort(-size, kind="stable")
        begin, size = start[order], size[order]
        node, count, bad = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64), np.zeros(len(order), bool)

        def follow(who: np.ndarray) -> np.ndarray:
            """Pops at these words' nodes and fails; those that still have a node."""
            count[who] += self.pops[node[who]]
            node[who] = self.fail[node[who]]
            lost = node[who] == NONE
            bad[who[lost]], node[who[lost]] = True, ROOT
            return who[~lost]

        few = int(size[FEW]) if len(size) > FEW else 0
        for t in range(few):
            who = np.arange(np.searchsorted(-size, -t, "left"))
            who = who[~bad[who]]
            while len(who):
                moved = self._move(node[who], data[begin[who] + t].astype(np.int64))
                ok = moved != NONE
                node[who[ok]] = moved[ok]
                who = follow(who[~ok])
        fail, pops, children = self.fail, self.pops, self.children
        for i in np.flatnonzero((size > few) & ~bad).tolist():
            at, popped = int(node[i]), int(count[i])
            for c in data[begin[i] + few : begin[i] + size[i]].tobytes():
                while at != NONE and c not in children[at]:
                    popped += int(pops[at])
                    at = int(fail[at])
                if at == NONE:
                    bad[i], at = True, ROOT
                    break
                at = children[at][c]
            node[i], count[i] = at, popped
        who = np.flatnonzero((node != ROOT) & ~bad)
        while len(who):
            who = follow(who)
            who = who[node[who] != ROOT]
        out = np.empty(len(order), np.int64)
        out[order] = np.where(bad, 1, count)
        return out


@lru_cache(4)
def vocabulary(path: str) -> tuple[bytes, ...]:
    """The distinct strings of a byte-level vocabulary file, without its word-end marks."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    with open(path, encoding="utf-8") as file:
        names = json.load(file)["model"]["vocab"]
    return tuple(sorted({bytes(byte_of[c] for c in name.removesuffix("</w>")) for name in names} - {b""}))


@lru_cache(4)
def automaton(path: str) -> Automaton:
    return Automaton(list(vocabulary(path)))


def token_counts(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_tokens) for each row of df.

    Words are runs of non-space bytes with A-Z lower-cased; n_tokens sums the
    pieces that greedy longest match takes.  Null and blank texts have none.
    Repeated ids give a row each; other columns are left out.
    """

    modest_batches(df.sparkSession)

    def run(batches):
        matcher = automaton(vocabulary_path)
        for b in slices(batches, "text"):
            w = words(b.column(1))
            _, first, back = np.unique(w.hash, return_index=True, return_inverse=True)
            each = matcher.counts(w.data, w.start[first], w.end[first])
            ends = np.append(0, np.cumsum(each[back])) if len(back) else np.zeros(1, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(w.first)), pa.array(ends[w.first[1:]] - ends[w.first[:-1]])], ["id", "n_words", "n_tokens"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, n_words long, n_tokens long")
