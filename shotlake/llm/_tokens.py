"""Exact encoding of whole texts with the tokenizers library, through a cache of space-separated pieces.

The tokenizer's rules never join or look across ASCII white space, so a text's
ids are those of its pieces in order.  Where the vocabulary file's normaliser
lower-cases, pieces that differ in A-Z alone are one.  A tokenizer that does
look at white space, as byte-level ones do, encodes each text as a whole.  Each worker encodes a piece once and
keeps its ids; a text is then put together from the kept ids with array
operations.  The kept table starts afresh beyond `most` pieces, so memory is
bounded.  Pieces are told apart by 64-bit hashes of their bytes.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa

from shotlake.llm._text import U64, utf8, words

_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _lowers(normalizer: dict | None) -> bool:
    """Whether a normaliser of a vocabulary file lower-cases."""
    if not normalizer:
        return False
    return normalizer["type"] == "Lowercase" or bool(normalizer.get("lowercase")) or any(map(_lowers, normalizer.get("normalizers", [])))


class Encoder:
    def __init__(self, path: str, most: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        with open(path, encoding="utf-8") as file:
            self.lower = _lowers(json.load(file).get("normalizer"))
        whole, *parts = (self.tokenizer.encode(x, add_special_tokens=False).ids for x in (" a b\n\tc,", "a", "b", "c,"))
        self.apart = whole == sum(parts, [])
        self._clear()

    def _clear(self) -> None:
        self.known, self.start, self.size = np.zeros(0, U64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.pool = np.zeros(0, np.uint32)

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        """Adds pieces by their ascending hashes; encodings are dropped as soon as their ids are copied."""
        sizes, ids = [], [self.pool]
        for i in range(0, len(pieces), 2_000):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(pieces[i : i + 2_000], add_special_tokens=False)]
            sizes += map(len, found)
            ids.append(np.fromiter((x for e in found for x in e), np.uint32))
        size = np.array(sizes, np.int32)
        start = len(self.pool) + np.cumsum(size) - size
        self.pool = np.concatenate(ids)
        at = np.searchsorted(self.known, hashes)
        self.known, self.start, self.size = np.insert(self.known, at, hashes), np.insert(self.start, at, start), np.insert(self.size, at, size)

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, uint32, and where each text's begin; one more offset than texts.  Null counts as empty."""
        if not self.apart:
            found = [e.ids for e in self.tokenizer.encode_batch_fast(column.fill_null("").to_pylist(), add_special_tokens=False)]
            return np.fromiter((x for ids in found for x in ids), np.uint32), np.append(0, np.cumsum([len(ids) for ids in found])).astype(np.int64)
        special = b"<|" in utf8(column)[0].tobytes()  # then a special token's string could arise from capitals
        w = words(column, lower=self.lower and not special)
        seen, first, back = np.unique(w.hash, return_index=True, return_inverse=True)
        if len(self.known) > self.most:
            self._clear()
        at = np.minimum(np.searchsorted(self.known, seen), max(0, len(self.known) - 1))
        new = self.known[at] != seen if len(self.known) else np.ones(len(seen), bool)
        if new.any():
            raw = w.data.tobytes()
            self._learn(seen[new], [raw[w.start[i] : w.end[i]].decode("utf-8", "replace") for i in first[new]])
            at = np.searchsorted(self.known, seen)
        sizes = self.size[at][back].astype(np.int64) if len(seen) else np.zeros(0, np.int64)
        ends = np.append(0, np.cumsum(sizes))
        begin = self.start[at][back] - ends[:-1] if len(seen) else np.zeros(0, np.int64)
        return self.pool[np.repeat(begin, sizes) + np.arange(ends[-1])], ends[w.first]


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with end_id after each text."""
    return np.insert(ids, offsets[1:], np.uint32(end_id)), offsets + np.arange(len(offsets))
