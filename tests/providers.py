"""Deterministic providers: what models do, by rules that need none.

Each is made once in a worker and turns a batch of rows into rows, as
`media.Provider` asks, so a model can take its place.  They measure what is in
the data, energy, bands, bright areas, and always give the same for the same input.
"""

from __future__ import annotations

import hashlib
import importlib.util

import numpy as np
import pandas as pd

from shotlake.functions.text import SECTIONS


def available(needs: dict[str, list[str]]) -> dict[str, tuple[bool, list[str]]]:
    """For each phase whether the modules that it needs are there, and which are missing."""
    missing = {k: [m for m in v if importlib.util.find_spec(m) is None] for k, v in needs.items()}
    return {k: (not v, v) for k, v in missing.items()}


class EnergyRegions:
    """Regions of (stream, sample_rate, samples) in which the level of short windows reaches a threshold; pauses below `gap` seconds are bridged."""

    schema = "stream string, region_no long, start_sec double, end_sec double, samples array<float>"

    def __init__(self, threshold: float = 0.02, window: float = 0.02, gap: float = 0.3):
        self.threshold, self.window, self.gap = threshold, window, gap

    def regions(self, samples: np.ndarray, rate: int) -> list[tuple[int, int]]:
        size = max(1, round(rate * self.window))
        if not len(samples):
            return []
        edges = np.arange(0, len(samples), size)
        level = np.sqrt(np.add.reduceat(samples.astype(np.float64) ** 2, edges) / np.diff(np.append(edges, len(samples))))
        out: list[tuple[int, int]] = []
        for i in np.flatnonzero(level >= self.threshold):
            a, b = int(edges[i]), int(min(edges[i] + size, len(samples)))
            if out and a - out[-1][1] <= self.gap * rate:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
        return out

    def rows(self, batch: pd.DataFrame) -> pd.DataFrame:
        out = []
        for stream, rate, samples in zip(batch.stream, batch.sample_rate, batch.samples, strict=True):
            samples = np.asarray(samples if samples is not None else [], np.float32)
            out += [(stream, i, a / rate, b / rate, samples[a:b]) for i, (a, b) in enumerate(self.regions(samples, 1 if pd.isna(rate) else int(rate)))]
        return pd.DataFrame(out, columns=["stream", "region_no", "start_sec", "end_sec", "samples"])


class PitchWords:
    """Words of regions (stream, region_no, start_sec, end_sec, samples): one for each quarter of a second, by how often the sign changes; louder ones end a sentence."""

    schema = "stream string, region_no long, start_sec double, end_sec double, text string, words array<struct<text:string,start:double,end:double>>"

    def rows(self, batch: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in batch.itertuples():
            x, words = np.asarray(r.samples, np.float64), []
            n = max(1, round((r.end_sec - r.start_sec) * 4))
            for k, part in enumerate(np.array_split(x, n)):
                rate = int(1000 * np.mean(np.diff(np.signbit(part)) != 0)) if len(part) > 1 else 0
                words.append({"text": f"tone{rate}", "start": k * (r.end_sec - r.start_sec) / n, "end": (k + 1) * (r.end_sec - r.start_sec) / n})
            out.append((r.stream, r.region_no, r.start_sec, r.end_sec, " ".join(w["text"] for w in words) + ".", words))
        return pd.DataFrame(out, columns=["stream", "region_no", "start_sec", "end_sec", "text", "words"])


class BandPrint:
    """A unit vector of the energy in even bands of each of samples; null for silence or none."""

    schema = "stream string, region_no long, embedding array<double>"

    def __init__(self, bands: int = 16):
        self.bands = bands

    def rows(self, batch: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in batch.itertuples():
            x = np.asarray(r.samples if r.samples is not None else [], np.float64)
            power = np.abs(np.fft.rfft(x)) ** 2 if len(x) >= 2 * self.bands else np.zeros(0)
            e = np.sqrt([p.sum() for p in np.array_split(power, self.bands)]) if power.sum() > 0 else None
            out.append((r.stream, r.region_no, None if e is None else e / np.linalg.norm(e)))
        return pd.DataFrame(out, columns=["stream", "region_no", "embedding"])


class SmoothStems:
    """Two stems whose sum is the input: a moving average as instrumental, and the rest as vocals."""

    schema = "stream string, vocals array<float>, instrumental array<float>"

    def __init__(self, width: int = 9):
        self.width = width

    def rows(self, batch: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in batch.itertuples():
            x = np.asarray(r.samples, np.float32)
            low = np.convolve(x, np.full(self.width, 1 / self.width), "same")[: len(x)].astype(np.float32) if len(x) else x
            out.append((r.stream, x - low, low))
        return pd.DataFrame(out, columns=["stream", "vocals", "instrumental"])


class BrightBoxes:
    """Boxes round connected bright areas of gray frames (stream, frame_index, height, width, data), largest first, with their mean as score."""

    schema = "stream string, frame_index long, box_no long, x1 double, y1 double, x2 double, y2 double, score double"

    def __init__(self, threshold: int = 200, least: int = 16):
        self.threshold, self.least = threshold, least

    def boxes(self, gray: np.ndarray) -> list[tuple[int, int, int, int, float]]:
        left, out = gray >= self.threshold, []
        while left.any():
            at = np.zeros_like(left)
            at[np.unravel_index(int(left.argmax()), left.shape)] = True
            while True:  # grows over its neighbours until nothing is added
                grown = at.copy()
                grown[1:] |= at[:-1]
                grown[:-1] |= at[1:]
                grown[:, 1:] |= at[:, :-1]
                grown[:, :-1] |= at[:, 1:]
                grown &= left
                if (grown == at).all():
                    break
                at = grown
            left = left & ~at
            y, x = np.nonzero(at)
            if len(y) >= self.least:
                out.append((int(x.min()), int(y.min()), int(x.max()) + 1, int(y.max()) + 1, float(gray[at].mean() / 255)))
        return sorted(out, key=lambda b: (-(b[2] - b[0]) * (b[3] - b[1]), b))

    def rows(self, batch: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in batch.itertuples():
            gray = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width)
            out += [(r.stream, r.frame_index, i, *map(float, b)) for i, b in enumerate(self.boxes(gray))]
        return pd.DataFrame(out, columns=["stream", "frame_index", "box_no", "x1", "y1", "x2", "y2", "score"])


class PatchPrint:
    """A unit vector of the means of an even grid over gray images (stream, frame_index, height, width, data); zeros for a flat one."""

    schema = "stream string, frame_index long, embedding array<double>"

    def __init__(self, side: int = 4):
        self.side = side

    def rows(self, batch: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in batch.itertuples():
            gray = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width).astype(np.float64)
            cells = np.array([c.mean() if c.size else 0.0 for rows in np.array_split(gray, self.side) for c in np.array_split(rows, self.side, axis=1)])
            cells = cells - cells.mean()
            n = np.linalg.norm(cells)
            out.append((r.stream, r.frame_index, cells / n if n > 1e-9 else cells))
        return pd.DataFrame(out, columns=["stream", "frame_index", "embedding"])


class SectionChat:
    """An answer to each prompt (key, prompt) with every section that one must have, and the prompt's digest under each."""

    schema = "key string, answer string"

    def rows(self, batch: pd.DataFrame) -> pd.DataFrame:
        answers = ["\n".join(f"{s} {hashlib.md5((s + p).encode()).hexdigest()[:8]}" for s in SECTIONS) for p in batch.prompt]
        return pd.DataFrame({"key": batch.key, "answer": answers})
