"""Order-dependent folds against plain restatements of their rules."""

import math
import random

import numpy as np
import pytest

from shotlake.operators import identity as ID
from shotlake.operators import registry
from shotlake.operators import segments as S
from shotlake.operators.registry import Registry


def plain_segments(total, cuts, least, most, rounds):
    """Straight from the rules, on lists of bounds."""
    if total < least:
        return [(0, total)]
    bounds = sorted({0, total, *(c for c in cuts if 0 < c < total)}) if len(cuts) >= 2 else [0, total]

    def split(bounds):
        out = [0]
        for a, b in zip(bounds, bounds[1:], strict=False):
            n = math.ceil((b - a) / most) if b - a > most else 1
            out += [x for x in (a + round(k * (b - a) / n) for k in range(1, n + 1)) if x > out[-1]]
        return out

    def short(bounds):
        return next((i for i in range(len(bounds) - 1) if bounds[i + 1] - bounds[i] < least), None)

    for _ in range(rounds):
        bounds = split(bounds)
        while len(bounds) > 2 and (i := short(bounds)) is not None:
            options = []
            if i > 0:
                options.append((bounds[i + 1] - bounds[i - 1], 0, i))
            if i + 2 < len(bounds):
                options.append((bounds[i + 2] - bounds[i], 1, i + 1))
            fitting = [o for o in options if o[0] <= most] or options
            del bounds[min(fitting)[2]]
        if all(least <= b - a <= most for a, b in zip(bounds, bounds[1:], strict=False)):
            return list(zip(bounds, bounds[1:], strict=False))
    bounds = split(bounds)
    for _ in range(100):
        if len(bounds) <= 2 or (i := short(bounds)) is None:
            break
        left = bounds[i] - bounds[i - 1] if i else math.inf
        right = bounds[i + 2] - bounds[i + 1] if i + 2 < len(bounds) else math.inf
        del bounds[i if left <= right else i + 1]
        bounds = split(bounds)
    return list(zip(bounds, bounds[1:], strict=False))


def test_segments_follow_the_rules():
    rng = random.Random(1)
    for _ in range(400):
        total, least = rng.randrange(1, 400), rng.randrange(1, 40)
        most = rng.randrange(least, 90)
        cuts = sorted(rng.sample(range(total + 1), rng.randrange(0, min(12, total + 1))))
        assert S.fold_segments(total, cuts, least, most)[0] == plain_segments(total, cuts, least, most, 5)


def test_segments_of_stated_cases():
    assert S.fold_segments(250, [0, 75, 175, 250], 25, 375)[0] == [(0, 75), (75, 175), (175, 250)]
    assert len(S.fold_segments(950, [], 25, 375)[0]) == math.ceil(38 / 15)
    assert all(b - a >= 50 for a, b in S.fold_segments(100, [0, 25, 50, 75, 100], 50, 375)[0])
    assert S.fold_segments(37, [], 50, 375) == ([(0, 37)], 1, True)


def test_track_clusters_join_strongest_first_and_keep_conflicts_apart():
    rng = random.Random(2)
    for _ in range(100):
        n = rng.randrange(1, 9)
        pairs = sorted(((round(rng.random(), 3), a, b, rng.random() < 0.3) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.6), key=lambda p: (-p[0], p[1], p[2]))
        bans = {(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.2}
        got = ID.fold_tracks(list(range(n)), pairs, bans, 0.5)
        sets = [{t} for t in range(n)]
        for s, a, b, f in pairs:
            x, y = next(g for g in sets if a in g), next(g for g in sets if b in g)
            if x is not y and (s >= 0.5 or f) and not any((min(p, q), max(p, q)) in bans for p in x for q in y):
                sets.remove(y)
                x |= y
        assert {frozenset(t for t in got if got[t] == c) for c in got.values()} == set(map(frozenset, sets))


def test_greedy_clusters_recompute_centres_from_members():
    rng = np.random.default_rng(3)
    vectors = [v for v in rng.normal(size=(60, 4))]
    unit = lambda v: v / np.linalg.norm(v)
    members, out = [], []
    for v in map(unit, vectors):
        scores = [float(v @ unit(np.mean(m, axis=0))) for m in members]
        best = max(range(len(scores)), key=scores.__getitem__, default=None)
        if best is not None and scores[best] >= 0.6:
            members[best].append(v)
        else:
            best = len(members)
            members.append([v])
        out.append(best)
    assert ID.fold_greedy(vectors, 0.6) == out


def test_near_copies_are_judged_against_what_is_kept():
    e = lambda *x: np.array(x, float)
    thumb = np.zeros(4)
    records = [(e(1, 0), thumb), (e(1, 0.01), thumb), (None, thumb), (None, thumb + 1), (None, thumb + 200), (e(0, 1), thumb)]
    assert ID.fold_distinct(records, 0.92, 0.995) == [0, 2, 4, 5]


def test_suppression_keeps_the_best_of_overlapping_boxes():
    boxes = np.array([[0, 0, 10, 10], [1, 1, 10, 10], [20, 20, 30, 30], [0, 0, 10, 4]], float)
    assert ID.fold_suppress(boxes, np.array([0.5, 0.9, 0.1, 0.3]), 0.4) == [1, 3, 2]
    assert ID.fold_suppress(np.zeros((0, 4)), np.zeros(0), 0.4) == []


def test_association_bridges_gaps_and_numbers_the_rest():
    box = (0, 0, 10, 10)
    near, tall = (2, 0, 12, 10), (0, 0, 10, 50)
    got = ID.fold_association([(0, 0, box, 7), (1, 0, near, None), (2, 0, tall, None), (20, 0, box, None)], diagonal=100)
    assert got == [7, 7, -30000, -210000]


def test_registry_merges_like_voices_once_for_each_sample():
    r = Registry()
    a, b = [1.0, 0.0], [0.0, 1.0]
    assert r.match(a, a, "v1", 0) == "speaker_1"
    assert r.match(b, b, "v1", 1) == "speaker_2"
    assert r.match([0.9, 0.1], [0.9, 0.1], "v2", 0) == "speaker_1"
    centre, n = r.speakers["speaker_1"]["cam"].copy(), r.speakers["speaker_1"]["samples"]
    assert r.match([0.9, 0.1], [0.9, 0.1], "v2", 0) == "speaker_1"  # again: nothing moves
    assert (r.speakers["speaker_1"]["cam"] == centre).all() and r.speakers["speaker_1"]["samples"] == n == 2
    assert r.match(None) is None
    assert r.match([0.9, 0.1], None, "v3", 0) == "speaker_1"  # without the second print the first decides
    assert np.isclose(np.linalg.norm(r.speakers["speaker_1"]["cam"]), 1)


def plain_registry(samples, least_cam, least_eres):
    """Each sample against each speaker, one after another."""
    cosine = lambda a, b: -1.0 if a is None or b is None or len(a) != len(b) else float(np.dot(a, b) / s) if (s := np.linalg.norm(a) * np.linalg.norm(b)) > 1e-9 else 0.0
    unit = lambda v: None if v is None else v / n if (n := np.linalg.norm(v)) > 1e-8 else v
    speakers, out = [], []
    for cam, eres in samples:
        if cam is None:
            out.append(None)
            continue
        cam, eres, best = unit(cam), unit(eres), (-1.0, None, -1.0, -1.0)
        for k, (c, e, _) in enumerate(speakers):
            x, y = cosine(cam, c), cosine(eres, e)
            if (y if y >= 0 else x) > best[0]:
                best = (y if y >= 0 else x, k, x, y)
        _, k, x, y = best
        if k is not None and x >= least_cam and (y < 0 or y >= least_eres):
            c, e, n = speakers[k]
            speakers[k] = (unit((c * n + cam) / (n + 1)), e if eres is None else eres if e is None else unit((e * n + eres) / (n + 1)), n + 1)
        else:
            k = len(speakers)
            speakers.append((cam, eres, 1))
        out.append(f"speaker_{k + 1}")
    return out, speakers


@pytest.mark.parametrize("odd", [False, True])
def test_a_registry_in_batches_equals_each_sample_against_each_speaker(monkeypatch, odd):
    rng = np.random.default_rng(12)
    monkeypatch.setattr(registry, "FEW", 20)
    monkeypatch.setattr(registry, "BATCH", 50)
    samples = [(rng.integers(-2, 3, 5).astype(float), rng.integers(-2, 3, 4).astype(float) if rng.random() < 0.6 else None) for _ in range(600)]  # small integers, so there are ties and right angles
    samples[7:7] = [(None, None), (np.zeros(5), np.zeros(4)), (np.ones(5), np.zeros(4)), (np.full(5, 1e-9), None)]
    if odd:
        samples[300:300] = [(np.array([3.0, 7.0]), None), (np.array([3.0, 6.0]), None)]
    for least in ((0.9, 0.9), (0.3, 0.55), (-1.0, -1.0)):
        if odd and least[0] < 0:
            continue  # prints of other lengths would be added to one another
        want, speakers = plain_registry(samples, *least)
        r, got = Registry(*least), []
        for a in range(0, len(samples), 70):
            got += r.match_all([(cam, eres, "v", None) for cam, eres in samples[a : a + 70]])
        assert got == want
        assert all((s["cam"] == c).all() and s["samples"] == n for s, (c, _, n) in zip(r.speakers.values(), speakers, strict=True))


def test_a_registry_of_many_speakers_looks_at_few(monkeypatch):
    rng = np.random.default_rng(13)
    calls, cosine = [], registry._cosine
    monkeypatch.setattr(registry, "_cosine", lambda a, b: calls.append(1) or cosine(a, b))
    r, samples = Registry(0.8, 0.8), rng.standard_normal((2000, 16))
    names = [r.match(x, y, None, i) for i, (x, y) in enumerate(zip(samples, np.roll(samples, 1, axis=0), strict=True))]
    assert len(set(names)) > 1000 and len(calls) < 20 * len(samples)


def test_anchors_equal_a_plain_restatement():
    rng = random.Random(21)
    for _ in range(300):
        boxes = [(x, y, x + rng.randrange(1, 30), y + rng.randrange(1, 30)) for x, y in ((rng.randrange(60), rng.randrange(60)) for _ in range(rng.randrange(4)))]
        faces = [(rng.randrange(80), rng.randrange(80), None if rng.random() < 0.2 else (x := rng.randrange(60), y := rng.randrange(60), x + 25, y + 25)) for _ in range(rng.randrange(8))]
        held, want = [*boxes], []
        for i, (x, y, box) in enumerate(faces):
            inside = [b for b in held if b[0] <= x <= b[2] and b[1] <= y <= b[3]]
            if not inside and box:
                want.append(i)
                held.append(box)
        assert ID.fold_anchors(boxes, faces) == want
