"""The exact nearest centre against all pairs, and how few of them it looks at."""

import time

import numpy as np
import pytest
from pyspark.sql import Observation

from shotlake.operators import registry as R


def plain(samples, centers):
    out = {}
    for i, x in samples:
        if x is None or None in x:
            continue
        best = None
        for c, y in sorted(centers, key=lambda p: p[0]):
            if y is None or None in y or len(y) != len(x):
                continue
            a, b = np.linalg.norm(x), np.linalg.norm(y)
            like = float(np.dot(x, y) / (a * b)) if a > 1e-9 and b > 1e-9 else 0.0
            if best is None or like > best[1] + 1e-12:
                best = (c, like)
        if best is not None:
            out[i] = best
    return out


def found(spark, samples, centers, **more):
    s = spark.createDataFrame(samples, "sample_id long, embedding array<double>").repartition(3)
    c = spark.createDataFrame(centers, "center_id long, center array<double>").repartition(3)
    return {r.sample_id: (r.center_id, r.similarity) for r in R.nearest_center(s, c, **more).collect()}


@pytest.mark.parametrize("dim", [2, 3, 24])
def test_nearest_centres_equal_all_pairs(spark, dim):
    rng = np.random.default_rng(dim)
    centers = [(i, rng.standard_normal(dim).round(1).tolist()) for i in range(90)] + [(200, rng.standard_normal(dim).tolist())]
    centers += [(300 + i, centers[i][1]) for i in range(9)] + [(400, [0.0] * dim), (401, [0.0] * dim), (402, None), (403, [None] * dim), (404, [1.0] * (dim + 1)), (405, [2.0] * (dim + 1))]
    samples = [(i, rng.standard_normal(dim).round(1).tolist()) for i in range(120)]
    samples += [(200 + i, centers[i][1]) for i in range(30)] + [(500, None), (501, [0.0] * dim), (502, [1.0] * (dim + 1)), (503, [1.0, None]), (504, [1.0] * 40)]
    got, want = found(spark, samples, centers), plain(samples, centers)
    assert got.keys() == want.keys()
    for i in want:
        assert got[i][0] == want[i][0] and got[i][1] == pytest.approx(want[i][1], abs=1e-12), i


def test_few_pairs_are_looked_at_where_voices_cluster(spark):
    rng = np.random.default_rng(1)
    middle = rng.standard_normal((60, 24))
    centers = [(i, (middle[i % 60] + 0.05 * rng.standard_normal(24)).tolist()) for i in range(1200)]
    samples = [(i, (middle[i % 60] + 0.05 * rng.standard_normal(24)).tolist()) for i in range(600)]
    pairs = Observation()
    got = found(spark, samples, centers, pivots=60, pairs=pairs)
    assert {i: c for i, (c, _) in got.items()} == {i: c for i, (c, _) in plain(samples, centers).items()}
    assert pairs.get["pairs"] < 600 * 1200 / 8


def test_no_centres_or_no_samples(spark):
    assert found(spark, [(1, [1.0])], []) == {} and found(spark, [], [(1, [1.0])]) == {}
    assert found(spark, [(1, [0.0, 0.0])], [(7, [1.0, 0.0]), (3, [0.0, 1.0])]) == {1: (3, 0.0)}


def test_many_vectors_without_structure_take_seconds(spark):
    rng = np.random.default_rng(7)
    x, y = rng.standard_normal((2000, 64)), rng.standard_normal((1000, 64))
    like = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (y / np.linalg.norm(y, axis=1, keepdims=True)).T
    began = time.time()
    got = found(spark, list(enumerate(x.tolist())), list(enumerate(y.tolist())))
    assert time.time() - began < 60
    assert [got[i][0] for i in range(2000)] == like.argmax(1).tolist()


def test_equal_centres_are_compared_once_and_short_vectors_as_others(spark):
    centers = [(i, [1.0, 2.0, 2.0]) for i in range(300, 0, -1)] + [(900, [2e-7, 0.0, 0.0]), (901, [0.0, 2e-7, 0.0])]
    pairs = Observation()
    got = found(spark, [(i, [2.0, 4.0, 4.0 + i]) for i in range(50)] + [(99, [3e-7, 1e-8, 0.0])], centers, pairs=pairs)
    assert {c for i, (c, _) in got.items() if i < 50} == {1} and got[99][0] == 900 and got[99][1] > 0.99
    assert pairs.get["pairs"] <= 51 * 3


@pytest.mark.parametrize("block", [1 << 9, 1 << 12])
def test_blocks_of_any_size_give_the_same(spark, monkeypatch, block):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(R, "BLOCK", block)
    monkeypatch.setattr(R, "LEAST", 100)
    centers = [(i, x) for i, x in enumerate((rng.standard_normal((300, 6)) * [3, 1, 1, 1, 1, 1] + 2).round(1).tolist())]
    samples = [(i, x) for i, x in enumerate((rng.standard_normal((400, 6)) + 2).round(1).tolist())]
    got, want = found(spark, samples, centers), plain(samples, centers)
    assert {i: c for i, (c, _) in got.items()} == {i: c for i, (c, _) in want.items()}
