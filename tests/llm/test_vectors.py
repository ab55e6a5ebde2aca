"""Nearest neighbours, hard negatives and the filter audit against brute force, and on odd and empty tables."""

import itertools
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shotlake.llm import _blocks, adaptive_scan, filter_audit, hard_negatives, queries
from shotlake.llm._text import words
from tests.compare import SF
from tests.llm.test_operators import split

VECTORS = "vec_id long, embedding array<float>, label int, id string, slot string, list string, score string"


def table(spark, rows):
    """Rows (vec_id, embedding, label) with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "clash", "clash", "clash", "clash") for r in rows], VECTORS).repartition(3)


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def plain_nearest(rows, k, asked=lambda i: i % 50 == 0):
    """{query: [(id, cosine), ...]}, in double precision."""
    good = [(i, [float(np.float32(x)) for x in v]) for i, v, *_ in rows if i is not None and usable(v) and any(v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: E731, B905
    own = {}
    for i, v in good:
        if asked(i):
            own[i] = min(own.get(i, v), v)
    return {q: sorted(((i, dot(x, v) / math.sqrt(dot(x, x) * dot(v, v))) for i, v in good if i != q), key=lambda p: (-round(p[1], 12), p[0]))[:k] for q, x in own.items()}


def found_by(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_a_share_of_a_distance_is_over_its_limit_as_often_as_stated():
    rng = np.random.default_rng(3)
    x = np.square(rng.standard_normal((40_000, 24)))
    share = x[:, :9].sum(1) / x.sum(1)
    for alpha in (0.2, 0.01):
        assert np.mean(share > adaptive_scan.beta_limit(9, 24, alpha)) == pytest.approx(alpha, rel=0.15)
    assert adaptive_scan.beta_limit(9, 24, 1e-5) > share.max() * 0.95


@pytest.mark.parametrize("spread", [0.15, 1.0, 100.0])
def test_neighbours_of_clustered_and_scattered_vectors(spark, spread):
    rng = np.random.default_rng(int(spread * 10))
    centres = rng.standard_normal((40, 32))
    x = (centres[rng.integers(0, 40, 6000)] + spread * rng.standard_normal((6000, 32))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(5)
    got = found_by(adaptive_scan.nearest(df, df.where("vec_id % 50 = 0"), k=5).collect())
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    near = unit[::50] @ unit.T
    near[np.arange(120), np.arange(0, 6000, 50)] = -2
    hits = 0
    for q in range(120):
        mine = got[q * 50]
        assert len(mine) == 5 and [s for _, s in mine] == pytest.approx([near[q, i] for i, _ in mine], abs=1e-12)
        hits += len({i for i, _ in mine} & set(np.argsort(-near[q])[:5].tolist()))
    assert hits >= 0.95 * 600


def test_tight_clusters_are_probed_in_part_and_scattered_ones_nearly_all(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((30, 32))
    fitted = {}
    for spread in (0.05, 100.0):
        unit = adaptive_scan.unit_rows(centres[rng.integers(0, 30, 4000)] + spread * rng.standard_normal((4000, 32)))
        fitted[spread] = adaptive_scan.probes_for(unit, adaptive_scan.fit_centres(unit, 16), 5, 0.98)
    assert fitted[0.05] <= 4 < 10 <= fitted[100.0]


def test_most_columns_of_far_rows_are_not_touched():
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.standard_normal((4000, 64)), 0.1 * rng.standard_normal((60, 64)) + 1])
    column = pa.array(x.tolist(), pa.list_(pa.float64()))
    turn = np.linalg.qr(rng.standard_normal((64, 64)))[0]
    cuts = [*range(8, 64, 8), 64]
    index = adaptive_scan.Index(turn, np.zeros((1, 64)), 1, cuts, [adaptive_scan.beta_limit(d, 64, 1e-5) if d < 64 else 1.0 for d in cuts])
    block = adaptive_scan.block_of(index, pa.table({"id": np.arange(4060), "vector": column}))
    asked, touched = block.part(4000, 4010), []

    class Watched(np.ndarray):
        def __getitem__(self, at):
            touched.append(len(at[1]))
            return np.asarray(self)[at]

    block.columns = [c.view(Watched) for c in block.columns]
    least = np.full(10, 0.95)
    i, j, score = adaptive_scan.scan(index, block, asked, least, 5)
    assert sum(touched) < 4060 * 8 / 2 and set(j.tolist()) <= set(range(4000, 4060))
    whole = adaptive_scan.unit_rows(x)
    for q in range(10):
        best = np.argsort(-(whole @ whole[4000 + q]))[1:6]
        assert set(best.tolist()) <= set(j[i == q].tolist()) | ({4000 + q} if whole[best].min() < 0.95 else set())


def odd_vectors():
    rng = np.random.default_rng(9)
    rows = [(i, rng.standard_normal(6).round(2).tolist(), i % 3) for i in range(160)]
    rows += [(200 + i, rows[50][1], 1) for i in range(30)]  # copies of a query
    rows += [(50, rows[50][1], 2), (100, [9.0] * 6, 0), (100, rows[100][1], 1)]  # ids that repeat, the first with another label
    rows += [(300, [1.0, 2.0], 0), (350, [0.0] * 6, 1), (400, None, 1), (401, [1.0, None, 2.0], 1), (402, [math.inf] * 6, 1), (403, [math.nan] * 6, 1), (404, [], 1), (None, rows[0][1], 1), (405, rows[0][1], None), (450, rows[3][1], 0), (450, rows[3][1], 0)]
    return rows


def test_neighbours_in_odd_and_empty_tables(spark):
    rows = odd_vectors()
    df = table(spark, rows)
    got = found_by(adaptive_scan.nearest(df, df.where("vec_id % 50 = 0"), k=5).collect())
    pad = [(i, None if v is None else v + [0.0] * (6 - len(v)), *r) for i, v, *r in rows]
    want = plain_nearest(pad, 5)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(s == pytest.approx(t, abs=1e-12) for q in want for (_, s), (_, t) in zip(got[q], want[q], strict=True))
    assert got[50][0] == (200, 1.0) and [i for i, _ in got[50]] == [200, 201, 202, 203, 204]
    few = df.where("vec_id in (0, 1, 2)")
    assert [(r.query_id, r.rank) for r in adaptive_scan.nearest(few, few.where("vec_id = 0"), k=5).orderBy("rank").collect()] == [(0, 1), (0, 2)]
    empty = df.where("false")
    assert adaptive_scan.nearest(empty, empty).count() == 0 and adaptive_scan.nearest(df, empty).count() == 0 and adaptive_scan.nearest(empty, df).count() == 0


def test_a_query_that_finds_too_few_rows_in_its_lists_goes_on(spark):
    rng = np.random.default_rng(2)
    tight = lambda c, n: (c + 0.001 * rng.standard_normal((n, 8))).tolist()
    axis = np.eye(8) * 5
    rows = [(i, v) for i, v in enumerate(tight(axis[0], 4) + [v for a in axis[1:] for v in tight(a, 300)])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = found_by(adaptive_scan.nearest(df, df.where("vec_id = 0"), k=8).collect())
    assert len(got[0]) == 8 and {i for i, _ in got[0][:3]} == {1, 2, 3}


def test_rows_are_dealt_evenly_and_every_pair_meets_once(spark, monkeypatch):
    monkeypatch.setattr(_blocks, "LEAST", 8)
    monkeypatch.setattr(_blocks, "MOST", 8 * 6 * 8)
    rows = odd_vectors()
    df = table(spark, rows)
    got = found_by(adaptive_scan.nearest(df, df.where("vec_id % 50 = 0"), k=7).collect())
    pad = [(i, None if v is None else v + [0.0] * (6 - len(v)), *r) for i, v, *r in rows]
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in plain_nearest(pad, 7).items()}
    whole = hard_negatives.whole_numbers(df)
    got = hard_negatives.hard_negatives(whole, whole.where("id % 50 = 0")).collect()
    assert sorted(map(tuple, got)) == plain_negatives(rows)


def plain_negatives(rows, positives=5, negatives=3, relabel=lambda i, x: x):
    good = [(i, relabel(i, label), [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, label in rows if i is not None and label is not None and usable(v)]
    own, out = {}, []
    for i, label, v in good:
        if i % 50 == 0:
            own[i] = min(own.get(i, (label, v)), (label, v))
    for a, (label, x) in own.items():
        scores = sorted(((-sum(p * q for p, q in zip(x, v)), i, other) for i, other, v in good if i != a))  # noqa: B905
        for s, p, _ in [r for r in scores if r[2] == label][:positives]:
            fits = [(n, i) for n, i, other in scores if other != label and 50 * -s <= 100 * -n <= 95 * -s]
            out += [(a, p, k + 1, i, -s, -n) for k, (n, i) in enumerate(fits[:negatives])]
    return sorted(out)


def test_hard_negatives_in_odd_and_empty_tables(spark):
    rows = odd_vectors()
    df = hard_negatives.whole_numbers(table(spark, rows))
    got = sorted(map(tuple, hard_negatives.hard_negatives(df, df.where("id % 50 = 0")).collect()))
    assert got == plain_negatives(rows) and len(got) > 20
    empty = df.where("false")
    assert hard_negatives.hard_negatives(empty, empty).count() == 0 and hard_negatives.hard_negatives(df, empty).count() == 0
    one = df.where("label = 1")
    assert hard_negatives.hard_negatives(one, one.where("id % 50 = 0")).count() == 0


def test_registered_hard_negatives_equal_brute_force_and_relabel(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = sorted(map(tuple, queries.QUERIES["op13_hard_negatives"](spark, SF).collect()))
    assert got == plain_negatives(rows, relabel=lambda i, x: (x + 1) % 10 if i % 7 == 0 else x)


@pytest.mark.parametrize("scale", [1, 256, 1 << 22])
def test_bounds_hold_every_score_and_leave_out_most_pairs_of_lopsided_vectors(scale):
    rng = np.random.default_rng(scale)
    x = (rng.standard_normal((900, 40)) * scale * 0.8 ** np.arange(40)).astype(np.int64)
    x[:5] = 0
    moments = x.astype(np.float64).T @ x
    bounds = hard_negatives.Bounds(hard_negatives.rotation(moments), 8)
    assert np.abs(bounds.turn.T @ bounds.turn - np.eye(40)).max() < 1e-12
    rows = bounds.rows(pa.table({"id": np.arange(900), "label": np.arange(900) % 4, "vector": pa.array(x.tolist(), pa.list_(pa.int64()))}))
    want = rows.whole @ rows.whole.T
    for low, high in bounds.steps(rows, rows):
        assert (low <= want).all() and (want <= high).all()
        width = np.median(high - low)
    if scale > 1:
        assert width < 0.05 * np.median(np.abs(want))


def test_moments_add_up_over_tasks(spark):
    x = np.random.default_rng(1).integers(-9, 9, (300, 5))
    df = spark.createDataFrame([(v.tolist(),) for v in x], "vector array<int>").repartition(7)
    assert np.array_equal(hard_negatives.second_moments(df, 5), (x.T @ x).astype(float))
    assert not hard_negatives.second_moments(df.where("false"), 5).any()


def plain_audit(docs, labels):
    """Rows of the audit by following every order over every document."""
    good, toxic = ({i for i, q, t in labels if (q, t)[c] == 1} for c in (0, 1))
    of_text, rows = {}, []
    for i, text, _ in docs:
        of_text.setdefault(text or "", set()).add(i)
    for i, text, lang in docs:
        t, w = text or "", split(text, lower=False)
        capitals = sum("A" <= c <= "Z" for c in t)
        failed = {f for f, x in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * capitals > 3 * len(t), any(c in "#$%&*|" for c in t), i is not None and any(o is not None and o < i for o in of_text[t])), strict=True) if x}
        rows.append((lang or "", failed, i in good, i in toxic))
    out, shapley = [], {}
    for part in {r[0] for r in rows}:
        for order in itertools.permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            everyone, gone = left, []
            for step, f in enumerate(order, 1):
                out_now = [r for r in left if f in r[1]]
                out.append([part, "".join(order), step, len(left) - len(out_now), len(out_now), sum(f in r[1] for r in gone), sum(r[1] == {f} for r in everyone), sum(r[2] for r in out_now), sum(r[3] for r in out_now)])
                shapley[part, f] = shapley.get((part, f), 0) + len(out_now)
                left, gone = [r for r in left if f not in r[1]], gone + out_now
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_of_odd_and_empty_tables(spark):
    many = " ".join(f"w{i}" for i in range(250))
    docs = [(1, many, "en"), (2, many, "en"), (2, many, "fr"), (3, many, None), (None, many, "en"), (None, many, ""), (0, many + " #", "en"), (5, "A " * 300, "en"), (6, "a b " * 50, "fr"), (7, None, "fr"), (8, "", "en"), (9, "é" * 40 + " Ab", None), (4, " " + many.upper(), "de"), (11, "x" * 100_000, "de"), (12, "a\tb\x0bc\x85d" * 900, "de"), (1, "ONE", "en"), (1, "ONE", "en")]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (7, None, 1), (None, 1, 1), (99, 1, 1), (12, 1, 1)]
    df = spark.createDataFrame([(*d, *("clash" for _ in range(6))) for d in docs], "doc_id long, text string, lang string, id string, part string, digest string, mask string, n string, good string").repartition(4)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(df, known).select(*COLUMNS).collect()
    assert sorted(map(tuple, got)) == plain_audit(docs, labels)
    assert filter_audit.audit(df.where("false"), known).count() == 0
    assert filter_audit.audit(df, known.where("false")).agg(F.sum("good_lost")).first()[0] == 0


def test_registered_audit_equals_every_order_over_every_document(spark):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    assert sorted(map(tuple, queries.QUERIES["op12_filter_audit"](spark, SF).select(*COLUMNS).collect())) == plain_audit(docs, labels)


def test_distinct_words_are_verified_where_hashes_meet():
    texts = ["a b c a bb bb", "", "x y z x", "one"]
    w = words(pa.array(texts), lower=False)
    assert filter_audit.distinct_words(w).tolist() == [4, 0, 3, 1]
    w.hash = w.hash & np.uint64(1)  # nearly all words share a hash
    assert filter_audit.distinct_words(w).tolist() == [4, 0, 3, 1]


def test_exact_products_of_large_numbers_do_not_pass_a_long(spark):
    big = float(1 << 19)
    df = spark.createDataFrame([(0, [big] * 64, 0), (1, [big] * 64, 0), (2, [big * 0.75] * 64, 1), (3, [1e30] * 64, 1)], "vec_id long, embedding array<double>, label int")
    rows = hard_negatives.whole_numbers(df)
    got = hard_negatives.hard_negatives(rows, rows.where("id % 50 = 0")).collect()
    want = 64 * int(big * 256) ** 2
    assert rows.count() == 3 and [(r.negative_id, Fraction(r.positive_score), r.negative_score) for r in got] == [(2, want, want * 3 // 4)]
