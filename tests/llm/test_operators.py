"""Each operator against a brute-force restatement, and on odd and empty tables."""

import base64
import collections
import hashlib
import io
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shotlake.llm import _tokens, bitplanes, chat, decontaminate, katz, language_id, ngram_jaccard, packing, quality, token_counts, warc
from shotlake.llm._components import components
from shotlake.llm._filter import maybe_in
from shotlake.llm._store import new_path
from shotlake.llm._text import U64, words
from tests.compare import SF
from tests.llm.conftest import ODD

FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def split(text, lower=True):
    text = text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(FOLD) if lower else text)


def near_copies(rng, groups, vocabulary=400):
    """Random texts in groups of exact and edited copies."""
    out = []
    for _ in range(groups):
        base = [f"w{rng.randrange(vocabulary)}" for _ in range(rng.choice([3, 8, 20, 60, 150]))]
        for _ in range(rng.randrange(1, 6)):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                text[rng.randrange(len(text))] = f"w{rng.randrange(vocabulary)}"
            out.append(" ".join(text))
    rng.shuffle(out)
    return list(enumerate(out))


def plain_components(rows, n, percent):
    sets = {}
    for i, text in rows:
        w = split(text)
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_jaccard_components_equal_all_pairs(spark, n, percent):
    rows = near_copies(random.Random(n), 60)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.id: (r.n_shingles, r.component_id) for r in ngram_jaccard.jaccard_components(df, n=n, numerator=percent).collect()}
    want = plain_components(rows, n, percent)
    assert got == want and len({c for _, c in want.values()}) < len(want)


def test_every_pair_within_the_threshold_shares_a_key_that_neither_leaves_out():
    rng = np.random.default_rng(7)
    for t in ((85, 100), (80, 100)):
        table = ngram_jaccard.bands(*t, 4000)
        lows = np.array([b.low for b in table])

        def left(s, order):
            keys, band, spare = ngram_jaccard.keys_of(s, table, lows)
            out = []
            for b in set(band.tolist()):
                mine = sorted(zip(keys[band == b].tolist(), spare[band == b].tolist(), strict=True), key=lambda x: order(x[0]))
                out += [k for i, (k, most) in enumerate(mine) if i >= most]
            return out

        for _ in range(400):
            size = int(rng.choice([6, 7, 9, 12, 20, 50, 200, 900]))
            s = np.unique(rng.integers(0, 2**63, size).astype(U64))
            r = s.copy()
            for _ in range(rng.integers(0, size // 4 + 1)):
                r = np.delete(r, rng.integers(len(r))) if rng.random() < 0.5 and len(r) > 1 else np.append(r, U64(rng.integers(0, 2**63)))
            r = np.unique(r)
            both = len(np.intersect1d(s, r))
            salt = int(rng.integers(2**62))
            order = lambda k: (k * 0x9E3779B97F4A7C15 ^ salt) % 2**64  # noqa: E731, B023  any one order of all keys will do
            if t[1] * both >= t[0] * (len(s) + len(r) - both) and both < max(len(s), len(r)):
                assert set(left(s, order)) & set(left(r, order))


@pytest.mark.parametrize("turns", [0, 6])
def test_jaccard_of_a_large_near_copy_group_of_long_texts(spark, turns):
    rng = random.Random(4)
    base = [f"w{rng.randrange(3000)}" for _ in range(3200)]
    rows = []
    for i in range(120):
        text = list(base)
        for _ in range(rng.choice([5, 60, 90, 120, 170])):
            text[rng.randrange(len(text))] = f"v{rng.randrange(9000)}"
        rows.append((i, " ".join(text)))
    rows += [(1000 + i, " ".join(base[:60] + [f"u{rng.randrange(9000)}" for _ in range(60)])) for i in range(60)]
    got = {r.id: (r.n_shingles, r.component_id) for r in ngram_jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), most_turns=turns).collect()}
    assert got == plain_components(rows, 4, 85)


def test_jaccard_of_odd_and_empty_tables(odd, empty):
    rows = ngram_jaccard.jaccard_components(odd).collect()
    assert len(rows) == len(ODD)
    got = {r.id: (r.n_shingles, r.component_id) for r in rows}
    assert got[2] == (10, 1) and got[3] == (0, 3) and got[5] == (0, 5) and got[7] == (1, 6) and got[9] == (1, 9)
    assert ngram_jaccard.jaccard_components(empty).count() == 0


def test_jaccard_links_rows_by_their_own_texts_where_ids_repeat_or_are_null(spark):
    rng = random.Random(18)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    chain = [" ".join(f"e{j}" if j < 4 * k else w for j, w in enumerate(base)) for k in range(3)]
    other = [" ".join([*(f"o{i}" for i in range(100)), f"end{k}"]) for k in range(2)]
    # The middle of the chain has no id; id 1 has two unlike texts, each with a near copy.
    rows = [(5, chain[0]), (None, chain[1]), (6, chain[2]), (1, other[0]), (2, other[1]), (1, "p q r s t u v w x y"), (3, "p q r s t u v w x y z")]
    got = collections.Counter((r.id, r.component_id) for r in ngram_jaccard.jaccard_components(spark.createDataFrame(rows, "id long, text string").repartition(3), id_col="id").collect())
    assert got == collections.Counter([(5, 5), (None, 5), (6, 5), (1, 1), (2, 1), (1, 1), (3, 1)])


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and got[101] == 100


def test_plan_packs_everything_once_and_tightly():
    for seed in range(60):
        rng = random.Random(seed)
        capacity = rng.choice([10, 64, 2048])
        histogram = collections.Counter(rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 600)))
        p, bins = packing.plan(histogram, capacity), collections.defaultdict(list)
        for length, lo, hi, sequence, each, offset in p.runs:
            for rank in range(lo, hi):
                bins[sequence + (rank - lo) // each].append((offset + (rank - lo) % each * length, length))
        assert collections.Counter(n for b in bins.values() for _, n in b) == histogram and len(bins) == p.sequences
        for b in bins.values():
            at = 0
            for offset, length in sorted(b):
                assert offset == at
                at += length
            assert at <= capacity
        assert p.sequences <= math.ceil(11 / 9 * sum(k * v for k, v in histogram.items()) / capacity) + 1 or p.sequences <= sum(v for k, v in histogram.items() if 2 * k > capacity) + 1


def test_a_piece_of_the_longest_length_fills_a_sequence():
    assert packing.plan({4: 2, 2: 2, 1: 1}, 4).sequences == 4
    with pytest.raises(ValueError):
        packing.plan({5: 1}, 4)


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_follows_the_vocabulary_file(file):
    import public_tokenizers

    path, texts = public_tokenizers.path(file), ["Big BIG big  cat\n\tSat.", "", None, "  é É a,b <|endoftext|> x", "ONE"]
    ids, offsets = _tokens.Encoder(path)(pa.array(texts, pa.string()))
    plain = Tokenizer.from_file(path)
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_a_common_length_is_dealt_over_many_salts(spark, monkeypatch):
    monkeypatch.setattr(packing, "SALTED", 7)
    rows = [(i, 0, 10 if i % 3 else 1 + i % 60) for i in range(900)]
    got = packing.pack(spark.createDataFrame(rows, "id long, piece int, length long").repartition(4), 64, ["id"]).collect()
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    assert sorted((r.id, r.length) for r in got) == [(i, n) for i, _, n in rows]
    for b in bins.values():
        ends = [0, *np.cumsum([n for _, n in sorted(b)]).tolist()]
        assert [o for o, _ in sorted(b)] == ends[:-1] and ends[-1] <= 64


def test_pieces_of_parts_share_no_sequence(spark, monkeypatch):
    monkeypatch.setattr(packing, "SALTED", 7)
    of = lambda i: (None, "a", "b")[i % 7 % 3]
    rows = [(i, of(i), 10 if i % 3 else 1 + i % 60) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, part string, length long").repartition(4)
    bins, parts = collections.defaultdict(list), collections.defaultdict(set)
    for r in (got := packing.pack(df, 64, ["id"], "part").collect()):
        bins[r.sequence_id].append((r.offset, r.length))
        parts[r.part].add(r.sequence_id)
    assert sorted((r.id, r.part or "", r.length) for r in got) == [(i, p or "", n) for i, p, n in rows]
    for b in bins.values():
        ends = [0, *np.cumsum([n for _, n in sorted(b)]).tolist()]
        assert [o for o, _ in sorted(b)] == ends[:-1] and ends[-1] <= 64
    assert sorted(bins) == list(range(len(bins))) and sum(map(len, parts.values())) == len(bins)
    for p, found in parts.items():
        assert len(found) == packing.plan(collections.Counter(n for _, q, n in rows if q == p), 64).sequences
    assert packing.pack(df.where("false"), 64, ["id"], "part").count() == 0


def test_packed_documents(odd, empty, vocabulary):
    rows = packing.packed_documents(odd, vocabulary, capacity=64, with_ids=True).collect()
    tokenizer = Tokenizer.from_file(vocabulary)
    want = collections.Counter()
    for i, t in ODD:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 64):
            raw = np.array(ids[k : k + 64], "<u4").tobytes()
            want[i, k // 64, k, len(raw) // 4, zlib.crc32(raw)] += 1
    assert collections.Counter((r.id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert b[0][0] == 0 and all(x[0] + x[1] == y[0] for x, y in zip(b, b[1:], strict=False)) and sum(b[-1]) <= 64
    assert packing.packed_documents(empty, vocabulary).count() == 0


def test_cached_encoding_is_that_of_the_whole_text(vocabulary):
    encode, tokenizer = _tokens.Encoder(vocabulary, most=5), Tokenizer.from_file(vocabulary)
    rng = random.Random(4)
    bits = ["It's", "don't", "'sTOP", ",'s", "İstanbul", "é", "́x", "<|endoftext|>", "<|ENDOFTEXT|>", "日本語", "١٢٣", "x\x85y", "ΑΣ", " ", "\n", "\t", "  ", "a", "B!"]
    for _ in range(40):
        texts = ["".join(rng.choice([b, b + " "]) for b in rng.choices(bits, k=rng.randrange(9))) for _ in range(5)] + [None]
        ids, at = encode(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_token_shard_round_trip(kind):
    rng = np.random.default_rng(8)
    documents = [(i, rng.integers(0, 2**32 if i % 3 else 300, n, dtype=np.uint32)) for i, n in enumerate([0, 1, 7, 8, 9, 1000, 0, 64, 129])]
    raw = b"".join(bitplanes.encode_shard(iter(documents), kind, block_ids=64))
    got = list(bitplanes.decode_shard(pa.PythonFile(io.BytesIO(raw), "r")))
    assert [(n, ids.tolist()) for n, _, ids in got] == [(n, ids.tolist()) for n, ids in documents]
    assert [s for _, s, _ in got] == np.cumsum([0, *(len(x) for _, x in documents)])[:-1].tolist()
    with pytest.raises(ValueError):
        bitplanes.read_index(pa.PythonFile(io.BytesIO(raw[:-3]), "r"))


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_token_file(spark, odd, empty, vocabulary, kind):
    path = new_path(spark, "t")
    bitplanes.write_token_file(odd, path, vocabulary, planes=kind, block_ids=1024)
    tokenizer, start, want = Tokenizer.from_file(vocabulary), 0, []
    for i, t in sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, start, np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert sorted(((r.doc_id, r.start, bytes(r.ids)) for r in bitplanes.read_token_file(spark, path).collect()), key=lambda r: r[1]) == want
    path = new_path(spark, "t")
    bitplanes.write_token_file(empty, path, vocabulary)
    assert bitplanes.read_token_file(spark, path).count() == 0


def test_token_file_rolls_shards_reads_by_parts_and_prunes_by_id(spark, vocabulary):
    rows = [(None if i < 40 else 7 if i < 140 else i, f"w{i} " * (i % 30)) for i in range(400)]
    path = new_path(spark, "t")
    bitplanes.write_token_file(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path, vocabulary, block_ids=64, shard_ids=3000, split_ids=500)
    back = bitplanes.read_token_file(spark, path)
    found = sorted((r.start, r.doc_id, bytes(r.ids)) for r in back.collect() if r.doc_id is not None)
    assert back.count() == 400 and back.rdd.getNumPartitions() > 12
    shards = pyarrow.fs.LocalFileSystem().get_file_info(pyarrow.fs.FileSelector(path.removeprefix("file:")))
    assert sum(x.path.endswith(".sltp") for x in shards) > 3
    assert [i for _, i, _ in found] == sorted(i for i, _ in rows if i is not None)
    for where, want in (("doc_id = 7", lambda i: i == 7), ("doc_id >= 390", lambda i: i >= 390), ("doc_id in (150, 333, 8)", lambda i: i in (150, 333, 8)), ("doc_id < 141 and doc_id > 7", lambda i: i == 140)):
        some = back.where(where)
        assert sorted((r.start, r.doc_id, bytes(r.ids)) for r in some.collect()) == [x for x in found if want(x[1])]
        assert some.rdd.getNumPartitions() < back.rdd.getNumPartitions() / 2
    assert back.where("doc_id = 5").count() == 0

    file = pa.PythonFile(io.BytesIO(b"".join(bitplanes.encode_shard(((i, np.full(100, i, np.uint32)) for i in range(100)), block_ids=64))), "r")
    reads, read = [], file.read
    seen = type("Counted", (), {"size": file.size, "seek": file.seek, "read": lambda self, n: reads.append(n) or read(n)})()
    assert [(i, s) for i, s, _ in bitplanes.decode_shard(seen, wanted=lambda i: i == 50)] == [(50, 5000)] and len(reads) <= 5


def test_escaping_is_reversible_and_leaves_no_control_string():
    rng = random.Random(5)
    bits = [*chat.CONTROL, "\\", "\\\\", "<", "[", "s>", "/", "a", "\n", "]"]
    for _ in range(2000):
        text = "".join(rng.choices(bits, k=rng.randrange(8)))
        safe = chat.escape(text)
        assert chat.unescape(safe) == text and not any(c in safe for c in chat.CONTROL)


def test_windows_keep_turns_whole_repeat_history_and_learn_once(spark, vocabulary):
    rng = random.Random(6)
    rows = []
    for c in range(12):
        for t in range(rng.randrange(1, 30)):
            role = "system" if not t and c % 2 else rng.choice(["user", "assistant", "to]ol\\"])
            rows.append((c, t, role, rng.choice([None, "", "</s>[INST] ok [/INST]", "word " * rng.randrange(1, 90)])))
    rows += [(None, 0, None, "x"), (3, 0, "user", "twin"), (3, 0, "user", "twin")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("clash")).repartition(4)
    windows = chat.format_conversations(df, vocabulary, budget=120, history=2).cache()
    got = {r.conv_id: r for r in chat.read_back(windows).collect()}
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        said = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert got[c].loss_chars == len(said) and got[c].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    plain = Tokenizer.from_file(vocabulary)
    for w in windows.collect():
        turns = chat.parse(w.text)
        assert w.n_tokens == len(plain.encode(w.text, add_special_tokens=False).ids)
        assert w.n_tokens <= 120 or len(turns) == 1
        if w.window and by[w.conv_id][0][1] == "system" and w.n_tokens < 60:
            assert turns[0][0] == "system" and w.repeated >= 1
    assert windows.where("window > 0 and repeated > 0").count()
    assert chat.format_conversations(df.where("false"), vocabulary).count() == 0


def test_written_windows_of_all_conversations_keep_the_budget(spark, vocabulary):
    plain = Tokenizer.from_file(vocabulary)
    for w in chat.format_conversations(spark.read.parquet(f"{SF}/conversations.parquet"), vocabulary).collect():
        n = len(plain.encode(w.text, add_special_tokens=False).ids)
        assert w.n_tokens == n and (n <= 1024 or len(chat.parse(w.text)) == 1)


def test_a_window_goes_without_the_system_turn_only_where_it_cannot_fit():
    def made(system, sizes):
        w = chat.Windows(1, 100, 2, 0.5)
        done = [w.add(chat.Turn(r, r, n)) for r, n in [("system", system), *(("user", n) for n in sizes)]]
        return [[r for r, _ in chat.parse(x["text"])] for x in [*done, w.close()] if x]

    assert made(60, [40, 40, 40]) == [["system", "user"]] + [["system", "user"]] * 2
    assert made(60, [40, 41]) == [["system", "user"], ["user", "user"]]
    assert made(60, [120]) == [["system"], ["user"]]
    assert made(20, [60, 45, 40]) == [["system", "user"], ["system", "user"], ["system", "user"]]


def test_base_statistics(odd):
    for _, t in ODD + [(0, "a b c d e f g h " * 3 + "\nq\nq\n \nq"), (0, "# * $\n\n# * $")]:
        w, lines = split(t, False), [x for x in (t or "").split("\n") if split(x, False)]
        times = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        mark = np.zeros(len(w), bool)
        for i in range(len(w) - 7):
            if times[tuple(w[i : i + 8])] > 1:
                mark[i : i + 8] = True
        want = [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), int(mark.sum())]
        got = quality.base_stats(words(pa.array([t, "z"], pa.string()), lower=False))
        assert [int(got[c][0]) for c in quality.BASE] == want


def test_quality_verdicts(spark, odd, empty):
    rng = random.Random(9)
    good, bad = [f"good{i}" for i in range(200)], [f"bad{i}" for i in range(200)]
    rows = [(i, " ".join(rng.choice(bad if i % 5 == 0 else good) for _ in range(60))) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(0, 400, 2)] + [(None, None, None)], "doc_id long, quality int, toxic int")
    got = {r.id: r for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()}
    assert not any(got[i].kept for i in range(0, 400, 5))
    assert sum(got[i].kept for i in range(400)) >= 0.97 * 320
    rows = quality.judged(odd, labels).collect()
    assert len(rows) == len(ODD) and not any(r.kept for r in rows if r.n_words < 20)
    assert quality.judged(empty, labels).count() == 0
    assert all(r.score == 0 for r in quality.judged(odd, labels.where("false")).collect())


def test_one_trusted_outlier_does_not_set_the_quality_threshold(spark):
    rng = random.Random(17)
    good, bad = [f"good{i}" for i in range(200)], [f"bad{i}" for i in range(200)]
    rows = [(i, " ".join(rng.choice(bad if i % 5 == 0 else good) for _ in range(60))) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 5 != 0 or i == 100), 0) for i in range(400)], "doc_id long, quality int, toxic int")
    got = {r.id: r for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()}
    assert not any(got[i].kept for i in range(0, 400, 5)) and sum(got[i].kept for i in range(400)) >= 0.97 * 320


@pytest.mark.parametrize(("size", "lost", "passed"), [("sf0.01", 0.03, 0.12), ("sf0.1", 0.01, 0.01)])
def test_quality_on_labelled_rows(spark, size, lost, passed):
    labels = spark.read.parquet(f"/root/testdata/{size}/labels.parquet")
    got = quality.judged(spark.read.parquet(f"/root/testdata/{size}/documents.parquet"), labels).where("not base_failed")
    n = {r[0]: (r[1], r[2]) for r in got.join(labels.where("quality = 0 or toxic = 0").withColumnRenamed("doc_id", "id"), "id").groupBy("quality").agg(F.count("*"), F.count(F.when(F.col("kept"), 1))).collect()}
    assert n[1][1] >= (1 - lost) * n[1][0] and n[0][1] <= passed * n[0][0]


def test_likelihood_ratio_equals_its_definition():
    of_all, of_trusted = np.array([[3, 1, 0, 0], [5, 5, 2, 0]], np.int64), np.array([[2, 0, 0, 0], [4, 1, 0, 0]], np.int64)
    got = quality.ratios(of_all, of_trusted, 0.5)
    assert np.isclose(got[0, 1], math.log(1.5 / 7) - math.log(5.5 / 14)) and np.isclose(got[1, 0], math.log(2.5 / 4) - math.log(3.5 / 6))


def test_quality_scores_and_verdicts_equal_a_plain_restatement(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(2)).alias("half")).collect()
    marks = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    trusted = {i for i, r in marks.items() if r.quality == 1 and r.toxic == 0}
    cells, n = {}, 1 << 16
    for r in docs:
        cells[r.doc_id] = quality.features(words(pa.array([r.text], pa.string()), lower=False), n)[1].tolist()
    total = {(h, t): collections.Counter(c for r in docs if r.half == h and (not t or r.doc_id in trusted) for c in cells[r.doc_id]) for h in (0, 1) for t in (False, True)}
    want = {}
    for r in docs:
        every, good = total[1 - r.half, False], total[1 - r.half, True]
        sums = [sum(x.values()) + 0.5 * n for x in (good, every)]
        ratio = [math.log((good[c] + 0.5) / sums[0]) - math.log((every[c] + 0.5) / sums[1]) for c in cells[r.doc_id]]
        want[r.doc_id] = sum(ratio) / max(1, len(ratio))
    got = {r.id: r for r in quality.judged(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert all(math.isclose(got[i].score, x, abs_tol=1e-9) for i, x in want.items())
    judged = [(math.floor(want[i] * 1000), i in trusted) for i, r in marks.items() if i in got and not got[i].base_failed and (r.quality == 0 or i in trusted)]
    good, bad = sum(t for _, t in judged), sum(not t for _, t in judged)
    loss = lambda at: sum(t for s, t in judged if s < at) * bad + sum(not t for s, t in judged if s >= at) * good
    best = min([-(10**6), *sorted({s + 1 for s, _ in judged})], key=loss)
    assert {i for i, r in got.items() if r.kept} == {i for i, r in got.items() if not r.base_failed and want[i] >= best / 1000}


@pytest.mark.parametrize("n", [0, 1, 3000, 60_000])
def test_the_filter_passes_all_keys_and_few_others(spark, n):
    keys = spark.range(n).select(F.when(F.col("id") > 0, F.col("id") * 7).alias("k")).union(spark.sql("select 7L as k where false"))
    rows = spark.range(7 * 60_000).select(F.col("id").alias("k"), ((F.col("id") % 7 == 0) & (F.col("id") > 0) & (F.col("id") < 7 * n)).alias("key"))
    got = rows.where(maybe_in(spark, "k", keys)).groupBy("key").count().collect()
    count = {r["key"]: r["count"] for r in got}
    assert count.get(True, 0) == max(0, n - 1) and count.get(False, 0) < 0.03 * 7 * 60_000
    assert spark.sql("select cast(null as long) as k").where(maybe_in(spark, "k", keys)).count() == (n > 0)


def test_only_rows_of_the_ids_pass_the_filter(spark, odd):
    docs = odd.select(F.col("doc_id").alias("id"), "text")
    assert sorted(r.id for r in quality.of_ids(docs, spark.createDataFrame([(2,), (9,), (77,)], "id long")).collect()) == [2, 2, 9]
    assert quality.of_ids(docs, docs.where("false").select("id")).count() == 0


def plain_pieces(word, pieces):
    n, at = 0, 0
    while at < len(word):
        end = next((e for e in range(min(len(word), at + 300), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 1
        n, at = n + 1, end
    return n


def test_token_counts_equal_greedy_longest_match(odd, empty, vocabulary):
    rng = random.Random(10)
    for _ in range(80):
        pieces = {bytes(rng.choices(b"abc", k=rng.randrange(1, 6))) for _ in range(rng.randrange(1, 12))}
        texts = [bytes(rng.choices(b"abcd" if rng.random() < 0.3 else b"abc", k=rng.randrange(1, 12))) for _ in range(20)]
        w = words(pa.array([t.decode() for t in texts]))
        assert token_counts.Automaton(sorted(pieces)).counts(w.data, w.start, w.end).tolist() == [plain_pieces(t, pieces) for t in texts]
    assert token_counts.Automaton([]).counts(w.data, w.start, w.end).tolist() == [1] * 20
    known = set(token_counts.vocabulary(vocabulary))
    rows = token_counts.token_counts(odd, vocabulary).collect()
    want = collections.Counter((i, len(split(t)), sum(n * plain_pieces(x.encode(), known) for x, n in collections.Counter(split(t)).items())) for i, t in ODD)
    assert collections.Counter((r.id, r.n_words, r.n_tokens) for r in rows) == want
    # Words of all lengths at once: many end early, a few very long ones go on alone, one of them to a dead end.
    pieces = {b"a", b"ab", b"abc", b"ca", b"cab", b"b", b"aab", b"c"}
    texts = [bytes(rng.choices(b"abc", k=k)) for k in [1, 2, 3, 5, 8] * 8 + [400, 2000, 30_000]] + [b"abc" * 999 + b"d" + b"a" * 99]
    w = words(pa.array([t.decode() for t in texts]))
    assert token_counts.Automaton(sorted(pieces)).counts(w.data, w.start, w.end).tolist() == [plain_pieces(t, pieces) for t in texts]
    assert token_counts.token_counts(empty, vocabulary).count() == 0


def test_warc_round_trip_pushdown_and_revisits(spark):
    pages = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (3, None, None), (4, "http://b/\r\n4", ""), (5, "http://b/5", "grüße\r\n\r\nWARC/1.1"), (None, "u", "same"), (1, "again", "same"), (6, "http://a/6", "y" * 200_000)]
    df = spark.createDataFrame([(*p, "clash", "clash") for p in pages], "page_id long, url string, html string, sha1 string, first string").repartition(3)
    path = new_path(spark, "w")
    warc.write_warc(df, path)
    rows = warc.read_warc(spark, path).collect()
    sha = lambda s: base64.b32encode(hashlib.sha1((s or "").encode()).digest()).decode()
    got = collections.Counter((r.page_id, r.type, r.payload_bytes, r.payload_digest, r.refers_to) for r in rows)
    first = {"same": 1, "": 3, "grüße\r\n\r\nWARC/1.1": 5, "y" * 200_000: 6}
    want = collections.Counter()
    for i, _, h in pages:
        f = first[h or ""]
        want[(i, "response" if i == f else "revisit", len((h or "").encode()), sha(h), None if i == f else f)] += 1
    assert got == want
    assert {bytes(r.content) for r in rows if r.type == "response"} == {b"same", b"", "grüße\r\n\r\nWARC/1.1".encode(), b"y" * 200_000}
    wanted = warc.read_warc(spark, path, "none").where((F.col("type") == "revisit") & F.col("target_uri").startswith("http://a/"))
    assert [r.page_id for r in wanted.collect()] == [2]
    plan = wanted._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"\bFilter \(", plan)  # the reader judges all of it
    path = new_path(spark, "w")
    warc.write_warc(df, path, least_bytes=5)
    assert warc.read_warc(spark, path, "check").where("type = 'revisit'").count() == 0
    path = new_path(spark, "w")
    warc.write_warc(df.where("false"), path)
    assert warc.read_warc(spark, path).count() == 0


def test_warc_reads_other_archives_and_refuses_damage(tmp_path):
    raw = warc.record(1, "http://x", b"abc", warc.base64.b32encode(hashlib.sha1(b"abc").digest()).decode(), None)
    import gzip

    for name, data in (("plain.warc", raw + raw), ("foreign.warc.gz", gzip.compress(raw) + gzip.compress(raw)), ("own.warc.gz", warc.member(raw) + warc.member(raw))):
        (tmp_path / name).write_bytes(data)
        with pyarrow.fs.LocalFileSystem().open_input_file(str(tmp_path / name)) as file:
            assert [r["content"] for r in warc.records(file, payload="full")] == [b"abc", b"abc"], name
        with pyarrow.fs.LocalFileSystem().open_input_file(str(tmp_path / name)) as file:
            assert list(warc.records(file, lambda h: h["type"] == "request")) == []
    for body, payload in ((b"HTTP/1.1 200 OK\r\nX: y", b""), (b"HTTP/1.1 200 OK\r\n\r\n\r\n\r\nz", b"\r\n\r\nz"), (b"", b""), (b"\r\n\r\n", b"\r\n\r\n"), (b"q" * 300_000, b"q" * 300_000)):
        odd = b"WARC/1.0\r\nwarc-type: response\r\nWARC-Record-ID: <urn:uuid:1-2>\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
        for name, data in (("odd.warc", odd + raw), ("odd.warc.gz", gzip.compress(odd) + gzip.compress(raw)), ("odd2.warc.gz", warc.member(odd) + warc.member(raw))):
            (tmp_path / name).write_bytes(data)
            with pyarrow.fs.LocalFileSystem().open_input_file(str(tmp_path / name)) as file:
                assert [(r["page_id"], r["content"]) for r in warc.records(file, payload="full")] == [(None, payload), (1, b"abc")], name
    (tmp_path / "bad.warc").write_bytes(raw.replace(b"abc", b"abd"))
    with pyarrow.fs.LocalFileSystem().open_input_file(str(tmp_path / "bad.warc")) as file, pytest.raises(ValueError, match="digest"):
        list(warc.records(file, payload="check"))


@pytest.mark.parametrize("block", [1, 2, 7, 16, 1000])
def test_phrases_are_longest_matches_of_the_whole_text_whatever_the_block(block):
    rng = random.Random(11)
    sample = {k: "".join(rng.choices(a, k=300)) for k, a in (("x", "ab "), ("y", "abc "))}
    model = language_id.fit({k: v.encode() for k, v in sample.items()})
    texts = ["".join(rng.choices("abcd ", k=rng.randrange(0, 120))) for _ in range(40)]
    texts += [sample["x"][:200], sample["y"][40:160] * 2, "é" * 33, None, "a" * 90]  # phrases longer than a block, and characters of two bytes
    got = language_id.phrases(model, pa.array(texts, pa.string()), block=block)
    squeeze = lambda s: re.sub(" +", " ", s).encode()
    for row, text in zip(got, (squeeze(t or "") for t in texts), strict=True):
        for n, source in zip(row, map(squeeze, sample.values()), strict=True):
            at = want = 0
            while at < len(text):
                end = at + 1
                while end < len(text) and text[at : end + 1] in source:
                    end += 1
                at, want = end, want + 1
            assert n == want


def test_a_rare_language_does_not_shorten_the_samples_of_others(spark):
    rng = random.Random(3)
    rows = [(i, "en", " ".join(rng.choices("the cat sat on a mat while it rained and we were at home".split(), k=60))) for i in range(200)]
    rows += [(500 + i, "en", rows[0][2]) for i in range(300)] + [(900, "rare", "kzq wvx")]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = language_id.sample(df, "text", "lang", 8192, 512)
    assert len(got["en"]) == 8192 and got["rare"] == b"kzq wvx" and got["en"].count(rows[0][2].encode()) <= 1
    assert {r.doc_id for r in language_id.identified(df, df, sample_bytes=8192).where("lang_pred = 'rare'").collect()} == {900}


def test_languages(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = language_id.held_out("doc_id", 3, 1)
    got = language_id.identified(docs.withColumn("held_out", out), docs.where(~out)).where("held_out").collect()
    assert got and sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got) and all(0 <= r.score <= 1 for r in got)
    rows = language_id.identified(odd, odd).collect()
    assert len(rows) == len(ODD) and {r.lang_pred for r in rows if not (r.text or "").strip()} == {"und"} and set(rows[0].asDict()) >= {"kind", "block"}
    assert language_id.identified(empty, odd).count() == 0
    assert {r.lang_pred for r in language_id.identified(odd, empty).collect()} == {"und"}


def plain_katz(texts, train):
    """(tokens, known, N, base, score) of each text from the definitions, with plain dictionaries; the probability of a word after another; P of seen words; what follows each word."""
    words_of = [split(t) for t in texts]
    uni = collections.Counter(w for ws, t in zip(words_of, train, strict=True) if t for w in [*ws, "</e>"])
    total, types = sum(uni.values()), len(uni)
    n1 = [sum(n == r for w, n in uni.items() if w != "</e>") for r in range(1, 7)]
    d1 = katz.good_turing(n1)
    p = {w: (d1[n] if n <= 5 and w != "</e>" else 1) * n / (total + 1) for w, n in uni.items()}
    unseen = (1 - sum(p.values())) / katz.unseen_types(n1)
    pairs = collections.Counter()
    for ws, t in zip(words_of, train, strict=True):
        if t:
            seq = ["<s>", *ws, "</e>"]
            pairs.update(zip(seq, seq[1:], strict=False))
    d = katz.good_turing([sum(n == r for n in pairs.values()) for r in range(1, 7)])
    after = collections.defaultdict(dict)
    for (h, w), n in pairs.items():
        after[h][w] = n

    def prob(h, w):
        seen = after.get(h, {})
        if not seen:
            return p.get(w, unseen)
        c = sum(seen.values())
        disc = {x: (d[n] if n <= 5 else 1) * n / c for x, n in seen.items()}
        scale = c / (c + 1) if sum(disc.values()) > 1 - 1e-9 else 1
        if w in seen:
            return scale * disc[w]
        return (1 - scale * sum(disc.values())) / (1 - sum(p[x] for x in seen)) * p.get(w, unseen)

    out = []
    for ws in words_of:
        seq = ["<s>", *ws, "</e>"]
        base = sum(math.log10((uni[w] + 0.5) / (total + 0.5 * (types + 1))) for w in [*ws, "</e>"])
        out.append((len(ws) + 1, sum(uni[w] > 0 for w in [*ws, "</e>"]), total, base, sum(math.log10(prob(h, w)) for h, w in zip(seq, seq[1:], strict=False))))
    return out, prob, p, katz.unseen_types(n1), after


def katz_texts():
    rng = random.Random(12)
    texts = [" ".join(f"w{min(int(rng.expovariate(0.12)), 60)}" for _ in range(rng.randrange(0, 40))) for _ in range(120)] + ["w1 w1 w2", "new words only", None, "w1 w1 w2"]
    return texts, [i % 5 != 1 for i in range(len(texts))]


@pytest.mark.parametrize(("cached", "frequent", "pieces"), [(1 << 19, 1 << 18, 3), (0, 0, 1), (7, 10, 5)])
def test_katz_equals_its_definition_and_sums_to_one(spark, cached, frequent, pieces):
    texts, train = katz_texts()
    df = spark.createDataFrame([(i, t, r, "clash", 0) for i, (t, r) in enumerate(zip(texts, train, strict=True))], "doc_id long, text string, tr boolean, part string, block int").repartition(pieces)
    want, prob, p, unseen, after = plain_katz(texts, train)
    got = {r.id: r for r in katz.scored(df, F.col("tr"), cached=cached, frequent=frequent).collect()}
    for i, (n, known, total, base, score) in enumerate(want):
        r = got[i]
        assert (r.train, r.n_tokens, r.n_known, r.train_tokens) == (train[i], n, known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9)
    for h in list(after)[:20]:
        assert math.isclose(sum(prob(h, w) for w in p) + unseen * prob(h, "never seen"), 1, rel_tol=1e-9)


def test_katz_scores_repeated_and_null_ids_by_their_own_texts(spark):
    a = [f"w{i}" for i in range(200)]
    b = [f"v{i}" if i in (1, 4, 7) else w for i, w in enumerate(a)]
    rows = [(1, " ".join(a)), (1, " ".join(b)), (1, " ".join(a)), (None, " ".join(a)), (None, " ".join(b[:20]))] + [(i, f"w{i} w{i + 1}") for i in range(10, 30)]
    want = collections.Counter((i, *x[:3], round(x[3], 6), round(x[4], 6)) for (i, _), x in zip(rows, plain_katz([t for _, t in rows], [i is None or i != 12 for i, _ in rows])[0], strict=True))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for layout in (df.coalesce(1), df.repartition(2), df.repartition(len(rows)), df.repartition(3, "text")):
        got = katz.scored(layout, F.col("doc_id").isNull() | (F.col("doc_id") != 12))
        assert collections.Counter((r.id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got.collect()) == want


def test_katz_of_odd_and_empty_tables(odd, empty):
    rows = katz.scored(odd, F.col("doc_id") != 1).collect()
    assert len(rows) == len(ODD) and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    assert sorted(r.n_tokens for r in rows) == sorted(len(split(t)) + 1 for _, t in ODD)
    assert katz.scored(empty, F.lit(True)).count() == 0
    rows = katz.scored(odd, F.lit(False)).collect()
    assert len(rows) == len(ODD) and all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in rows)


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_nearest_run():
    rng = random.Random(13)
    for _ in range(150):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(lo, 8))] for lo in (1, 0))
        edits, s, e = decontaminate.nearest_run(np.array(a, U64), np.array(b, U64))
        assert edits == plain_edits(a, b[s:e]) == min(plain_edits(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1))


@pytest.mark.parametrize("kind", ["substitute", "insert", "delete"])
def test_contamination_recall_at_the_largest_distance(spark, kind):
    rng = random.Random(kind)
    vocabulary = [f"w{i}" for i in range(3000)]
    items = [[rng.choice(vocabulary) for _ in range(rng.randrange(9, 61))] for _ in range(300)]
    rows = []
    for k, item in enumerate(items):
        part = list(item)
        for at in sorted(rng.sample(range(1, len(part)), decontaminate.edits_allowed(len(part), 0.2)), reverse=True):
            if kind == "insert":
                part.insert(at, "edited")
            else:
                part[at : at + 1] = ["edited"] if kind == "substitute" else []
        rows.append((k, " ".join([rng.choice(vocabulary) for _ in range(40)] + part + [rng.choice(vocabulary) for _ in range(40)])))
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = {(r.id, r.item_id) for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    found = sum((k, k) in got for k in range(300)) / 300
    print(f"recall, {kind}: {found:.3f}")
    assert found >= 0.98


def test_contamination_by_stock_phrases_and_repeated_items(spark):
    stock = "please read the following text and choose the best answer from the list below"
    items = [f"{stock} number{i} of{i} all{i}" for i in range(300)]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(900, items[7]), (901, items[7])], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"{stock} " * 300), (2, f"x y {items[7]} z"), (2, f"x y {items[7]} z"), (None, items[9]), (3, None)], "doc_id long, text string")
    got = decontaminate.contaminated(docs, bench).collect()
    exact = collections.Counter((r.id, r.item_id) for r in got if r.edits == 0)
    assert exact == {(2, 7): 2, (2, 900): 2, (2, 901): 2, (None, 9): 1}
    clean = decontaminate.uncontaminated(docs.withColumn("item", F.lit("clash")), bench.where("item_id in (7, 9)"), share=0.0)
    assert sorted((r.doc_id, r.item) for r in clean.collect()) == [(1, "clash"), (3, "clash")] and clean.columns == ["doc_id", "text", "item"]


def test_contamination_recall_and_precision(spark, odd, empty):
    rng = random.Random(14)
    vocabulary = [f"w{i}" for i in range(3000)]
    items = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 5, 15, 30, 59]))] for _ in range(40)]
    rows, want = [], set()
    for d in range(400):
        text = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))]
        if d % 2:
            k = rng.randrange(40)
            part = list(items[k])
            for _ in range(rng.randrange(decontaminate.edits_allowed(len(part), 0.2) + 1)):
                part[rng.randrange(len(part))] = "edited"
            cut = rng.randrange(len(text) + 1)
            text[cut:cut] = part
        rows.append((d, ", ".join(text).title()))
        for k, item in enumerate(items):
            allowed = decontaminate.edits_allowed(len(item), 0.2)
            run = [x.lower() for x in text]
            if len(set(item) & set(run)) >= min(len(item), 3) - (allowed > 0) and min((plain_edits(item, run[i : i + n]) for n in range(max(0, len(item) - allowed), len(item) + allowed + 1) for i in range(max(1, len(run) - n + 1))), default=99) <= allowed:
                want.add((d, k))
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)] + [(98, None), (99, " . ")], "item_id long, text string")
    for block in (20_000, 15):
        got = {(r.id, r.item_id) for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench, block_items=block).collect()}
        assert got <= want and len(got) >= 0.97 * len(want)
    assert decontaminate.contaminated(odd, bench).count() == 0
    assert decontaminate.contaminated(odd, odd.select(F.col("doc_id").alias("item_id"), "text").where("doc_id = 1")).count() == 3
    assert decontaminate.contaminated(empty, bench).count() == 0 == decontaminate.contaminated(odd, bench.where("false")).count()


@pytest.mark.parametrize("size", [420, 1000, 6000])
def test_sketches_never_part_linked_sets_and_part_most_that_are_clearly_unlike(size):
    rng = np.random.default_rng(size)
    unlike = 0
    for _ in range(60):
        s = np.unique(rng.integers(0, 2**63, size).astype(U64))
        r = np.concatenate([s[rng.random(len(s)) > rng.choice([0.01, 0.08, 0.3])], rng.integers(0, 2**63, int(size * rng.choice([0.0, 0.02, 0.05]))).astype(U64)])
        r = np.unique(r)
        a, b = ngram_jaccard.wide(s), ngram_jaccard.wide(r)
        if a is None or b is None:
            continue
        if len(a) > len(b):
            a = a[: len(b)] ^ a[len(b) :]
        elif len(b) > len(a):
            b = b[: len(a)] ^ b[len(a) :]
        apart, differ = int(np.bitwise_count((a ^ b).view(U64)).sum()), len(np.setxor1d(s, r))
        assert apart <= differ
        if 100 * len(np.intersect1d(s, r)) < 75 * len(np.union1d(s, r)):
            unlike += apart * 185 > 15 * (len(s) + len(r))
    assert unlike >= 12


def test_unlinked_copies_of_a_long_text_are_not_verified_pair_by_pair(spark, monkeypatch):
    rng = random.Random(11)
    base = [f"w{rng.randrange(90_000)}" for _ in range(6000)]
    rows = []
    for i in range(250):
        text = list(base)
        for k in rng.sample(range(6000), 275):  # about 0.69 alike
            text[k] = f"v{i}x{k}"
        rows.append((i, " ".join(text)))
    rows.append((1000, rows[7][1] + " end"))
    verified, plain = [], ngram_jaccard._verified

    def counted(pairs, *rest):
        verified.append(pairs.count())
        return plain(pairs, *rest)

    monkeypatch.setattr(ngram_jaccard, "_verified", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.id: r.component_id for r in ngram_jaccard.jaccard_components(df, n=4, numerator=85).collect()}
    assert got == {i: 7 if i == 1000 else i for i, _ in rows}
    assert sum(verified) < 1000


def test_a_language_of_equal_rows_is_learned_and_the_driver_gets_few_rows(spark, monkeypatch):
    for seed in range(3):
        rows = spark.range(200).selectExpr("id", "'aa' as lang", f"concat('the cat sat on number ', id + {seed}, ' mat while it rained') as text")
        rows = rows.union(spark.range(60_000).selectExpr("id + 1000", "'xx'", f"'kzq wvx jjq {seed} zzkq'"))
        rows = rows.union(spark.range(20_000).selectExpr("id + 100000", "'long'", "concat(repeat(concat('plok nemu ', id, ' '), 40), id)"))
        got, whole = [], type(rows).collect
        monkeypatch.setattr(type(rows), "collect", lambda df: got.append(whole(df)) or got[-1])
        found = language_id.sample(rows, "text", "lang", 4096, 512)
        monkeypatch.undo()
        assert set(found) == {"aa", "xx", "long"} and found["xx"].startswith(b"kzq wvx") and len(found["long"]) == 4096
        assert sum(map(len, got)) < 250
    model = language_id.fit(found)
    assert [r.lang_pred for r in language_id.predict(spark.createDataFrame([(1, "zzkq kzq wvx")], "doc_id long, text string"), model).collect()] == ["xx"]


FILTERS = ["{c} = 3", "{c} <> 3", "not ({c} = 3)", "{c} in (1, 3)", "{c} in (1, null)", "{c} not in (1, 3)", "{c} not in (1, null)", "{c} is null", "{c} is not null", "{c} <=> 3", "not ({c} <=> 3)", "{c} <=> null", "{c} > 3", "{c} >= 3", "{c} < 3", "{c} <= 3", "not ({c} > 3)", "{c} > 1 and {c} <> 4", "{c} = 1 or {c} = 4", "{c} = null", "{c} between 2 and 4 and {c} not in (3)", "{c} in (2)"]


def test_every_filter_on_archives_gives_the_rows_of_the_filter_in_spark(spark):
    pages = [(i if i else None, None if i == 4 else f"http://{'ab'[i % 2]}/{i}", "same" if i < 3 else f"p{i}") for i in range(8)]
    path = new_path(spark, "w")
    warc.write_warc(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2), path)
    whole = spark.createDataFrame(warc.read_warc(spark, path, "none").collect(), warc.SCHEMA)
    texts = ["type <> 'revisit'", "type not in ('response', null)", "target_uri like 'http://a%'", "not (target_uri like 'http://a%')", "target_uri like '%/3'", "target_uri like '%b/%' and type = 'response'", "refers_to is null and type <> 'x'", "target_uri is null", "content is null"]
    for where in [f.format(c=c) for f in FILTERS for c in ("page_id", "refers_to", "payload_bytes")] + texts:
        got, want = (sorted(map(repr, df.where(where).collect())) for df in (warc.read_warc(spark, path, "none"), whole))
        assert got == want, where


def test_every_filter_on_token_files_gives_the_rows_of_the_filter_in_spark(spark, vocabulary):
    rows = [(None if i < 6 else i // 6, f"w{i} " * (i % 7)) for i in range(60)]
    path = new_path(spark, "t")
    bitplanes.write_token_file(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), path, vocabulary, block_ids=16, shard_ids=100, split_ids=20)
    whole = spark.createDataFrame(bitplanes.read_token_file(spark, path).collect(), bitplanes.SCHEMA)
    for where in [f.format(c="doc_id") for f in FILTERS]:
        got, want = (sorted(map(repr, df.where(where).collect())) for df in (bitplanes.read_token_file(spark, path), whole))
        assert got == want, where


def test_small_batches_are_put_together_and_large_ones_cut():
    from shotlake.llm._text import gathered

    sizes = [3, 0, 5, 40, 1, 1, 9, 9, 9, 2]
    batches = [pa.RecordBatch.from_pydict({"n": [i], "text": ["x" * k]}) for i, k in enumerate(sizes)]
    got = list(gathered(iter(batches), "text", 10))
    assert [x for b in got for x in b.column(0).to_pylist()] == list(range(len(sizes)))
    assert [sum(map(len, b.column(1).to_pylist())) for b in got] == [8, 40, 2, 9, 9, 9, 2] or all(b.num_rows == 1 or sum(map(len, b.column(1).to_pylist())) <= 10 for b in got)
    assert len(got) < len(sizes) and list(gathered(iter([]), "text")) == []


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_katz_of_any_order_backs_off_recursively_and_sums_to_one(spark, order):
    from shotlake.llm import katz_order

    texts, train = katz_texts()
    sequences = [["<s>", *split(t), "</e>"] for t in texts]
    *_, p1, types, _ = plain_katz(texts, train)
    n1 = collections.Counter(w for s, t in zip(sequences, train, strict=True) if t for w in s[1:])
    unseen = (1 - sum(p1.values())) / types
    levels = []
    for k in range(2, order + 1):
        grams = collections.Counter(tuple(s[i : i + k]) for s, t in zip(sequences, train, strict=True) if t for i in range(len(s) - k + 1))
        d = katz.good_turing([sum(n == r for n in grams.values()) for r in range(1, 7)])
        after = collections.defaultdict(dict)
        for g, n in grams.items():
            after[g[:-1]][g[-1]] = n
        levels.append((after, d))

    def prob(h, w):
        if not h:
            return p1.get(w, unseen)
        after, d = levels[len(h) - 1]
        seen = after.get(h, {})
        if not seen:
            return prob(h[1:], w)
        c = sum(seen.values())
        disc = {x: (d[n] if n <= 5 else 1) * n / c for x, n in seen.items()}
        scale = c / (c + 1) if sum(disc.values()) > 1 - 1e-9 else 1
        if w in seen:
            return scale * disc[w]
        return (1 - scale * sum(disc.values())) / max(1 - sum(prob(h[1:], x) for x in seen), unseen) * prob(h[1:], w)

    df = spark.createDataFrame([(i if i % 9 else None, t, r, "clash") for i, (t, r) in enumerate(zip(texts, train, strict=True))], "doc_id long, text string, tr boolean, row string").repartition(3)
    want = sorted((i if i % 9 else -1, len(s) - 1, round(sum(math.log10(prob(tuple(s[max(0, j - order + 1) : j]), s[j])) for j in range(1, len(s))), 7)) for i, s in enumerate(sequences))
    got = katz_order.scored(df, F.col("tr"), order).collect()
    assert sorted((-1 if r.id is None else r.id, r.n_tokens, round(r.score, 7)) for r in got) == want
    if order > 2:
        contexts = [h for h in levels[-1][0]][:15]
        assert all(math.isclose(sum(prob(h, w) for w in n1) + types * prob(h, "never seen"), 1, rel_tol=1e-9) for h in contexts)
    if order == 2:
        packed = {(r.id, round(r.score, 7)) for r in katz.scored(df, F.col("tr")).collect()}
        assert packed == {(r.id, round(r.score, 7)) for r in got}
    assert katz_order.scored(df.where("false"), F.col("tr"), order).count() == 0
