import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from shotlake.llm import queries, token_counts
from tests.compare import SF, duckdb_rows, spark_rows
from tests.llm.test_operators import FOLD, plain_components, plain_edits, plain_katz, plain_pieces, split


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, name):
    assert spark_rows(queries.QUERIES[name](spark, SF)) == duckdb_rows(queries.ORACLE_SQL[name])


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.kept(stage(spark, docs, SF), name)
        counts.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
            clean = docs
    assert counts[4] <= counts[3] <= counts[2] <= counts[1] <= counts[0] and counts[4] < counts[0]
    from shotlake.llm import decontaminate, ngram_jaccard

    assert ngram_jaccard.jaccard_components(clean, n=5, numerator=80).where("id <> component_id").count() == 0
    assert decontaminate.contaminated(clean, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == {r.doc_id for r in clean.select("doc_id").collect()}


def test_pipeline_stages_carry_verdicts_by_row(spark, odd, tmp_path):
    texts = lambda df: sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in df.collect())
    stage, sf = dict(corpus_pipeline.STAGES), str(tmp_path)
    clean, repeats = " ".join(f"plain{i}" for i in range(40)), "again and again " * 40
    spark.createDataFrame([(99, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    fill = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").repartition(3)

    # A null id is kept on its own text, and a rejected text goes though another row of its id stays.
    got = stage["quality"](spark, fill([(None, clean), (1, clean), (1, repeats), (None, repeats)]), sf)
    assert texts(got) == [(False, 0, clean), (True, 1, clean)]

    # One row of a group of copies stays, with or without an id; the smallest id goes first, and null last.
    other, third = " ".join(f"other{i}" for i in range(40)), " ".join(f"third{i}" for i in range(40))
    got = stage["near_copies"](spark, fill([(3, clean), (3, clean), (7, clean), (None, clean), (None, other), (None, other), (4, third), (4, other + " more"), (5, None), (5, None)]), sf)
    assert texts(got) == [(True, 3, clean), (True, 4, other + " more"), (True, 4, third), (True, 5, ""), (True, 5, "")]

    held = "so one two three four five six it is"
    got = stage["decontaminate"](spark, fill([(None, held), (None, clean), (2, held), (2, clean)]), sf)
    assert texts(got) == [(False, 0, clean), (True, 2, clean)]

    # Without any language only what is null or has no letter goes.
    got = stage["language_id"](spark, odd.withColumn("lang", F.lit(None).cast("string")), sf)
    assert texts(got) == texts(odd.where(r"text rlike r'\p{L}'")) and got.columns == odd.columns
    for name in ("quality", "near_copies", "decontaminate"):
        assert stage[name](spark, odd, sf).columns == odd.columns
    assert texts(stage["near_copies"](spark, odd.where("doc_id <= 2"), sf))[0][1] == 1 and stage["near_copies"](spark, odd.where("doc_id <= 2"), sf).count() == 1


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def encoded(documents, vocabulary):
    plain = Tokenizer.from_file(vocabulary)
    return {i: plain.encode(r.text or "", add_special_tokens=False).ids for i, r in documents.items()}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op2_as_registered(spark, encoded):
    want = {(i, p): (2048 * p, part) for i, ids in encoded.items() for p, part in enumerate([*ids, 0][k : k + 2048] for k in range(0, len(ids) + 1, 2048))}
    rows, bins = queries.QUERIES["op2_best_fit_packing"](spark, SF).collect(), {}
    assert len(rows) == len(want)
    for r in rows:
        start, part = want[r.doc_id, r.piece]
        assert (r.start, r.length, r.ids_crc32) == (start, len(part), crc(part))
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        ends = np.cumsum([n for _, n in sorted(b)]).tolist()
        assert [o for o, _ in sorted(b)] == [0, *ends[:-1]] and ends[-1] <= 2048
    total = sum(len(p) for _, p in want.values())
    assert len(bins) <= math.ceil(total / 2048) * 1.01 + 1


def test_op3_as_registered(spark):
    by = {-7: [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        by.setdefault(r.conv_id, []).append((r.turn, r.role, r.text or ""))
    got = {r.conv_id: r for r in queries.QUERIES["op3_chat_formatting"](spark, SF).collect()}
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        said = "".join(x for _, role, x in turns if role == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest()) and got[c].formatted_chars > sum(len(x) for *_, x in turns)


def test_op4_as_registered(spark, documents):
    got = {r.doc_id: r for r in queries.QUERIES["op4_quality_rules"](spark, SF).collect()}
    assert set(got) == set(documents)
    for i, d in documents.items():
        text = d.text or ""
        w, lines = split(text, False), [x for x in text.split("\n") if split(x, False)]
        times, mark = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7)), [False] * len(w)
        for k in range(len(w) - 7):
            if times[tuple(w[k : k + 8])] > 1:
                mark[k : k + 8] = [True] * 8
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), sum(mark))
        assert r.base_failed == (len(w) < 20 or 100 * sum(mark) > 30 * len(w)) and not (r.base_failed and r.kept)


def test_op5_as_registered(spark, documents, vocabulary):
    known = set(token_counts.vocabulary(vocabulary))
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in queries.QUERIES["op5_token_counts"](spark, SF).collect()}
    assert got == {i: (len(w := split(d.text)), sum(n * plain_pieces(x.encode(), known) for x, n in collections.Counter(w).items())) for i, d in documents.items()}


def test_op7_as_registered(spark, documents):
    got = {r.doc_id: r for r in queries.QUERIES["op7_language_id"](spark, SF).collect()}
    assert set(got) == set(documents) and all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 for i, r in got.items())
    judged = [i for i, r in got.items() if r.held_out and documents[i].lang]
    assert sum(got[i].lang_pred == documents[i].lang for i in judged) >= 0.97 * len(judged) > 0
    assert {i for i, r in got.items() if r.lang_pred == "und"} == {i for i, d in documents.items() if not any(c.isalpha() for c in d.text or "")}


def test_op8_as_registered(spark, encoded):
    start, want = 0, {}
    for i in sorted(encoded):
        ids = [*encoded[i], 1]
        want[i], start = (start, len(ids), crc(ids)), start + len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.QUERIES["op8_token_planes"](spark, SF).collect()} == want


def test_op9_as_registered(spark, documents):
    order = sorted(documents)
    train = [zlib.crc32(str(i).encode()) % 5 != 1 for i in order]
    want = dict(zip(order, plain_katz([documents[i].text for i in order], train)[0], strict=True))
    got = {r.doc_id: r for r in queries.QUERIES["op9_katz_lm"](spark, SF).collect()}
    assert set(got) == set(want)
    for (i, (n, known, total, base, score)), t in zip(want.items(), train, strict=True):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not t, n, known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9)


def test_op10_as_registered(spark, documents):
    words_of = lambda t: re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+", (t or "").translate(FOLD))
    items = {r.item_id: words_of(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    found = {(r.doc_id, r.item_id): r for r in queries.QUERIES["op10_decontamination"](spark, SF).collect()}
    texts = {i: words_of(d.text) for i, d in documents.items()}
    for (i, k), r in found.items():
        assert r.edits == plain_edits(items[k], texts[i][r.start_word : r.end_word]) <= max(0, min(len(items[k]) // 5, (len(items[k]) - 3) // 3))
    for i, w in texts.items():
        line = " ".join(["", *w, ""])
        assert all((i, k) in found and found[i, k].edits == 0 for k, x in items.items() if x and " ".join(["", *x, ""]) in line)


def test_near_copies_stage_keeps_the_smallest_id_of_each_plain_group(spark, documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    groups = plain_components([(i, d.text) for i, d in documents.items()], 5, 80)
    want = {i for i, (n, c) in groups.items() if i == c}
    assert {r.doc_id for r in dict(corpus_pipeline.STAGES)["near_copies"](spark, docs, SF).collect()} == want


def test_filtering_stages_follow_their_operators(spark, documents):
    docs, stage = spark.read.parquet(f"{SF}/documents.parquet"), dict(corpus_pipeline.STAGES)
    kept = {r.doc_id for r in queries.QUERIES["op4_quality_rules"](spark, SF).where("kept").collect()}
    assert {r.doc_id for r in stage["quality"](spark, docs, SF).collect()} == kept
    held = {r.doc_id for r in queries.QUERIES["op10_decontamination"](spark, SF).collect()}
    assert {r.doc_id for r in stage["decontaminate"](spark, docs, SF).collect()} == set(documents) - held
    assert {r.doc_id for r in stage["language_id"](spark, docs, SF).collect()} == {i for i, d in documents.items() if any(c.isalpha() for c in d.text or "")}


def test_stages_of_odd_and_empty_tables(spark, odd, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([(99, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, odd.where("false"), sf).count() == 0
        out = stage(spark, odd, sf)
        assert out.columns == odd.columns and 0 < out.count() <= odd.count() or name == "quality"
    assert {r.doc_id for r in corpus_pipeline.STAGES[4][1](spark, odd, sf).collect()} == {r.doc_id for r in odd.collect()}


def test_language_of_the_text_decides_where_it_is_packed(spark, tmp_path):
    rng, sf = random.Random(5), str(tmp_path)
    words = {"aa": ["".join(rng.choices("abcde", k=4)) for _ in range(300)], "zz": ["".join(rng.choices("vwxyz", k=4)) for _ in range(300)]}
    text = lambda k: " ".join(rng.choices(words[k], k=rng.randrange(30, 60)))
    rows = [(i, text(k := "az"[i % 2] * 2), k, "kept", "kept") for i in range(120)]
    wrong = {500: "aa", 501: "zz", 502: "aa", 503: "zz"}  # by label of the other language, or without one
    rows += [(i, text(k), {500: "zz", 501: "aa"}.get(i), "kept", "kept") for i, k in wrong.items()] + [(600, "12 34 ! " * 30, "aa", "kept", "kept"), (601, None, "zz", "kept", "kept")]
    rows.append((602, "klmno lmnok " * 3 + " ".join(f"{a}{b}lmno" for a in "klmno" for b in "klmno"), "mm", "kept", "kept"))  # of a language that nothing else teaches
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score string").repartition(3)
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    want = {i: "az"[i % 2] * 2 for i in range(120)} | wrong | {602: "mm"}

    out = corpus_pipeline.drop_unknown_language(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    assert out.schema.names == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
    assert {r.doc_id: (r.lang, r.lang_pred, r.score) for r in out.collect()} == {i: (k, "kept", "kept") for i, k in want.items()}

    held = {}
    for r in corpus_pipeline.run(spark, sf).collect():
        assert r.lang == want[r.doc_id]
        held.setdefault(r.sequence_id, set()).add(r.lang)
    assert all(len(x) == 1 for x in held.values()) and {x for y in held.values() for x in y} >= {"aa", "zz"}
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {(r.doc_id, r.lang) for r in corpus_pipeline.drop_unknown_language(spark, unlabelled, sf).collect()} == {(i, None) for i in want}
