from pyspark.sql import functions as F

from shotlake.operators import transcript as TR

WORD = "array<struct<text:string,start:double,end:double>>"


def test_sentences_take_their_words(spark):
    words = [(w, i * 1.0, i + 0.5) for i, w in enumerate(["Hi", "you", "Go", "on"])]
    rows = [("a", 0, 10.0, 20.0, "Hi you. Go on.", words), ("a", 1, 30.0, 31.0, "No words here", []), ("a", 2, 40.0, 50.0, "Too many. Tokens for these.", words), ("a", 3, 60.0, 61.0, "  ", words)]
    df = spark.createDataFrame(rows, f"stream string, region_no int, start_sec double, end_sec double, text string, words {WORD}")
    got = [(r.region_no, r.sentence_no, r.text.strip(), r.start_sec, r.end_sec, len(r.words), r.timed) for r in TR.sentence_spans(df).orderBy("region_no", "sentence_no").collect()]
    assert got == [(0, 0, "Hi you.", 10.0, 11.5, 2, True), (0, 1, "Go on.", 12.0, 13.5, 2, True), (1, 0, "No words here", 30.0, 31.0, 0, False), (2, 0, "Too many. Tokens for these.", 40.0, 43.5, 4, True)]


def test_every_source_has_a_result(spark):
    sources = spark.createDataFrame([("a", True), ("b", False), ("c", None), ("d", True)], "stream string, has_audio boolean")
    regions = spark.createDataFrame([("a", 1), ("d", 1)], "stream string, region_no int")
    said = spark.createDataFrame([("a", "s2"), ("a", "s1")], "stream string, speaker string")
    got = {r.stream: (r.segments, r.speakers, r.reason) for r in TR.results_with_reason(sources, regions, said).collect()}
    assert got == {"a": (2, ["s1", "s2"], None), "b": (0, [], "no_audio"), "c": (0, [], "no_speech"), "d": (0, [], "empty_transcript")}


def test_labels(spark):
    seg = spark.createDataFrame([(1, "x", 2.0), (1, "y", 1.0), (1, "x", 3.0)], "shot int, speaker string, start_sec double")
    assert sorted((r.speaker, r.label) for r in TR.renumbered_speakers(seg, ["shot"]).collect()) == [("x", "(S2)"), ("x", "(S2)"), ("y", "(S1)")]
    text = F.lit(TR.reference_lines() + " <Subject 1> <Picture 7> <Subject 1>")
    r = spark.range(1).select(TR.forbidden_labels(text), TR.forbidden_labels(F.lit(TR.reference_lines())), TR.shot_duration(F.lit(0.0), F.lit(1.0), F.lit(3.0)), TR.accepted_cut(F.lit(4.12), F.lit(4.0)), TR.accepted_cut(F.lit(None).cast("double"), F.lit(4.0))).first()
    assert list(r) == [["<Subject 1>", "<Picture 7>"], [], 2.0, False, False]


def test_audio_and_faces(spark):
    w = spark.createDataFrame([("a", 0, 1, [3.0]), ("a", 0, 0, [1.0, 2.0]), ("a", 0, 2, [])], "stream string, label int, window_no int, samples array<float>")
    assert TR.representative_audio(w).first().samples == [1.0, 2.0, 3.0]
    f = spark.createDataFrame([("a", 0, 1, 0, 0.0, 0.0, 50.0, 50.0, 0.9), ("a", 0, 1, 1, 0.0, 0.0, 50.0, 50.0, 0.9), ("a", 0, 1, 2, 0.0, 0.0, 5.0, 50.0, 1.0)], "stream string, frame_index long, owner int, face_no int, x1 double, y1 double, x2 double, y2 double, score double")
    assert [r.face_no for r in TR.embeddable_faces(f, 20, 0.5).collect()] == [0]


def test_cleaned_outputs_equal_the_sql_on_odd_texts(spark, tmp_path):
    import duckdb

    from shotlake.plans import speech_queries as SQ

    bits = ["", " ", "\n", "\x0b", " ", "a", "```", "<think>", "</thinK>", "</think>", "<thińk>", "<reaſoning>", "<|im_", "<|im_end|>", "start|>", "\r\n"]
    texts = [None, "", " \t\n", "\x0b", "  " * 30, *(x + y + z for x in bits for y in bits for z in ("", "b", " "))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = sorted(con.execute(SQ.ORACLE_SQL["prompt_clean"]).fetchall())
    got = sorted(tuple(r) for r in SQ.prompt_clean(spark, str(tmp_path)).collect())
    assert len(got) == len(texts) + len(SQ._OUTPUTS) and got == want


def test_word_ranges_of_many_sentences_take_seconds(spark):
    import itertools
    import random
    import time

    from shotlake.functions import text as T

    rng = random.Random(3)
    rows = [(n, [rng.choice([0, 1, 1, 2, 9]) for _ in range(n)]) for n in [*range(40), 99, 100, 101, 2500, 20000]]
    df = spark.createDataFrame(rows, "n long, c array<int>")
    total = F.aggregate("c", F.lit(0), lambda a, x: a + x)
    began = time.time()
    ranges = lambda n: F.transform(T.word_ranges(F.col("c"), n), lambda x: F.array(x["sentence"], x["first"], x["last"]))
    got = {r.n: (r.r, r.more) for r in df.select("n", ranges(total).alias("r"), ranges(total + 1).alias("more")).collect()}
    assert time.time() - began < 60
    for n, c in rows:
        ends = list(itertools.accumulate(c))
        assert got[n] == ([[i, e - k, e - 1] for i, (k, e) in enumerate(zip(c, ends, strict=True)) if k], [[0, 0, sum(c)]])


def test_word_alignment_equals_the_sql_where_a_text_is_null(spark, tmp_path):
    import duckdb

    from shotlake.plans import speech_queries as SQ

    texts = [None, None, "", " ", "One. Two three! 4?\nFive", "a" * 30 + ". ", "One. Two.", None, "x", "y", None, "Ten. Eleven"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(tuple(r) for r in SQ.word_alignment(spark, str(tmp_path)).collect()) == sorted(con.execute(SQ.ORACLE_SQL["word_alignment"]).fetchall())
