"""Corpus cleaning as five stages over `documents`; each stage is written and read back before the next.

language_id    documents whose language cannot be told (null, or no letter) go; lang becomes
               the language that the text is in, whatever its label said
quality        documents that fail the base rules or the likelihood-ratio threshold go
near_copies    of each group of texts linked by Jaccard similarity of five-word
               shingles of at least 0.8, the document with the smallest id stays (one row)
decontaminate  documents that hold a benchmark item within its edit distance go
packing        what is left becomes pieces in sequences of at most 2048 tokens, each of one language

All but the last return the columns of documents, and only the first changes a
value, lang.  Every row is judged on its own text, whether its id repeats or is
null.  Each stage reads its input more than once, so it is to be a written
table, or one that gives the same rows again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotlake.llm import decontaminate, language_id, ngram_jaccard, packing, quality
from shotlake.llm._store import discard, kept


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _beside(docs: DataFrame) -> str:
    """Something longer than any column's name, to lead the names of columns beside docs' own."""
    return "_" * (1 + max(map(len, docs.columns)))


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is null or has no letter go; all others get a language and stay.

    It is told from the text, replaces lang and is what the last stage packs by;
    labels, which may be missing or wrong, only teach.  Texts fall into two halves
    by their hash, and each is told by what the other teaches, so no text vouches
    for its own label.  Labels of languages that were not taught stay, and without
    any all do.  Empty texts go, repeated rows stay side by side, an empty table
    stays empty.
    """
    own = _beside(docs)
    row_id, text, lang = (f"{own}{c}" for c in ("doc_id", "text", "lang"))
    rows = docs.toDF(*(own + c for c in docs.columns)).where(F.col(text).rlike(r"\p{L}"))  # docs may have columns named as what is found
    half = F.pmod(F.xxhash64(text), F.lit(2)).cast("string")
    samples = language_id.sample(rows.select(text, F.concat(half, lang).alias(lang)), text, lang)
    told = []
    for h in "01":
        model = language_id.fit({k[1:]: v for k, v in samples.items() if k[0] != h})
        found = language_id.predict(rows.where(half == h), model, row_id, text)
        judged = (F.col("score") > 0) & (F.col(lang).isNull() | F.col(lang).isin(model.languages))
        told.append(found.withColumn(lang, F.when(judged, F.col("lang_pred")).otherwise(F.col(lang))))
    return told[0].union(told[1]).select(*(F.col(own + c).alias(c) for c in docs.columns))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that quality.verdicts does not keep go, by `labels` of sf_dir.

    Null, empty and short texts fail the base rules and go.  A row without an
    id, or that shares one, is kept or not on its own text.
    """
    own = _beside(docs)
    return quality.verdicts(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), prefix=own).where(F.col(f"{own}kept")).select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: that of the smallest id, null last, and one of those that share it.

    Rows with equal texts are a group, whatever their ids; texts without a word are copies of nothing and all stay.
    """
    row = f"{_beside(docs)}row"
    named = kept(docs.withColumn(row, F.monotonically_increasing_id()), "near-copies-rows")  # ids may be null or repeat, so rows get numbers, written before use
    groups = ngram_jaccard.jaccard_components(named, id_col=row, n=5, numerator=80, denominator=100).select(F.col("id").alias(row), "component_id")
    first = groups.join(named.select(row, "doc_id"), row).groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row))[row].alias(row))
    return named.join(first.select(row), row, "left_semi").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold an item of `benchmark` of sf_dir go.  Null and empty texts hold none and stay."""
    return decontaminate.uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each row's ids: doc_id, piece, start, length, ids_crc32, lang, sequence_id, offset.

    A sequence holds one lang, null being one.  Null and empty texts are the end id alone.
    """
    return packing.packed_documents(docs, _vocabulary(), capacity=2048, end_id=0, part_col="lang").withColumnsRenamed({"id": "doc_id", "part": "lang"})


STAGES = [
    ("language_id", drop_unknown_language),
    ("quality", drop_low_quality),
    ("near_copies", keep_one_of_near_copies),
    ("decontaminate", drop_contaminated),
    ("packing", pack),
]

#: SQL cannot express the models.  tests/llm/test_queries.py restates each stage in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for sf_dir's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = kept(docs, f"stage-{name}")
            discard(before)
    return docs
