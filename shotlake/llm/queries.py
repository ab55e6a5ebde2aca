"""The queries opN_<name>: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotlake.llm import adaptive_scan, bitplanes, chat, decontaminate, filter_audit, hard_negatives, katz, language_id, ngram_jaccard, packing, quality, token_counts, warc
from shotlake.llm._store import kept, new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id: 4-word shingles, Jaccard of at least 0.85."""
    found = ngram_jaccard.jaccard_components(_table(spark, sf_dir, "documents"), n=4, numerator=85, denominator=100)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: sequences of at most 2048 tokens."""
    found = packing.packed_documents(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), capacity=2048, end_id=0)
    return found.withColumnRenamed("id", "doc_id")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the written windows."""
    saying = spark.sql("SELECT -7L AS conv_id, t.turn, t.role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(saying)
    return chat.read_back(kept(chat.format_conversations(rows, _vocabulary("word_bpe_49k.json")), "chat"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, base statistics, base_failed, score and kept for each document."""
    found = quality.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.withColumnRenamed("id", "doc_id")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_tokens: greedy longest-match pieces of each whole text."""
    found = token_counts.token_counts(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))
    return found.withColumnRenamed("id", "doc_id")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, read back from the written archives."""
    path = new_path(spark, "warc")
    warc.write_warc(_table(spark, sf_dir, "pages"), path, least_bytes=0)
    found = warc.read_warc(spark, path, payload="check").where(F.col("type").isin("response", "revisit"))
    return found.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the other two folds of three."""
    docs = _table(spark, sf_dir, "documents")
    out = language_id.held_out("doc_id", 3, 1)
    found = language_id.identified(docs.select("doc_id", "text", out.alias("held_out")), docs.where(~out))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op8_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, read back from the written token file."""
    path = new_path(spark, "tokens")
    bitplanes.write_token_file(_table(spark, sf_dir, "documents"), path, _vocabulary("word_bpe_49k.json"), end_id=1)
    found = bitplanes.read_token_file(spark, path)
    return found.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op9_katz_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; learned from the other four folds of five."""
    found = katz.scored(_table(spark, sf_dir, "documents"), ~language_id.held_out("doc_id", 5, 1))
    return found.select(F.col("id").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, start_word, end_word, edits: the benchmark items that documents hold."""
    found = decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


def op11_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 5 rows found nearest by cosine to each row whose vec_id is divisible by 50."""
    rows = _table(spark, sf_dir, "embeddings")
    return adaptive_scan.nearest(rows, rows.where("vec_id % 50 = 0"), k=5)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part, filter_order, step and counts of five filters of documents over all 120 orders."""
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; anchors have a vec_id divisible by 50."""
    rows = hard_negatives.whole_numbers(_table(spark, sf_dir, "embeddings"))
    rows = rows.withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.hard_negatives(rows, rows.where("id % 50 = 0"), n_positives=5, n_negatives=3, lowest=50, highest=95)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_best_fit_packing, op3_chat_formatting, op4_quality_rules, op5_token_counts, op6_warc, op7_language_id, op8_token_planes, op9_katz_lm, op10_decontamination, op11_adaptive_scan, op12_filter_audit, op13_hard_negatives)}

#: Links by brute force over all pairs that share a shingle, then the smallest id that they reach.
_JACCARD_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(generate_series(1, len(w) - 3), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM w),
g AS (SELECT doc_id, unnest(s) AS g FROM s), n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles FROM s),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n_shingles + y.n_shingles - i)),
reach AS (SELECT doc_id AS a, doc_id AS c FROM n UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.a)
SELECT n.doc_id, n_shingles, min(c) AS component_id FROM n JOIN reach r ON r.a = n.doc_id GROUP BY n.doc_id, n_shingles"""

_WARC_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages), f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, 1 + i // 4 * 5, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM p JOIN f USING (h)"""

#: The exact neighbours.  The search is approximate; on tables of so few lists it probes them all.
_NEAREST_SQL = """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) / sqrt(list_dot_product(q.e, q.e) * list_dot_product(c.e, c.e)) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 5"""

_AUDIT_SQL = r"""WITH f AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
l AS (SELECT doc_id, bool_or(coalesce(quality, 0) = 1) AS good, bool_or(coalesce(toxic, 0) = 1) AS toxic FROM labels GROUP BY doc_id),
e AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  CAST(len(w) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT) + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS INT)
  + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(f.doc_id > min(f.doc_id) OVER (PARTITION BY t), false) AS INT) AS mask FROM f LEFT JOIN l ON f.doc_id = l.doc_id),
m AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM e GROUP BY part, mask),
b AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c, unnest([1, 2, 4, 8, 16]) AS v),
o AS (SELECT p.c || q.c || r.c || s.c || t.c AS filter_order, [p.v, q.v, r.v, s.v, t.v] AS bits FROM b p JOIN b q ON q.v <> p.v JOIN b r ON r.v NOT IN (p.v, q.v) JOIN b s ON s.v NOT IN (p.v, q.v, r.v) JOIN b t ON t.v NOT IN (p.v, q.v, r.v, s.v)),
s AS (SELECT filter_order, k AS step, bits[k] AS bit, coalesce(list_sum(bits[1:k - 1]), 0)::INT AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS k))
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (mask = bit), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(n * (120 // greatest(bit_count(mask), 1))) FILTER (mask & bit <> 0), 0) AS BIGINT) AS shapley
FROM m, s GROUP BY part, filter_order, step, bit, before"""

_NEGATIVES_SQL = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.e, c.e) AS BIGINT) AS score FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3"""

ORACLE_SQL: dict[str, str] = {"op1_ngram_jaccard_join": _JACCARD_SQL, "op6_warc": _WARC_SQL, "op11_adaptive_scan": _NEAREST_SQL, "op12_filter_audit": _AUDIT_SQL, "op13_hard_negatives": _NEGATIVES_SQL}
