"""The queries of this subpackage, one for each operator, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspec.llm import class_lm, decontamination, line_dedup, near_dedup, passages, quality, sentence_pieces, token_counts, toxicity, transport_stream
from loomspec.llm.common import crc_of_id, scratch_path, table

TOKEN_LIMIT = 2048
TOXIC_AT, GOOD_AT = 0.7, 0.3


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents; the cache is a new one, so that every distinct text is encoded here."""
    out = token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), scratch_path(spark, "token-cache"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, lambda crc: crc % 3 != 1)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (crc_of_id(F.col("doc_id")) % 3 == 1).alias("held_out"), "score", (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.remove_boilerplate(table(spark, sf_dir, "documents"), removed_col="n_removed")
    return out.select("doc_id", "n_removed", F.length("text").cast("bigint").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op4_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport_stream.store_texts(table(spark, sf_dir, "documents"), keep_media=False)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    vectors, network = quality.train(docs, labels, lambda crc: crc % 5 != 0)
    scored = quality.score(docs, vectors, network)
    return scored.select("doc_id", (crc_of_id(F.col("doc_id")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= GOOD_AT).cast("int").alias("predicted"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontamination.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.size("hit_words").cast("bigint")
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op7_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model, counts = class_lm.train(docs, lambda crc: crc % 7 != 2)
    scored = class_lm.score(docs, model, counts)
    return scored.select("doc_id", (crc_of_id(F.col("doc_id")) % 7 == 2).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("bigint").alias("train_tokens"), "base_score", "score")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op10_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode_texts(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), digests_only=True)


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_toxicity, op3_line_dedup, op4_transport_stream, op5_quality, op6_decontamination, op7_class_lm, op8_near_dedup, op9_passages, op10_sentence_pieces)}

ORACLE_SQL = {
    "op3_line_dedup": rf"""
WITH lines AS (
  SELECT doc_id, source, pos, line, trim(lower(regexp_replace(line, '[ \t\n\x0B\f\r]+', ' ', 'g')), ' ') AS k
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
        FROM documents WHERE text IS NOT NULL)),
boiler AS (
  SELECT k FROM lines WHERE k <> '' GROUP BY k HAVING count(DISTINCT coalesce('s' || source, 'n')) >= {line_dedup.LEAST_SITES}),
kept AS (
  SELECT l.doc_id, coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE b.k IS NULL), '') AS text,
         count(*) FILTER (WHERE b.k IS NOT NULL) AS n_removed
  FROM lines l LEFT JOIN boiler b ON l.k = b.k GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(k.n_removed, 0)::BIGINT AS n_removed, length(k.text)::BIGINT AS n_chars, sha256(k.text) AS text_sha256
FROM documents d LEFT JOIN kept k USING (doc_id)
""",
    "op6_decontamination": rf"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{decontamination.UPPER}', '{decontamination.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{decontamination.UPPER}', '{decontamination.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), {decontamination.WINDOW}) AS size, array_to_string(w[i:i + least(len(w), {decontamination.WINDOW}) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {decontamination.WINDOW} + 1, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
grams AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS gram
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM dw, sizes WHERE len(w) >= size)),
hits AS (SELECT g.doc_id, g.i, g.size, x.item_id FROM grams g JOIN windows x ON g.gram = x.gram AND g.size = x.size),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(i.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(i.listed, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN covered c USING (doc_id) LEFT JOIN items i USING (doc_id)
""",
}
