"""A corpus pipeline over `documents`: toxic documents go, cross-site boilerplate lines go, one document of each group of near
copies stays, documents that hold benchmark passages go, and what is left is encoded.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs; `run` writes each stage's rows as Parquet in the shared
folder and reads them again as the next one's docs. Null texts score as empty ones, lose no lines, are linked with nothing,
hold no passage and encode as empty; very long texts are rows as any other; rows without an id are judged by their text
and stay in the near-copy stage; repeated rows share their fate; other columns are carried along; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspec.llm import decontamination, line_dedup, near_dedup, sentence_pieces, toxicity
from loomspec.llm.common import saved, table, unused
from loomspec.llm.queries import TOXIC_AT, tokenizer_file

#: Near copies share this many per cent of their shingles of so many words.
SHINGLE, PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that score as toxic; rows without an id are scored, too."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), lambda crc: crc % 3 != 1)
    name = unused("__toxicity", docs.columns)
    return toxicity.score_column(docs, model, name).where(F.col(name) < TOXIC_AT).select(*docs.columns)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less their boilerplate lines; n_chars, where there is one, follows the text."""
    out = line_dedup.remove_boilerplate(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs, SHINGLE, PERCENT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), remove="documents")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and the text that they decode to."""
    return sentence_pieces.encode_texts(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_boilerplate),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("encoding", encode),
]

#: A trained score decides the first stage, which SQL cannot express; tests compare each stage with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, f"pipeline-{name.replace(' ', '-')}")
    return docs
