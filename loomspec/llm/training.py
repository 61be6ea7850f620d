"""What both classifiers share: picking a bounded sample of labelled rows and reading its features.

Only labels, ids and texts are read. The sample holds at most `limit` rows: those whose id has the smallest seeded hash, so
it does not depend on partitions or order. Rows whose label, id or text is null are never learnt from.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspec.llm.common import ID, TEXT, crc_of_id, id_text

#: Most labelled rows that a model is fitted on.
SAMPLE_ROWS = 20_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, learn_from, id_col: str = "doc_id", text_col: str = "text", limit: int = SAMPLE_ROWS) -> DataFrame:
    """(ID, TEXT, label double): ids repeated in either table count once; conflicting labels of an id take the larger."""
    chosen = labels.select(labels[id_col].cast("bigint").alias(ID), labels[label_col].cast("double").alias("label")).dropna()
    chosen = chosen.where(learn_from(crc_of_id(F.col(ID)))).groupBy(ID).agg(F.max("label").alias("label"))
    chosen = chosen.orderBy(F.xxhash64(F.col(ID), F.lit(7)), ID).limit(limit)
    # at most `limit` rows of two numbers: a proven bound
    return id_text(docs, id_col, text_col, null_as_empty=False).dropna().join(F.broadcast(chosen), ID)


def held_out(crc: Column, modulus: int, remainder: int) -> Column:
    return crc % modulus == remainder


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.clip(x, -60, 60)))
