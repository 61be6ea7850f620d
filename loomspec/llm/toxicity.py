"""Toxicity scores by a factorization machine over hashed terms.

A text's terms are its distinct lower-case words and the beginnings of the longer ones, for inflected and compound forms,
hashed into 2**24 buckets. The model holds a weight and a vector of
`FACTORS` numbers for each bucket that is frequent enough in the training sample; a pair of terms adds the product of
their vectors, so that words which are harmless apart can count together. The training sample is bounded
(training.SAMPLE_ROWS), and terms that fewer than `LEAST_TEXTS` of its texts have are left out; scoring reads every whole
text, however long. Null and empty texts have no terms and get the bias alone. Repeated rows keep a row each; null ids stay null; other columns are not read; an empty table gives an empty result. Where no row is
labelled, every score is 0.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspec.llm.common import ID, TEXT, bounded_memo, id_text, lean, pieces, saved, ship
from loomspec.llm.training import labelled_sample, sigmoid

BUCKETS = 1 << 24
FACTORS = 6
#: Terms must be in this many texts of the training sample.
LEAST_TEXTS = 8
EPOCHS = 12
#: Parts in which the sample goes to the driver.
PARTS = 8
#: How much more a toxic text weighs than a clean one, and how much slower factors learn than weights.
RARE_WEIGHT, FACTOR_STEP = 1.5, 0.1
MEMO_ENTRIES = 200_000
#: Texts whose terms a worker holds at a time.
AT_ONCE = 500
WORDS = re.compile(r"\w+").findall


#: Lengths of the beginnings that are terms of their own.
BEGINNINGS = (4, 5, 6, 7)


def buckets(word: str) -> tuple[int, ...]:
    """Of a word, and of its beginnings."""
    terms = [word, *("^" + word[:k] for k in BEGINNINGS if len(word) >= k)]
    return tuple({zlib.crc32(x.encode()) & (BUCKETS - 1) for x in terms})


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces, so that the terms of few texts are held at a time."""
    return pieces(batches, AT_ONCE)


def distinct_buckets(texts: DataFrame) -> DataFrame:
    """(label, key, terms): the distinct buckets of each text, in order, and a digest of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = bounded_memo(MEMO_ENTRIES)
        memo.make = buckets
        for batch in _pieces(batches):
            terms = [np.array(sorted(set().union(*map(memo.__getitem__, set(WORDS(x.lower()))))), np.int32) for x in batch.column(TEXT).to_pylist()]
            keys = pa.array([xxhash.xxh3_64_intdigest(x.tobytes()) >> 1 for x in terms], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("label"), keys, pa.array(terms, pa.list_(pa.int32()))], names=["label", "key", "terms"])

    return texts.select("label", TEXT).mapInArrow(lean(run), "label double, key bigint, terms array<int>")


def numbered_terms(rows: DataFrame, terms: np.ndarray) -> DataFrame:
    """rows with the places of their terms among the given ones, as bytes of 32-bit integers; other terms are left out."""
    shared = rows.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = shared.value
        for batch in batches:
            column = batch.column("terms")
            flat, offsets = column.flatten().to_numpy(), column.offsets.to_numpy() - column.offsets[0].as_py()
            at = np.searchsorted(kept, flat)
            known = kept[np.minimum(at, len(kept) - 1)] == flat if len(kept) else np.zeros(len(flat), bool)
            ends = np.concatenate([[0], np.cumsum(known)])[offsets]
            places = at[known].astype("<i4").tobytes()
            out = [places[4 * a : 4 * b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("key"), pa.array(out, pa.binary())], names=["label", "key", "terms"])

    return rows.mapInArrow(lean(run), "label double, key bigint, terms binary")


class FactorizationMachine:
    """bias + sum of weights + sum over pairs of <v_i, v_j>, for sets of term indices."""

    def __init__(self, terms: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.terms, self.bias, self.weights, self.factors = terms, bias, weights, factors
        self.place = {int(b): i for i, b in enumerate(terms)}

    def raw(self, index: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Scores before the sigmoid; text k has the terms index[offsets[k]:offsets[k + 1]]."""
        rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        out = self.bias + np.bincount(rows, self.weights[index], len(offsets) - 1)
        for f in range(self.factors.shape[1]):
            v = self.factors[index, f]
            out += 0.5 * (np.bincount(rows, v, len(offsets) - 1) ** 2 - np.bincount(rows, v * v, len(offsets) - 1))
        return out


def fit(labels: np.ndarray, terms: np.ndarray, index: np.ndarray, offsets: np.ndarray, seed: int = 11) -> FactorizationMachine:
    """Adagrad on mini-batches of the log loss, with L2 on weights and factors. Text i has terms[index[offsets[i]:offsets[i + 1]]]."""
    rng = np.random.default_rng(seed)
    n, k = len(terms), FACTORS
    rate = min(max(labels.mean() if len(labels) else 0.0, 1e-6), 1 - 1e-6)
    w, v = np.zeros(n), rng.normal(0, 0.02, (n, k))
    model = FactorizationMachine(terms.astype(np.int64), float(np.log(rate / (1 - rate))), w, v)
    if not n or labels.min() == labels.max():
        return model
    sum_w, sum_v, sum_b, step, l2 = np.full(n, 1e-6), np.full((n, k), 1e-6), 1e-6, 0.15, 2e-4
    weight = np.where(labels > 0, RARE_WEIGHT, 1.0)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(labels))
        for first in range(0, len(order), 256):
            chosen = order[first : first + 256]
            lens = offsets[chosen + 1] - offsets[chosen]
            own = np.concatenate([index[offsets[i] : offsets[i + 1]] for i in chosen])
            row = np.repeat(np.arange(len(chosen)), lens)
            error = (sigmoid(model.raw(own, np.concatenate([[0], np.cumsum(lens)]))) - labels[chosen]) * weight[chosen]
            used, inverse = np.unique(own, return_inverse=True)
            grad = np.bincount(inverse, error[row], len(used)) / len(chosen) + l2 * w[used]
            sum_w[used] += grad**2
            vi = v[own]
            total = np.stack([np.bincount(row, vi[:, f], len(chosen)) for f in range(k)], 1)
            pull = error[row][:, None] * (total[row] - vi)
            grad_v = np.stack([np.bincount(inverse, pull[:, f], len(used)) for f in range(k)], 1) / len(chosen) + l2 * v[used]
            sum_v[used] += grad_v**2
            w[used] -= step * grad / np.sqrt(sum_w[used])
            v[used] -= FACTOR_STEP * step * grad_v / np.sqrt(sum_v[used])
            g = error.mean()
            sum_b += g * g
            model.bias -= step * g / np.sqrt(sum_b)
    return model


def train(docs: DataFrame, labels: DataFrame, learn_from, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> FactorizationMachine:
    """Fit on the bounded sample of labelled rows; learn_from(crc) tells which rows may be learnt from."""
    sample = saved(distinct_buckets(labelled_sample(docs, labels, label_col, learn_from, id_col, text_col)), "labelled-terms")
    # the sample bounds the terms, too: fewer than its words, and their beginnings, divided by LEAST_TEXTS
    often = sample.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_TEXTS)
    terms = np.sort(often.select("term").toArrow()["term"].to_numpy())
    labels_of, sizes, places = [], [], []
    for part in range(PARTS):  # a part at a time, so that neither half of the driver holds the sample twice
        rows = numbered_terms(sample.where(F.pmod("key", F.lit(PARTS)) == part), terms).toArrow()
        order = np.lexsort([rows["key"].to_numpy(), rows["label"].to_numpy()])  # whatever order they came in
        labels_of.append(rows["label"].to_numpy()[order])
        own = [x.as_py() for x in rows["terms"]]
        sizes.append(np.array([len(own[i]) // 4 for i in order], np.int64))
        places.append(np.frombuffer(b"".join(own[i] for i in order), "<i4"))
    return fit(np.concatenate(labels_of), terms, np.concatenate(places), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]))


def score(docs: DataFrame, model: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col and score in 0 to 1."""
    return _scored(id_text(docs, id_col, text_col).select(ID, TEXT), 1, model).select(F.col("c0").alias(id_col), "score")


def score_column(docs: DataFrame, model: FactorizationMachine, out_col: str, text_col: str = "text") -> DataFrame:
    """docs, all its rows and columns, with the score of each."""
    ship(docs.sparkSession)
    place = [c.lower() for c in docs.columns].index(text_col.lower())
    rows = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    text = [] if isinstance(docs.schema[place].dataType, T.StringType) else [F.col(f"c{place}").cast("string")]  # no text goes twice
    scored = _scored(rows.select("*", *text), len(docs.columns) if text else place, model)
    return scored.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)), F.col("score").alias(out_col))


def _scored(rows: DataFrame, text: int, model: FactorizationMachine) -> DataFrame:
    """The columns of rows as c0, c1, ... and the score of the one at the given place; a null text counts as empty."""
    terms, bias, weights, factors = model.terms, model.bias, model.weights, model.factors
    shared = rows.sparkSession.sparkContext.broadcast((terms, bias, weights, factors))  # FACTORS + 2 numbers for each term of the bounded sample
    rows = rows.toDF(*(f"c{i}" for i in range(len(rows.columns))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = FactorizationMachine(*shared.value)
        memo = bounded_memo(MEMO_ENTRIES)
        place = machine.place
        memo.make = lambda word: tuple(place[b] for b in buckets(word) if b in place)
        for batch in _pieces(batches):
            found = []
            for x in batch.column(text).to_pylist():
                found.append(sorted(set().union(*map(memo.__getitem__, set(WORDS((x or "").lower()))))))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found], dtype=np.int64)])
            index = np.fromiter((i for x in found for i in x), np.int64, offsets[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sigmoid(machine.raw(index, offsets)))], names=[*batch.schema.names, "score"])

    return rows.mapInArrow(lean(run), T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())]))
