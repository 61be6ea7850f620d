"""Quality scores: random-indexing word vectors, pooled per document, through a two-layer network.

Word vectors come from all documents: each word has a sparse random index vector, and a word's context vector is the sum of
the index vectors of its neighbours at distances 1 and 2, over the whole corpus. Words share `BUCKETS` rows by hash, so the
table that is summed, collected and broadcast has a fixed size. A document is pooled into the mean and the spread of its
words' vectors, and the mean likeness of adjacent words. The network learns from a bounded sample of labelled rows
(training.SAMPLE_ROWS), and a temperature fitted on rows kept apart calibrates its probabilities.

Null and empty texts pool to zeros; a very long text is one row, pooled whole. Repeated rows keep a row each; null ids stay null; other columns are not read; an empty
table gives an empty result. Where no row is labelled, every score is 0.5.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspec.llm.common import ID, TEXT, bounded_memo, id_text
from loomspec.llm.training import labelled_sample, sigmoid

BUCKETS = 1 << 14
WIDTH = 48
REACH = (1, 2)
HIDDEN = 32
EPOCHS = 40
MEMO_ENTRIES = 400_000
BLOCK_WORDS = 250_000
WORDS = re.compile(r"\w+|[^\w\s]+").findall


def index_vectors(seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Each bucket's two places in the vector and their signs."""
    rng = np.random.default_rng(seed)
    first = rng.integers(0, WIDTH, BUCKETS)
    second = (first + rng.integers(1, WIDTH, BUCKETS)) % WIDTH
    return np.stack([first, second]), rng.choice([-1.0, 1.0], (2, BUCKETS))


class Words:
    """Buckets of a text's words and marks, in order; case counts, for shouting is a sign of its own."""

    def __init__(self):
        self.memo = bounded_memo(MEMO_ENTRIES)
        self.memo.make = lambda w: zlib.crc32(w.encode()) % BUCKETS

    def blocks(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(buckets, words in each text), for runs of texts of about BLOCK_WORDS words."""
        ids, lens, size = [], [], 0
        for text in texts:
            words = WORDS(text)
            ids.append(np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words)))
            lens.append(len(words))
            size += len(words)
            if size >= BLOCK_WORDS:
                yield np.concatenate(ids), np.array(lens)
                ids, lens, size = [], [], 0
        if lens:
            yield np.concatenate(ids), np.array(lens)


def context_sums(docs: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    """BUCKETS rows: the sums of the neighbours' index vectors, and in the last column the count of words. All documents are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, (places, signs) = Words(), index_vectors()
        sums, counts = np.zeros(BUCKETS * WIDTH), np.zeros(BUCKETS)
        for batch in batches:
            for ids, lens in words.blocks(batch.column(TEXT).to_pylist()):
                counts += np.bincount(ids, minlength=BUCKETS)
                text = np.repeat(np.arange(len(lens)), lens)
                for d in REACH:
                    near = np.flatnonzero(text[d:] == text[:-d]) if len(ids) > d else np.zeros(0, np.int64)
                    for a, b in ((ids[near], ids[near + d]), (ids[near + d], ids[near])):
                        for k in range(2):
                            sums += np.bincount(a * WIDTH + places[k][b], signs[k][b], BUCKETS * WIDTH)
        used = np.flatnonzero(counts)
        sums = sums.reshape(BUCKETS, WIDTH)[used].astype(np.int64)
        names = ["bucket", "n", *(f"s{i}" for i in range(WIDTH))]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used].astype(np.int64)), *(pa.array(np.ascontiguousarray(sums[:, i])) for i in range(WIDTH))], names=names)

    names = ["n", *(f"s{i}" for i in range(WIDTH))]
    partial = id_text(docs, id_col, text_col).select(TEXT).mapInArrow(run, "bucket bigint, " + ", ".join(f"{x} bigint" for x in names))
    total = partial.groupBy("bucket").agg(*(F.sum(x).alias(x) for x in names)).toPandas()  # at most BUCKETS rows
    out = np.zeros((BUCKETS, WIDTH + 1))
    out[total["bucket"].to_numpy(np.int64)] = total[[*names[1:], "n"]].to_numpy(float)
    return out


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Unit vectors, after the corpus' mean direction is taken off."""
    counts, sums = sums[:, -1], sums[:, :-1]
    mean = sums / np.maximum(counts, 1)[:, None]
    mean -= (mean * counts[:, None]).sum(0) / max(counts.sum(), 1)
    mean[counts == 0] = 0
    return (mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pool(vectors: np.ndarray, ids: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """For each text the mean and spread of its vectors, the likeness of neighbours, and how much it has at all."""
    out = np.zeros((len(lens), 2 * WIDTH + 3), np.float32)
    full, starts = np.flatnonzero(lens), np.concatenate([[0], np.cumsum(lens)])[:-1]
    if not len(full):
        return out
    x = vectors[ids]
    at, n = starts[full], lens[full][:, None].astype(np.float32)
    mean = np.add.reduceat(x, at, axis=0) / n
    square = np.add.reduceat(x * x, at, axis=0) / n
    out[full, :WIDTH], out[full, WIDTH : 2 * WIDTH] = mean, np.sqrt(np.maximum(square - mean * mean, 0))
    text = np.repeat(np.arange(len(lens)), lens)
    near = text[1:] == text[:-1]
    like = np.einsum("ij,ij->i", x[1:], x[:-1])
    pairs = np.maximum(np.bincount(text[1:][near], minlength=len(lens)), 1)
    out[:, 2 * WIDTH] = np.bincount(text[1:][near], like[near], len(lens)) / pairs
    out[:, 2 * WIDTH + 1] = np.bincount(text[1:][near], (ids[1:] == ids[:-1])[near], len(lens)) / pairs
    out[:, 2 * WIDTH + 2] = np.log1p(lens) / 10
    return out


def pooled(texts: DataFrame, shared, extra: str) -> DataFrame:
    """(extra, features)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            found = [pool(shared.value, ids, lens) for ids, lens in words.blocks(batch.column(TEXT).to_pylist())]
            rows = np.concatenate(found) if found else np.zeros((0, 2 * WIDTH + 3), np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(extra), pa.array(list(rows), pa.list_(pa.float32()))], names=[extra, "features"])

    return texts.select(extra, TEXT).mapInArrow(run, f"{extra} double, features array<float>")


class Network:
    """One hidden layer of rectified units, one output; temperature divides the output."""

    def __init__(self, width: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.mean, self.scale, self.temperature = np.zeros(width), np.ones(width), 1.0
        self.parts = [rng.normal(0, (2 / width) ** 0.5, (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, (2 / HIDDEN) ** 0.5, HIDDEN), np.zeros(1)]

    def raw(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.parts
        return np.maximum(((x - self.mean) / self.scale) @ a + b, 0) @ c + d[0]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.raw(x) / self.temperature)

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 3) -> Network:
        """Adam on the log loss; a tenth of the rows is kept apart for the temperature and the choice of the epoch."""
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-3)
        apart = rng.random(len(x)) < 0.1
        if apart.all() or not apart.any():
            apart[:] = False
        check, x, cy, y = x[apart], x[~apart], y[apart], y[~apart]
        z = (x - self.mean) / self.scale
        m, v, t = [np.zeros_like(p) for p in self.parts], [np.zeros_like(p) for p in self.parts], 0
        best, kept = np.inf, self.parts
        for _ in range(EPOCHS):
            order = rng.permutation(len(z))
            for first in range(0, len(z), 128):
                i = order[first : first + 128]
                a, b, c, d = self.parts
                h = np.maximum(z[i] @ a + b, 0)
                error = (sigmoid(h @ c + d[0]) - y[i]) / len(i)
                back = np.outer(error, c) * (h > 0)
                grads = [z[i].T @ back + 1e-4 * a, back.sum(0), h.T @ error + 1e-4 * c, np.array([error.sum()])]
                t += 1
                for k, g in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.parts[k] = self.parts[k] - 0.002 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
            if len(check) and (loss := log_loss(self.raw(check), cy)) < best:
                best, kept = loss, [p.copy() for p in self.parts]
        if len(check):
            self.parts = kept
            out = self.raw(check)
            self.temperature = float(min(np.geomspace(0.25, 4, 65), key=lambda s: log_loss(out / s, cy)))
        return self


def log_loss(raw: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, raw) - y * raw))


def train(docs: DataFrame, labels: DataFrame, learn_from, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, Network]:
    """Word vectors of all documents, and the network fitted on the bounded sample."""
    vectors = word_vectors(context_sums(docs, id_col, text_col))
    shared = docs.sparkSession.sparkContext.broadcast(vectors)  # BUCKETS * WIDTH numbers
    sample = pooled(labelled_sample(docs, labels, label_col, learn_from, id_col, text_col), shared, "label").toPandas()
    network = Network(2 * WIDTH + 3)
    if not len(sample):
        network.parts = [np.zeros_like(p) for p in network.parts]
        return vectors, network
    x, y = np.stack(sample["features"].to_list()).astype(float), sample["label"].to_numpy(float)
    order = np.lexsort((*x.T[:3], y))
    return vectors, network.fit(x[order], y[order])


def score(docs: DataFrame, vectors: np.ndarray, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col and score in 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast((vectors, network))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, net = shared.value
        words = Words()
        for batch in batches:
            found = [net.probability(pool(table, ids, lens).astype(float)) for ids, lens in words.blocks(batch.column(TEXT).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(ID), pa.array(np.concatenate(found) if found else np.zeros(0))], names=[id_col, "score"])

    return id_text(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` bigint, score double")
