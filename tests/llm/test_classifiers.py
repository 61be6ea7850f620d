import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loomspec.llm import quality, toxicity


def labelled(spark, documents, make):
    docs = documents([(i, make(i)[0]) for i in range(900)] + [(None, "x"), (2000, None), (2001, "")])
    labels = spark.createDataFrame([(i, make(i)[1], make(i)[1]) for i in range(900)] + [(None, 1, 1), (2000, None, None)], "doc_id bigint, toxic int, quality int")
    return docs, labels


def pairs_only(i):
    """Toxic only where an insult meets a group: each alone is harmless."""
    r = random.Random(i)
    words = [r.choice("sun moon tree lake bird stone wind leaf".split()) for _ in range(12)]
    insult, group = r.random() < 0.5, r.random() < 0.5
    return " ".join(words + ["insult"] * insult + ["group"] * group), int(insult and group)


def test_interactions_are_learnt(spark, documents):
    docs, labels = labelled(spark, documents, pairs_only)
    model = toxicity.train(docs, labels, lambda crc: crc % 3 != 1)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    truth = np.array([pairs_only(i)[1] for i in range(900)])
    guess = np.array([got[i] >= 0.5 for i in range(900)])
    assert (truth == guess).mean() > 0.97 and len(got) == 903 and all(0 <= s <= 1 for s in got.values())
    assert got[2000] == got[2001]


def test_fast_form_equals_all_pairs():
    rng = np.random.default_rng(0)
    m = toxicity.FactorizationMachine(np.arange(6), 0.3, rng.normal(size=6), rng.normal(size=(6, 3)))
    index, offsets = np.array([0, 2, 5, 1]), np.array([0, 3, 3, 4])
    rows = [index[a:b] for a, b in zip(offsets, offsets[1:])]
    slow = [m.bias + sum(m.weights[r]) + sum(m.factors[x] @ m.factors[y] for k, x in enumerate(r) for y in r[k + 1 :]) for r in rows]
    assert np.allclose(m.raw(index, offsets), slow)


def test_scores_of_few_texts_at_a_time(spark, documents, monkeypatch):
    """A batch of many texts is scored in bounded pieces, the text goes to the worker once, and no score depends on either."""
    model = toxicity.FactorizationMachine(np.arange(1 << 10), 0.1, np.linspace(-1, 1, 1 << 10), np.full((1 << 10, 2), 0.01))
    monkeypatch.setattr(toxicity, "BUCKETS", 1 << 10)
    rows = [(i, f"word{i} other {i % 7}" if i % 9 else None) for i in range(40)]
    docs = documents(rows, 1).withColumn("Whole", F.lit(1))
    want = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    monkeypatch.setattr(toxicity, "AT_ONCE", 7)
    got = toxicity.score_column(docs, model, "s")
    assert {r["doc_id"]: r["s"] for r in got.collect()} == want and len(want) == 40
    assert got.drop("s").schema == docs.schema and "struct" not in got._jdf.queryExecution().optimizedPlan().toString().lower()
    pieces = list(toxicity._pieces(iter([pa.RecordBatch.from_pydict({"x": list(range(20))})])))
    assert [p.num_rows for p in pieces] == [7, 7, 6]


def test_no_labels_and_extra_columns(spark, documents):
    docs = documents([(1, "a b"), (2, None)]).withColumn("score", F.lit("x")).withColumn("label", F.lit(1))
    none = spark.createDataFrame([], "doc_id bigint, toxic int, quality int")
    model = toxicity.train(docs, none, lambda crc: crc >= 0)
    assert toxicity.score_column(docs, model, "__s").columns == [*docs.columns, "__s"]
    assert all(r["score"] < 0.01 for r in toxicity.score(docs, model).collect())
    vectors, net = quality.train(docs, none, lambda crc: crc >= 0)
    assert [r["score"] for r in quality.score(docs, vectors, net).collect()] == [0.5, 0.5]
    assert quality.score(docs.limit(0), vectors, net).count() == 0


def shaped(i):
    r = random.Random(i)
    words = [r.choice("sun moon tree lake bird stone wind leaf road hill".split()) for _ in range(60)]
    good = r.random() < 0.7
    return (" ".join(words) + "." if good else " ".join(w + "!!" for w in words)), int(good)


def test_quality_holds_out(spark, documents):
    docs, labels = labelled(spark, documents, shaped)
    vectors, net = quality.train(docs, labels, lambda crc: crc % 5 != 0)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, vectors, net).collect()}
    assert np.mean([(got[i] >= 0.5) == shaped(i)[1] for i in range(900)]) > 0.97 and 0.25 <= net.temperature <= 4


def test_context_sums_count_every_neighbour(spark, documents):
    docs = documents([(1, "a b a"), (2, "b")])
    sums = quality.context_sums(docs, "doc_id", "text")
    assert sums[:, -1].sum() == 4
    places, signs = quality.index_vectors()
    a, b = (quality.Words().memo[w] for w in "ab")
    want = np.zeros(quality.WIDTH)
    for k in range(2):
        want[places[k][b]] += 2 * signs[k][b]  # b on both sides
        want[places[k][a]] += 2 * signs[k][a]  # the other a, twice
    assert np.array_equal(sums[a, :-1], want)
