import collections
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspec.llm import class_lm, transport_stream as ts


@pytest.mark.parametrize("n", [0, 1, 183, 184, 575, 576, 577, 9215, 9216, 9217, 200_000])
def test_round_trip(n):
    data = bytes((7 * i + n) & 255 for i in range(n))
    payload = ts.padded(data)
    media = ts.mux(payload)
    stream = ts.parse(media)
    assert len(media) % 188 == 0 and stream.payload(ts.ES_PID) == payload and payload.startswith(data)
    assert stream.programs == {1: {ts.ES_PID: ts.PRIVATE_DATA}} and not stream.continuity_errors + stream.bad_sections
    assert [u.pts for u in stream.units] == [16 * ts.TICKS * i for i in range(len(stream.units))] and all(u.random_access for u in stream.units)


def test_damage_is_seen():
    media = ts.mux(ts.padded(b"x" * 50_000))
    cut = [media[i : i + 188] for i in range(0, len(media), 188)]
    assert ts.parse(b"".join(cut[:7] + cut[8:])).continuity_errors == 1
    assert ts.parse(b"".join(cut[:8] + cut[7:])).continuity_errors == 0  # a repeated packet
    assert ts.parse(b"".join(cut[:8] + cut[7:])).payload() == ts.padded(b"x" * 50_000)
    bad = bytearray(media)
    bad[20] ^= 1
    assert ts.parse(bytes(bad)).bad_sections == 1 and not ts.parse(bytes(bad)).programs
    assert ts.parse(None).packets == ts.parse(b"").packets == ts.parse(b"abc").packets == 0 and ts.parse(b"\x00" * 188).lost_sync == 1


def test_known_bytes():
    assert ts.section_crc(b"123456789") == 0x0376E6E7  # the check value of this CRC
    assert ts._read_stamp(ts._stamp(2, (1 << 33) - 5)) == (1 << 33) - 5


def test_tables(documents, odd_rows):
    got = ts.store_texts(documents(odd_rows).withColumn("media", F.lit(1)))
    rows = got.collect()
    assert len(rows) == len(odd_rows)
    for r in rows:
        assert r["payload_bytes"] % 576 == 0 and r["media_bytes"] == len(r["media"])
    one = next(r for r in rows if r["doc_id"] == 1)
    assert one["n_bytes"] == 0 and one["tail_crc32"] == zlib.crc32(b"\xff" * 32)
    units = ts.media_table(got, "doc_id", "media").collect()
    assert sum(len(u["data"]) for u in units) == sum(r["payload_bytes"] for r in rows) and {u["program"] for u in units} == {1}
    assert ts.store_texts(documents(odd_rows).limit(0)).count() == 0


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(0)
    kind = np.arange(24) % 3
    counts = rng.poisson(np.where((kind[:, None] + 1) % 3 == kind[None, :], 40, 1)).astype(float)

    def likelihood(of):
        both = np.zeros((of.max() + 1,) * 2)
        np.add.at(both, (of[:, None], of[None, :]), counts)
        f = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
        return f(both) - f(both.sum(0)) - f(both.sum(1))

    perm = rng.permutation(24)
    counts = counts[np.ix_(perm, perm)]
    of = class_lm.exchange(counts, 24, 3, 20)
    assert likelihood(of) > likelihood(np.arange(24) % 3) and len({tuple(sorted(kind[perm][of == c])) for c in range(3)}) == 3
    assert all(len(set(kind[perm][of == c])) == 1 for c in range(3))


def test_base_scores(documents, odd_rows, prose):
    rows = [*odd_rows, *((i, prose(30, i % 17)) for i in range(50, 120))]
    docs = documents(rows).withColumn("word", F.lit(1))
    model, counts = class_lm.train(docs, lambda crc: crc % 7 != 2)
    got = sorted((tuple(r) for r in class_lm.score(docs, model, counts).collect()), key=lambda r: (str(r[0]), r[1], r[2]))
    token = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    c = collections.Counter()
    for i, t in rows:
        if zlib.crc32(("null" if i is None else str(i)).encode()) % 7 != 2:
            c.update(token(t))
    n, v = sum(c.values()), len(c)
    assert (model.total, model.distinct) == (n, v)
    want = sorted(((i, len(token(t)), sum(c[w] > 0 for w in token(t)), sum(math.log10((c[w] + 1) / (n + v + 1)) for w in token(t))) for i, t in rows), key=lambda r: (str(r[0]), r[1], r[2]))
    assert [r[:3] for r in got] == [r[:3] for r in want] and np.allclose([r[3] for r in got], [r[3] for r in want])
    assert all(r[4] < 0 for r in got)
    assert sum(r[4] for r in got) > sum(r[3] for r in got)


def test_probabilities_sum_to_one(documents, prose):
    docs = documents([(i, prose(40, i % 9)) for i in range(60)])
    model, counts = class_lm.train(docs, lambda crc: crc >= 0)
    assert np.allclose((10.0**model.transition).sum(1), 1)
    by_class = collections.defaultdict(float)
    for k, e, _ in model.words.values():
        by_class[k] += 10**e
    assert all(abs(x - 1) < 1e-9 for k, x in by_class.items() if k < class_lm.CLASSES)
    for k, x in by_class.items():
        if k >= class_lm.CLASSES:  # with the place of unseen words
            assert abs(x + 10 ** model.emission(k - class_lm.CLASSES, 0) - 1) < 1e-9


def test_shapes_in_columns(spark, odd_rows):
    words = [w for _, t in odd_rows for w in (t or "").encode().split()][:200] + [x.encode() for x in ("a.", "b!", "c,", "d;", "12", "é", "é.", "longer-word", "日本", "x)", "\x00", "end…", "a" * 30, "½")] + [class_lm.END]
    got = spark.createDataFrame([(w,) for w in words], "word binary").select(class_lm.shape_column(F.col("word"))).collect()
    assert [r[0] for r in got] == [class_lm.shape(w) for w in words]


def test_without_training_rows(documents):
    docs = documents([(1, "a b"), (2, None)])
    model, counts = class_lm.train(docs, lambda crc: crc < 0)
    assert model.total == 0 and all(math.isfinite(r["score"]) for r in class_lm.score(docs, model, counts).collect())


def test_words_beyond_the_clustered_take_a_learnt_class(documents, monkeypatch):
    monkeypatch.setattr(class_lm, "HEAD", 1500)  # some words are learnt in the join
    r = random.Random(5)
    kinds = [[f"{k}x{i:04d}" for i in range(900)] for k in "ab"]  # of one shape: only their neighbours tell them apart
    text = lambda: " ".join(r.choice(kinds[i % 2]) for i in range(200))
    model, counts = class_lm.train(documents([(i, text()) for i in range(300)]), lambda crc: crc >= 0)
    of = {bytes(x["word"]).decode(): x["class"] for x in counts.collect()}
    assert len(of) == 1801 and all(of[w] < class_lm.CLASSES for k in kinds for w in k)
    assert not {of[w] for w in kinds[0]} & {of[w] for w in kinds[1]}
    rare = [w for w in of if w.encode() not in model.words]
    assert len(rare) == 301
    words = [rare[0], rare[1], kinds[0][0], rare[2]]
    got = class_lm.score(documents([(1, " ".join(words))]), model, counts).first()
    n = {bytes(x["word"]).decode(): x["n"] for x in counts.collect()}
    path = [of[" end"], *(of[w] for w in words), of[" end"]]
    want = sum(model.transition[a, b] for a, b in zip(path, path[1:])) + sum(math.log10(n[w] / model.totals[of[w]]) for w in [*words, " end"])
    assert got["n_known"] == 5 and abs(got["score"] - want) < 1e-9


def test_transitions_count_the_classes_of_all_words(documents, monkeypatch):
    """Also of those that are learnt beyond the head: the counts of brute force."""
    monkeypatch.setattr(class_lm, "HEAD", 1100)
    r = random.Random(6)
    kinds = [[f"{k}x{i:04d}" for i in range(700)] for k in "ab"]
    rows = [(i, " ".join([*(r.choice(kinds[j % 2]) for j in range(100)), f"once{i}"])) for i in range(200)]
    model, counts = class_lm.train(documents(rows), lambda crc: crc >= 0)
    of = {bytes(x["word"]).decode(): x["class"] for x in counts.collect()}
    assert sum(c < class_lm.CLASSES and w.encode() not in model.words for w, c in of.items()) > 200
    brute = np.zeros((class_lm.WIDTH, class_lm.WIDTH))
    for _, text in rows:
        path = [of[w] for w in [" end", *text.split(), " end"]]
        for a, b in zip(path, path[1:]):
            brute[a, b] += 1
    got = model.transition.copy()
    model.learn_transitions(brute)
    assert np.allclose(got, model.transition, atol=1e-12)


@pytest.mark.parametrize("flush", [3, 400_000])
def test_class_pairs_against_brute_force(spark, documents, prose, monkeypatch, flush):
    """Words of the head, of the tail and neither, next to each other in all ways, in one piece or many."""
    monkeypatch.setattr(class_lm, "FLUSH_WORDS", flush)
    texts = [prose(60, i % 25) for i in range(50)] + ["", "word"]
    words = sorted({w for t in texts for w in class_lm.tokens(t.encode())})
    head, tail = {w: i % class_lm.WIDTH for i, w in enumerate(words[::3])}, {w: i % class_lm.CLASSES for i, w in enumerate(words[1::3])}
    want = {}
    of = lambda w: head.get(w, tail.get(w, class_lm.CLASSES + class_lm.shape(w)))
    for t in texts:
        path = [class_lm.END, *class_lm.tokens(t.encode())]
        for a, b in zip(path, path[1:], strict=False):
            want[of(a) * class_lm.WIDTH + of(b)] = want.get(of(a) * class_lm.WIDTH + of(b), 0) + 1
    data = documents(list(enumerate(texts))).select(F.col("text").cast("binary").alias("data"))
    known = spark.createDataFrame(list(tail.items()), "word binary, class int")
    got = class_lm.class_pairs(data, spark.sparkContext.broadcast(head), known).collect()
    assert {r["pair"]: r["n"] for r in got} == want and len(got) == len(want)


def test_training_leaves_only_what_scoring_reads(spark, documents, prose, monkeypatch):
    kept, saved = {}, class_lm.saved
    monkeypatch.setattr(class_lm, "saved", lambda df, name: kept.setdefault(name, saved(df, name)))
    docs = documents([(i, prose(40, i)) for i in range(60)])
    model, classes = class_lm.train(docs, lambda crc: crc >= 0)
    there = {name for name, df in kept.items() if any(os.path.exists(x.removeprefix("file://")) for x in df.inputFiles())}
    assert there == {"word-classes"} and class_lm.score(docs, model, classes).count() == 60
