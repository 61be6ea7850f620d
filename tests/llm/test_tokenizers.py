import hashlib
import struct

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loomspec.llm import sentence_pieces, token_counts
from loomspec.llm.common import pieces, scratch_path

WORDS, PIECES = str(public_tokenizers.path("word_bpe_49k.json")), str(public_tokenizers.path("piece_bpe_32k.model"))


def by_library(text, path):
    if path.endswith(".model"):
        import sentencepiece

        return len(sentencepiece.SentencePieceProcessor(model_file=path).encode(text or ""))
    from tokenizers import Tokenizer

    return len(Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids)


@pytest.mark.parametrize("path", [WORDS, PIECES, str(public_tokenizers.path("byte_bpe_50k.json"))])
def test_counts_equal_the_library(spark, documents, odd_rows, path):
    got = token_counts.count_tokens(documents(odd_rows).withColumn("digest", F.lit("x")).withColumn("n_tokens", F.lit(-1)), path, scratch_path(spark, "cache"))
    assert got.columns == ["doc_id", "n_bytes", "n_tokens"]
    wanted = sorted(((i, len((t or "").encode()), by_library(t, path)) for i, t in odd_rows), key=repr)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == wanted


def test_cache_encodes_only_misses(spark, documents, monkeypatch):
    cache, seen = scratch_path(spark, "cache"), []
    real = token_counts.encode_misses
    monkeypatch.setattr(token_counts, "encode_misses", lambda m, p: (seen.append(m.count()), real(m, p))[1])
    token_counts.count_tokens(documents([(1, "a b"), (2, "a  b "), (3, "c")]), WORDS, cache).collect()
    again = token_counts.count_tokens(documents([(4, "a b"), (5, "d e f"), (6, "c")]), WORDS, cache)
    assert seen == [2, 1] and sorted(r["n_tokens"] for r in again.collect()) == [1, 2, 3]


def test_empty_table(spark, documents):
    empty = documents([(1, "x")]).limit(0)
    assert token_counts.count_tokens(empty, WORDS, scratch_path(spark, "cache")).count() == 0
    assert sentence_pieces.encode_texts(empty, PIECES).count() == 0


def test_pieces_equal_the_library(documents, odd_rows):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = sentence_pieces.encode_texts(documents(odd_rows), PIECES).collect()
    found = sorted(((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in got), key=repr)
    ids = [(i, model.encode(t or "", add_bos=True, add_eos=True)) for i, t in odd_rows]
    assert found == sorted(((i, tuple(x), model.decode(x)) for i, x in ids), key=repr)
    digests = sentence_pieces.encode_texts(documents(odd_rows), PIECES, digests_only=True).collect()
    wanted = sorted(((i, len(x), hashlib.sha256(struct.pack(f"<{len(x)}I", *x)).hexdigest(), hashlib.sha256(model.decode(x).encode()).hexdigest()) for i, x in ids), key=repr)
    assert sorted((tuple(r) for r in digests), key=repr) == wanted


def test_decoding_a_column(spark, documents):
    encoded = sentence_pieces.encode_texts(documents([(1, "round trip")]), PIECES).drop("decoded")
    assert sentence_pieces.decode_ids(encoded, PIECES).first()["decoded"] == "round trip"


def test_random_texts():
    import random

    import sentencepiece

    r, codec = random.Random(2), sentence_pieces.codec(PIECES)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert codec.chunked
    texts = ["".join(r.choice(["a", "the", " ", "  ", "\n", "▁", "é", "日", "'s", "\x00"]) for _ in range(r.randint(0, 12))) for _ in range(2000)]
    assert [x.tolist() for x in codec.encode(texts)] == model.encode(texts, add_bos=True, add_eos=True)


def test_second_run_encodes_what_is_new(spark, documents, monkeypatch):
    cache, rows = scratch_path(spark, "cache"), [(i, f"text number {i % 7}") for i in range(40)]
    first = sorted(tuple(r) for r in token_counts.count_tokens(documents(rows), WORDS, cache).collect())
    seen, encode = [], token_counts.encode_misses

    def watched(misses, path):
        seen.append(misses.count())
        return encode(misses, path)

    monkeypatch.setattr(token_counts, "encode_misses", watched)
    assert sorted(tuple(r) for r in token_counts.count_tokens(documents(rows), WORDS, cache).collect()) == first and not seen
    for sent in (token_counts.MOST_SENT, 0):
        monkeypatch.setattr(token_counts, "MOST_SENT", sent)
        more = token_counts.count_tokens(documents([*rows, (99, f"something new {sent}")]), WORDS, cache).collect()
        assert seen.pop() == 1 and not seen and len(more) == 41


def test_workers_keep_no_table_and_encode_in_pieces(spark, documents):
    """A worker outlives its task: what it still holds would count beside the next stage's."""

    def held(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([sum(len(c.table) for c in sentence_pieces._CODECS.values())], pa.int64())})

    docs = documents([(i, f"text number {i}") for i in range(1300)], parts=1)
    got = sentence_pieces.encode_texts(docs, PIECES).collect()
    assert len(got) == 1300 and {r["doc_id"]: r["decoded"] for r in got} == {i: f"text number {i}" for i in range(1300)}
    assert {r["n"] for r in spark.range(0, 8, 1, 8).mapInArrow(held, "n bigint").collect()} == {0}


def test_pieces_hold_every_row():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"x": list(range(a, b))}) for a, b in ((0, 20), (20, 20), (20, 27))]
    parts = [x.column(0).to_pylist() for x in pieces(iter(batches), 7)]
    assert [len(x) for x in parts] == [7, 7, 6, 7] and sum(parts, []) == list(range(27))
