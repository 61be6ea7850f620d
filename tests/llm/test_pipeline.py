"""Each stage of the pipeline against a plain computation on the stage's own input."""

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from loomspec.llm import toxicity
from loomspec.llm.common import saved, table


def test_stages(spark, small):
    docs = table(spark, small, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line dedup", "near dedup", "decontamination", "encoding"]
    for name, stage in corpus_pipeline.STAGES:
        after = saved(stage(spark, docs, small), "test")
        before, now = {r["doc_id"]: r for r in docs.collect()}, {r["doc_id"]: r for r in after.collect()}
        assert set(now) <= set(before)
        if name != "encoding":
            assert after.columns == docs.columns
        if name == "toxicity":
            model = toxicity.train(docs, table(spark, small, "labels"), lambda crc: crc % 3 != 1)
            bad = {r["doc_id"] for r in toxicity.score(docs, model).where("score >= 0.7").collect()}
            assert set(before) - set(now) == bad
        elif name == "line dedup":
            assert set(now) == set(before)
            norm = lambda x: " ".join(x.lower().split())
            sites: dict = {}
            for r in before.values():
                for x in r["text"].split("\n"):
                    sites.setdefault(norm(x), set()).add(r["source"])
            for i, r in before.items():
                assert now[i]["text"] == "\n".join(x for x in r["text"].split("\n") if not norm(x) or len(sites[norm(x)]) < 10)
                assert now[i]["n_chars"] == len(now[i]["text"])
        elif name == "near dedup":
            from test_near import brute

            found = brute([(i, r["text"]) for i, r in before.items()], 5, 80)
            assert set(now) == {i for i, (_, c) in found.items() if c == i}
        elif name == "decontamination":
            import re

            words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
            grams = set()
            for r in table(spark, small, "benchmark").collect():
                w = words(r["text"])
                grams |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
            sizes = {len(g) for g in grams}
            hit = {i for i, r in before.items() for n in sizes for w in [words(r["text"])] if any(tuple(w[k : k + n]) in grams for k in range(len(w) - n + 1))}
            assert set(before) - set(now) == hit
        else:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
            for i, r in before.items():
                assert now[i]["ids"] == model.encode(r["text"], add_bos=True, add_eos=True) and now[i]["decoded"] == model.decode(now[i]["ids"])
        docs = after
    assert set(now) == {r["doc_id"] for r in corpus_pipeline.run(spark, small).collect()}


def test_empty_input(spark, small):
    docs = table(spark, small, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, small), "test")
        assert docs.count() == 0


def test_nulls(spark, small):
    docs = table(spark, small, "documents").limit(20).withColumns({"text": F.when(F.col("doc_id") % 3 > 0, F.col("text")), "source": F.lit(None).cast("string"), "n_chars": F.lit(None).cast("bigint")})
    for _, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, small), "test")
    assert docs.count() > 0


def test_clashing_and_missing_columns(spark, small):
    docs = table(spark, small, "documents").limit(30).drop("n_chars", "lang").withColumns({c: F.lit("kept") for c in ("__toxicity", "__gone", "__lines_row", "score", "key", "hit", "whole", "component_id")})
    for name, stage in corpus_pipeline.STAGES:
        after = saved(stage(spark, docs, small), "test")
        if name != "encoding":
            assert after.columns == docs.columns and {r["__gone"] for r in after.collect()} <= {"kept"}
        docs = after
