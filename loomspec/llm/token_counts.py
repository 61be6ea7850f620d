"""Token counts through a digest cache.

Texts are normalised, digested together with the tokenizer's version, and looked up in a stored table of counts; only
distinct texts that the table lacks are encoded, and their counts are appended. Null texts count as empty. Repeated rows
keep a row each; a null id stays null. An empty table gives an empty result. Other columns of the input are not read.

Where there are stored counts, digests alone meet them first, and only texts that they lack are fetched: a run that finds all
of them moves no text. Texts whose digests agree share one encoding, so a hot group of copies costs one encoding: the
aggregation by digest combines copies in the map tasks, before anything is shuffled. The counts of very frequent texts are
broadcast on their way back. A very long text is one row and is encoded whole, in blocks.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspec.llm.common import ID, TEXT, id_text, saved, spread_join

#: Digests of new texts that are broadcast, 32 bytes each; more of them meet the texts in a shuffle.
MOST_SENT = 500_000
#: Entries of each of a worker's two tables of counts, and characters of text that are split at a time.
TABLE_ENTRIES = 800_000
BLOCK_CHARS = 200_000

#: Fixed value: how the word tokenizer's file splits normalised text.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters outside those on which the library's normaliser and splitter and Python's agree: plain white space and
#: printable Latin-1 but its soft hyphen, superscripts and fractions.
ODD = "[^\t\n\r\x20-\x7e\xa1-\xac\xae-\xb1\xb4-\xb8\xba\xbb\xbf-\xff]"


def tokenizer_version(path: str) -> str:
    """The digest of the tokenizer's file: a changed file never meets another's counts."""
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()[:16]


def drops_white_space(path: str) -> bool:
    """Whether runs of white space can be collapsed without changing a count: the file's normaliser does it and its words hold none."""
    if not path.endswith(".json"):
        return False
    spec = json.loads(Path(path).read_text())
    return any(x.get("pattern") == {"Regex": "\\s+"} and x.get("content") == " " for x in (spec.get("normalizer") or {}).get("normalizers", [])) and splits_words(spec) and all(not set(x["content"]) & set(" \t\n\r") for x in spec["added_tokens"])


def splits_words(spec: dict) -> bool:
    first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    return first.get("pattern") == {"Regex": WORDS} and first.get("behavior") == "Removed"


def normalised(text: Column, collapse: bool) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " ")) if collapse else text


class Counter:
    """Counts of texts as the library gives them.

    Where the file splits text into words that are encoded apart from each other, each distinct word is encoded once
    for a table, and so is each distinct run without white space, out of its words.
    Texts with added tokens, or with characters in ODD, go to the library whole.
    """

    def __init__(self, path: str):
        self.words = None
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.whole = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            return
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        spec = json.loads(Path(path).read_text())
        model = Tokenizer.from_file(path)
        model.no_truncation()
        model.no_padding()
        self.whole = lambda texts: [len(x.ids) for x in model.encode_batch_fast(texts, add_special_tokens=False)]
        if splits_words(spec):
            self.words = regex.compile(WORDS).findall
        self.added = [x["content"] for x in spec["added_tokens"]]
        self.odd = re.compile(ODD).search
        self.chunk_counts: dict[str, int] = {}
        self.word_counts: dict[str, int] = {}

    def _count_chunks(self, chunks: set[str]) -> None:
        """Put the counts of white-space separated chunks into the table; words never cross white space."""
        cut = {x: self.words(x) for x in chunks}
        new = {y for x in cut.values() for y in x}
        if len(self.word_counts) + len(new) > TABLE_ENTRIES:
            self.word_counts.clear()
        if new := list(new.difference(self.word_counts)):
            self.word_counts.update(zip(new, self.whole(new), strict=True))
        get = self.word_counts.__getitem__
        self.chunk_counts.update((x, sum(map(get, words))) for x, words in cut.items())

    def _count_apart(self, texts: list[str]) -> list[int]:
        cut = [x.lower().split() for x in texts]
        new = {x for chunks in cut for x in chunks}
        if len(self.chunk_counts) + len(new) > TABLE_ENTRIES:
            self.chunk_counts.clear()
        self._count_chunks(new.difference(self.chunk_counts))
        get = self.chunk_counts.__getitem__
        return [sum(map(get, chunks)) for chunks in cut]

    def __call__(self, texts: list[str]) -> list[int]:
        if self.words is None:
            return self.whole(texts)
        out, block, size = [0] * len(texts), [], 0
        whole = [i for i, x in enumerate(texts) if any(y in x for y in self.added) or self.odd(x)]
        for i, n in zip(whole, self.whole([texts[i] for i in whole]), strict=True):
            out[i] = n
        apart = sorted(set(range(len(texts))).difference(whole))
        for k, i in enumerate(apart):
            block.append(i)
            size += len(texts[i])
            if size >= BLOCK_CHARS or k == len(apart) - 1:
                for j, n in zip(block, self._count_apart([texts[j] for j in block]), strict=True):
                    out[j] = n
                block, size = [], 0
        return out


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One for each Python worker, which serves many tasks."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def encode_misses(misses: DataFrame, path: str) -> DataFrame:
    """(digest, n_tokens, copies): the count of each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        gc.disable()  # many small lists live for one block; nothing here makes cycles
        for batch in batches:
            got = count(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(got, pa.int64()), batch.column("copies")], names=["digest", "n_tokens", "copies"])

    return misses.select("digest", "text", "copies").mapInArrow(run, "digest binary, n_tokens bigint, copies bigint")


def read_cache(spark, cache_path: str, version: str) -> DataFrame | None:
    """The stored counts of one tokenizer version; None where there are none yet. Runs that overlapped may both have stored a digest."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{cache_path}/version={version}")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    stored = spark.read.schema("digest binary, n_tokens bigint, copies bigint").parquet(f"{cache_path}/version={version}")
    return stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"), F.max("copies").alias("copies"))


def _lacking(keyed: DataFrame, cache: DataFrame) -> DataFrame | None:
    """The rows of keyed whose digests the cache lacks, found before any text moves; None where it has all."""
    new = saved(keyed.select("digest").distinct().join(cache.select("digest"), "digest", "left_anti"), "new-digests")
    count = new.count()
    if not count:
        return None
    return keyed.join(F.broadcast(new) if count <= MOST_SENT else new, "digest", "left_semi")


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, n_bytes (UTF-8 bytes of the text as given) and n_tokens."""
    spark = docs.sparkSession
    version, collapse = tokenizer_version(tokenizer_path), drops_white_space(tokenizer_path)
    keyed = id_text(docs, id_col, text_col).withColumns({"n_bytes": F.octet_length(TEXT).cast("bigint"), "text": normalised(F.col(TEXT), collapse)})
    keyed = keyed.withColumn("digest", F.unhex(F.sha2("text", 256)))
    cache = read_cache(spark, cache_path, version)
    new = keyed if cache is None else _lacking(keyed, cache)
    if new is not None:
        misses = new.groupBy("digest").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
        encode_misses(misses, tokenizer_path).write.mode("append").parquet(f"{cache_path}/version={version}")
    rows = keyed.select(F.col(ID).alias(id_col), "n_bytes", "digest")
    return spread_join(rows, read_cache(spark, cache_path, version), ["digest"], "n_tokens", "copies", F.xxhash64(id_col)).drop("digest")
