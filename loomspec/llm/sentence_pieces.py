"""SentencePiece encoding and decoding through tables of distinct chunks.

Where no piece of the model holds a white-space marker after another character, merges never cross the start of a run of
markers. A text is then cut into marked words; each worker keeps a table of distinct marked words, segments a word once
when it first meets it, and joins the ids back by position. The table is bounded, emptied when full and at the end of a task,
for a worker outlives its tasks; results do not depend on it. Nothing is shuffled, so no hot word or hot document lands in one task.

Null texts count as empty; empty texts have the begin and end ids alone. A very long text is one row, encoded whole. Repeated rows keep a row each, null ids stay
null, other columns are not read, and an empty table gives an empty result.
"""

from __future__ import annotations

import gc
import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspec.llm.common import ID, TEXT, id_text, lean, pieces, ship

MARK = "▁"
#: Entries of a worker's table, and characters of text that are cut into chunks at a time.
TABLE_ENTRIES = 700_000
BLOCK_CHARS = 200_000
RUNS = re.compile(f"{MARK}+[^{MARK}]*")


class ChunkCodec:
    """Encodes and decodes with one model; `chunked` tells whether the table of distinct chunks can serve it."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.alone = model.piece_to_id(MARK)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        probes = ["a", " a", "  a  b ", "\ta\u3000b", "\ufb01 A\u030a \u212b"]
        self.chunked = all(re.fullmatch(f"{MARK}*[^{MARK}]*", p) for p in pieces) and model.encode("a ") == [*model.encode("a"), self.alone] and all(model.normalize(x) == MARK + x.replace(" ", MARK) for x in probes)
        self.table: dict[str, bytes] = {}
        self.ends = array("I", [model.bos_id()]).tobytes(), array("I", [model.eos_id()]).tobytes()

    def _chunks(self, text: str) -> list[str]:
        if "  " in text or MARK in text or text[:1] == " " or text[-1:] == " ":
            return RUNS.findall(MARK + text.replace(" ", MARK))
        return [MARK + x for x in text.split(" ")] if text else []

    def _segment(self, chunks: set[str]) -> None:
        """Put chunks into the table. encode() itself adds the first marker, but not to an empty text."""
        ids = self.model.encode([x[1:].replace(MARK, " ") for x in chunks], num_threads=1)
        self.table.update(zip(chunks, [array("I", x or [self.alone]).tobytes() for x in ids], strict=True))

    def encode(self, texts: list[str]) -> Iterator[array]:
        """All ids of each text, begin and end included."""
        if not self.chunked:
            yield from (array("I", x) for x in self.model.encode(texts, add_bos=True, add_eos=True, num_threads=1))
            return
        first = 0
        while first < len(texts):
            last, size = first, 0
            while last < len(texts) and size < BLOCK_CHARS:
                size += len(texts[last])
                last += 1
            cut = [self._chunks(x) for x in texts[first:last]]
            new = {x for chunks in cut for x in chunks}
            if len(self.table) + len(new) > TABLE_ENTRIES:
                self.table.clear()
            self._segment(new.difference(self.table))
            get = self.table.__getitem__
            for chunks in cut:
                yield array("I", self.ends[0] + b"".join(map(get, chunks)) + self.ends[1])
            first = last

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids)


_CODECS: dict[str, ChunkCodec] = {}


def codec(path: str) -> ChunkCodec:
    if path not in _CODECS:
        _CODECS[path] = ChunkCodec(path)
    return _CODECS[path]


def encode_texts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", digests_only: bool = False) -> DataFrame:
    """One row per input row: id_col, ids (array of int) and decoded text, or, with digests_only, n_tokens, ids_sha256 and decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = codec(model_path)
        gc.disable()  # many small lists live for one block; nothing here makes cycles
        try:
            for batch in pieces(batches):
                all_ids = list(to.encode(batch.column(TEXT).to_pylist()))
                decoded = [to.decode(x.tolist()) for x in all_ids]
                if digests_only:
                    columns = [pa.array([len(x) for x in all_ids], pa.int64()), pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in all_ids]), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded])]
                    yield pa.RecordBatch.from_arrays([batch.column(ID), *columns], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    cuts = np.cumsum([0, *map(len, all_ids)], dtype=np.int32)
                    ids = pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(all_ids).astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([batch.column(ID), ids, pa.array(decoded, pa.string())], names=[id_col, "ids", "decoded"])
        finally:
            to.table.clear()  # the model stays with the worker, the table does not
            gc.enable()

    rest = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digests_only else "ids array<int>, decoded string"
    return id_text(docs, id_col, text_col).mapInArrow(lean(run), f"`{id_col}` bigint, {rest}")


def decode_ids(encoded: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds the text that an array of ids decodes to; null arrays decode to null."""

    ship(encoded.sparkSession)

    def back(ids):
        model = codec(model_path).model
        return ids.map(lambda x: None if x is None else model.decode([int(i) for i in x]))

    return encoded.withColumn(out_col, F.pandas_udf(back, "string")(F.col(ids_col)))
