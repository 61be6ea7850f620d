"""Class-based n-gram scores: exchange clustering assigns words to classes; transitions between classes and emissions of words
give a smoothed log-probability for each text.

Counts come from all training texts: a table of every word's count and class, as long as the vocabulary, and the counts of
adjacent classes. Exchange clustering moves each of the `CLUSTERED` most frequent tokens (the end token among them) to the
class that raises the likelihood of the adjacent-unit counts most, until a sweep gains less than `SETTLED` a token. Every
other word that occurs `LEARNT` times or more then joins the class whose neighbours are likest its own, from the counts of the classes next to it, which are
summed by word across the cluster. Rarer words, and words that were never seen, belong to a class by their shape. Then log
P(word | previous) = log P(class | class of the previous) + log P(word | class): transitions are interpolated with the
classes' own frequencies, and counted with the classes of all words; emissions are additively
smoothed in the shape classes, where unseen words share one more place.

Scoring reads each text once. The `HEAD` most frequent words and their classes go to the workers (a fixed bound); all other
words meet the table of counts and classes in a join by word, position by position, and their texts in one by row.

A null text counts as empty and has its end token alone; a very long text is one row, its tokens held by one task. An empty
table gives an empty result. Repeated rows keep a row each; null ids stay null and count as the text 'null' for the choice of
training rows. Without training tokens every probability is the smoothing's own. Other columns
are not read.
"""

from __future__ import annotations

import sys
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspec.llm.common import ID, ROW, TEXT, bounded_memo, crc_of_id, drop_saved, id_text, saved

CLUSTERED, CLASSES, LEARNT = 1000, 48, 5
#: The log likelihood for each token below which a sweep's gain ends the exchange.
SETTLED = 1e-4
HEAD = 1 << 17
#: Bits of the filters of words that are learnt, and of a part of it (fixed by the function that makes it).
LEARNT_BITS, PART_BITS = 1 << 24, 32768
#: Additive smoothing within a shape class; weight of a class' own frequency in a transition.
ADD, BACK_OFF = 0.5, 20.0
MEMO_ENTRIES = 400_000
FLUSH_WORDS = 400_000
#: The end token contains a space, as no word does.
END = b" end"
SHAPES = 64
WIDTH, UNITS = CLASSES + SHAPES, CLUSTERED + SHAPES
PAIRS = WIDTH * WIDTH
#: Places of a pair whose class is not known yet.
NONE, ONE, BOTH = range(3)


def shape(word: bytes) -> int:
    """0 to SHAPES - 1: by length, digits, bytes outside ASCII, and the mark at the end."""
    last = word[-1]
    mark = 0 if last >= 128 or chr(last).isalnum() else 1 if last in b".!?" else 2 if last in b",;:" else 3
    digits, wide = len(word.translate(None, b"0123456789")) < len(word), not word.isascii()
    return mark * 16 + digits * 8 + wide * 4 + min(3, len(word) // 5)


def shape_column(word: Column) -> Column:
    """The same of a column of words."""
    text = word.cast("string")
    mark = F.when(text.rlike(r"[0-9A-Za-z\x{80}-\x{10FFFF}]\z"), 0).when(text.rlike(r"[.!?]\z"), 1).when(text.rlike(r"[,;:]\z"), 2).otherwise(3)
    return mark * 16 + text.rlike("[0-9]").cast("int") * 8 + text.rlike(r"[\x{80}-\x{10FFFF}]").cast("int") * 4 + F.least(F.lit(3), F.floor(F.octet_length(word) / 5)).cast("int")


def tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def word_counts(texts: DataFrame) -> DataFrame:
    """(word binary, n): how often each token is in the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(counts: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column("data").to_pylist():
                counts.update(tokens(text))
                if len(counts) > FLUSH_WORDS:
                    yield rows(counts)
                    counts = Counter()
        yield rows(counts)

    return texts.select("data").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def exchange(counts: np.ndarray, movable: int, classes: int, sweeps: int) -> np.ndarray:
    """The class of each unit. The first `movable` units move among `classes` classes; every other unit is a class of its own.

    Maximises sum f(N(c, d)) - sum f(N(c, .)) - sum f(N(., d)) with f(x) = x log x, over the counts of adjacent classes.
    """
    n = len(counts)
    of = np.concatenate([np.arange(movable) % classes, classes + np.arange(n - movable)])
    width = classes + n - movable

    def f(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1e-300))

    left, right = np.zeros((width, n)), np.zeros((n, width))  # class before unit, unit before class
    np.add.at(left, of, counts)
    np.add.at(right.T, of, counts.T)
    both = np.zeros((width, width))
    np.add.at(both, of, right)
    least = 1e-9 + 1e-13 * f(counts.sum())  # a gain below the sums' precision is none
    last = -np.inf
    for _ in range(sweeps):
        moved = 0
        for w in range(movable):
            a, self_count = of[w], counts[w, w]
            out_w, in_w = right[w].copy(), left[:, w].copy()  # after w by class, before w by class
            out_w[a] -= self_count
            in_w[a] -= self_count
            both[a] -= out_w
            both[:, a] -= in_w
            both[a, a] -= self_count
            rows, cols = both.sum(1), both.sum(0)
            own, at = both[:classes], np.arange(classes)
            gain = (f(own + out_w) - f(own)).sum(1) + (f(both[:, :classes] + in_w[:, None]) - f(both[:, :classes])).sum(0)
            corner = both[at, at]
            gain -= f(corner + out_w[:classes]) + f(corner + in_w[:classes]) - 2 * f(corner)
            gain += f(corner + out_w[:classes] + in_w[:classes] + self_count) - f(corner)
            total_out, total_in = out_w.sum() + self_count, in_w.sum() + self_count
            gain -= f(rows[:classes] + total_out) - f(rows[:classes]) + f(cols[:classes] + total_in) - f(cols[:classes])
            b = int(np.argmax(gain)) if gain.max() > gain[a] + least else a if a < classes else int(np.argmax(gain))
            both[b] += out_w
            both[:, b] += in_w
            both[b, b] += self_count
            if b != a:
                of[w] = b
                left[a] -= counts[w]
                left[b] += counts[w]
                right[:, a] -= counts[:, w]
                right[:, b] += counts[:, w]
                moved += 1
        likelihood = f(both).sum() - f(both.sum(0)).sum() - f(both.sum(1)).sum()
        if not moved or likelihood - last < SETTLED * counts.sum():
            break
        last = likelihood
    return of


class ClassModel:
    """Tables for the workers; see the module's docstring."""

    def __init__(self, total: int, distinct: int, totals: np.ndarray, types: np.ndarray):
        """totals and types: tokens and distinct words of each class."""
        self.total, self.distinct, self.totals = total, distinct, totals
        self.shape_totals, self.shape_types = totals[CLASSES:], types[CLASSES:]
        self.words: dict[bytes, tuple[int, float, int]] = {}
        self.end, self.transition = CLASSES, np.zeros((WIDTH, WIDTH))

    def learn_words(self, head: list[tuple[bytes, int, int]]) -> None:
        """(word, count, class) of the head."""
        for word, n, c in head:
            self.words[word] = c, float(np.log10(n / self.totals[c])) if c < CLASSES else self.emission(c - CLASSES, n), n
        self.end = self.words[END][0] if END in self.words else CLASSES

    def learn_transitions(self, counts: np.ndarray) -> None:
        own = (counts.sum(0) + 1) / (counts.sum() + WIDTH)
        self.transition = np.log10((counts + BACK_OFF * own) / (counts.sum(1, keepdims=True) + BACK_OFF))

    def emission(self, s: int, n: int) -> float:
        return float(np.log10((n + ADD) / (self.shape_totals[s] + ADD * (self.shape_types[s] + 1))))


def word_bits(words: DataFrame) -> np.ndarray:
    """LEARNT_BITS bits: those that the given words hash to. A word without its bit need not be looked at."""
    number = (F.crc32("word") % LEARNT_BITS + 1).alias("bit")  # parts and their bits are counted from 1
    parts = words.select(number).groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    out = np.zeros(LEARNT_BITS, bool)
    for part, bits in parts.collect():  # LEARNT_BITS / PART_BITS rows of 4 KB at most
        out[(part - 1) * PART_BITS :][:PART_BITS] = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")
    return np.packbits(out)


def neighbours(texts: DataFrame, shared, bits) -> DataFrame:
    """(word, at, n): how often units, the clustered tokens and the shapes of others, are next to a word that may be learnt: before it,
    and from UNITS on after it. Rows without a word have the pairs of units, as a * UNITS + b, and how often a comes before b.
    A text's first token follows the end token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, learnt = shared.value, np.unpackbits(bits.value)
        local: dict[bytes, int] = defaultdict(count().__next__)
        held: list[np.ndarray] = []
        sums, size, end = np.zeros(UNITS * UNITS, np.int64), 0, place.get(END, CLUSTERED + shape(END))

        def lists(words: pa.Array, cuts: np.ndarray, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            cuts = pa.array(cuts.astype(np.int32))
            return pa.RecordBatch.from_arrays([words, pa.ListArray.from_arrays(cuts, pa.array(at.astype(np.int32))), pa.ListArray.from_arrays(cuts, pa.array(n.astype(np.int64)))], names=["word", "at", "n"])

        def rows() -> pa.RecordBatch:
            ids, words = np.concatenate(held), list(local)
            kind = np.array([place[w] if w in place else CLUSTERED + shape(w) for w in words])
            seen = np.array([w not in place and bool(learnt[zlib.crc32(w) % LEARNT_BITS]) for w in words])
            c = kind[ids]
            before = np.concatenate([[end], c[:-1]])  # every text ends with the end token
            np.add(sums, np.bincount(before * UNITS + c, minlength=len(sums)), out=sums)
            here, then = np.flatnonzero(seen[ids]), np.flatnonzero(seen[ids[:-1]])
            keys = np.concatenate([ids[here] * 2 * UNITS + before[here], ids[then] * 2 * UNITS + UNITS + c[then + 1]])
            found, n = np.unique(keys, return_counts=True)
            word = found // (2 * UNITS)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
            return lists(pa.array([words[k] for k in word[first].tolist()], pa.binary()), np.concatenate([first, [len(word)]]), found % (2 * UNITS), n)

        for batch in batches:
            for text in batch.column("data").to_pylist():
                words = tokens(text)
                held.append(np.fromiter(map(local.__getitem__, words), np.int64, len(words)))
                size += len(words)
                if size > 10 * FLUSH_WORDS:
                    yield rows()
                    local = defaultdict(count().__next__)
                    held.clear()
                    size = 0
        if held:
            yield rows()
        used = np.flatnonzero(sums)
        yield lists(pa.nulls(1, pa.binary()), np.array([0, len(used)]), used, sums[used])

    return texts.select("data").mapInArrow(run, "word binary, at array<int>, n array<bigint>")


def assigned(counts: DataFrame, near: DataFrame, of: np.ndarray, pairs: np.ndarray, unit_class: np.ndarray, shared, least_clustered: int) -> DataFrame:
    """(word, n, class) of all words. A class of the exchange is as likely as its members' neighbours make a word's own."""
    both = np.zeros((WIDTH, WIDTH))
    np.add.at(both, (of[:, None], of[None, :]), pairs)
    into, out = both[:, :CLASSES], both[:CLASSES]
    # log P(class before | class) and log P(class after | class), a row for each of the 2 * WIDTH places
    likely = np.log(np.concatenate([(into + 0.1) / (into.sum(0) + 0.1 * WIDTH), ((out + 0.1) / (out.sum(1, keepdims=True) + 0.1 * WIDTH)).T]))
    nobody = np.bincount(of, minlength=WIDTH)[:CLASSES] == 0
    class_of = np.concatenate([unit_class, WIDTH + unit_class])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shared.value
        for batch in batches:
            n, at = batch.column("n").to_numpy(), batch.column("at")
            size = pc.fill_null(pc.list_value_length(at), 0).to_numpy()
            found = np.full(batch.num_rows, -1)
            known = np.flatnonzero(size)
            if len(known):
                where, m = at.flatten().to_numpy(), batch.column("times").flatten().to_numpy()
                ends = np.cumsum(size[known])
                for first in range(0, len(known), 2000):  # so many words at a time, to bound the memory
                    last = min(first + 2000, len(known))
                    low, high = ends[first] - size[known[first]], ends[last - 1]
                    own = np.repeat(np.arange(last - first), size[known[first:last]]) * 2 * WIDTH + class_of[where[low:high]]
                    scores = np.bincount(own, m[low:high], (last - first) * 2 * WIDTH).reshape(-1, 2 * WIDTH) @ likely
                    scores[:, nobody] = -np.inf
                    found[known[first:last]] = np.argmax(scores, 1)
            found[n < LEARNT] = -1
            words = batch.column("word").to_pylist()
            for i in np.flatnonzero(found < 0).tolist():
                found[i] = CLASSES + shape(words[i])
            for i in np.flatnonzero(n >= least_clustered).tolist():
                found[i] = place.get(words[i], found[i])
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(found, pa.int32())], names=["word", "n", "class"])

    by_word = near.groupBy("word").agg(F.flatten(F.collect_list("at")).alias("at"), F.flatten(F.collect_list("n")).alias("times"))
    least = min(LEARNT, least_clustered)  # where there are few words, rare ones are clustered
    often = counts.where(F.col("n") >= least).join(by_word, "word", "left").mapInArrow(run, "word binary, n bigint, class int")
    return often.unionByName(counts.where(F.col("n") < least).select("word", "n", (shape_column(F.col("word")) + CLASSES).alias("class")))


def class_pairs(texts: DataFrame, shared, tail: DataFrame | None) -> DataFrame:
    """(pair, n): how often class a comes before class b, as a * WIDTH + b. shared has the classes of the head, tail, (word, class),
    those of learnt words beyond it, which meet their places in joins; all other words count by their shape.

    A worker sums what it can: pairs of known classes, and for each word of the tail what classes are before it and, from WIDTH
    on, after it. Such sums travel as n * PAIRS + place. Pairs of two words of the tail meet the second one's class in a join of their own."""
    spark = texts.sparkSession
    bits = spark.sparkContext.broadcast(word_bits(tail) if tail is not None else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, open_words = shared.value, []
        may_be = None if bits.value is None else np.unpackbits(bits.value)
        memo, end = bounded_memo(MEMO_ENTRIES), of.get(END, CLASSES + shape(END))

        def make(word: bytes) -> int:
            """The class, or WIDTH and more for words that may be in the tail."""
            if word in of:
                return of[word]
            if may_be is None or not may_be[zlib.crc32(word) % LEARNT_BITS]:
                return CLASSES + shape(word)
            open_words.append(word)
            return WIDTH + len(open_words) - 1

        memo.make = make

        held: list[np.ndarray] = []
        sums, size = np.zeros(PAIRS, np.int64), 0

        def row(kind: int, words: pa.Array, others: pa.Array, cuts: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
            lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(codes, pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(words), kind), pa.int32()), words, others, lists], names=["kind", "word", "other", "codes"])

        def rows() -> Iterator[pa.RecordBatch]:
            ids = np.concatenate([[end], *held])  # every text ends with the end token
            a, b = ids[:-1], ids[1:]
            open_a, open_b = a >= WIDTH, b >= WIDTH
            known = ~(open_a | open_b)
            np.add(sums, np.bincount(a[known] * WIDTH + b[known], minlength=PAIRS), out=sums)
            if not open_words:
                return
            words = pa.array(open_words, pa.binary())
            after, before, both = open_a & ~open_b, open_b & ~open_a, open_a & open_b
            keys, n = np.unique(np.concatenate([(a[after] - WIDTH) * 2 * WIDTH + WIDTH + b[after], (b[before] - WIDTH) * 2 * WIDTH + a[before]]), return_counts=True)
            word = keys // (2 * WIDTH)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
            yield row(ONE, words.take(pa.array(word[first])), pa.nulls(len(first), pa.binary()), np.concatenate([first, [len(word)]]), n * PAIRS + keys % (2 * WIDTH))
            keys, n = np.unique((a[both] - WIDTH) * len(words) + b[both] - WIDTH, return_counts=True)
            yield row(BOTH, words.take(pa.array(keys // len(words))), words.take(pa.array(keys % len(words))), np.arange(len(keys) + 1), n * PAIRS)

        for batch in batches:
            for text in batch.column("data").to_pylist():
                words = tokens(text)
                held.append(np.fromiter(map(memo.__getitem__, words), np.int64, len(words)))
                size += len(words)
                if size > 10 * FLUSH_WORDS:
                    yield from rows()
                    held.clear()
                    size = 0
                    if len(open_words) > MEMO_ENTRIES:
                        memo.clear()
                        open_words.clear()
        if held:
            yield from rows()
        used = np.flatnonzero(sums)
        nowhere = b" %d" % TaskContext.get().partitionId()  # no word has a space
        yield row(NONE, pa.array([nowhere], pa.binary()), pa.nulls(1, pa.binary()), np.array([0, len(used)]), sums[used] * PAIRS + used)

    found = texts.select("data").mapInArrow(run, "kind int, word binary, other binary, codes array<bigint>")
    at, n = F.col("code") % PAIRS, F.expr(f"code div {PAIRS}")
    if tail is None:
        return found.select(F.explode("codes").alias("code")).groupBy(at.alias("pair")).agg(F.sum(n).alias("n"))
    tail = tail.select(F.col("word").alias("key"), F.col("class").alias("of"))
    class_of = lambda word: F.coalesce("of", shape_column(F.col(word)) + CLASSES).cast("bigint")
    once = found.join(tail, found["word"] == tail["key"], "left").select("kind", "other", F.when(F.col("kind") != NONE, class_of("word")).alias("c"), F.explode("codes").alias("code"))
    one = F.when(at < WIDTH, at * WIDTH + F.col("c")).otherwise(F.col("c") * WIDTH + at - WIDTH)
    pair = F.when(F.col("kind") == NONE, at).when(F.col("kind") == ONE, one).otherwise(F.col("c") * WIDTH)
    once = once.groupBy("other", pair.alias("pair")).agg(F.sum(n).alias("n"))
    # of two places that were open the second one is left; pairs that are complete go anywhere
    key = F.coalesce("other", F.encode(F.concat(F.lit(" "), F.col("pair").cast("string")), "UTF-8"))
    twice = once.withColumn("place", key).join(tail, F.col("place") == F.col("key"), "left")
    whole = F.col("pair") + F.when(F.col("other").isNotNull(), class_of("other")).otherwise(0)
    return twice.groupBy(whole.alias("pair")).agg(F.sum("n").alias("n"))


def train(docs: DataFrame, learn_from, id_col: str = "doc_id", text_col: str = "text") -> tuple[ClassModel, DataFrame]:
    """The model, and the table (word, n, class) of all training tokens; learn_from(crc) tells which rows are learnt from."""
    spark = docs.sparkSession
    send = spark.sparkContext.broadcast
    texts = id_text(docs, id_col, text_col).where(learn_from(crc_of_id(F.col(ID)))).select(F.monotonically_increasing_id().alias(ROW), ID, F.col(TEXT).cast("binary").alias("data"))
    counts = saved(word_counts(texts), "word-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    first = counts.orderBy(F.desc("n"), "word").limit(CLUSTERED).collect()
    top, least = [bytes(x["word"]) for x in first], min((x["n"] for x in first), default=0)
    near = saved(neighbours(texts, send({w: i for i, w in enumerate(top)}), send(word_bits(counts.where(F.col("n") >= LEARNT)))), "neighbours")
    each = near.where("word IS NULL").select(F.explode(F.arrays_zip("at", "n")).alias("x")).groupBy("x.at").agg(F.sum("x.n").alias("n"))
    found = each.toPandas()  # UNITS ** 2 rows at most
    pairs = np.zeros(UNITS * UNITS)
    pairs[found["at"].to_numpy(np.int64)] = found["n"].to_numpy(float)
    pairs = pairs.reshape(UNITS, UNITS)
    of = exchange(pairs, CLUSTERED, CLASSES, sys.maxsize)
    clustered = send({w: int(of[i]) for i, w in enumerate(top)})
    used = np.concatenate([of[: len(top)], of[CLUSTERED:]])
    kept = np.concatenate([np.arange(len(top)), np.arange(CLUSTERED, UNITS)])
    classes = saved(assigned(counts, near.where("word IS NOT NULL"), used, pairs[np.ix_(kept, kept)], of, clustered, least), "word-classes")
    for table in (near, counts):  # nothing reads them any more
        drop_saved(table)
    totals, types = np.zeros(WIDTH), np.zeros(WIDTH)
    for c, n, m in classes.groupBy("class").agg(F.sum("n"), F.count("*")).collect():  # WIDTH rows at most
        totals[c], types[c] = n, m
    model = ClassModel(total, distinct, totals, types)
    head = [(bytes(x["word"]), x["n"], x["class"]) for x in classes.orderBy(F.desc("n"), "word").limit(HEAD).toLocalIterator()]  # HEAD rows at most
    model.learn_words(head)
    tail = None
    if distinct > HEAD:
        word, n, _ = head[-1]
        tail = classes.where((F.col("class") < CLASSES) & ((F.col("n") < n) | (F.col("n") == n) & (F.col("word") > F.lit(word)))).select("word", "class")
    seen = class_pairs(texts, send({w: x[0] for w, x in model.words.items()}), tail).toPandas()  # WIDTH ** 2 rows at most
    sums = np.zeros(WIDTH * WIDTH)
    sums[seen["pair"].to_numpy(np.int64)] = seen["n"].to_numpy(float)
    model.learn_transitions(sums.reshape(WIDTH, WIDTH))
    return model, classes


_PART = "row bigint, id bigint, word binary, pos int, prev int, next int, s int, n_tokens bigint, n_known bigint, base double, score double"


def _parts(texts: DataFrame, model: ClassModel) -> DataFrame:
    """A row for each text, of what the head alone decides, and one for each place of a word that is not in the head; prev and
    next are the classes beside it, -1 where they are not in the head."""
    shared = texts.sparkSession.sparkContext.broadcast(model)
    types = [pa.int64(), pa.int64(), pa.binary(), *[pa.int32()] * 4, pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    names = [x.split()[0] for x in _PART.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        # the last place stands for all words that are not in the head
        place = {w: i for i, w in enumerate(m.words)}
        of = np.array([*(x[0] for x in m.words.values()), -1])
        emitted = np.array([*(x[1] for x in m.words.values()), 0.0])
        base = np.array([*(np.log10((x[2] + 1) / (m.total + m.distinct + 1)) for x in m.words.values()), 0.0])
        get, other = place.get, len(place)
        shapes = bounded_memo(MEMO_ENTRIES)
        shapes.make = shape
        texts_of, rare_of, size = [], [], 0

        def rows() -> Iterator[pa.RecordBatch]:
            keys, ids, n, known, bases, scores = zip(*texts_of, strict=True)
            zero, k = np.zeros(len(keys), np.int32), len(keys)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((keys, ids, [b" row %d" % x for x in keys], zero - 1, zero, zero, zero - 1, n, known, bases, scores), types, strict=True)], names=names)
            if rare_of:
                row, key, words, pos, before, after = zip(*rare_of, strict=True)
                lens = [len(x) for x in pos]
                flat = [w for x in words for w in x]
                k = len(flat)
                columns = (np.repeat(np.array(row, np.int64), lens), pa.array(key, pa.int64()).take(pa.array(np.repeat(np.arange(len(lens)), lens))), flat, np.concatenate(pos), np.concatenate(before), np.concatenate(after), np.fromiter(map(shapes.__getitem__, flat), np.int32, k), *[np.zeros(k, np.int64)] * 2, *[np.zeros(k)] * 2)
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=names)

        for batch in batches:
            for row, key, text in zip(*(batch.column(x).to_pylist() for x in (ROW, ID, "data")), strict=True):
                words = tokens(text)
                at = np.fromiter(map(get, words, repeat(other)), np.int64, len(words))
                path = np.concatenate([[m.end], of[at]])
                a, b = path[:-1], path[1:]
                ok = (a >= 0) & (b >= 0)
                rare = np.flatnonzero(path < 0)
                score = float(m.transition[a[ok], b[ok]].sum() + emitted[at].sum())
                texts_of.append((row, key, len(words), len(words) - len(rare), float(base[at].sum()), score))
                if len(rare):
                    after = np.concatenate([path[1:], [-2]])[rare]
                    rare_of.append((row, key, [words[k - 1] for k in rare.tolist()], rare, path[rare - 1], after))
                size += 1 + len(rare)
                if size > 50_000:
                    yield from rows()
                    texts_of, rare_of, size = [], [], 0
        if texts_of:
            yield from rows()

    return texts.mapInArrow(run, _PART)


def _joined(texts: DataFrame, model: ClassModel, classes: DataFrame) -> DataFrame:
    """A row for each text: its part, and the places of its other words with their classes and counts."""
    both = _parts(texts, model).join(classes.withColumnRenamed("n", "m"), "word", "left")
    place = F.when(F.col("pos") >= 0, F.struct("pos", "prev", "next", F.coalesce("class", F.col("s") + CLASSES).alias("class"), F.coalesce("m", F.lit(0)).alias("m")))
    return both.groupBy("row", "id").agg(*(F.sum(x).alias(x) for x in ("n_tokens", "n_known", "base", "score")), F.sort_array(F.collect_list(place)).alias("places"))


def _places(column) -> tuple[np.ndarray, ...]:
    """For all places of a batch: its row, and the pairs of classes that they take part in, with their rows."""
    row = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
    flat = column.flatten()
    pos, before, after, of, m = (flat.field(x).to_numpy() for x in ("pos", "prev", "next", "class", "m"))
    left, right = before >= 0, after >= 0
    run = np.flatnonzero((row[1:] == row[:-1]) & (pos[1:] == pos[:-1] + 1))
    a, b = np.concatenate([before[left], of[right], of[run]]), np.concatenate([of[left], after[right], of[run + 1]])
    return row, of, m, np.concatenate([row[left], row[right], row[run]]), a.astype(np.int64), b.astype(np.int64)


def score(docs: DataFrame, model: ClassModel, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, n_tokens, n_known, base_score (unigrams, one added to each count) and score (the classes')."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        in_shape = m.shape_totals + ADD * (m.shape_types + 1)
        for batch in batches:
            row, of, n, pair_row, a, b = _places(batch.column("places"))
            size = batch.num_rows
            learnt, s = of < CLASSES, np.maximum(of - CLASSES, 0)
            emitted = np.log10(np.where(learnt, n, n + ADD) / np.where(learnt, m.totals[of], in_shape[s]))
            base = batch.column("base").to_numpy() + np.bincount(row, np.log10((n + 1) / (m.total + m.distinct + 1)), size)
            known = batch.column("n_known").to_numpy() + np.bincount(row[n > 0], minlength=size)
            total = batch.column("score").to_numpy() + np.bincount(row, emitted, size) + np.bincount(pair_row, m.transition[a, b], size)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_tokens"), pa.array(known), pa.array(base), pa.array(total)], names=[id_col, "n_tokens", "n_known", "base_score", "score"])

    texts = id_text(docs, id_col, text_col).select(F.monotonically_increasing_id().alias(ROW), ID, F.col(TEXT).cast("binary").alias("data"))
    return _joined(texts, model, counts).mapInArrow(run, f"`{id_col}` bigint, n_tokens bigint, n_known bigint, base_score double, score double")
