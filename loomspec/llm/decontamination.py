"""Benchmark decontamination by n-grams, in DataFrame functions alone.

Words are runs of ASCII letters, digits and non-ASCII characters, with A-Z lower-cased. A window is `n` consecutive words of
a benchmark item; an item with fewer words, but some, is one window. The hashes of all windows, when at most
`MOST_HASHES` (their number is counted first), go to the executors as one set inside the plan, and each document's windows
are looked up in it where the document is read: no row is made for a window that misses, and nothing is shuffled but
hits. A larger benchmark is joined through a shuffle instead, by 128-bit digests of the windows. Hits of the first way are
verified by that digest, too, or word by word where documents go as a whole. A very long text is one row, read whole.

A null text or item has no words. Repeated documents keep a row each; items with the same id are one item; null item ids are
not listed. An empty benchmark hits nothing, an empty table of documents gives an empty result. Other columns are not read
by `find_hits`, and kept as they are by `decontaminate`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspec.llm.common import ID, ROW, TEXT, id_text

WINDOW = 10
#: Window hashes that a plan may carry: 8 bytes each.
MOST_HASHES = 200_000
#: Fixed value: a word, after A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(f"({WORD})"), F.lit(1))


def starts(array: Column, n: int) -> Column:
    """1, 2, ... for each window of n elements."""
    return F.when(F.size(array) >= n, F.sequence(F.lit(1), F.size(array) - (n - 1))).otherwise(F.array().cast("array<int>"))


def places(size: int, hashes: list[int]) -> Column:
    """Where the words w hold a window with one of the hashes, from 1."""
    return F.filter(starts(F.col("w"), size), lambda i: F.xxhash64(F.slice("w", i, size)).isin(hashes))


def digest(gram: Column) -> Column:
    """Of a window's words, which hold no space."""
    return F.unhex(F.md5(F.array_join(gram, " ").cast("binary")))


def _placed(size: int):
    return lambda i: F.struct((i - 1).alias("at"), digest(F.slice("w", i, size)).alias("gram"))


def _is_one_of(size: int, grams: list[str]):
    return lambda i: F.array_join(F.slice("w", i, size), " ").isin(grams)


def benchmark_windows(benchmark: DataFrame, n: int, item_col: str, text_col: str) -> DataFrame:
    """Distinct (gram, size, hash, item)."""
    cut = benchmark.select(benchmark[item_col].cast("string").alias("item"), words(benchmark[text_col].cast("string")).alias("w")).where(F.size("w") > 0)
    whole = F.array(F.col("w"))
    grams = F.when(F.size("w") < n, whole).otherwise(F.transform(starts(F.col("w"), n), lambda i: F.slice("w", i, n)))
    out = cut.select("item", F.explode(grams).alias("gram")).distinct()
    return out.select("item", "gram", F.size("gram").alias("size"), F.xxhash64("gram").alias("hash"))


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", most_hashes: int = MOST_HASHES) -> DataFrame:
    """One row per document: id_col, n_words, hit_words (positions from 0, in order) and items (sorted as strings)."""
    cut = id_text(docs, id_col, text_col).select(F.monotonically_increasing_id().alias(ROW), ID, words(F.col(TEXT)).alias("w"))
    return _with_hits(cut, benchmark, n, item_col, most_hashes, [ID]).withColumnRenamed(ID, id_col)


def _with_hits(cut: DataFrame, benchmark: DataFrame, n: int, item_col: str, most_hashes: int, keep: list[str]) -> DataFrame:
    windows = benchmark_windows(benchmark, n, item_col, "text")
    sizes = windows.groupBy("size").agg(F.countDistinct("hash").alias("hashes")).collect()  # at most n rows
    in_plan = sum(x["hashes"] for x in sizes) <= most_hashes
    found = []
    for size in sorted(x["size"] for x in sizes):
        hashes = [x[0] for x in windows.where(F.col("size") == size).select("hash").distinct().sort("hash").collect()] if in_plan else None
        at = places(size, hashes) if in_plan else starts(F.col("w"), size)
        found.append(F.transform(at, _placed(size)))
    none = F.array().cast("array<struct<at:int,gram:binary>>")
    cut = cut.select(ROW, *keep, F.size("w").cast("bigint").alias("n_words"), F.concat(none, *found).alias("c"))
    # documents without a candidate keep one row
    flat = cut.select(ROW, *keep, "n_words", F.explode_outer("c").alias("c")).select(ROW, *keep, "n_words", "c.at", "c.gram")
    by_gram = windows.groupBy(digest(F.col("gram")).alias("gram")).agg(F.first("size").alias("size"), F.sort_array(F.collect_set("item")).alias("items"))
    if in_plan:
        by_gram = F.broadcast(by_gram)  # at most MOST_HASHES windows, as counted
    hits = flat.join(by_gram, "gram", "left")
    covered = F.when(F.col("size").isNotNull(), F.sequence("at", F.col("at") + F.col("size") - 1))
    found = hits.select(ROW, *keep, "n_words", covered.alias("covered"), "items")
    out = found.groupBy(ROW, *keep, "n_words").agg(F.collect_list("covered").alias("covered"), F.collect_set("items").alias("items"))
    return out.select(*keep, "n_words", F.array_sort(F.array_distinct(F.flatten("covered"))).alias("hit_words"), F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", n: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", most_hashes: int = MOST_HASHES) -> DataFrame:
    """The documents without hits (remove='documents'), or all documents without their hit words (remove='spans').

    Rows, columns and their order stay as they are otherwise. Without its spans, a text that was hit is what stands between
    and around its hit words, including their separators.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove: {remove!r}")
    whole = [F.struct(*(docs[c] for c in docs.columns)).alias("whole")]
    cut = docs.select(F.monotonically_increasing_id().alias(ROW), *whole, words(docs[text_col].cast("string")).alias("w"))
    if remove == "documents":
        windows = benchmark_windows(benchmark, n, item_col, "text")
        if (count := windows.select("hash").distinct().count()) == 0:
            return docs
        if count <= most_hashes:
            return _without_hits(cut, windows).select(*(F.col("whole")[c].alias(c) for c in docs.columns))
    # a text's digest stands for its row: it is the same however often the input is computed
    digest = F.unhex(F.sha2(docs[text_col].cast("string"), 256)).alias("key")
    numbered = docs.select(digest, *whole)
    cut = docs.select(F.monotonically_increasing_id().alias(ROW), digest, words(docs[text_col].cast("string")).alias("w"))
    hits = _with_hits(cut, benchmark, n, item_col, most_hashes, ["key"]).where(F.size("hit_words") > 0).dropDuplicates(["key"])
    both = numbered.join(hits.select("key", "hit_words"), "key", "left")
    if remove == "documents":
        return both.where(F.col("hit_words").isNull()).select(*(F.col("whole")[c].alias(c) for c in docs.columns))
    return both.select(*((without_words(F.col("whole")[c], F.col("hit_words")) if c == text_col else F.col("whole")[c]).alias(c) for c in docs.columns))


def _without_hits(cut: DataFrame, windows: DataFrame) -> DataFrame:
    """Rows of cut whose words hold no window. The few rows with a candidate are verified in their own row, against the windows' words."""
    found = []
    for size in sorted(x[0] for x in windows.select("size").distinct().collect()):  # at most n rows
        own = windows.where(F.col("size") == size).select("hash", "gram").distinct().sort("hash").collect()  # counted by the caller
        hashes, grams = sorted({x["hash"] for x in own}), sorted({" ".join(x["gram"]) for x in own})
        found.append(F.exists(places(size, hashes), _is_one_of(size, grams)))
    hit = found[0]
    for x in found[1:]:
        hit = hit | x
    # the row's number in the condition keeps the optimizer from moving it below the projection that makes the words once
    return cut.select(ROW, "whole", hit.alias("hit")).where((F.col(ROW) >= 0) & ~F.col("hit"))


def without_words(text: Column, positions: Column) -> Column:
    """text without the words at the positions (null: as it is); the separators stay."""
    found, gaps = F.regexp_extract_all(text, F.lit(f"({ANY_CASE})"), F.lit(1)), F.split(text, ANY_CASE)
    kept = F.transform(found, lambda w, i: F.when(F.array_contains(positions, i), F.lit("")).otherwise(w))
    rebuilt = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(kept, i), F.lit("")))), "")
    return F.when(positions.isNull(), text).otherwise(rebuilt)
