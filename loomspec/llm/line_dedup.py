"""Cross-site boilerplate lines, by the number of distinct sites that hold a line, in DataFrame functions alone.

A line's key is a 128-bit digest of its trimmed, lower-cased text; empty lines have none and are never removed. HyperLogLog
sketches of the sites are made in the map tasks, merged by aggregation and estimated for each line. Lines estimated well
below the threshold stay, lines well above it go, and those near it (by the relative error of the sketch, with a wide
margin) get exact counts of distinct sites before the decision. A null site counts as one site of its own.

The digests of up to `MOST_LINES` boilerplate lines, counted first, go to the executors within the plan, and each document is
rid of its lines where it is read; more of them meet the documents' lines in a join by key, and documents their hits in one by
text digest, in which frequent texts are dealt out.

Lines are split at line feeds; a very long text is one row, read whole. Null texts stay null, empty ones empty; a document whose lines all go keeps its row, with an
empty text. Repeated rows keep a row each; an empty table gives an empty result. All columns of the input are kept, and no
row is lost; internal columns have names of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspec.llm.common import saved, spread_join, unused

#: A line on at least this many distinct sites is boilerplate.
LEAST_SITES = 10
#: log2 of the sketch's buckets: a relative standard error of 0.8326 / sqrt(2**11), under 2 %.
SKETCH_BITS = 11
#: Estimates within this factor of the threshold are counted exactly: more than ten standard errors.
NEAR = 1.3


#: Lines whose digests may travel in the plan; beyond that, documents meet their lines in a join.
MOST_LINES = 100_000


def plain_lines(text: Column) -> Column:
    """The lines of a text as they are compared: lower-cased, runs of white space as one space, trimmed."""
    return F.transform(F.split(F.lower(F.regexp_replace(text, r"[ \t\x0B\f\r]+", " ")), "\n"), F.trim)


def line_key(plain: Column) -> Column:
    return F.when(plain != "", F.unhex(F.md5(plain.cast("binary"))))


def line_keys(text: Column) -> Column:
    """The distinct keys of a text's lines."""
    return F.transform(F.array_distinct(F.filter(plain_lines(text), lambda x: x != "")), line_key)


def boilerplate_lines(docs: DataFrame, site_col: str = "source", text_col: str = "text", least_sites: int = LEAST_SITES) -> DataFrame:
    """The keys of the lines that at least least_sites distinct sites hold, as (key, sites): exact, or an estimate far above."""
    pairs = docs.select(F.coalesce(F.concat(F.lit("s"), docs[site_col].cast("string")), F.lit("n")).alias("site"), F.explode(line_keys(docs[text_col].cast("string"))).alias("key"))
    sketched = pairs.groupBy("key").agg(F.hll_sketch_agg("site", F.lit(SKETCH_BITS)).alias("sketch"))
    estimates = saved(sketched.select("key", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= least_sites / NEAR), "line-sites", small=True)
    clear = estimates.where(F.col("sites") > least_sites * NEAR)
    near = estimates.where(F.col("sites") <= least_sites * NEAR)
    exact = pairs.join(near.select("key"), "key", "left_semi").groupBy("key").agg(F.countDistinct("site").alias("sites")).where(F.col("sites") >= least_sites)
    return clear.unionByName(exact)


def remove_boilerplate(docs: DataFrame, site_col: str = "source", text_col: str = "text", least_sites: int = LEAST_SITES, removed_col: str | None = None, most_lines: int = MOST_LINES) -> DataFrame:
    """docs with the text less its boilerplate lines; with removed_col also the number of lines removed."""
    lines = saved(boilerplate_lines(docs, site_col, text_col, least_sites).select("key"), "boilerplate", small=True)
    text = F.col(text_col).cast("string")
    if lines.count() <= most_lines:
        found = [row[0] for row in lines.select(F.lower(F.hex("key"))).sort("key").collect()]  # most_lines at most, as counted
        goes, source = lambda plain: F.md5(plain.cast("binary")).isin(found), docs
    else:
        row, hit = unused("__lines_row", docs.columns), unused("__lines_hit", docs.columns)
        # a text's digest stands for its row: it is the same however often the input is computed, and copies share one list of hits
        numbered = docs.withColumn(row, F.unhex(F.sha2(text, 256)))
        keys = numbered.select(row, F.explode(line_keys(text)).alias("key"))
        hits = keys.join(lines, "key", "left_semi").groupBy(row).agg(F.collect_set("key").alias(hit), F.count("*").alias("n"))  # at most a document's own lines
        hits = saved(hits.withColumn("copies", F.col("n") / F.size(hit)), "line-hits")
        source = spread_join(numbered, hits, [row], hit, "copies", F.xxhash64(*(c for c, t in docs.dtypes if not t.startswith("map"))))
        goes = lambda plain: F.coalesce(F.array_contains(F.col(hit), line_key(plain)), F.lit(False))
    split = F.split(text, "\n")
    both = F.arrays_zip(split.alias("line"), plain_lines(text).alias("plain"))
    kept = F.transform(F.filter(both, lambda x: (x["plain"] == "") | ~goes(x["plain"])), lambda x: x["line"])
    out = [F.array_join(kept, "\n").alias(c) if c == text_col else F.col(c) for c in docs.columns]
    if removed_col:
        out.append(F.coalesce(F.size(split) - F.size(kept), F.lit(0)).cast("bigint").alias(removed_col))
    return source.select(*out)
