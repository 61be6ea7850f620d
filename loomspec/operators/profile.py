"""Profiles of whole frames: one aggregation for all columns' statistics, one for the values of all columns with few."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspec.functions.digests import collapsed, pattern

FEW_VALUES, TOP = 50, 20
QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)
#: Of a full profile.
ALL_QUANTILES = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


def numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def texts(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _long(df: DataFrame, aggregates: dict[str, dict[str, Column]]) -> DataFrame:
    """One row per column from one aggregation over all: aggregates maps a statistic to an expression for each column."""
    columns = list(next(iter(aggregates.values())))
    wide = df.agg(*(e.alias(f"{s}|{c}") for s, each in aggregates.items() for c, e in each.items()))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), *(F.col(f"`{s}|{c}`").alias(s) for s in aggregates)) for c in columns))
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def _distinct(*columns: Column) -> Column:
    """About how many distinct values, or combinations of values without NULL, there are: one sketch, whose relative error is 1.6 %."""
    there = columns[0].isNotNull()
    for c in columns[1:]:
        there = there & c.isNotNull()
    return F.hll_sketch_estimate(F.hll_sketch_agg(F.when(there, F.xxhash64(*columns)), F.lit(12)))


def completeness(df: DataFrame, columns: list[str] | None = None, exact: bool = False) -> DataFrame:
    """(column, n, non_null, completeness, distinct_count). Distinct counts come from sketches in the one aggregation, or, if
    exact, from an aggregation by value for each column, which reads that column alone: no row is multiplied by the columns."""
    columns = columns or df.columns
    x = {c: F.col(f"`{c}`") for c in columns}
    if exact:
        out = reduce(DataFrame.unionAll, (_exact(df, c) for c in columns))
    else:
        out = _long(df, {"n": {c: F.count("*") for c in columns}, "non_null": {c: F.count(x[c]) for c in columns}, "distinct_count": {c: _distinct(F.to_json(x[c]) if isinstance(df.schema[c].dataType, T.MapType) else x[c]) for c in columns}})
    return out.select("column", "n", "non_null", F.when(F.col("n") > 0, F.round(F.col("non_null") / F.col("n"), 6)).otherwise(0.0).alias("completeness"), "distinct_count")


def _exact(df: DataFrame, column: str) -> DataFrame:
    """A column's row of counts; its values are counted in the map tasks first."""
    by_value = df.groupBy(F.col(f"`{column}`").alias("v")).agg(F.count("*").alias("k"))
    return by_value.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("k"))), F.lit(0)).alias("non_null"), F.count("v").alias("distinct_count")).select(F.lit(column).alias("column"), "*")


def numeric_summary(df: DataFrame, columns: list[str] | None = None, exact: bool = False, places: int = 4, quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """Extremes, moments and quantiles of all numeric columns in one pass; quantiles from sketches of a bounded size, or exact
    ones, which hold a column's distinct values in memory."""
    columns = columns or numeric(df)
    x = {c: F.col(f"`{c}`").cast("double") for c in columns}
    quantile = (lambda c, q: F.percentile(x[c], F.lit(q))) if exact else (lambda c, q: F.percentile_approx(x[c], F.lit(q), F.lit(10000)))
    stats = {"min": F.min, "max": F.max, "mean": F.avg, "stddev": F.stddev_samp, "sum": F.sum, "skewness": F.skewness, "kurtosis": F.kurtosis}
    out = _long(df, {s: {c: f(x[c]) for c in columns} for s, f in stats.items()} | {f"p{round(100 * q)}": {c: quantile(c, q) for c in columns} for q in quantiles})
    return out.select("column", *(F.round(s, places).alias(s) for s in out.columns if s != "column"))


def text_summary(df: DataFrame, columns: list[str] | None = None, exact: bool = False) -> DataFrame:
    columns = columns or texts(df)
    n = {c: F.length(F.col(f"`{c}`")) for c in columns}
    stats = {"min_length": F.min, "max_length": F.max, "avg_length": F.avg, "median_length": lambda x: F.percentile(x, F.lit(0.5)) if exact else F.percentile_approx(x, F.lit(0.5), F.lit(10000)).cast("double"), "empty": lambda x: F.count_if(x == 0)}
    out = _long(df, {s: {c: f(n[c]) for c in columns} for s, f in stats.items()})
    return out.withColumn("avg_length", F.round("avg_length", 4))


def stacked(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value) of all columns, as text; NULLs stay."""
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns))
    return df.select(F.explode(rows).alias("r")).select("r.*")


def frequencies(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n, share) of all values, from one aggregation; share is of the non-NULL values."""
    counts = stacked(df, columns).where("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("n"))
    totals = df.agg(*(F.count(F.col(f"`{c}`")).alias(c) for c in columns))
    long = totals.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("total")) for c in columns))).alias("r")).select("r.*")
    return counts.join(F.broadcast(long), "column").select("column", "value", "n", F.round(F.col("n") / F.col("total"), 4).alias("share"))  # a row for each column


def top_values(df: DataFrame, column: str, n: int = TOP) -> DataFrame:
    """The most frequent values, ties by value."""
    x = F.col(f"`{column}`")
    return df.where(x.isNotNull()).groupBy(x.cast("string").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(n)


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """(bin, low, high, n): equal widths between the extremes; the last bin has its upper end."""
    x = F.col(f"`{column}`").cast("double")
    ends = df.agg(F.min(x).alias("a"), F.max(x).alias("b"))
    binned = df.where(x.isNotNull()).select(x.alias("x")).join(F.broadcast(ends))  # one row
    at = F.when(F.col("b") == F.col("a"), F.lit(0)).otherwise(F.least(F.floor((F.col("x") - F.col("a")) / ((F.col("b") - F.col("a")) / bins)), F.lit(bins - 1)))
    counts = binned.groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    width = (F.col("b") - F.col("a")) / bins
    frame = ends.where("a IS NOT NULL").select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "a", width.alias("w"))
    return frame.join(counts, "bin", "left").select("bin", F.round(F.col("a") + F.col("bin") * F.col("w"), 6).alias("low"), F.round(F.col("a") + (F.col("bin") + 1) * F.col("w"), 6).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def entropy(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, entropy) in bits, over non-NULL values."""
    counts = stacked(df, columns).where("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("n"))
    # -sum p log p = log N - sum n log n / N
    return counts.groupBy("column").agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log2("n")).alias("s")).select("column", F.round(F.log2("total") - F.col("s") / F.col("total"), 6).alias("entropy"))


def patterns(df: DataFrame, column: str) -> DataFrame:
    """One row: the structural pattern of at least 0.8 of the values, else the collapsed one of at least 0.6, else NULL."""
    x = F.col(f"`{column}`")
    forms = df.where(x.isNotNull()).select(pattern(x).alias("exact")).groupBy("exact").agg(F.count("*").alias("n"))
    whole = forms.agg(F.sum("n").alias("total"), F.max(F.struct("n", "exact")).alias("e"))
    short = forms.groupBy(collapsed(F.col("exact")).alias("short")).agg(F.sum("n").alias("n")).agg(F.max(F.struct("n", "short")).alias("s"))
    both = whole.join(short)  # one row each
    return both.select(F.when(F.col("e.n") / F.col("total") >= 0.8, F.col("e.exact")).when(F.col("s.n") / F.col("total") >= 0.6, F.col("s.short")).alias("pattern"), F.coalesce("total", F.lit(0)).alias("n"))


def sample_values(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """A deterministic sample: the distinct values with the smallest hashes."""
    x = F.col(f"`{column}`").cast("string")
    return df.where(x.isNotNull()).select(x.alias("value")).distinct().orderBy(F.md5("value"), "value").limit(n)


def key_candidates(df: DataFrame, width: int = 3, most: int = 12, sets: list[tuple[str, ...]] | None = None) -> DataFrame:
    """(columns, distinct_count, unique) of column sets that may be keys, the best first; only minimal ones are marked unique.

    Without given sets, complete columns are ranked by their share of distinct values, which sketches tell, and the sets of the
    best of them are taken. The counts are exact: a set that holds a smaller one that is unique has as many values as rows;
    all others are counted, in one job for each width. NULL is no value of a column, but is one within a combination.
    """
    if sets is None:
        stats = [r for r in completeness(df).collect() if r["n"] and r["non_null"] == r["n"]]
        kinds = {f.name: f.dataType for f in df.schema.fields}
        ratio = {r["column"]: r["distinct_count"] / r["n"] for r in stats if not isinstance(kinds[r["column"]], T.ArrayType | T.MapType | T.StructType)}
        ranked = sorted(ratio, key=lambda c: (-ratio[c], df.columns.index(c)))[:8]
        sets = [s for w in range(1, width + 1) for s in combinations(ranked, w)]
        sets.sort(key=lambda s: (-(min(1.0, sum(ratio[c] for c in s)) - 0.05 * (len(s) - 1)), len(s), s))
        sets = sets[:most]
    if not sets:
        return df.sparkSession.createDataFrame([], "columns string, distinct_count bigint, unique boolean")
    total = df.count()
    unique: list[tuple] = []
    rows = []
    for w in sorted({len(s) for s in sets}):
        of_width = [s for s in sets if len(s) == w]
        above = {s for s in of_width if any(set(u) < set(s) for u in unique)}  # holds a key, so it is one, but not a minimal one
        asked = [s for s in of_width if s not in above]
        counts = [_combinations(df, s).agg(F.lit(i).alias("i"), F.count("*").alias("n")) for i, s in enumerate(asked)]
        exact = {asked[r["i"]]: r["n"] for r in reduce(DataFrame.unionAll, counts).collect()} if asked else {}
        unique += [s for s, n in exact.items() if n == total]
        rows += [(",".join(s), exact.get(s, total), s in unique) for s in of_width]
    return df.sparkSession.createDataFrame(rows, "columns string, distinct_count bigint, unique boolean")


def _combinations(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    out = df.select(*(F.col(f"`{c}`") for c in columns)).distinct()
    return out.dropna() if len(columns) == 1 else out


def promoted_key(candidates: list[tuple[tuple[str, ...], float]], least: float = 0.9, gap: float = 0.05) -> tuple[str, ...] | None:
    """The best candidate, if its score is high enough and far enough above the next."""
    ranked = sorted(candidates, key=lambda c: (-c[1], len(c[0]), c[0]))
    if not ranked or ranked[0][1] < least or len(ranked) > 1 and ranked[0][1] - ranked[1][1] < gap and len(ranked[0][0]) == len(ranked[1][0]):
        return None
    return ranked[0][0]


def alerts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, alert): Constant, NullSpike (over half NULL), HighCardinality (over 0.9 distinct), Imbalanced (over 0.9 one value), Skewed (beyond 2)."""
    columns = columns or df.columns
    base = completeness(df, columns)
    most = stacked(df, columns).where("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("k")).groupBy("column").agg(F.max("k").alias("top"))
    skew = numeric_summary(df, [c for c in numeric(df) if c in columns]).select("column", "skewness") if any(c in columns for c in numeric(df)) else df.sparkSession.createDataFrame([], "column string, skewness double")
    all_ = base.join(most, "column", "left").join(skew, "column", "left")
    found = F.array_compact(F.array(
        F.when(F.col("distinct_count") == 1, "Constant"),
        F.when(F.col("completeness") < 0.5, "NullSpike"),
        F.when((F.col("distinct_count") > 1) & (F.col("distinct_count") / F.col("non_null") > 0.9), "HighCardinality"),
        F.when((F.col("distinct_count") > 1) & (F.col("top") / F.col("non_null") > 0.9), "Imbalanced"),
        F.when(F.abs("skewness") > 2, "Skewed"),
    ))
    return all_.select("column", F.explode(found).alias("alert"))


def profile(df: DataFrame) -> list[dict]:
    """A profile for rules_from_profile: two or three jobs, however many columns."""
    rows = {r["column"]: r.asDict() for r in completeness(df).collect()}
    few = [c for c, r in rows.items() if 0 < r["distinct_count"] <= FEW_VALUES and c in texts(df)]
    for r in numeric_summary(df).collect() if numeric(df) else []:
        rows[r["column"]] |= r.asDict() | {"numeric": True}
    for r in text_summary(df).collect() if texts(df) else []:
        rows[r["column"]] |= r.asDict()
    for r in frequencies(df, few).collect() if few else []:  # FEW_VALUES rows for each column at most
        rows[r["column"]].setdefault("values", []).append(r["value"])
    for r in rows.values():
        r["uniqueness"] = r["distinct_count"] / r["non_null"] if r["non_null"] else 0.0
        if "values" in r:
            r["values"].sort()
    return list(rows.values())
