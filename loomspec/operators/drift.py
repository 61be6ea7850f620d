"""Baselines, drift statistics and diffs of two frames. Distributions meet in joins; nothing but single figures reaches the driver."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspec.functions.digests import row_checksum

NULL_MARK = "__NULL__"
MODERATE, SIGNIFICANT = 0.1, 0.2


def frequencies(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n), NULL under a mark of its own."""
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(NULL_MARK)).alias("value")) for c in columns))
    return df.select(F.explode(rows).alias("r")).select("r.*").groupBy("column", "value").agg(F.count("*").alias("n"))


def categorical(df: DataFrame, most: int = 100) -> list[str]:
    """Text columns with few distinct values, from one aggregation."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    got = df.agg(*(F.approx_count_distinct(F.col(f"`{c}`")).alias(c) for c in names)).first() if names else {}
    return [c for c in names if 0 < got[c] <= most]


def capture(df: DataFrame, primary_key: list[str] | None = None) -> dict[str, DataFrame | int]:
    """What later runs are compared with: the row count, frequencies, numeric summaries, and digests of records."""
    from loomspec.operators.profile import numeric, numeric_summary

    out: dict = {"row_count": df.count(), "frequencies": frequencies(df, categorical(df) or []) if categorical(df) else None, "numeric": numeric_summary(df, exact=False) if numeric(df) else None}
    if primary_key:
        out["records"] = record_digests(df, primary_key)
    return out


def row_count_change(before: int, after: int) -> dict:
    change = after - before
    percent = 100.0 * change / before if before else (100.0 if after else 0.0)
    return {"absolute": change, "percent": round(percent, 6), "direction": "increase" if change > 0 else "decrease" if change < 0 else "unchanged"}


def _paired(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys, F.col("n").alias("a")).join(b.select(*keys, F.col("n").alias("b")), keys, "full_outer").select(*keys, F.coalesce("a", F.lit(0)).cast("double").alias("a"), F.coalesce("b", F.lit(0)).cast("double").alias("b"))


def smoothed_js(a: DataFrame, b: DataFrame) -> DataFrame:
    """(column, js): Jensen-Shannon divergence by natural logarithms over ln 2; values that one side lacks count as 1e-10."""
    eps = 1e-10
    totals = _paired(a, b, ["column", "value"])
    sums = totals.groupBy("column").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    p = totals.join(sums, "column").select("column", F.when(F.col("a") > 0, F.col("a") / F.col("ta")).otherwise(eps).alias("p"), F.when(F.col("b") > 0, F.col("b") / F.col("tb")).otherwise(eps).alias("q"))
    norm = p.groupBy("column").agg(F.sum("p").alias("sp"), F.sum("q").alias("sq"))
    x, y = F.col("p") / F.col("sp"), F.col("q") / F.col("sq")
    m = (x + y) / 2
    term = (x * F.log(x / m) + y * F.log(y / m)) / 2
    return p.join(norm, "column").groupBy("column").agg(F.round(F.least(F.sum(term) / math.log(2), F.lit(1.0)), 6).alias("js"))


def js_bits(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(js): Jensen-Shannon divergence in bits, without smoothing, of two frames (keys, n)."""
    both = _paired(a, b, keys)
    sums = both.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    p, q = F.col("a") / F.col("ta"), F.col("b") / F.col("tb")
    m = (p + q) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    return both.join(F.broadcast(sums)).agg(F.round(F.greatest(F.least(F.sum((part(p) + part(q)) / 2), F.lit(1.0)), F.lit(0.0)), 6).alias("js"))


def psi(a: DataFrame, b: DataFrame, keys: list[str], epsilon: float = 1e-4) -> DataFrame:
    """(psi): the population stability index of two frames (keys, n); every bin is smoothed by epsilon."""
    both = _paired(a, b, keys)
    sums = both.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"), F.count("*").alias("k"))
    p = (F.col("a") + epsilon) / (F.col("ta") + F.col("k") * epsilon)
    q = (F.col("b") + epsilon) / (F.col("tb") + F.col("k") * epsilon)
    return both.join(F.broadcast(sums)).agg(F.round(F.greatest(F.sum((q - p) * F.log(q / p)), F.lit(0.0)), 6).alias("psi"))


def verdict(psi_value: Column, schema_changed: Column) -> Column:
    return F.when(schema_changed, "schema_changed").when(psi_value < MODERATE, "stable").when(psi_value < SIGNIFICANT, "moderate").otherwise("significant")


def chi_square(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(chi2, cells): does b follow a? a is scaled to b's total; cells that a lacks are left out; under two cells there is no value."""
    both = _paired(a, b, keys)
    sums = both.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    expected = F.col("a") / F.col("ta") * F.col("tb")
    cells = both.join(F.broadcast(sums)).where("a > 0 AND tb > 0").agg(F.sum((F.col("b") - expected) ** 2 / expected).alias("c"), F.count("*").alias("cells"))
    return cells.select(F.when(F.col("cells") >= 2, F.round("c", 6)).alias("chi2"), "cells")


def binned(df: DataFrame, column: str, edges: DataFrame, bins: int = 20, outside: bool = False) -> DataFrame:
    """(bin, n) on the edges (a, b) of a reference: one row. Values outside are left out, or counted in bins of their own."""
    x = F.col(f"`{column}`").cast("double")
    rows = df.where(x.isNotNull()).select(x.alias("x")).join(F.broadcast(edges))
    width = (F.col("b") - F.col("a")) / bins
    at = F.when(width == 0, F.lit(0)).otherwise(F.least(F.floor((F.col("x") - F.col("a")) / width), F.lit(bins - 1))).cast("int")
    inside = (F.col("x") >= F.col("a")) & (F.col("x") <= F.col("b"))
    at = F.when(inside, at).when(F.col("x") < F.col("a"), -1).otherwise(bins)
    rows = rows if outside else rows.where(inside)
    return rows.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def ends(df: DataFrame, column: str) -> DataFrame:
    x = F.col(f"`{column}`").cast("double")
    return df.agg(F.min(x).alias("a"), F.max(x).alias("b"))


def rebinned(source_edges: list[float], counts: list[float], target_edges: list[float]) -> list[float]:
    """Counts of one histogram on the bins of another, each bin spread evenly."""
    out = [0.0] * (len(target_edges) - 1)
    for low, high, n in zip(source_edges, source_edges[1:], counts, strict=False):
        for j, (a, b) in enumerate(zip(target_edges, target_edges[1:], strict=False)):
            if high > low and (common := min(high, b) - max(low, a)) > 0:
                out[j] += n * common / (high - low)
    return out


def ks(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """(ks): the largest distance of the two distribution functions, over all values.

    Running sums are made within ranges of the values, and each range is moved by the sums of those before it, so that no task
    orders the whole table.
    """
    from pyspark.sql import Window

    one = lambda df, s: df.select(F.col(f"`{column}`").cast("double").alias("x"), F.lit(s).alias("s")).where("x IS NOT NULL")
    counts = one(a, 0).unionByName(one(b, 1)).groupBy("x").agg(F.count_if(F.col("s") == 0).alias("na"), F.count_if(F.col("s") == 1).alias("nb"))
    ranged = counts.repartitionByRange("x").withColumn("part", F.spark_partition_id())
    sums = ranged.groupBy("part").agg(F.sum("na").alias("pa"), F.sum("nb").alias("pb"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    starts = sums.select("part", F.coalesce(F.sum("pa").over(before), F.lit(0)).alias("sa"), F.coalesce(F.sum("pb").over(before), F.lit(0)).alias("sb"))
    total = sums.agg(F.sum("pa").alias("ta"), F.sum("pb").alias("tb"))
    w = Window.partitionBy("part").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = ranged.select("part", F.sum("na").over(w).alias("ra"), F.sum("nb").over(w).alias("rb")).join(F.broadcast(starts), "part").join(F.broadcast(total))
    return run.agg(F.round(F.max(F.abs((F.col("ra") + F.col("sa")) / F.col("ta") - (F.col("rb") + F.col("sb")) / F.col("tb"))), 6).alias("ks"))


def ks_p_value(statistic: float, n: int, m: int) -> float:
    """The asymptotic two-sided probability."""
    x = statistic * math.sqrt(n * m / (n + m))
    if x < 0.2:
        return 1.0
    return max(0.0, min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def chi_square_p_value(statistic: float, cells: int) -> float:
    """The upper tail of the chi-square distribution with cells - 1 degrees of freedom."""
    a, x = (cells - 1) / 2, statistic / 2
    if x <= 0:
        return 1.0
    if x < a + 1:
        term = total = 1 / a
        for n in range(1, 1000):
            term *= x / (a + n)
            total += term
            if term < total * 1e-15:
                break
        return max(0.0, 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a)))
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return min(1.0, math.exp(-x + a * math.log(x) - math.lgamma(a)) * h)


def kl_divergence(df: DataFrame, column: str, partition: dict[str, float]) -> DataFrame:
    """(kl): of the column's values from expected weights; NULL where a value has no weight."""
    x = F.col(f"`{column}`")
    counts = df.where(x.isNotNull()).groupBy(x.cast("string").alias("value")).agg(F.count("*").alias("n"))
    weights = df.sparkSession.createDataFrame([(str(k), float(v)) for k, v in partition.items()], "value string, q double")
    total = counts.agg(F.sum("n").alias("t"))
    p = F.col("n") / F.col("t")
    both = counts.join(F.broadcast(weights), "value", "left").join(F.broadcast(total))
    return both.agg(F.when(F.count_if(F.col("q").isNull()) == 0, F.round(F.sum(p * F.log(p / F.col("q"))), 6)).alias("kl"))


def record_digests(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, digest): the digest of all other columns' values, NULLs marked."""
    rest = [c for c in df.columns if c not in keys]
    return df.select(*keys, row_checksum([F.col(f"`{c}`") for c in rest], mark_nulls=True).alias("digest"))


def record_changes(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(status, n): added, removed, modified and unchanged records, by one join on the null-safe key."""
    return diff_status(before, after, keys, [c for c in before.columns if c not in keys]).groupBy("status").agg(F.count("*").alias("n"))


def diff_status(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, status) of all rows of two frames; presence is a flag of its own, so NULL keys are told apart from missing rows."""
    left = a.select(*(F.col(f"`{k}`").alias(f"a_{k}") for k in keys), F.struct(*(F.col(f"`{c}`") for c in columns)).alias("va"), F.lit(True).alias("in_a"))
    right = b.select(*(F.col(f"`{k}`").alias(f"b_{k}") for k in keys), F.struct(*(F.col(f"`{c}`") for c in columns)).alias("vb"), F.lit(True).alias("in_b"))
    on = None
    for k in keys:
        one = left[f"a_{k}"].eqNullSafe(right[f"b_{k}"])
        on = one if on is None else on & one
    both = left.join(right, on, "full_outer")
    status = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(F.col("va").eqNullSafe(F.col("vb")), "unchanged").otherwise("modified")
    return both.select(*(F.when(F.col("in_a"), F.col(f"a_{k}")).otherwise(F.col(f"b_{k}")).alias(k) for k in keys), status.alias("status"))


def row_diff(a: DataFrame, b: DataFrame, keys: list[str], samples: int = 100) -> tuple[DataFrame, DataFrame]:
    """(counts by status, up to `samples` keys of each status but unchanged)."""
    from pyspark.sql import Window

    status = diff_status(a, b, keys, [c for c in a.columns if c not in keys and c in b.columns])
    w = Window.partitionBy("status").orderBy(*keys)
    sample = status.where("status <> 'unchanged'").withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= samples).drop("__rn")
    return status.groupBy("status").agg(F.count("*").alias("n")), sample


def schema_diff(a: T.StructType, b: T.StructType) -> list[tuple[str, str]]:
    """(column, change): added, removed, type_changed, nullability_changed or unchanged."""
    x, y = {f.name: f for f in a.fields}, {f.name: f for f in b.fields}
    out = []
    for n in sorted(set(x) | set(y)):
        change = "added" if n not in x else "removed" if n not in y else "type_changed" if x[n].dataType != y[n].dataType else "nullability_changed" if x[n].nullable != y[n].nullable else "unchanged"
        out.append((n, change))
    return out


def compare_column(a: DataFrame, b: DataFrame, column: str, bins: int = 20) -> dict:
    """Drift of one column: numbers by bins, PSI, KS and JS; text by values, PSI, chi-square and JS; moments not at all."""
    kind = a.schema[column].dataType
    if isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType):
        return {"column": column, "kind": "temporal"}
    if isinstance(kind, T.NumericType):
        edges = ends(a, column)
        x, y = binned(a, column, edges, bins), binned(b, column, edges, bins)
        return {"column": column, "kind": "numeric", "psi": psi(x, y, ["bin"]).first()[0], "ks": ks(a, b, column).first()[0], "js": js_bits(x, y, ["bin"]).first()[0]}
    x, y = (frequencies(d, [column]).select("value", "n") for d in (a, b))
    return {"column": column, "kind": "categorical", "psi": psi(x, y, ["value"]).first()[0], "chi2": chi_square(x, y, ["value"]).first()[0], "js": js_bits(x, y, ["value"]).first()[0]}
