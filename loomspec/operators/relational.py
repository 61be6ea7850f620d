"""Joins, unions, unpivots, pre-aggregations and survivorship, as functions of DataFrames.

A joined table's columns are named `<alias>__<column>`. Keys are pairs of SQL expressions, on the left and on the right
frame. One row per key is chosen by aggregation where that is enough, so that skewed keys are combined in the map tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspec.operators.ingest import orderable, sort_keys
from loomspec.spec import SpecError

Keys = Sequence[tuple[str, str]]


def prefixed(df: DataFrame, alias: str, keys: Sequence[str] = ()) -> DataFrame:
    """Columns as <alias>__<column>, and the key expressions as __k0, __k1, ..."""
    return df.select(*(F.expr(k).alias(f"__k{i}") for i, k in enumerate(keys)), *(F.col(f"`{c}`").alias(f"{alias}__{c}") for c in df.columns))


def _on(left: DataFrame, right: DataFrame, keys: Keys, null_safe: bool = False) -> Column:
    out = None
    for i, (l, _) in enumerate(keys):
        a, b = F.expr(l), F.col(f"__k{i}")
        one = a.eqNullSafe(b) if null_safe else a == b
        out = one if out is None else out & one
    if out is None:
        raise SpecError("a join needs keys")
    return out


def direct_join(left: DataFrame, right: DataFrame, alias: str, keys: Keys, how: str = "left", where: str | None = None, null_safe: bool = False) -> DataFrame:
    """LEFT, INNER or FULL OUTER. The filter reads the right frame alone, so rows of the left stay in a LEFT join; in a FULL
    OUTER join it is part of the condition, so rows of the right that it refuses stay, too, without a partner."""
    held = bool(where) and how.replace("_", "").lower().startswith(("full", "outer"))
    if where and not held:
        right = right.where(F.expr(where))
    other = prefixed(right, alias, [r for _, r in keys] + ([f"({where})"] if held else []))
    on = _on(left, other, keys, null_safe)
    if held:
        on = on & F.col(f"__k{len(keys)}")
    return left.join(other, on, how).drop(*(f"__k{i}" for i in range(len(keys) + held)))


def bridge_join(left: DataFrame, bridge: DataFrame, target: DataFrame, bridge_alias: str, alias: str, first: Keys, second: Keys, how: str = "left") -> DataFrame:
    """Over a table between: first joins left and bridge, second the bridge's columns and the target's."""
    step = direct_join(left, bridge, bridge_alias, first, how)
    return direct_join(step, target, alias, [(f"{bridge_alias}__{a}", b) for a, b in second], how)


def first_record_join(left: DataFrame, right: DataFrame, alias: str, keys: Keys, order_by: Sequence[str] = (), how: str = "left", where: str | None = None) -> DataFrame:
    """The first row of each key joins; all columns break ties."""
    if where:
        right = right.where(F.expr(where))
    names = [f"__k{i}" for i in range(len(keys))]
    keyed = right.select(*(F.expr(r).alias(n) for n, (_, r) in zip(names, keys, strict=True)), *right.columns)
    w = Window.partitionBy(*names).orderBy(*sort_keys(tuple(order_by), orderable(right)))
    one = keyed.withColumn("__rn", F.row_number().over(w)).where("__rn = 1")
    other = one.select(*names, *(F.col(f"`{c}`").alias(f"{alias}__{c}") for c in right.columns))
    return left.join(other, _on(left, other, keys), how).drop(*names)


def pivot_join(left: DataFrame, right: DataFrame, alias: str, keys: Keys, value: str, n: int, order_by: Sequence[str] = (), where: str | None = None) -> DataFrame:
    """The first n values of each key as <alias>__<value>_1 ... _n; by default in the order of the values. Missing ones are NULL."""
    if where:
        right = right.where(F.expr(where))
    names = [f"__k{i}" for i in range(len(keys))]
    keyed = right.select(*(F.expr(r).alias(k) for k, (_, r) in zip(names, keys, strict=True)), *right.columns)
    w = Window.partitionBy(*names).orderBy(*sort_keys(tuple(order_by) or (f"{value} asc",), orderable(right)))
    ranked = keyed.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n)
    wide = ranked.groupBy(*names).agg(*(F.max(F.when(F.col("__rn") == i, F.col(value))).alias(f"{alias}__{value}_{i}") for i in range(1, n + 1)))
    return left.join(wide, _on(left, wide, keys), "left").drop(*names)


def alternative_path_join(left: DataFrame, right: DataFrame, alias: str, paths: Sequence[Keys], how: str = "left", where: str | None = None) -> DataFrame:
    """A row matches by any of several key pairs, the first that matches wins, then the first row by all columns.

    The first row of each key of a path is chosen by an aggregation, before it joins: a join adds no row, however many rows
    share a key. An OR of the paths would compare all pairs.
    """
    if where:
        right = right.where(F.expr(where))
    row = F.struct(*(F.col(f"`{c}`").alias(c) for c in right.columns))
    # by all columns, NULLs last
    rank = F.struct(*(x.alias(f"o{i}{j}") for i, c in enumerate(orderable(right)) for j, x in enumerate((F.col(f"`{c}`").isNull(), F.col(f"`{c}`")))))
    out, found = left, []
    for p, path in enumerate(paths):
        names = [f"__k{p}_{i}" for i in range(len(path))]
        keyed = right.select(*(F.expr(r).alias(n) for n, (_, r) in zip(names, path, strict=True)), row.alias("__row"), rank.alias("__rank")).dropna(subset=names)
        first = keyed.groupBy(*names).agg(F.min_by("__row", "__rank").alias(f"__row{p}"))
        on = None
        for n, (l, _) in zip(names, path, strict=True):
            one = F.expr(l) == F.col(n)
            on = one if on is None else on & one
        if on is None:
            raise SpecError("a path needs keys")
        out = out.join(first, on, "left").drop(*names)
        found.append(f"__row{p}")
    if how.replace("_", "").lower() in ("inner", "right", "rightouter"):
        out = out.where(F.coalesce(*found).isNotNull())
    return out.select("*", *(F.coalesce(*found)[c].alias(f"{alias}__{c}") for c in right.columns)).drop(*found)


def aggregate_join(left: DataFrame, right: DataFrame, alias: str, keys: Keys, aggregates: dict[str, str], where: str | None = None, lookup: DataFrame | None = None, via: tuple[str, str, str] | None = None) -> DataFrame:
    """right is grouped by its keys before the join; with via (right's key, lookup's key, lookup's base key) first through a lookup table."""
    grouped = pre_aggregate(right, [r for _, r in keys] if via is None else [via[2]], aggregates, where, lookup, via)
    names = [f"__k{i}" for i in range(len(keys))]
    other = grouped.select(*names, *(F.col(a).alias(f"{alias}__{a}") for a in aggregates))
    return left.join(other, _on(left, other, keys), "left").drop(*names)


def pre_aggregate(right: DataFrame, keys: Sequence[str], aggregates: dict[str, str], where: str | None = None, lookup: DataFrame | None = None, via: tuple[str, str, str] | None = None) -> DataFrame:
    """Grouped by __k0, ...; every Spark aggregate is legal, COUNT(DISTINCT ..) and FILTER too."""
    if where:
        right = right.where(F.expr(where))
    if via is not None:
        source_key, lookup_key, base_key = via
        other = lookup.select(F.expr(lookup_key).alias("__lk"), F.expr(base_key).alias("__k0"))
        right = right.withColumn("__sk", F.expr(source_key)).join(other, F.col("__sk") == F.col("__lk"))
        return right.groupBy("__k0").agg(*(F.expr(e).alias(a) for a, e in aggregates.items()))
    return right.groupBy(*(F.expr(k).alias(f"__k{i}") for i, k in enumerate(keys))).agg(*(F.expr(e).alias(a) for a, e in aggregates.items()))


def window_aggregate(right: DataFrame, keys: Sequence[str], columns: Sequence[str], order_by: Sequence[str], where: str | None = None) -> DataFrame:
    """The winning row of each key, with the columns asked for."""
    if where:
        right = right.where(F.expr(where))
    names = [f"__k{i}" for i in range(len(keys))]
    keyed = right.select(*(F.expr(k).alias(n) for n, k in zip(names, keys, strict=True)), *right.columns)
    w = Window.partitionBy(*names).orderBy(*sort_keys(tuple(order_by), orderable(right)))
    return keyed.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").select(*names, *columns)


def key_universe(sources: Sequence[tuple[DataFrame, str]], name: str) -> DataFrame:
    """The distinct non-NULL keys of several tables."""
    out = None
    for df, key in sources:
        one = df.select(F.expr(key).alias(name)).where(F.col(name).isNotNull())
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def union_branches(branches: Sequence[DataFrame], distinct: bool = False) -> DataFrame:
    """Branches of the same columns, by name; columns that a branch lacks are NULL."""
    out = branches[0]
    for b in branches[1:]:
        out = out.unionByName(b, allowMissingColumns=True)
    return out.distinct() if distinct else out


def union_exclude_base(base: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """base, and the rows of other whose key base lacks. NULL keys match nothing."""
    return base.unionByName(other.join(base.select(*keys).distinct(), list(keys), "left_anti"), allowMissingColumns=True)


def union_coalesce_base(base: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row for each match: base's values, or other's where they are NULL; rows of one side alone stay. NULL keys match nothing."""
    names = list(dict.fromkeys([*base.columns, *other.columns]))
    a = base.select(F.struct(*base.columns).alias("a"), *(F.col(k).alias(f"__a{i}") for i, k in enumerate(keys)))
    b = other.select(F.struct(*other.columns).alias("b"), *(F.col(k).alias(f"__b{i}") for i, k in enumerate(keys)))
    on = None
    for i in range(len(keys)):
        one = F.col(f"__a{i}") == F.col(f"__b{i}")
        on = one if on is None else on & one
    both = a.join(b, on, "full_outer")
    pick = lambda n: F.coalesce(*([F.col("a")[n]] if n in base.columns else []), *([F.col("b")[n]] if n in other.columns else []))
    return both.select(*(pick(n).alias(n) for n in names))


def unpivot(df: DataFrame, ids: Sequence[str], columns: Sequence[str], value: str = "value", name: str = "source_column") -> DataFrame:
    """Wide to long; NULLs are left out."""
    return df.unpivot(list(ids), list(columns), name, value).where(F.col(value).isNotNull())


def survivor(values: Sequence[Column], strategy: str | None = None, default: Column | None = None, text: bool = False, stamps: Sequence[Column] = ()) -> Column:
    """One value of several: the first that is there (empty text is not), the greatest, the most recent or the longest."""
    values = list(values)
    if not values:
        raise SpecError("a survivorship needs values")
    if strategy == "max_across_sources":
        out = F.greatest(*values) if len(values) > 1 else values[0]
    elif strategy == "most_recent":
        pairs = F.array(*(F.when(v.isNotNull(), F.struct(s.alias("s"), F.lit(-i).alias("i"), v.alias("v"))) for i, (v, s) in enumerate(zip(values, stamps, strict=True))))
        out = F.array_max(pairs)["v"]
    elif strategy == "longest_value":
        pairs = F.array(*(F.when(v.isNotNull(), F.struct(F.length(v.cast("string")).alias("s"), F.lit(-i).alias("i"), v.alias("v"))) for i, v in enumerate(values)))
        out = F.array_max(pairs)["v"]
    elif strategy in (None, "priority", "highest_priority"):
        if len(values) > 1 and text:
            values = [F.nullif(v, F.lit("")) for v in values]
        out = F.coalesce(*values) if len(values) > 1 else values[0]
    else:
        raise SpecError(f"survivorship strategy {strategy!r}")
    return out if default is None else F.coalesce(out, default)
