"""From raw rows to typed tables: casts, deduplication, and the write modes.

Every choice among rows is a total order: after the declared order, all columns break ties. Latest rows are chosen by an
aggregation of structs, which is combined in the map tasks, so a key with very many rows costs no sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspec.functions.casts import cast_column
from loomspec.spec import SpecError, TableDefinition

META = ("_source_file", "_load_ts")


def order_columns(order: tuple[str, ...] | list[str]) -> list[tuple[str, bool]]:
    """(expression, descending); descending is the default."""
    out = []
    for x in order:
        text, _, way = x.strip().rpartition(" ")
        out.append((text, way.lower() == "desc") if way.lower() in ("asc", "desc") else (x.strip(), True))
    return out


def sort_keys(order: tuple[str, ...] | list[str], ties: list[str]) -> list[Column]:
    """For a window: NULLS LAST always, then all columns."""
    keys = [(F.expr(x).desc_nulls_last() if down else F.expr(x).asc_nulls_last()) for x, down in order_columns(order)]
    return keys + [F.col(f"`{c}`").asc_nulls_last() for c in ties]


def orderable(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType | T.VariantType)]


def latest(df: DataFrame, keys: list[str], order: tuple[str, ...], keep_null_keys: bool = False) -> DataFrame:
    """One row per key: the first by the order. With keep_null_keys rows with a NULL in the key all stay."""
    kept = None
    if keep_null_keys:
        whole = [F.col(f"`{k}`").isNotNull() for k in keys]
        has_key = whole[0]
        for x in whole[1:]:
            has_key = has_key & x
        kept, df = df.where(~has_key), df.where(has_key)
    ordered = order_columns(order)
    if all(down for _, down in ordered):
        # NULL is the least in a struct, so the largest struct is the first by DESC NULLS LAST
        ranks = [F.expr(x).alias(f"o{i}") for i, (x, _) in enumerate(ordered)] + [F.col(f"`{c}`").alias(f"t{i}") for i, c in enumerate(orderable(df))]
        best = F.max_by(F.struct(*(F.col(f"`{c}`") for c in df.columns)), F.struct(*ranks))
        out = df.groupBy(*(F.col(f"`{k}`") for k in keys)).agg(best.alias("__row")).select("__row.*")
    else:
        w = Window.partitionBy(*keys).orderBy(*sort_keys(order, orderable(df)))
        out = df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
    return out if kept is None else out.unionByName(kept)


def typed(raw: DataFrame, spec: TableDefinition, typed_raw: bool = False) -> DataFrame:
    """The cast projection; columns that the raw data lack are NULL, and the provenance columns pass through."""
    there = {c.lower(): c for c in raw.columns}
    out = []
    for c in spec.ordered():
        if c.source_expression:
            out.append(cast_column(F.expr(c.source_expression), c, typed=True).alias(c.name))
            continue
        name = there.get(c.name.lower())
        out.append(cast_column(F.col(f"`{name}`") if name else F.lit(None).cast("string"), c, typed_raw).alias(c.name))
    own = {c.name.lower() for c in spec.columns}
    return raw.select(*out, *(F.col(m) for m in META if m in there and m not in own))


def upsert(old: DataFrame | None, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new replace those of old with the same key."""
    if old is None:
        return new
    return old.join(new.select(*keys).distinct(), _same(old, new, keys), "left_anti").unionByName(new, allowMissingColumns=True)


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    out = a[keys[0]].eqNullSafe(b[keys[0]])
    for k in keys[1:]:
        out = out & a[k].eqNullSafe(b[k])
    return out


def merged(old: DataFrame, new: DataFrame, spec: TableDefinition) -> DataFrame:
    """An upsert whose columns follow their merge strategies, with NULL keys alike and columns of either side kept: replace, keep_minimum, keep_maximum, keep_existing; a merge
    condition (on o and n, the old and the new row) limits when a new value is taken at all."""
    keys = list(spec.primary_key)
    o, n = F.col("o"), F.col("n")
    left = old.select(*(F.col(k).alias(f"__{i}") for i, k in enumerate(keys)), F.struct(*old.columns).alias("o"))
    right = new.select(*(F.col(k).alias(f"__{i}") for i, k in enumerate(keys)), F.struct(*new.columns).alias("n"))
    right = right.select(*(F.col(f"__{i}").alias(f"__n{i}") for i in range(len(keys))), "n")
    same = F.col("__0").eqNullSafe(F.col("__n0"))
    for i in range(1, len(keys)):
        same = same & F.col(f"__{i}").eqNullSafe(F.col(f"__n{i}"))
    both = left.join(right, same, "full_outer")
    strategies = {c.name: c for c in spec.columns}
    out = []
    for name in [*old.columns, *(c for c in new.columns if c not in old.columns)]:
        c, a, b = strategies.get(name), o[name] if name in old.columns else F.lit(None), n[name] if name in new.columns else F.lit(None)
        way = (c.merge_strategy if c else None) or "replace"
        if way not in ("replace", "keep_minimum", "keep_maximum", "keep_existing"):
            raise SpecError(f"merge strategy {way!r}")
        value = {"replace": b, "keep_minimum": F.least(a, b), "keep_maximum": F.greatest(a, b), "keep_existing": F.coalesce(a, b)}[way]
        if c and c.merge_condition:
            value = F.when(F.expr(c.merge_condition), value).otherwise(a)
        out.append(F.when(n.isNull(), a).when(o.isNull(), b).otherwise(value).alias(name))
    return both.select(*out)


def max_sequence(old: DataFrame | None, new: DataFrame, keys: list[str], order: tuple[str, ...]) -> DataFrame:
    """An upsert in which an older row never replaces a newer one, whichever batch it came in."""
    rows = new if old is None else old.unionByName(new, allowMissingColumns=True)
    return latest(rows, keys, order)


def excluded(new: DataFrame, conditions: tuple[str, ...], reference: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """new without the rows for which a condition holds; conditions see src, and xref, the row of reference with the same keys."""
    rows = new.select(F.struct(*new.columns).alias("src"), *(F.col(k).alias(f"__{k}") for k in keys or []))
    if reference is not None:
        other = reference.dropDuplicates(keys).select(F.struct(*reference.columns).alias("xref"), *(F.col(k).alias(f"__{k}") for k in keys))
        rows = rows.join(other, [f"__{k}" for k in keys], "left")
    for c in conditions:
        rows = rows.where(~F.coalesce(F.expr(c), F.lit(False)))
    return rows.select("src.*")


def apply_post_rules(df: DataFrame, rules: tuple[tuple[str, str, str], ...]) -> DataFrame:
    """(condition, column, expression): the column takes the expression's value where the condition holds; a new one is NULL elsewhere."""
    for condition, column, expression in rules:
        otherwise = F.col(column) if column in df.columns else F.lit(None)
        df = df.withColumn(column, F.when(F.expr(condition), F.expr(expression)).otherwise(otherwise))
    return df


def batch_rows(raw: DataFrame, spec: TableDefinition, typed_raw: bool = False, reference: DataFrame | None = None) -> DataFrame:
    """A batch's typed rows without those that the exclusions name; reference is the table whose rows they see as xref."""
    new = typed(raw, spec, typed_raw)
    if spec.ingestion.exclusions:
        new = excluded(new, spec.ingestion.exclusions, reference, list(spec.primary_key))
    return new


def ingest_batch(old: DataFrame | None, raw: DataFrame, spec: TableDefinition, typed_raw: bool = False, reference: DataFrame | None = None) -> DataFrame:
    """What the table holds after a batch. Snapshot replaces; incremental without a key appends; with one it upserts."""
    return after_batch(old, batch_rows(raw, spec, typed_raw, reference), spec)


def appends(spec: TableDefinition) -> bool:
    """Whether a batch only adds rows, so that the table need not be written again."""
    return spec.ingestion.mode != "snapshot" and not spec.primary_key


def after_batch(old: DataFrame | None, new: DataFrame, spec: TableDefinition) -> DataFrame:
    mode, keys = spec.ingestion, list(spec.primary_key)
    if mode.mode == "snapshot":
        out = new
    elif not keys:
        out = new if old is None else old.unionByName(new, allowMissingColumns=True)
    elif mode.policy == "max_sequence_wins":
        out = max_sequence(old, new, keys, mode.order_by)
    else:
        new = latest(new, keys, mode.order_by)
        out = merged(old, new, spec) if old is not None and any(c.merge_strategy for c in spec.columns) else upsert(old, new, keys)
    return apply_post_rules(out, mode.post_rules)


def scored_merge(sources: list[DataFrame], keys: list[str], stamps: list[str], with_source: bool = False) -> DataFrame:
    """Rows of several files, one per key: the one with most stamps equal to the key's latest, then of the first file, then by all columns."""
    if not keys:
        raise SpecError("a merge needs a primary key")
    rows = None
    for i, df in enumerate(sources):
        one = df.withColumn("merge_source", F.lit(i))
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
    # a window keeps rows with NULL in the key, and leaves them where the choice below looks for them: one shuffle for both
    by_key = Window.partitionBy(*keys)
    rows = rows.withColumns({f"__max_{s}": F.max(s).over(by_key) for s in stamps})
    score = sum((F.when(F.col(s) == F.col(f"__max_{s}"), 1).otherwise(0) for s in stamps), F.lit(0))
    rows = rows.withColumn("merge_score", score).drop(*(f"__max_{s}" for s in stamps))
    plain = [c for c in rows.columns if c not in ("merge_score", "merge_source")]
    first = F.min_by(F.struct(*rows.columns), F.struct((-F.col("merge_score")).alias("s"), "merge_source", *(F.col(c).alias(f"t_{c}") for c in plain)))
    out = rows.groupBy(*keys).agg(first.alias("r")).select("r.*")
    return out if with_source else out.drop("merge_source", "merge_score")
