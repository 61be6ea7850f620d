"""From the specification of a derived table to a DataFrame: base, joins, pre-aggregations, survivorship, final filter and dedup.

Nothing is emitted as text: expressions of a candidate are evaluated in the scope of their own source before it joins, and
Catalyst plans the rest. Variables in double braces are put into expressions first.
"""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspec.operators import relational as R
from loomspec.operators.ingest import latest
from loomspec.plans.resolve import Resolved, candidates, is_aggregate, numbered, resolve
from loomspec.schema import TEXT_TYPES, spark_type
from loomspec.spec import Candidate, SpecError, TableDefinition
from loomspec.spec import Column as ColumnSpec


class Compiler:
    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], specs: dict[str, TableDefinition] | None = None, variables: dict[str, str] | None = None):
        self.spark, self.variables = spark, variables or {}
        self.specs = specs or {}
        self.tables = {name: self._overlaid(name, df) for name, df in tables.items()}

    def _text(self, x: str | None) -> str | None:
        if x is None:
            return None

        def put(m: re.Match) -> str:
            if m[1] not in self.variables:
                raise SpecError(f"no variable {m[1]!r}")
            return str(self.variables[m[1]])

        return re.sub(r"\{\{\s*(\w+)\s*\}\}", put, x)

    def _overlaid(self, name: str, df: DataFrame) -> DataFrame:
        """Computed columns of a source's own specification take the place of physical ones."""
        if name not in self.specs:
            return df
        own = {c.name: F.expr(self._text(c.source_expression)) for c in self.specs[name].columns if c.source_expression}
        return df.withColumns(own) if own else df

    def _table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise SpecError(f"no table {name!r}")
        return self.tables[name]

    def compile(self, target: TableDefinition) -> DataFrame:
        plan = resolve(target, self.specs)
        frame = self._base(target, plan)
        for r in plan.joins:
            frame = self._join(frame, target, r)
        for source, names in plan.aggregated.items():
            frame = self._aggregate(frame, target, plan, source, names)
        return self._final(frame, target, plan)

    # base views

    def _base(self, target: TableDefinition, plan: Resolved) -> DataFrame:
        m = target.metadata
        if m.base_strategy == "union_sources":
            return R.key_universe([(self._table(t), self._text(k)) for t, k in m.union_sources], m.union_key or target.primary_key[0])
        if m.base_strategy == "union_branches":
            return self._branches(target)
        if plan.base is None:
            return self.spark.range(1).select(F.lit(1).alias("__one"))
        base = self._table(plan.base)
        if m.base_filter:
            base = base.where(F.expr(self._text(m.base_filter)))
        if m.base_strategy == "unpivot":
            if m.unpivot_dedup:
                base = latest(base, list(m.unpivot_key or target.primary_key), m.unpivot_dedup)
            ids = [c for c in base.columns if c not in m.unpivot_columns]
            return R.unpivot(base, ids, m.unpivot_columns, m.unpivot_value)
        if m.base_strategy == "aggregate_source":
            return self._grouped(base, target, plan.base)
        return base

    def _grouped(self, base: DataFrame, target: TableDefinition, name: str) -> DataFrame:
        keys, aggregates = [], []
        for column, x in candidates(target):
            if x.table not in (None, name):
                raise SpecError(f"{target.name}: an aggregated source is read alone, not {x.table}")
            if is_aggregate(x.expression):
                aggregates.append(F.expr(self._text(x.expression)).alias(column))
            else:
                keys.append(F.expr(self._text(x.expression or x.column)).alias(column))
        if not keys:
            raise SpecError(f"{target.name}: an aggregated source needs a key")
        return base.groupBy(*keys).agg(*aggregates)

    def _branches(self, target: TableDefinition) -> DataFrame:
        m, out = target.metadata, []
        for table in m.branches:
            df = self._table(table)
            if table in m.branch_filters:
                df = df.where(F.expr(self._text(m.branch_filters[table])))
            columns = []
            for c in target.ordered():
                own = [x for x in (c.derivation.candidates if c.derivation else ()) if x.table == table]
                if not own:
                    columns.append(F.lit(None).cast(spark_type(c)).alias(c.name))
                elif own[0].union_value is not None:
                    columns.append(F.lit(own[0].union_value).cast(spark_type(c)).alias(c.name))
                else:
                    if own[0].row_filter:
                        df = df.where(F.expr(self._text(own[0].row_filter)))
                    columns.append(F.expr(self._text(own[0].expression or own[0].column)).cast(spark_type(c)).alias(c.name))
            meta = [F.col(x) for x in df.columns if x.startswith("meta_") and x not in {c.name for c in target.columns}]
            order = m.branch_dedup.get(table, ())
            extra = [F.expr(x.rsplit(" ", 1)[0] if x.lower().endswith((" asc", " desc")) else x).alias(f"__o{i}") for i, x in enumerate(order)]
            branch = df.select(*columns, *meta, *extra)
            if order:
                ways = tuple(f"__o{i} {x.rsplit(' ', 1)[1] if x.lower().endswith((' asc', ' desc')) else 'desc'}" for i, x in enumerate(order))
                branch = latest(branch, list(target.primary_key), ways).drop(*(f"__o{i}" for i in range(len(order))))
            out.append(branch)
        if m.overlap:
            if len(out) != 2:
                raise SpecError(f"{target.name}: an overlap is between two branches")
            way = {"exclude_base": R.union_exclude_base, "coalesce_base": R.union_coalesce_base}[m.overlap]
            return way(out[0], out[1], target.primary_key)
        return R.union_branches(out, m.union_mode == "distinct")

    # joins

    def _sources(self, target: TableDefinition, r) -> DataFrame:
        """The joined table with the expressions that the target's candidates want of it."""
        df = self._table(r.table)
        wanted = {name: x for name, x in candidates(target) if x.source == r.alias and x.expression}
        return df.withColumns({f"__x_{n}": F.expr(self._text(x.expression)) for n, x in wanted.items()}) if wanted else df

    def _join(self, frame: DataFrame, target: TableDefinition, r) -> DataFrame:
        right, where = self._sources(target, r), self._text(r.filter)
        keys = [(self._text(a), self._text(b)) for a, b in r.keys]
        if r.strategy == "alternative_path":
            return R.alternative_path_join(frame, right, r.alias, r.paths, r.how, where)
        if r.bridge:
            if where:
                right = right.where(F.expr(where))
            return R.bridge_join(frame, self._table(r.bridge), right, f"{r.alias}_via_{r.bridge}", r.alias, keys, r.bridge_keys, r.how)
        if r.strategy == "first_record":
            return R.first_record_join(frame, right, r.alias, keys, r.order_by or self._first_order(right), r.how, where)
        if r.strategy == "pivot":
            slots = numbered(target, r)
            column = r.pivot_column or next(x.column for n, x in candidates(target) if x.source == r.alias and n == slots[0][0])
            return R.pivot_join(frame, right, r.alias, keys, column, max(n for _, n in slots), r.order_by, where)
        return R.direct_join(frame, right, r.alias, keys, r.how, where)

    @staticmethod
    def _first_order(right: DataFrame) -> tuple[str, ...]:
        """Without a declared order: a type column, then a name column."""
        named = lambda word: sorted(c for c in right.columns if word in c.lower())[:1]
        return tuple(f"{c} asc" for c in dict.fromkeys(named("type") + named("name")))

    def _aggregate(self, frame: DataFrame, target: TableDefinition, plan: Resolved, source: str, names: tuple[str, ...]) -> DataFrame:
        found = [(n, x) for n, x in candidates(target) if x.source == source and n in names]
        first = found[0][1]
        r = next((x for x in (*target.relationships, *(self.specs[plan.base].relationships if plan.base in self.specs else ())) if x.alias == source), None)
        key = target.primary_key[0] if target.primary_key else None
        pairs = list(r.keys) if r else [(key, key)]
        df = self._table(first.table)
        groups: dict[tuple, list[tuple[str, Candidate]]] = {}
        for n, x in found:
            groups.setdefault((x.row_filter, x.order_by, x.join_via), []).append((n, x))
        for (row_filter, order_by, via), xs in groups.items():
            where = self._text(row_filter)
            on = [b for _, b in pairs]
            if order_by:
                columns = {n: x.column or re.fullmatch(r"\s*MAX_BY\s*\(\s*([^,]+),.*", self._text(x.expression), re.I | re.S)[1] for n, x in xs}
                rows = df.withColumns({f"__x_{n}": F.expr(c) for n, c in columns.items()})
                other = R.window_aggregate(rows, on, [f"__x_{n}" for n, _ in xs], order_by, where)
                other = other.select(*(f"__k{i}" for i in range(len(on))), *(F.col(f"__x_{n}").alias(f"{source}____x_{n}") for n, _ in xs))
            else:
                lookup = self._table(via.table) if via else None
                other = R.pre_aggregate(df, on, {f"{source}____x_{n}": self._text(x.expression) for n, x in xs}, where, lookup, (via.source_key, via.lookup_key, via.base_key) if via else None)
            condition = None
            for i, (a, _) in enumerate(pairs):
                one = F.expr(a) == F.col(f"__k{i}")
                condition = one if condition is None else condition & one
            frame = frame.join(other, condition, "left").drop(*(f"__k{i}" for i in range(len(pairs))))
        return frame

    # final columns

    def _value(self, frame: DataFrame, target: TableDefinition, plan: Resolved, column: ColumnSpec, x: Candidate) -> Column:
        if x.source is None or x.source == plan.base:
            return F.expr(self._text(x.expression)) if x.expression else F.col(x.column)
        if x.expression or x.order_by:
            return F.col(f"{x.source}____x_{column.name}")
        joined = next((r for r in plan.joins if r.alias == x.source), None)
        if joined is not None and joined.strategy == "pivot":
            n = dict(numbered(target, joined)).get(column.name)
            if n is not None:
                return F.col(f"{x.source}__{joined.pivot_column or x.column}_{n}")
        return F.col(f"{x.source}__{x.column}")

    def column(self, frame: DataFrame, target: TableDefinition, plan: Resolved, c: ColumnSpec) -> Column:
        d, kind = c.derivation, spark_type(c)
        default = d.default if d and d.default is not None else c.default
        literal = F.lit(default).cast(kind) if default is not None else None
        if target.metadata.base_strategy in ("union_branches", "aggregate_source") or d and d.strategy in ("primary_key", "base_column"):
            return F.col(c.name).cast(kind)
        if not d or not d.candidates:
            if literal is None and plan.base is not None and c.name in frame.columns and (target.metadata.base_strategy != "base_table" or c.name in target.primary_key):
                return F.col(c.name).cast(kind)
            if literal is None and c.name in target.primary_key:
                return F.col(c.name).cast(kind)
            return (F.lit(None) if literal is None else literal).cast(kind)
        ordered = sorted(d.candidates, key=lambda x: 999 if x.priority is None else x.priority)
        values = [self._value(frame, target, plan, c, x) for x in ordered]
        stamps = [self._value(frame, target, plan, c, replace(x, column=x.order_by[0], expression=None, order_by=())) for x in ordered] if d.strategy == "most_recent" else ()
        return R.survivor(values, d.strategy, literal, c.type.upper() in TEXT_TYPES, stamps).cast(kind)

    def _final(self, frame: DataFrame, target: TableDefinition, plan: Resolved) -> DataFrame:
        m = target.metadata
        columns = [self.column(frame, target, plan, c).alias(c.output_name) for c in target.ordered()]
        taken = {c.output_name for c in target.columns}
        meta = [F.col(f"`{x}`") for x in frame.columns if (x.startswith("meta_") or "__meta_" in x) and x not in taken]
        extra = [F.expr(x.rsplit(" ", 1)[0] if x.lower().endswith((" asc", " desc")) else x).alias(f"__o{i}") for i, x in enumerate(m.final_order)] if m.final_dedup == "latest" else []
        out = frame.select(*columns, *meta, *extra)
        if m.final_filter:
            out = out.where(F.expr(self._text(m.final_filter)))
        if m.final_dedup == "distinct":
            out = out.distinct()
        elif m.final_dedup == "latest":
            ways = tuple(f"__o{i} {x.rsplit(' ', 1)[1] if x.lower().endswith((' asc', ' desc')) else 'desc'}" for i, x in enumerate(m.final_order))
            out = latest(out, list(target.primary_key), ways, keep_null_keys=True).drop(*(f"__o{i}" for i in range(len(extra))))
        return out


def compile_table(spark: SparkSession, target: TableDefinition, tables: dict[str, DataFrame], specs: dict[str, TableDefinition] | None = None, variables: dict[str, str] | None = None) -> DataFrame:
    return Compiler(spark, tables, specs, variables).compile(target)
