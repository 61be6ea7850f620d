"""The graph of tables: build order, cycles, dangling references, reverse lineage, fingerprints, compatibility and change sets."""

from __future__ import annotations

import hashlib
import json
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame, SparkSession

from loomspec.plans.resolve import candidates, is_aggregate
from loomspec.schema import may_be_null, widens
from loomspec.spec import SpecError, TableDefinition, to_dict


def inputs(spec: TableDefinition) -> set[str]:
    """The tables that a derived table reads."""
    m = spec.metadata
    found = {x.table for _, x in candidates(spec) if x.table} | {r.table for r in spec.relationships} | {r.bridge for r in spec.relationships if r.bridge}
    found |= {t for t, _ in m.union_sources} | set(m.branches) | ({m.base_table} if m.base_table else set())
    return found - {spec.name}


def build_order(specs: dict[str, TableDefinition]) -> list[str]:
    """Inputs before what is made of them; ties by name. A cycle is an error that names it."""
    sorter = TopologicalSorter({n: sorted(inputs(s) & set(specs)) for n, s in sorted(specs.items())})
    try:
        return list(sorter.static_order())
    except CycleError as e:
        raise SpecError(f"cycle: {' -> '.join(e.args[1])}") from e


def dangling(specs: dict[str, TableDefinition]) -> list[tuple[str, str, str]]:
    """(table, kind, reference) of references to tables or columns that no specification has."""
    out = []
    for n, s in sorted(specs.items()):
        out += [(n, "table", t) for t in sorted(inputs(s) - set(specs))]
        for _, x in candidates(s):
            if x.table in specs and x.column and x.column not in {c.name for c in specs[x.table].columns}:
                out.append((n, "column", f"{x.table}.{x.column}"))
        for column, table, other in s.foreign_keys:
            if table not in specs or other not in {c.name for c in specs[table].columns}:
                out.append((n, "foreign key", f"{column} -> {table}.{other}"))
    return out


def roles(specs: dict[str, TableDefinition]) -> dict[str, str]:
    """SOURCE without inputs, GOLD where nothing reads it, INTERMEDIATE between; INGESTED has a source of its own."""
    read = {t for s in specs.values() for t in inputs(s)}
    return {n: ("INGESTED" if s.source else "SOURCE") if not inputs(s) else "INTERMEDIATE" if n in read else "GOLD" for n, s in specs.items()}


def to_materialize(specs: dict[str, TableDefinition]) -> set[str]:
    """Derived tables that several others read."""
    readers = {n: sum(n in inputs(s) for s in specs.values()) for n in specs}
    return {n for n, k in readers.items() if k > 1 and inputs(specs[n])}


def consumers(spark: SparkSession, specs: dict[str, TableDefinition]) -> DataFrame:
    """Reverse lineage: (source_table, source_column, target_table, target_column, usage)."""
    rows = []
    for n, s in sorted(specs.items()):
        for column, x in candidates(s):
            if x.table:
                rows.append((x.table, x.column or x.expression, n, column, "aggregate" if is_aggregate(x.expression) else "expression" if x.expression else "column"))
        for r in s.relationships:
            rows += [(r.table, b, n, a, "join key") for a, b in r.keys]
    return spark.createDataFrame(rows, "source_table string, source_column string, target_table string, target_column string, usage string")


def fingerprint(spec: TableDefinition) -> str:
    return hashlib.sha256(json.dumps(to_dict(spec), sort_keys=True, default=str).encode()).hexdigest()


def changed(old: dict[str, TableDefinition], new: dict[str, TableDefinition]) -> list[str]:
    """Tables to build again: those whose specification differs, and all that are made of them, in build order."""
    dirty = {n for n, s in new.items() if n not in old or fingerprint(old[n]) != fingerprint(s)}
    out = []
    for n in build_order(new):
        if n in dirty or inputs(new[n]) & dirty:
            dirty.add(n)
            out.append(n)
    return out


def compatibility(old: TableDefinition, new: TableDefinition) -> list[tuple[str, str, bool]]:
    """(change, column, breaking) between two versions; a column is the same if its name or an alias is."""
    out, before = [], {c.name: c for c in old.columns}
    after = {c.name: c for c in new.columns}
    renamed = {a: c.name for c in new.columns for a in c.aliases if a in before and a not in after}
    for n, c in before.items():
        if n in renamed:
            out.append(("renamed", n, False))
        other = after.get(renamed.get(n, n))
        if other is None:
            out.append(("removed", n, True))
            continue
        if (c.type, c.length, c.precision, c.scale) != (other.type, other.length, other.precision, other.scale):
            out.append(("type", n, not widens(c, other)))
        if may_be_null(c) != may_be_null(other):
            out.append(("nullability", n, may_be_null(c)))
    for n, c in after.items():
        if n not in before and n not in renamed.values():
            out.append(("added", n, not may_be_null(c) and c.default is None))
    if old.primary_key != new.primary_key:
        out.append(("primary key", ",".join(new.primary_key), True))
    return out


def diff(old: TableDefinition, new: TableDefinition) -> dict[str, list[str]]:
    """Added, removed and changed columns and rules."""
    out = {}
    for kind, a, b in (("columns", {c.name: c for c in old.columns}, {c.name: c for c in new.columns}), ("rules", {r.id: r for r in old.rules}, {r.id: r for r in new.rules})):
        out |= {f"{kind}_added": sorted(set(b) - set(a)), f"{kind}_removed": sorted(set(a) - set(b)), f"{kind}_changed": sorted(k for k in set(a) & set(b) if a[k] != b[k])}
    return out | {"metadata": sorted(k for k in {**to_dict(old.metadata), **to_dict(new.metadata)} if to_dict(old.metadata).get(k) != to_dict(new.metadata).get(k))}


def manifest(specs: dict[str, TableDefinition]) -> str:
    """What is built, in which order, from which specification, as JSON."""
    kinds = roles(specs)
    return json.dumps([{"table": n, "role": kinds[n], "inputs": sorted(inputs(specs[n])), "fingerprint": fingerprint(specs[n])} for n in build_order(specs)], indent=2)
