"""Which table is the base of a derived table, how the others join it, and in which order."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from loomspec.spec import Candidate, Relationship, SpecError, TableDefinition

#: Words that mark an expression as an aggregate where no analyzer is at hand.
AGGREGATES = re.compile(r"\b(COUNT|MIN|MAX|MAX_BY|MIN_BY|SUM|AVG|FIRST|LAST|STDDEV|COLLECT_LIST|COLLECT_SET)\s*\(", re.I)
QUOTED = re.compile(r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*|/\*.*?\*/""", re.S)
MANY = ("1:N", "1:0..N", "N:M")


@dataclass(frozen=True)
class Resolved:
    base: str | None
    joins: tuple[Relationship, ...]
    aggregated: dict[str, tuple[str, ...]]  # source -> target columns that aggregate it


def is_aggregate(expression: str | None) -> bool:
    """Words within literals, quoted names and comments are none of the expression's own."""
    return bool(expression and AGGREGATES.search(QUOTED.sub(" ", expression)))


def candidates(target: TableDefinition) -> list[tuple[str, Candidate]]:
    return [(c.name, x) for c in target.columns if c.derivation for x in c.derivation.candidates]


def contributions(target: TableDefinition) -> dict[str, int]:
    """How many columns each source (table or instance) may fill."""
    out: dict[str, int] = {}
    for _, x in candidates(target):
        if x.source:
            out[x.source] = out.get(x.source, 0) + 1
    return out


def infer_base(target: TableDefinition, specs: dict[str, TableDefinition]) -> str | None:
    """The declared base; else, of the contributing tables, the one with the highest hub score, then most relationships, then the first name."""
    if target.metadata.base_table:
        return target.metadata.base_table
    if target.metadata.base_strategy in ("union_sources", "union_branches"):
        return None  # the base is made of keys or branches, no table
    tables = sorted({x.table for _, x in candidates(target) if x.table})
    if not tables:
        return None
    rank = lambda t: (-(specs[t].metadata.hub_score or 0) if t in specs else 0, -len(specs[t].relationships) if t in specs else 0, t)
    return min(tables, key=rank)


def infer_keys(base: TableDefinition, other: TableDefinition) -> tuple[tuple[str, str], ...]:
    """Shared primary key columns; else a shared key that looks like a member's, client's or user's; else any shared id."""
    ours, theirs = {c.name.lower(): c.name for c in base.columns}, {c.name.lower(): c.name for c in other.columns}
    shared = [k for k in (x.lower() for x in other.primary_key) if k in ours]
    if shared and len(shared) == len(other.primary_key):
        return tuple((ours[k], theirs[k]) for k in shared)
    both = sorted(set(ours) & set(theirs))
    for pattern in (r".*(member|client|user|key).*id", r".*(_id|id)"):
        if hit := [k for k in both if re.fullmatch(pattern, k)]:
            return ((ours[hit[0]], theirs[hit[0]]),)
    raise SpecError(f"no join keys between {base.name} and {other.name}")


def score(r: Relationship, target: TableDefinition, specs: dict[str, TableDefinition]) -> float:
    """Of several relationships to a table the best: by confidence, cardinality, keys that are primary, and contribution."""
    by_cardinality = {"1:1": 5, "N:1": 3, "1:N": -2, "1:0..N": -2}.get(r.cardinality, 0)
    primary = 2 if r.table in specs and set(specs[r.table].primary_key) == {b for _, b in r.keys} and r.keys else 0
    return 10 * r.confidence + by_cardinality + primary + contributions(target).get(r.alias, 0)


def infer_strategy(r: Relationship, target: TableDefinition) -> str:
    """1:N joins pivot where the target has numbered columns of one source column, and take the first record otherwise."""
    if r.strategy:
        return r.strategy
    if r.paths:
        return "alternative_path"
    if r.how == "full_outer" or r.cardinality not in MANY:
        return "direct"
    return "pivot" if len(numbered(target, r)) >= 2 else "first_record"


def numbered(target: TableDefinition, r: Relationship) -> list[tuple[str, int]]:
    """(target column, n) of columns name_1, name_2, ... that one source column of r fills."""
    out = []
    for name, x in candidates(target):
        if x.source == r.alias and (m := re.fullmatch(r".*_(\d+)", name)):
            out.append((name, int(m[1])))
    return sorted(out, key=lambda p: p[1])


def resolve(target: TableDefinition, specs: dict[str, TableDefinition]) -> Resolved:
    base = infer_base(target, specs)
    counts = contributions(target)
    declared: dict[str, Relationship] = {}
    for r in (*(specs[base].relationships if base in specs else ()), *target.relationships):
        if r.alias not in declared or score(r, target, specs) > score(declared[r.alias], target, specs):
            declared[r.alias] = r
    by_source: dict[str, list[tuple[str, Candidate]]] = {}
    for name, x in candidates(target):
        if x.source and x.source != base:
            by_source.setdefault(x.source, []).append((name, x))
    aggregated = {s: tuple(n for n, _ in xs) for s, xs in by_source.items() if all(is_aggregate(x.expression) or x.order_by for _, x in xs)}
    bridges = {r.bridge for r in declared.values() if r.bridge}
    joins = []
    for source, xs in by_source.items():
        if target.metadata.base_strategy in ("union_branches", "aggregate_source"):
            continue
        r = declared.get(source)
        if r is None:
            table = xs[0][1].table
            if base not in specs or table not in specs:
                raise SpecError(f"{target.name} has no relationship to {source}")
            r = Relationship(table, infer_keys(specs[base], specs[table]), cardinality="1:0..N", instance=xs[0][1].table_instance, confidence=0.5)
        if source not in aggregated:
            joins.append(replace(r, strategy=infer_strategy(r, target)))
    joins = [r for r in joins if r.alias not in bridges or r.alias in counts]
    joins.sort(key=lambda r: (-counts.get(r.alias, 0), r.table, r.instance or ""))
    return Resolved(base, tuple(joins), aggregated if target.metadata.base_strategy not in ("union_branches", "aggregate_source") else {})
