"""Table specifications: frozen, validated descriptions of tables, their sources, derivations, joins, ingestion and rules."""

from __future__ import annotations

import dataclasses
import json
import re
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

#: The closed set of column types, and the spellings that emitters also take.
TYPES = ("VARCHAR", "DECIMAL", "INTEGER", "DATE", "DATETIME", "TIMESTAMP", "BOOLEAN", "TEXT", "CHAR", "FLOAT", "EMBEDDING")
ALSO = ("STRING", "DOUBLE", "INT", "BIGINT", "SMALLINT", "TINYINT")
NAME = re.compile(r"[A-Za-z][A-Za-z0-9_]{0,127}")


class SpecError(ValueError):
    """A specification that cannot be used as it is."""


@dataclass(frozen=True)
class JoinVia:
    """A lookup table between a source and the base: source rows reach the base through it."""

    table: str
    source_key: str
    lookup_key: str
    base_key: str


@dataclass(frozen=True)
class Candidate:
    """One way to fill a column: a column or an expression of a table, for sources of less and less priority."""

    table: str | None = None
    column: str | None = None
    expression: str | None = None
    priority: int | None = None
    row_filter: str | None = None
    order_by: tuple[str, ...] = ()
    table_instance: str | None = None
    union_value: Any = None
    join_via: JoinVia | None = None

    def __post_init__(self):
        if self.column is None and self.expression is None and self.union_value is None:
            raise SpecError("a candidate needs a column, an expression or a union value")

    @property
    def source(self) -> str | None:
        return self.table_instance or self.table


@dataclass(frozen=True)
class Derivation:
    candidates: tuple[Candidate, ...] = ()
    strategy: str | None = None  # priority (default), max_across_sources, most_recent, longest_value, primary_key, base_column
    default: Any = None


@dataclass(frozen=True)
class Column:
    name: str
    type: str = "VARCHAR"
    length: int | None = None
    precision: int | None = None
    scale: int | None = None
    format: str | None = None
    dimension: int | None = None
    nullable: bool | dict[str, bool] = True
    derivation: Derivation | None = None
    default: Any = None
    description: str = ""
    domain_type: str | None = None
    position: int | None = None
    canonical_name: str | None = None
    aliases: tuple[str, ...] = ()
    null_output_value: str | None = None
    merge_strategy: str | None = None  # replace, keep_minimum, keep_maximum, keep_existing
    merge_condition: str | None = None
    internal: bool = False
    source_expression: str | None = None

    def __post_init__(self):
        if not NAME.fullmatch(self.name):
            raise SpecError(f"column name {self.name!r}")
        if self.type.upper() not in TYPES + ALSO:
            raise SpecError(f"type {self.type!r} of {self.name}")

    @property
    def output_name(self) -> str:
        return self.canonical_name or self.name


@dataclass(frozen=True)
class Relationship:
    """How a table joins the base. keys are pairs of expressions, on the base and on the table."""

    table: str
    keys: tuple[tuple[str, str], ...] = ()
    how: str = "left"
    cardinality: str = "N:1"
    filter: str | None = None
    instance: str | None = None
    strategy: str | None = None  # direct, first_record, pivot; inferred where it is not given
    order_by: tuple[str, ...] = ()
    paths: tuple[tuple[tuple[str, str], ...], ...] = ()
    bridge: str | None = None
    bridge_keys: tuple[tuple[str, str], ...] = ()
    pivot_column: str | None = None
    confidence: float = 1.0

    @property
    def alias(self) -> str:
        return self.instance or self.table


@dataclass(frozen=True)
class Metadata:
    """Directives for the plan of a derived table."""

    base_table: str | None = None
    base_strategy: str = "base_table"  # base_table, union_sources, union_branches, unpivot, aggregate_source
    base_filter: str | None = None
    union_sources: tuple[tuple[str, str], ...] = ()  # (table, key expression)
    union_key: str | None = None
    union_mode: str = "all"
    branches: tuple[str, ...] = ()
    branch_filters: dict[str, str] = field(default_factory=dict)
    branch_dedup: dict[str, tuple[str, ...]] = field(default_factory=dict)
    overlap: str | None = None  # exclude_base or coalesce_base
    unpivot_columns: tuple[str, ...] = ()
    unpivot_value: str = "value"
    unpivot_dedup: tuple[str, ...] = ()
    unpivot_key: tuple[str, ...] = ()
    final_filter: str | None = None
    final_dedup: str | None = None  # distinct or latest
    final_order: tuple[str, ...] = ()
    hub_score: float | None = None


@dataclass(frozen=True)
class Source:
    kind: str = "delimited"
    path: str | None = None
    options: dict[str, Any] = field(default_factory=dict)
    projection: dict[str, str] = field(default_factory=dict)
    filename_pattern: str | None = None
    filename_columns: tuple[str, ...] = ()

    def __post_init__(self):
        if self.kind not in ("delimited", "parquet", "json", "jdbc"):
            raise SpecError(f"source kind {self.kind!r}")
        if self.kind == "jdbc" and ("dbtable" in self.options) == ("query" in self.options):
            raise SpecError("a jdbc source needs exactly one of dbtable and query")


@dataclass(frozen=True)
class Ingestion:
    mode: str = "snapshot"  # or incremental
    order_by: tuple[str, ...] = ("_load_ts",)
    policy: str = "last_batch_wins"  # or max_sequence_wins
    exclusions: tuple[str, ...] = ()
    post_rules: tuple[tuple[str, str, str], ...] = ()  # (condition, column, expression)


@dataclass(frozen=True)
class Rule:
    """A check. kwargs are the rule's own parameters; stage is raw, ingested or None to be classified by type."""

    type: str
    column: str | None = None
    kwargs: dict[str, Any] = field(default_factory=dict)
    severity: str = "warning"
    blocking: bool = False
    stage: str | None = None
    row_condition: str | None = None
    name: str | None = None

    @property
    def id(self) -> str:
        return self.name or "_".join(x for x in (self.type, self.column) if x)


@dataclass(frozen=True)
class TableDefinition:
    name: str
    columns: tuple[Column, ...] = ()
    primary_key: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    foreign_keys: tuple[tuple[str, str, str], ...] = ()  # (column, table, column)
    relationships: tuple[Relationship, ...] = ()
    metadata: Metadata = field(default_factory=Metadata)
    source: Source | None = None
    ingestion: Ingestion = field(default_factory=Ingestion)
    rules: tuple[Rule, ...] = ()
    context_column: str | None = None
    version: str = "1.0"
    description: str = ""

    def __post_init__(self):
        names = [c.name.lower() for c in self.columns]
        if len(set(names)) < len(names):
            raise SpecError(f"repeated column names in {self.name}")
        if missing := [k for k in self.primary_key if k.lower() not in names] if names else []:
            raise SpecError(f"primary key columns that {self.name} lacks: {missing}")

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name == name:
                return c
        raise SpecError(f"{self.name} has no column {name}")

    def ordered(self) -> list[Column]:
        """Columns in output order: by position, then by name."""
        return sorted(self.columns, key=lambda c: (c.position is None, c.position or 0, c.name))


_PARTS = {"columns": Column, "relationships": Relationship, "metadata": Metadata, "source": Source, "ingestion": Ingestion, "rules": Rule, "derivation": Derivation, "candidates": Candidate, "join_via": JoinVia}


def _tupled(x: Any) -> Any:
    return tuple(_tupled(y) for y in x) if isinstance(x, list | tuple) else x


def _build(kind: type, raw: dict[str, Any]) -> Any:
    known = {f.name: f for f in dataclasses.fields(kind)}
    if extra := set(raw) - set(known):
        raise SpecError(f"{kind.__name__} has no {sorted(extra)}")
    made = {}
    for k, v in raw.items():
        part = _PARTS.get(k)
        if part and isinstance(v, list | tuple):
            made[k] = tuple(_build(part, x) if isinstance(x, dict) else x for x in v)
        elif part and isinstance(v, dict):
            made[k] = _build(part, v)
        else:
            made[k] = {a: _tupled(b) for a, b in v.items()} if isinstance(v, dict) else _tupled(v)
    return kind(**made)


def from_dict(raw: dict[str, Any]) -> TableDefinition:
    return _build(TableDefinition, raw)


def to_dict(spec: Any) -> dict[str, Any]:
    """Only what differs from the defaults."""
    out = {}
    for f in dataclasses.fields(spec):
        v = getattr(spec, f.name)
        default = f.default if f.default is not dataclasses.MISSING else f.default_factory() if f.default_factory is not dataclasses.MISSING else dataclasses.MISSING
        if v == default:
            continue
        out[f.name] = _plain(v)
    return out


def _plain(v: Any) -> Any:
    if dataclasses.is_dataclass(v):
        return to_dict(v)
    if isinstance(v, list | tuple):
        return [_plain(x) for x in v]
    if isinstance(v, dict):
        return {k: _plain(x) for k, x in v.items()}
    return v


def load(path: str | Path) -> TableDefinition:
    """From a JSON or YAML file, or a folder of table.yaml and columns/*.yaml."""
    path = Path(path)
    if path.is_dir():
        import yaml

        raw = yaml.safe_load((path / "table.yaml").read_text())
        raw["columns"] = [yaml.safe_load(p.read_text()) for p in sorted((path / "columns").glob("*.yaml"))]
        return from_dict(raw)
    if path.suffix == ".json":
        return from_dict(json.loads(path.read_text()))
    import yaml

    return from_dict(yaml.safe_load(path.read_text()))


def save(spec: TableDefinition, path: str | Path) -> None:
    """As JSON or YAML by the suffix; without one, as a folder."""
    path = Path(path)
    raw = to_dict(spec)
    if path.suffix == ".json":
        path.write_text(json.dumps(raw, indent=2, sort_keys=True))
        return
    import yaml

    if path.suffix:
        path.write_text(yaml.safe_dump(raw, sort_keys=True))
        return
    (path / "columns").mkdir(parents=True, exist_ok=True)
    for c in raw.pop("columns", []):
        (path / "columns" / f"{c['name']}.yaml").write_text(yaml.safe_dump(c, sort_keys=True))
    (path / "table.yaml").write_text(yaml.safe_dump(raw, sort_keys=True))
