"""Column types: Spark types, widening, reflection from Spark, information schemas and JDBC, and emitters of schemas."""

from __future__ import annotations

import json
import re

from pyspark.sql import types as T

from loomspec.spec import Column, SpecError, TableDefinition

#: Which type may become which without loss.
WIDENINGS = {("INTEGER", "DECIMAL"), ("INTEGER", "FLOAT"), ("CHAR", "VARCHAR"), ("CHAR", "TEXT"), ("VARCHAR", "TEXT"), ("DATE", "DATETIME"), ("DATE", "TIMESTAMP"), ("DATETIME", "TIMESTAMP")}
TEXT_TYPES = ("VARCHAR", "TEXT", "CHAR", "STRING")
NUMBERS = ("INTEGER", "INT", "BIGINT", "SMALLINT", "TINYINT", "DECIMAL", "FLOAT", "DOUBLE")
MOMENTS = ("DATE", "DATETIME", "TIMESTAMP")
_PLAIN = {"INTEGER": T.IntegerType(), "INT": T.IntegerType(), "BIGINT": T.LongType(), "SMALLINT": T.ShortType(), "TINYINT": T.ByteType(), "FLOAT": T.FloatType(), "DOUBLE": T.DoubleType(), "BOOLEAN": T.BooleanType(), "DATE": T.DateType(), "DATETIME": T.TimestampType(), "TIMESTAMP": T.TimestampType()}


def spark_type(c: Column) -> T.DataType:
    kind = c.type.upper()
    if kind in TEXT_TYPES:
        return T.StringType()
    if kind == "DECIMAL":
        return T.DecimalType(c.precision or 10, c.scale if c.scale is not None else 2)
    if kind == "EMBEDDING":
        return T.ArrayType(T.FloatType(), containsNull=False)
    return _PLAIN[kind]


def may_be_null(c: Column) -> bool:
    return any(c.nullable.values()) if isinstance(c.nullable, dict) else bool(c.nullable)


def struct_type(spec: TableDefinition, internal: bool = False) -> T.StructType:
    return T.StructType([T.StructField(c.output_name, spark_type(c), may_be_null(c), {"type": c.type} | ({"length": c.length} if c.length else {})) for c in spec.ordered() if internal or not c.internal])


def ddl(spec: TableDefinition) -> str:
    """CREATE TABLE text."""
    rows = [f"  `{c.output_name}` {spark_type(c).simpleString().upper()}{'' if may_be_null(c) else ' NOT NULL'}{f" COMMENT {sql_text(c.description)}" if c.description else ''}" for c in spec.ordered() if not c.internal]
    return f"CREATE TABLE `{spec.name}` (\n" + ",\n".join(rows) + "\n)"


def sql_text(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def json_schema(spec: TableDefinition) -> str:
    kinds = {"INTEGER": "integer", "INT": "integer", "BIGINT": "integer", "DECIMAL": "number", "FLOAT": "number", "DOUBLE": "number", "BOOLEAN": "boolean", "EMBEDDING": "array"}
    props = {}
    for c in spec.ordered():
        if c.internal:
            continue
        kind = kinds.get(c.type.upper(), "string")
        props[c.output_name] = {"type": [kind, "null"] if may_be_null(c) else kind} | ({"maxLength": c.length} if c.length and kind == "string" else {}) | ({"description": c.description} if c.description else {})
    return json.dumps({"$schema": "https://json-schema.org/draft/2020-12/schema", "title": spec.name, "type": "object", "properties": props, "required": [c.output_name for c in spec.ordered() if not c.internal and not may_be_null(c)]}, indent=2)


def widens(a: Column, b: Column) -> bool:
    """Whether every value of a is one of b."""
    x, y = a.type.upper(), b.type.upper()
    if x == y == "DECIMAL":
        ap, asc, bp, bs = a.precision or 10, a.scale if a.scale is not None else 2, b.precision or 10, b.scale if b.scale is not None else 2
        return bs >= asc and bp - bs >= ap - asc
    if x == y or (x, y) in WIDENINGS:
        return not (y in TEXT_TYPES and b.length and (not a.length or a.length > b.length))
    return False


def reflect_type(dtype: T.DataType) -> dict:
    """What a Spark type is in a specification; types without a counterpart become text."""
    if isinstance(dtype, T.DecimalType):
        return {"type": "DECIMAL", "precision": dtype.precision, "scale": dtype.scale}
    if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.FloatType | T.DoubleType):
        return {"type": "EMBEDDING"}
    for kinds, name in (((T.ByteType, T.ShortType, T.IntegerType, T.LongType), "INTEGER"), ((T.FloatType, T.DoubleType), "FLOAT"), ((T.BooleanType,), "BOOLEAN"), ((T.DateType,), "DATE"), ((T.TimestampType, T.TimestampNTZType), "TIMESTAMP")):
        if isinstance(dtype, kinds):
            return {"type": name}
    return {"type": "VARCHAR"}


def reflect_schema(name: str, schema: T.StructType, primary_key: tuple[str, ...] = ()) -> TableDefinition:
    return TableDefinition(name, tuple(Column(f.name, nullable=f.nullable, position=i + 1, **reflect_type(f.dataType)) for i, f in enumerate(schema.fields)), primary_key)


def reflect_sql_type(declared: str) -> dict:
    """From a declared SQL type, such as NVARCHAR(40) or numeric(10, 2)."""
    m = re.match(r"\s*([A-Za-z]+(?:\s+[A-Za-z]+)*)\s*(?:\(\s*(\d+|max)\s*(?:,\s*(\d+)\s*)?\))?", declared)
    if not m:
        raise SpecError(f"SQL type {declared!r}")
    base, first, second = m[1].upper(), m[2], m[3]
    base = base[1:] if base in ("NVARCHAR", "NCHAR", "NTEXT") else base
    size = int(first) if first and first.isdigit() else None
    if base in ("VARCHAR", "CHARACTER VARYING", "CHAR", "CHARACTER", "BPCHAR"):
        return {"type": "CHAR" if base in ("CHAR", "CHARACTER", "BPCHAR") else "VARCHAR"} | ({"length": size} if size else {})
    if base in ("DECIMAL", "NUMERIC", "MONEY", "SMALLMONEY"):
        return {"type": "DECIMAL", "precision": size or (19 if "MONEY" in base else 18), "scale": int(second or (4 if "MONEY" in base else 0))}
    for names, kind in ((("INT", "INTEGER", "BIGINT", "SMALLINT", "TINYINT", "SERIAL", "BIGSERIAL"), "INTEGER"), (("FLOAT", "REAL", "DOUBLE", "DOUBLE PRECISION"), "FLOAT"), (("BOOL", "BOOLEAN", "BIT"), "BOOLEAN"), (("DATE",), "DATE"), (("DATETIME", "SMALLDATETIME"), "DATETIME"), (("TIMESTAMP", "TIMESTAMPTZ", "TIMESTAMP WITH TIME ZONE", "TIMESTAMP WITHOUT TIME ZONE"), "TIMESTAMP"), (("TEXT", "CLOB"), "TEXT")):
        if base in names:
            return {"type": kind}
    return {"type": "VARCHAR"}


def reflect_information_schema(columns: list[dict], keys: list[dict] = (), references: list[dict] = ()) -> list[TableDefinition]:
    """Specifications from rows of INFORMATION_SCHEMA: columns (table_name, column_name, data_type, is_nullable,
    ordinal_position), primary keys (table_name, column_name, ordinal_position), and foreign keys (table_name, column_name,
    referenced_table, referenced_column, ordinal_position). Composite keys keep the order of their ordinals."""
    out = []
    for table in sorted({c["table_name"] for c in columns}):
        own = sorted((c for c in columns if c["table_name"] == table), key=lambda c: c["ordinal_position"])
        pk = [k["column_name"] for k in sorted((k for k in keys if k["table_name"] == table), key=lambda k: k["ordinal_position"])]
        fk = [(r["column_name"], r["referenced_table"], r["referenced_column"]) for r in sorted((r for r in references if r["table_name"] == table), key=lambda r: (r["referenced_table"], r["ordinal_position"]))]
        out.append(TableDefinition(table, tuple(Column(c["column_name"], nullable=str(c.get("is_nullable", "YES")).upper() == "YES", position=c["ordinal_position"], **reflect_sql_type(c["data_type"])) for c in own), tuple(pk), foreign_keys=tuple(fk)))
    return out
