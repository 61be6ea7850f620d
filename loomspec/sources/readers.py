"""Readers by source kind. Delimited sources land as text; Parquet, JSON and JDBC keep their types."""

from __future__ import annotations

import csv
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspec.spec import Source, SpecError, TableDefinition

#: Names for record separators.
LINE_ENDS = {"CRLF": "\r\n", "LF": "\n", "CR": "\r"}
QUIRKS = ("skip_rows", "footer_rows", "line_terminator", "null_escape")


def csv_options(source: Source) -> dict[str, str]:
    o = source.options
    out = {"header": str(o.get("header", True)).lower(), "sep": o.get("delimiter", "|"), "inferSchema": "false", "encoding": o.get("encoding", "UTF-8"), "nullValue": o.get("null_value", "")}
    for ours, theirs in (("quote", "quote"), ("escape", "escape"), ("comment", "comment")):
        if o.get(ours) is not None:
            out[theirs] = o[ours]
    return out


def all_text(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_delimited(spark: SparkSession, spec: TableDefinition) -> DataFrame:
    source = spec.source
    if any(source.options.get(q) for q in QUIRKS):
        return read_quirky(spark, spec)
    reader = spark.read.options(**csv_options(source))
    if not source.options.get("header", True):
        reader = reader.schema(all_text([c.name for c in spec.columns]))
    return reader.csv(source.path)


def read_quirky(spark: SparkSession, spec: TableDefinition) -> DataFrame:
    """Preamble and trailer rows, record separators of several characters, comment lines, and an escape for NULL.

    A line's place is its file, the block of the file, and its number in the scan of that; preamble, header and trailer are
    each file's own. Only the places of their ends, a row for each file, are brought together, and only one header line
    reaches the driver: the first file's, which names the columns of all.
    """
    o = spec.source.options
    end = LINE_ENDS.get(o.get("line_terminator", "LF"), o.get("line_terminator", "\n"))
    reader = spark.read.option("lineSep", end) if end != "\n" else spark.read
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("__at")
    lines = reader.option("encoding", o.get("encoding", "UTF-8")).text(spec.source.path).select("value", F.col("_metadata.file_path").alias("__file"), at)
    lines = lines.where(F.trim("value") != "")
    if o.get("comment"):
        lines = lines.where(~F.col("value").startswith(o["comment"]))
    skip, foot, headed = int(o.get("skip_rows") or 0), int(o.get("footer_rows") or 0), bool(o.get("header", True))
    kept, header = lines, None
    if skip + headed:
        start = _nth(lines, skip + headed, F.col("__at").asc())
        kept = kept.join(F.broadcast(start.withColumnRenamed("__end", "__start")), "__file").where(F.col("__at") > F.col("__start"))
        if headed:
            first = start.where(F.col("__n") == skip + 1).orderBy("__file").first()
            if first is None:
                return spark.createDataFrame([], all_text([c.name for c in spec.columns]))
            header = lines.where((F.col("__file") == first["__file"]) & (F.col("__at.block") == first["__end"]["block"]) & (F.col("__at.line") == first["__end"]["line"])).first()["value"]
    if foot:
        kept = kept.join(F.broadcast(_nth(lines, foot, F.col("__at").desc()).select("__file", "__end")), "__file").where(F.col("__at") < F.col("__end"))
    sep, quote = o.get("delimiter", "|"), o.get("quote") or '"'
    if header is None:
        names = [c.name for c in spec.columns]
    else:
        names = [x.strip() for x in (next(csv.reader([header], delimiter=sep, quotechar=quote)) if len(sep) == len(quote) == 1 else header.split(sep))]
    parse = {"sep": sep} | {k: o[k] for k in ("quote", "escape") if o.get(k) is not None}
    cells = kept.select(F.from_csv("value", F.lit(", ".join(f"`{n}` STRING" for n in names)), parse).alias("r")).select("r.*")
    nulls = [o.get("null_value", ""), "\\N", *([o["null_escape"]] if o.get("null_escape") else [])]
    return cells.select(*(F.when(~F.col(f"`{n}`").isin(nulls), F.col(f"`{n}`")).alias(n) for n in names))


def _nth(lines: DataFrame, n: int, order: Column) -> DataFrame:
    """(__file, __end, __n): the place of each file's n-th line in the order, or of its last one, and how many it is. Map tasks keep n lines of a file."""
    ranked = lines.select("__file", "__at").withColumn("__n", F.row_number().over(Window.partitionBy("__file").orderBy(order))).where(F.col("__n") <= n)
    return ranked.groupBy("__file").agg(F.max_by("__at", "__n").alias("__end"), F.max("__n").alias("__n"))


def read_parquet(spark: SparkSession, spec: TableDefinition) -> DataFrame:
    return spark.read.parquet(spec.source.path)


def json_paths(dtype: T.DataType, prefix: str = "") -> list[str]:
    if not isinstance(dtype, T.StructType):
        return [prefix]
    return [p for f in dtype.fields for p in ([f"{prefix}.{f.name}".strip(".")] if not isinstance(f.dataType, T.StructType) else json_paths(f.dataType, f"{prefix}.{f.name}".strip(".")))]


def project_paths(df: DataFrame, projection: dict[str, str]) -> DataFrame:
    """Columns from dot-separated paths; a path that is not there is an error that lists those that are."""
    there = set(json_paths(df.schema))
    if missing := {p for p in projection.values() if p not in there and not any(t.startswith(p + ".") for t in there)}:
        raise SpecError(f"no paths {sorted(missing)}; there are {sorted(there)}")
    return df.select(*(F.col(".".join(f"`{x}`" for x in path.split("."))).alias(name) for name, path in projection.items()))


def read_json(spark: SparkSession, spec: TableDefinition) -> DataFrame:
    df = spark.read.option("multiLine", bool(spec.source.options.get("multiline", False))).json(spec.source.path)
    return project_paths(df, spec.source.projection) if spec.source.projection else df


def json_column(c: Column, projection: dict[str, tuple[str, str]]) -> list[Column]:
    """Typed columns from a column of JSON text: name -> (dot path, type)."""
    return [F.try_variant_get(F.try_parse_json(c), "$." + path, kind).alias(name) for name, (path, kind) in projection.items()]


def jdbc_options(source: Source, secrets: Callable[[str], str | None] | None = None) -> dict[str, str]:
    """Options for the JDBC reader. A password comes from a named secret alone; one that cannot be found is an error."""
    o = dict(source.options)
    if "password" in o:
        raise SpecError("a password must be given as password_secret")
    out = {k: str(o[k]) for k in ("url", "dbtable", "query", "driver", "user", "fetchsize") if o.get(k) is not None}
    if secret := o.get("password_secret"):
        if not (value := secrets(secret) if secrets else None):
            raise SpecError(f"no secret {secret!r}")
        out["password"] = value
    parts = {"partition_column": "partitionColumn", "lower_bound": "lowerBound", "upper_bound": "upperBound", "num_partitions": "numPartitions"}
    given = [k for k in parts if o.get(k) is not None]
    if given and len(given) < len(parts):
        raise SpecError(f"a partitioned read needs {sorted(parts)}")
    return out | {parts[k]: str(o[k]) for k in given}


def read_jdbc(spark: SparkSession, spec: TableDefinition, secrets: Callable[[str], str | None] | None = None) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(spec.source, secrets)).load()


READERS = {"delimited": read_delimited, "parquet": read_parquet, "json": read_json, "jdbc": read_jdbc}


def read(spark: SparkSession, spec: TableDefinition) -> DataFrame:
    if spec.source is None:
        raise SpecError(f"{spec.name} has no source")
    return READERS[spec.source.kind](spark, spec)


def snake_case(name: str) -> str:
    """CamelCase and acronyms as snake_case; anything else that is no letter or digit as one underscore."""
    x = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", name)
    x = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", x)
    return re.sub(r"[^0-9A-Za-z]+", "_", x).strip("_").lower()


def quoted(name: str, dialect: str = "ansi") -> str:
    return "[" + name.replace("]", "]]") + "]" if dialect == "sqlserver" else '"' + name.replace('"', '""') + '"'


def map_header(df: DataFrame, spec: TableDefinition) -> DataFrame:
    """Columns renamed to the specification's, by name, canonical name or alias, without regard to case and outer space."""
    known = {}
    for c in spec.columns:
        for n in (c.name, c.canonical_name, *c.aliases):
            if n:
                known.setdefault(n.strip().casefold(), c.name)
    return df.select(*(F.col(f"`{n}`").alias(known.get(n.strip().casefold(), n)) for n in df.columns))


def with_provenance(df: DataFrame, from_files: bool = False) -> DataFrame:
    """_source_file and _load_ts, where the raw data do not have them."""
    if "_source_file" not in df.columns:
        df = df.withColumn("_source_file", F.col("_metadata.file_path") if from_files else F.lit(None).cast("string"))
    if "_load_ts" in df.columns:
        return df.withColumn("_load_ts", F.col("_load_ts").try_cast("timestamp"))
    return df.withColumn("_load_ts", F.current_timestamp())


def filename_columns(source: Source, file: Column) -> dict[str, Column]:
    """The capture groups of the file name pattern, as columns."""
    name = F.regexp_extract(file, r"([^/]+)$", 1)
    return {c: F.regexp_extract(name, source.filename_pattern, i + 1) for i, c in enumerate(source.filename_columns)}
