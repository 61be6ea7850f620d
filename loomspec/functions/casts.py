"""Casts that give NULL for what they cannot read, as Column expressions and as SQL text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspec.functions import formats
from loomspec.schema import NUMBERS, TEXT_TYPES, spark_type
from loomspec.spec import Column as ColumnSpec

#: Types whose format is a date pattern.
MOMENTS = ("DATE", "DATETIME", "TIMESTAMP")
_TRUE, _FALSE = ("true", "t", "yes", "y", "1"), ("false", "f", "no", "n", "0")


def cleaned_number(c: Column) -> Column:
    """Trimmed, without a leading dollar sign; empty becomes NULL. Thousands separators stay, so such values fail to cast."""
    return F.nullif(F.trim(F.regexp_replace(F.trim(c), r"^\$", "")), F.lit(""))


def parsed(c: Column, pattern: str) -> Column:
    return F.try_to_timestamp(c, F.lit(formats.to_java(pattern)))


def epoch_ms(c: Column) -> Column:
    """Whole seconds from digits (twelve or more) or scientific notation; anything else by the default parse."""
    text = F.trim(c)
    number = text.rlike(r"^\d{12,}$") | text.rlike(r"^\d+(\.\d+)?[eE]\+?\d+$")
    return F.when(number, F.timestamp_seconds(F.floor(text.try_cast("double") / 1000))).otherwise(text.try_cast("timestamp"))


def excel_serial(c: Column) -> Column:
    """Days from 1899-12-30."""
    text = F.trim(c)
    return F.when(text.rlike(r"^\d{1,6}(\.0*)?$"), F.date_add(F.lit("1899-12-30").cast("date"), text.try_cast("double").cast("int")))


def excel_moment(c: Column) -> Column:
    """A serial day with its fraction."""
    days = F.trim(c).try_cast("double")
    return F.timestamp_seconds(F.round((days - 25569) * 86400))


def flexible_date(c: Column, declared: str | None = None, fallbacks: tuple[str, ...] = ()) -> Column:
    text = F.trim(F.regexp_replace(c, r"\s+", " "))
    tried = [parsed(text, p).cast("date") for p in formats.candidates(declared, fallbacks, formats.COMMON_DATES + formats.COMMON_TIMESTAMPS)]
    return F.when(text.rlike(r"^\d{4,6}$"), excel_serial(text)).otherwise(F.coalesce(*tried))


def flexible_timestamp(c: Column, declared: str | None = None, fallbacks: tuple[str, ...] = ()) -> Column:
    text = F.trim(F.regexp_replace(c, r"\s+", " "))
    tried = [parsed(text, p) for p in formats.candidates(declared, fallbacks, formats.COMMON_TIMESTAMPS + formats.COMMON_DATES)]
    return F.when(text.rlike(r"^\d{12,}$"), epoch_ms(text)).when(text.rlike(r"^\d{4,6}(\.\d+)?$"), excel_moment(text)).otherwise(F.coalesce(*tried))


def multi_format_timestamp(c: Column, declared: str, fallbacks: tuple[str, ...] = ()) -> Column:
    text = F.trim(c)
    return F.coalesce(*(parsed(text, p) for p in formats.candidates(declared, fallbacks)), F.when(text.rlike(r"^\d{12,}$"), epoch_ms(text)))


def boolean(c: Column) -> Column:
    text = F.lower(F.trim(c))
    return F.when(text.isin(*_TRUE), True).when(text.isin(*_FALSE), False)


def cast_column(c: Column, spec: ColumnSpec, typed: bool = False, fallbacks: tuple[str, ...] = ()) -> Column:
    """The value as the specification's type, NULL where it cannot be read. typed: the raw value is no text, so it is only cast."""
    kind, to = spec.type.upper(), spark_type(spec)
    if spec.format and kind in MOMENTS:
        for pattern in (spec.format, *fallbacks):
            formats.checked(pattern)
    if typed:
        return c.try_cast(to)
    if kind in TEXT_TYPES:
        return c.cast("string")
    if kind == "BOOLEAN":
        return boolean(c)
    if kind in NUMBERS:
        number = cleaned_number(c)
        return number.try_cast("double").try_cast(to) if kind == "FLOAT" else number.try_cast(to)
    if kind == "EMBEDDING":
        return F.from_json(c, T.ArrayType(T.FloatType()))
    if spec.format == formats.EPOCH_MS:
        moment = epoch_ms(c)
    elif spec.format == formats.EXCEL_SERIAL and kind == "DATE":
        return excel_serial(c)
    elif spec.format:
        moment = F.coalesce(*(parsed(F.trim(c), p) for p in formats.candidates(spec.format, fallbacks)))
    else:
        return F.nullif(F.trim(c), F.lit("")).try_cast(to)
    return moment.cast(to)


def cast_sql(name: str, spec: ColumnSpec, dialect: str = "spark") -> str:
    """The same cast as SQL text, for Spark or DuckDB."""
    kind = spec.type.upper()
    text, duck = f"trim({name})", dialect == "duckdb"
    if kind in TEXT_TYPES:
        return f"cast({name} AS {'VARCHAR' if duck else 'STRING'})"
    if kind == "BOOLEAN":
        listed = lambda xs: ", ".join(f"'{x}'" for x in xs)
        return f"CASE WHEN lower({text}) IN ({listed(_TRUE)}) THEN true WHEN lower({text}) IN ({listed(_FALSE)}) THEN false END"
    to = spark_type(spec).simpleString().upper()
    if kind in NUMBERS:
        replaced = f"regexp_replace({text}, '^\\$', '')" if duck else f"regexp_replace({text}, '^\\\\$', '')"
        value = f"nullif(trim({replaced}), '')"
        if duck and to in ("INT", "BIGINT", "SMALLINT", "TINYINT"):
            return f"CASE WHEN regexp_full_match({value}, '[+-]?\\d+') THEN try_cast({value} AS {to}) END"
        return f"try_cast({value} AS {to})"
    if spec.format and spec.format not in (formats.EPOCH_MS, formats.EXCEL_SERIAL):
        if duck:
            parse = f"CASE WHEN regexp_full_match({text}, '{formats.strict_regex(spec.format)}') THEN try_strptime({text}, '{formats.to_strftime(spec.format)}') END"
            return f"cast({parse} AS {'DATE' if kind == 'DATE' else 'TIMESTAMP'})"
        quoted = formats.to_java(spec.format).replace("'", "\\'")
        return f"cast(try_to_timestamp({text}, '{quoted}') AS {to})"
    return f"try_cast(nullif({text}, '') AS {to})"
