"""Row digests, structural patterns and canonical text of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def row_checksum(columns: list[Column], mark_nulls: bool = False) -> Column:
    """sha256 of the values as text, joined by bars. Without mark_nulls NULLs vanish, so that ('a', NULL) equals (NULL, 'a')."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat_ws("|", *(F.coalesce(t, F.lit("\x00")) for t in texts) if mark_nulls else texts), 256)


def row_hash(columns: list[Column]) -> Column:
    return F.xxhash64(*columns)


def pattern(c: Column) -> Column:
    """Capital letters as A, small ones as a, digits as N; all else stays."""
    capitals = F.regexp_replace(c, r"\p{Lu}", "A")
    return F.regexp_replace(F.regexp_replace(capitals, r"\p{Ll}", "a"), r"\p{Nd}", "N")


def collapsed(p: Column) -> Column:
    """Runs of three and more letters or digits as one with a plus."""
    for x in "AaN":
        p = F.regexp_replace(p, f"{x}{{3,}}", f"{x}+")
    return p


def canonical(df: DataFrame) -> DataFrame:
    """Every value as text with one form: for comparing engines. NULL is \\N, doubles are rounded to 9 places."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BooleanType):
            text = F.when(c, "true").otherwise("false")
        elif isinstance(f.dataType, T.FloatType | T.DoubleType):
            text = F.round(c.cast("double"), 9).cast("string")
        elif isinstance(f.dataType, T.TimestampType | T.TimestampNTZType):
            text = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        else:
            text = c.cast("string")
        out.append(F.when(c.isNull(), F.lit("\\N")).otherwise(text).alias(f.name))
    return df.select(*out)
