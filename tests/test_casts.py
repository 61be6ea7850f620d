import datetime as dt
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomspec.functions import casts, digests, formats
from loomspec.spec import Column


def cast(spark, values, column, typed=False):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select("i", casts.cast_column(F.col("v"), column, typed).alias("x")).orderBy("i").select("x").collect()]


def test_numbers(spark):
    assert cast(spark, ["1", " 2 ", "$3", "", None, "abc", "12.7", "1e3", "1,234"], Column("v", "INTEGER")) == [1, 2, 3, None, None, None, None, None, None]
    assert cast(spark, ["1.005", "$ 2.5", "12345678901.00", "-0.994"], Column("v", "DECIMAL", precision=5, scale=2)) == [Decimal("1.01"), Decimal("2.50"), None, Decimal("-0.99")]
    assert cast(spark, ["1.5", "x"], Column("v", "DOUBLE")) == [1.5, None]


def test_booleans_and_text(spark):
    assert cast(spark, ["TRUE", "no", "1", "maybe", "", None], Column("v", "BOOLEAN")) == [True, False, True, None, None, None]
    assert cast(spark, ["", " a "], Column("v")) == ["", " a "]


@pytest.mark.parametrize(("pattern", "good", "bad"), [("MM/DD/YYYY", "02/28/2021", "2/28/2021"), ("M/D/YYYY", "2/8/2021", "2021-02-08"), ("YYYYMMDD", "20210228", "20210230"), ("MMDDYYYY", "02282021", "20210228"), ("M/d/yyyy", "2/8/2021", "2021/2/8")])
def test_dates(spark, pattern, good, bad):
    got = cast(spark, [good, bad, "", None], Column("v", "DATE", format=pattern))
    assert got[0] is not None and got[1:] == [None, None, None]


def test_fractions_and_halves(spark):
    assert cast(spark, ["2024-01-31 23:59:58.123", "2024-01-31 23:59:58.123456"], Column("v", "TIMESTAMP", format="YYYY-MM-DD HH:MM:SS.SSS"))[1] is None
    assert cast(spark, ["1/2/2024 3:04 PM"], Column("v", "DATETIME", format="M/D/YYYY h:mm A")) == [dt.datetime(2024, 1, 2, 15, 4)]


def test_sentinels(spark):
    assert cast(spark, ["1706745598123", "x"], Column("v", "TIMESTAMP", format="EPOCH_MS")) == [dt.datetime(2024, 1, 31, 23, 59, 58), None]
    assert cast(spark, ["45351", "1", "n/a"], Column("v", "DATE", format="EXCEL_SERIAL")) == [dt.date(2024, 2, 29), dt.date(1899, 12, 31), None]


def test_every_pattern_reads_what_it_writes(spark):
    moment = "2021-12-28 23:49:58.123456"
    for p in formats.DATE_PATTERNS + formats.DATETIME_PATTERNS:
        x = spark.sql(f"SELECT timestamp'{moment}' AS t").select(F.date_format("t", formats.to_java(p)).alias("s")).select("s", casts.parsed(F.col("s"), p).alias("back")).first()
        assert x["back"] is not None and x["back"].date() == dt.date(2021, 12, 28), p
        import re

        assert re.fullmatch(formats.strict_regex(p), x["s"]), (p, x["s"])


def test_unknown_patterns_are_refused(spark):
    assert len(formats.PATTERNS) == len(set(formats.PATTERNS)) == 31
    with pytest.raises(ValueError, match="DD/MM/YYYY"):
        casts.cast_column(F.col("v"), Column("v", "DATE", format="DD/MM/YYYY"))
    with pytest.raises(ValueError, match="YYYY-M-D"):
        casts.cast_column(F.col("v"), Column("v", "TIMESTAMP", format="YYYY-MM-DD"), fallbacks=("YYYY-M-D",))


@pytest.mark.parametrize(("pattern", "text"), [("M/d/yyyy h:mm a", "1/2/2024 3:04 PM"), ("M/d/yyyy, h:mm a", "1/2/2024, 3:04 PM"), ("MM/dd/yyyy h:mma", "01/02/2024 3:04PM"), ("MM/dd/yyyy h:mmA", "01/02/2024 3:04PM"), ("MM/DD/YYYY hh:mm A", "01/02/2024 03:04 PM"), ("M/D/YYYY, h:mm A", "1/2/2024, 3:04 PM"), ("M/d/YYYY h:mm A", "1/2/2024 3:04 PM")])
def test_twelve_hour_patterns(spark, pattern, text):
    assert cast(spark, [text, "x"], Column("v", "DATETIME", format=pattern)) == [dt.datetime(2024, 1, 2, 15, 4), None]


def test_strftime_patterns():
    assert formats.strftime_to_java("%Y-%m-%dT%H:%M:%S") == "yyyy-MM-dd'T'HH:mm:ss"
    assert formats.to_strftime("YYYY-MM-DD HH:MM:SS.SSS") == "%Y-%m-%d %H:%M:%S.%f"


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(max_size=12), min_size=1, max_size=30))
def test_casts_never_fail(spark, values):
    values = [v for v in values if "\x00" not in v and not any(0xD800 <= ord(c) < 0xE000 for c in v)] or [""]
    for c in (Column("v", "INTEGER"), Column("v", "DECIMAL"), Column("v", "DATE", format="MM/DD/YYYY"), Column("v", "TIMESTAMP", format="EPOCH_MS"), Column("v", "BOOLEAN"), Column("v", "DATE", format="EXCEL_SERIAL")):
        assert len(cast(spark, values, c)) == len(values)


def test_digests_and_patterns(spark):
    df = spark.createDataFrame([("a", None), (None, "a")], "x string, y string")
    assert len({r[0] for r in df.select(digests.row_checksum([F.col("x"), F.col("y")])).collect()}) == 1
    assert len({r[0] for r in df.select(digests.row_checksum([F.col("x"), F.col("y")], mark_nulls=True)).collect()}) == 2
    assert spark.range(1).select(digests.collapsed(digests.pattern(F.lit("Customer#000123")))).first()[0] == "Aa+#N+"
