"""Case tables of the doors: text to value, reason and detail."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sluice.functions.doors import COMPACT_DATE, DMY, HOUR_OFFSET, MDY, SPACE_SEPARATOR, YMD, DateOptions, door
from sluice.functions.numbers import ALL, EUROZONE, INDIAN, SEPARATOR_DETECT, TRAILING_SIGN, NumFormat
from sluice.types import DeclarationError, Door


def judged(spark, kind, cells, **how):
    rows = spark.createDataFrame(list(enumerate(cells)), "i int, t string").select("i", door(kind, F.col("t"), **how).alias("c"))
    return [r["c"] for r in rows.orderBy("i").collect()]


def values(spark, kind, cells, **how):
    return [c["value"] if c["reason"] is None else c["reason"] for c in judged(spark, kind, cells, **how)]


CASES = [
    (Door.BOOL, {}, {"TRUE": True, "true": True, "Yes": True, "On": True, "1": True, "T": True, "in": True, "N": False, "out": False, "off": False, "0": False, "F": False, "2": "malformed", "ab": "malformed", "  ": "empty", "": "empty"}),
    (Door.I32, {}, {"7": 7, " 7 ": 7, "1,234": 1234, "0125": 125, "(5)": -5, "1e3": 1000, "0e5": 0, "-0": 0, "+3": 3, "0x10": 16, "0xFFFFFFFF": -1, "12x4": "malformed", "1.5": "malformed", "12,34": "malformed", "0,125": "malformed", "1,2,345": "malformed", "1234,567": "malformed", "50%": "malformed", "1e-2": "malformed", "99999999999": "out_of_range", "-2147483649": "out_of_range", "1e400": "out_of_range"}),
    (Door.I8, {}, {"0xFF": -1, "&H7F": 127, "0b101": 5, "-128": -128, "128": "out_of_range"}),
    (Door.U8, {}, {"255": 255, "256": "out_of_range", " -1": "out_of_range", "-0": 0}),
    (Door.U64, {}, {"18446744073709551615": Decimal(18446744073709551615), "18446744073709551616": "out_of_range"}),
    (Door.F64, {}, {"1.5": 1.5, ".007": 0.007, "50%": 0.5, "1,234.5": 1234.5, "1e400": "out_of_range", "NaN": "malformed", "Infinity": "malformed", "-inf": "malformed"}),
    (Door.F32, {}, {"1.5": 1.5, "1e39": "out_of_range"}),
    (Door.F64, {"form": EUROZONE}, {"1.234,50": 1234.5, "(7)": -7.0, "1,234.50": "malformed"}),
    (Door.DECIMAL, {"form": NumFormat(currency="$"), "precision": 18, "scale": 2}, {"$1,234.50": Decimal("1234.50"), "($5.00)": Decimal("-5.00"), "9": Decimal("9.00"), "-$3": Decimal("-3.00"), "1.234": "out_of_range", "1.2300": Decimal("1.23")}),
    (Door.DECIMAL, {"precision": 18, "scale": 2}, {"$1": "malformed"}),
    (Door.DECIMAL, {"form": NumFormat(flags=ALL | SEPARATOR_DETECT), "precision": 18, "scale": 4}, {"1.234": "malformed", "1,5": Decimal("1.5"), "1.234.567": Decimal(1234567), "0.125": Decimal("0.125"), "1.234,5": Decimal("1234.5"), "1,234.5": Decimal("1234.5")}),
    (Door.I32, {"form": NumFormat(flags=ALL | INDIAN)}, {"12,34,567": 1234567, "1,234": 1234, "0125": 125, "1234567": 1234567, "123,456": "malformed", "1,234,567": "malformed"}),
    (Door.I32, {"form": NumFormat(flags=ALL | TRAILING_SIGN)}, {"5-": -5, "5+": 5, "-5-": "malformed"}),
    (Door.I32, {"form": NumFormat(zero="٠")}, {"٤٢": 42}),
    (Door.UUID, {}, {"6F9619FF8B86D011B42D00CF4FC964FF": "6f9619ff-8b86-d011-b42d-00cf4fc964ff", "6f9619ff-8b86-d011-b42d-00cf4fc964ff": "6f9619ff-8b86-d011-b42d-00cf4fc964ff", "6f96": "malformed", "zf9619ff8b86d011b42d00cf4fc964ff": "malformed"}),
    (Door.DATE, {}, {"2026-01-07": date(2026, 1, 7), "2026/01/02": "malformed", "20260107": "malformed", "1900-02-29": "out_of_range", "2026-13-01": "out_of_range"}),
    (Door.DATE, {"options": DateOptions((COMPACT_DATE,))}, {"20260107": date(2026, 1, 7), "2026-01-07": date(2026, 1, 7)}),
    (Door.DATE_ORDERED, {"order": MDY}, {"1/7/2026": date(2026, 1, 7), "2026/1/7": date(2026, 1, 7), "13/7/2026": "out_of_range", "01/02/26": "malformed"}),
    (Door.DATE_ORDERED, {"order": DMY}, {"1/7/2026": date(2026, 7, 1), "13.7.2026": date(2026, 7, 13), "1/7-2026": "malformed"}),
    (Door.DATE_ORDERED, {"order": YMD}, {"2026-1-7": date(2026, 1, 7), "1/7/2026": "malformed"}),
    (Door.DATE_ORDERED, {"order": DMY, "options": DateOptions((), 2029, ((1, "Jan"), (10, "Okt")))}, {"07-Jan-26": date(2026, 1, 7), "7-okt-1999": date(1999, 10, 7), "07-Jan-30": date(1930, 1, 7), "07-Foo-26": "malformed"}),
    (Door.DATETIME, {"order": MDY}, {"1/7/2026 3:04 PM": datetime(2026, 1, 7, 15, 4), "1/7/2026 12:00 AM": datetime(2026, 1, 7), "1/7/2026": datetime(2026, 1, 7), "1/7/2026 25:00": "out_of_range"}),
    (Door.TIME, {}, {"15:04:05.5": 54_245_500_000_000, "24:00:00": "out_of_range", "3:04": "malformed"}),
    (Door.DURATION, {}, {"PT1H30M": 5_400_000_000_000, "-P1DT6H30M15.5S": -109_815_500_000_000, "P1W": 604_800_000_000_000, "P1Y": "malformed", "P": "malformed", "PT": "malformed"}),
    (Door.TIMESTAMP, {}, {"2026-01-07T15:04:05Z": datetime(2026, 1, 7, 15, 4, 5), "2026-01-07T15:04:05.123456789+01:00": datetime(2026, 1, 7, 14, 4, 5, 123456), "2026-01-07T15:04:05": "malformed", "2026-01-07 15:04:05Z": "malformed", "2026-02-30T00:00:00Z": "out_of_range"}),
    (Door.TIMESTAMP, {"options": DateOptions((SPACE_SEPARATOR, HOUR_OFFSET))}, {"2026-01-07 15:04:05+01": datetime(2026, 1, 7, 14, 4, 5)}),
    (Door.UNIX, {"precision": "ms"}, {"1700000000123": datetime(2023, 11, 14, 22, 13, 20, 123000), "x": "malformed", "99999999999999999999": "out_of_range"}),
    (Door.EXCEL_SERIAL, {}, {"45292.75": datetime(2024, 1, 1, 18), "1": datetime(1900, 1, 1), "59": datetime(1900, 2, 28), "60": "out_of_range", "0.5": "out_of_range", "-1": "malformed", "2958466": "out_of_range"}),
    (Door.EXCEL_SERIAL, {"epoch": 1904}, {"0": datetime(1904, 1, 1), "1.5": datetime(1904, 1, 2, 12)}),
    (Door.TEXT, {}, {"  padded ": "  padded ", "": "empty", "\x00": "\x00"}),
]


@pytest.mark.parametrize("kind, how, want", CASES, ids=[f"{k.value}-{i}" for i, (k, _, _) in enumerate(CASES)])
def test_door(spark, kind, how, want):
    assert dict(zip(want, values(spark, kind, want, **how), strict=True)) == want


def test_spans_are_bytes_of_the_whole_cell(spark):
    cells = judged(spark, Door.I32, ["12x4", " é", "  99999999999", "1.5"])
    assert [(c["detail"], c["offset"], c["len"]) for c in cells] == [("unexpectedCharacter", 2, 1), ("noDigits", 1, 2), ("tooLarge", 2, 11), ("fractionNotAllowed", 1, 2)]


def test_every_unicode_space_is_trimmed(spark):
    assert values(spark, Door.I32, ["  7　", "​7"]) == [7, "malformed"]


def test_text_that_is_not_utf8(spark):
    rows = spark.createDataFrame([(b"ab\xffc",), (b"\xc3",)], "t binary").select(door(Door.TEXT, F.col("t")).alias("c"))
    assert [(r["c"]["reason"], r["c"]["detail"], r["c"]["offset"]) for r in rows.collect()] == [("malformed", "invalidUtf8", 2), ("malformed", "invalidUtf8", 0)]


def test_groups_of_both_policies(spark):
    both, neither = ["1,000", "1,234", "0125", "1234567"], ["0,125", "0,000", "12,34", "1,2", "1234,567", "1,2,345", "1,2345,678", "1,234,56,789"]
    for form in (NumFormat(), NumFormat(flags=ALL | INDIAN)):
        assert all(isinstance(v, int) for v in values(spark, Door.I64, both, form=form))
        assert set(values(spark, Door.I64, neither, form=form)) == {"malformed"}


@pytest.mark.parametrize("bad", [{"flags": 256 | ALL}, {"decimal": ","}, {"decimal": ""}, {"flags": 1 << 12}])
def test_notations_that_cannot_be(bad):
    with pytest.raises(DeclarationError):
        NumFormat(**bad)
