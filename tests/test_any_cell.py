"""Any cell at any door: no exception under ANSI, and the lanes say what the full rules say."""

import math
import random
import struct
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sluice.functions.constraints import Constraints, checked
from sluice.functions.doors import COMPACT_DATE, DMY, HOUR_OFFSET, MDY, SPACE_SEPARATOR, DateOptions, _door_of, door
from sluice.functions.numbers import ALL, EUROZONE, INDIAN, SEPARATOR_DETECT, TRAILING_SIGN, NumFormat
from sluice.plans.columns import Column
from sluice.sources.workbook import cell, typed_door
from sluice.types import INTEGERS, Door

PIECES = ["0", "1", "7", "12", "007", "999", "1,234", "12,34,567", ".", ",", "-", "+", "(", ")", "%", "e", "E5", "e-400", "e99999999999", "0x", "&H", "0b", "FF", " ", "\t", "　", " ", "$", "€", "true", "no", "2024-02-29", "2023-02-29", "0000-01-01", "1/2/2024", "31.12.1999", "13/13/2020", "T", "10:20:30", "25:00", ".5", "Z", "+01:00", "+01", "PT", "P", "1H", "9" * 40, "9" * 19, "S", "W", "D", "Y", "a" * 8, "6f9619ff-8b86-d011-b42d-00cf4fc964ff", "6F9619FF8B86D011B42D00CF4FC964FF", "x", "é", "٤", "NaN", "Infinity", "2026-01-07T15:04:05Z", "2026-01-07 15:04:05", "PT1H30M", "\x00", "'", "\n", "/", ":"]


def cells(seed, n):
    rng = random.Random(seed)
    out = ["", " ", *PIECES]
    while len(out) < n:
        out.append("".join(rng.choice(PIECES) for _ in range(rng.choice([1, 1, 2, 2, 3, 4, 6]))))
    raw = [t.encode() for t in out]
    return raw + [bytes(rng.randrange(256) for _ in range(rng.randrange(1, 12))) for _ in range(300)]


HOWS = {
    Door.DECIMAL: [{}, {"precision": 18, "scale": 2}, {"precision": 5, "scale": 0}, {"precision": 38, "scale": 18, "form": EUROZONE}],
    Door.F64: [{}, {"form": EUROZONE}, {"form": NumFormat(flags=ALL | SEPARATOR_DETECT)}],
    Door.I64: [{}, {"form": EUROZONE}, {"form": NumFormat(flags=ALL | TRAILING_SIGN, currency="$")}, {"form": NumFormat(zero="٠")}],
    Door.I32: [{}, {"form": NumFormat(flags=ALL | INDIAN)}, {"form": NumFormat(group=" ", decimal=",")}],
    Door.DATE: [{}, {"options": DateOptions((COMPACT_DATE,))}],
    Door.DATE_ORDERED: [{}, {"order": MDY}, {"order": DMY, "options": DateOptions((), 2029, ((1, "Jan"),))}],
    Door.DATETIME: [{}, {"order": MDY}],
    Door.TIMESTAMP: [{}, {"options": DateOptions((SPACE_SEPARATOR, HOUR_OFFSET))}],
    Door.UNIX: [{"precision": p} for p in ("s", "ms", "us", "ns")],
    Door.EXCEL_SERIAL: [{}, {"epoch": 1904}],
}


@pytest.mark.parametrize("kind", [d for d in Door if d is not Door.TEXT], ids=lambda d: d.value)
def test_lanes_say_what_the_rules_say(spark, kind):
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    rows = spark.createDataFrame([(c,) for c in cells(3, 1500)], "raw binary").repartition(4).cache()
    for how in HOWS.get(kind, [{}]):
        both = rows.select("raw", door(kind, F.col("raw"), **how).alias("a"), _door_of(kind, F.col("raw"), how).alias("b"))
        fields = ("value", "reason", "detail", "offset", "len")
        differ = both.where(~F.forall(F.array(*(F.col(f"a.{f}").cast("string").eqNullSafe(F.col(f"b.{f}").cast("string")) for f in fields)), lambda same: same))
        assert [(bytes(r["raw"]), r["a"], r["b"]) for r in differ.limit(5).collect()] == [], how
        bad = both.where(F.col("a.reason").isNull() & F.col("a.value").isNull()).limit(3).collect()
        assert bad == [], how


def test_ten_thousand_cells_at_every_door(spark):
    rows = spark.createDataFrame([(c,) for c in cells(11, 10_000)], "raw binary").repartition(4)
    out = rows.select(*(door(d, F.col("raw"))["reason"].alias(d.value) for d in Door))
    counts = out.agg(*(F.count_if(F.col(d.value).isNull()).alias(d.value) for d in Door)).first().asDict()
    assert all(counts[d.value] for d in Door)


def doubles(n):
    rng = random.Random(5)
    out = [0.0, -0.0, 1.0, -1.0, 0.5, 1e300, -1e300, 5e-324, 1.7976931348623157e308, 3.5e38, 2.0**63, 2.0**64, -(2.0**63), 1e15, 1e16, 45292.75, 60.0, 2958465.999999, 2958466.0, 1 / 86400, 0.1, 0.30000000000000004, -1e10, 255.0, 256.0]
    while len(out) < n:
        x = struct.unpack("<d", rng.randbytes(8))[0]
        if math.isfinite(x):
            out += [x, round(rng.uniform(-1e6, 1e6), rng.randrange(6)), float(rng.randrange(-(10**rng.randrange(1, 20)), 10**19))]
    return out


def test_numbers_at_every_door(spark):
    from sluice.sources.serials import number_text

    numbers = doubles(3000)
    schema = "i int, c struct<kind: string, raw: binary, quoted: boolean, num: double, day: date, nanos: long, uncached: boolean>"
    rows = spark.createDataFrame([(i, tuple(cell("number", number_text(x), x).values())) for i, x in enumerate(numbers)], schema).repartition(4)
    doors = [d for d in Door if d not in (Door.UUID,)]
    got = rows.select("i", *(typed_door(F.col("c"), Column(0, d)).alias(d.value) for d in doors)).orderBy("i").collect()
    for x, r in zip(numbers, got, strict=True):
        whole = x == math.floor(x)
        for d, (low, high) in INTEGERS.items():
            own = r[d.value]
            exact = int(Decimal(number_text(x))) if whole else None
            if not whole:
                assert (own["reason"], own["detail"]) == ("malformed", "fractionNotAllowed")
            elif low <= exact <= high:
                assert (own["reason"], own["value"]) == (None, exact)
            else:
                assert (own["reason"], own["detail"]) == ("out_of_range", "tooLarge" if x > 0 else "negativeNotAllowed" if low == 0 else "tooSmall")
        assert r["f64"]["value"] == x
        assert (r["f32"]["reason"] == "out_of_range") == (abs(x) > 3.4028234663852886e38)
        assert r["text"]["value"] == number_text(x)
        assert (r["bool"]["reason"] is None) == (x in (0.0, 1.0))
        assert r["unix"]["reason"] == (None if whole and -62_135_596_800 <= x <= 253_402_300_799 else "out_of_range" if whole else "malformed")
        assert r["time"]["reason"] == (None if 0 <= x < 2_958_466 else "malformed" if x < 0 else "out_of_range")
        if abs(x) < 100_000:
            assert r["duration"]["value"] == int((Decimal(number_text(x)) * 86_400).quantize(Decimal("1e-9"), "ROUND_HALF_UP") * 10**9)


def test_reals_keep_their_digits_under_constraints(spark):
    texts = ["0.000000000001", "0.12345678901234", "1e30", "-1e-300", "1e308", "0", "3", "0.1", "0.30000000000000004"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    c = lambda rules, d=Door.F64: checked(door(d, F.col("t")), F.col("t").cast("binary"), d, rules)
    got = rows.select("i", c(Constraints(minimum="0")).alias("low"), c(Constraints(maximum="0.1")).alias("high"), c(Constraints(exclusive_maximum="0.30000000000000005")).alias("near"), c(Constraints(multiple_of="0.1")).alias("step"), c(Constraints(multiple_of="0.25", rounding="midpoint")).alias("mid"), c(Constraints(enum=("0.10", "1E30")), Door.F64).alias("listed")).orderBy("i").collect()
    for t, r in zip(texts, got, strict=True):
        x = float(t)
        d = Decimal(repr(x))
        assert r["low"]["value"] == x and r["low"]["keyword"] == ("minimum" if x < 0 else None)
        assert r["high"]["keyword"] == ("maximum" if d > Decimal("0.1") else None)
        assert r["near"]["keyword"] == ("exclusiveMaximum" if d >= Decimal("0.30000000000000005") else None)
        assert (r["listed"]["keyword"] is None) == (d in (Decimal("0.1"), Decimal("1E30")))
        if 1e-16 < abs(x) < 1e15 or x == 0:
            assert (r["step"]["keyword"] is None) == (d % Decimal("0.1") == 0), t
            assert r["step"]["value"] == x
    assert [r["mid"]["value"] for r in got][:2] == [0.0, 0.0] and got[6]["mid"]["value"] == 3.0
    assert got[0]["mid"]["adjusted"] and not got[6]["mid"]["adjusted"]


def test_decimals_and_long_durations(spark):
    rows = spark.createDataFrame([("0.5%", "PT9999999999999999999S", "9" * 38), ("50%", "-P106751DT23H47M16.854775808S", "-1"), ("1.25e1%", "P106752D", "1700000000123456789")], "d string, p string, u string")
    got = rows.select(door(Door.DECIMAL, F.col("d"), precision=18, scale=2).alias("d"), door(Door.DURATION, F.col("p")).alias("p"), door(Door.UNIX, F.col("u"), precision="ns").alias("u"), door(Door.DECIMAL, F.col("d"), precision=18, scale=3).alias("e")).collect()
    assert [(r["d"]["value"], r["d"]["detail"]) for r in got] == [(None, "tooPrecise"), (Decimal("0.50"), None), (None, "tooPrecise")]
    assert [r["e"]["value"] for r in got] == [Decimal("0.005"), Decimal("0.500"), Decimal("0.125")]
    assert [(r["p"]["value"], r["p"]["detail"]) for r in got] == [(None, "tooLarge"), (-(1 << 63), None), (None, "tooLarge")]
    assert [r["u"]["detail"] for r in got] == ["outsideWindow", None, None]
    assert got[2]["u"]["value"].microsecond == 123456
