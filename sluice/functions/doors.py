"""Doors as Catalyst expressions: a cell's text to a value or a fault, without a Python function.

Each door gives ``value, reason, detail, offset, len``; reason is null where the cell is cast, and offset and len are bytes
of the cell's text. What can overflow goes through ``try_`` functions or is bounded ahead, so a bad cell never ends a query.

A cell first meets *lanes*: cells in a door's plainest spelling are cast by one regular expression and one cast, and
frequent faults are told by one regular expression each, all in generated code. What no lane takes goes to the door's
full rules, whose intermediate values are bound by higher-order functions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.functions.numbers import INVARIANT, RADIX_PREFIX, SEPARATOR_DETECT, SPACE, NumFormat
from sluice.types import INTEGERS, SPARK_TYPE, DeclarationError, Door

# The words that the bool door takes, in any case.
TRUE = ("true", "t", "yes", "y", "on", "in", "1")
FALSE = ("false", "f", "no", "n", "off", "out", "0")

#: Date options: without them dates are strictly yyyy-MM-dd and timestamps RFC 3339.
COMPACT_DATE, SPACE_SEPARATOR, HOUR_OFFSET = "compact_date", "space_separator", "hour_offset"
YMD, MDY, DMY = "ymd", "mdy", "dmy"


@dataclass(frozen=True)
class DateOptions:
    flags: tuple[str, ...] = ()
    pivot: int = 0
    months: tuple[tuple[int, str], ...] = ()

    def __post_init__(self):
        if bad := set(self.flags) - {COMPACT_DATE, SPACE_SEPARATOR, HOUR_OFFSET}:
            raise DeclarationError(f"unknown date options {sorted(bad)}")
        if self.pivot and not 100 <= self.pivot <= 9999:
            raise DeclarationError("a pivot is 0 or from 100 to 9999")
        if any(not 1 <= m <= 12 or not name for m, name in self.months):
            raise DeclarationError("a month is from 1 to 12 and has a name")


STRICT = DateOptions()


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _result(t: Column, door: Door, value: Column, faults: Sequence[tuple[Column, str, str, Column | None, Column | None]], kind: str | None = None) -> Column:
    """Value and fault; faults in order: when, reason, detail, and a span of the trimmed text (else all of it)."""

    def fault(reason: str, detail: str, start: Column | None = None, n: Column | None = None) -> Column:
        start = F.lit(0) if start is None else start
        return F.struct(F.lit(reason).alias("reason"), F.lit(detail).alias("detail"), start.cast("int").alias("offset"), (F.octet_length(t) if n is None else n).cast("int").alias("len"))

    found = F.when(t == "", fault("empty", "blank"))
    for when, reason, detail, start, n in faults:
        found = found.when(when, fault(reason, detail, start, n))
    found = found.when(value.isNull(), fault("malformed", "notRecognized"))
    return F.struct(value.try_cast(kind or SPARK_TYPE[door]).alias("value"), found.alias("fault"))


def _door(judge: Callable[..., Column]) -> Callable[..., Column]:
    """A door from what judges trimmed text."""

    @wraps(judge)
    def whole(text: Column, *how: object, **more: object) -> Column:
        lead = F.octet_length(text) - F.octet_length(F.regexp_replace(text, rf"^{SPACE}+", ""))
        cell = F.struct(trimmed(text).alias("t"), lead.alias("lead"))
        return let(cell, lambda c: let(judge(c["t"], *how, **more), lambda r: _told(c, r)))

    return whole


def _told(c: Column, r: Column) -> Column:
    f = r["fault"]
    offset = F.when(f["reason"] == "empty", 0).otherwise(c["lead"] + f["offset"])
    return F.struct(F.when(f.isNull(), r["value"]).alias("value"), f["reason"].alias("reason"), f["detail"].alias("detail"), offset.cast("int").alias("offset"), f["len"].alias("len"))


@_door
def door_bool(t: Column) -> Column:
    low = F.lower(t)
    value = F.when(low.isin(*TRUE), True).when(low.isin(*FALSE), False)
    return _result(t, Door.BOOL, value, [])


def _numeral(t: Column, form: NumFormat, judge: Callable[[Column, Column, Column, NumFormat], Column]) -> Column:
    """judge(text in the notation's separators, plain digits, where detection cannot tell, the notation)."""
    shown = form.digits(t)
    if not form.has(SEPARATOR_DETECT):
        return let(shown, lambda s: let(form.plain(s), lambda p: judge(s, p, F.lit(False), form)))
    told = NumFormat(".", ",", form.flags & ~SEPARATOR_DETECT, form.currency, "", "", form.minus, form.plus, form.percent, form.zero)
    pair = F.struct(shown.alias("s"), form.detected(shown).alias("d"))
    return let(pair, lambda x: let(F.coalesce(x["d"], x["s"]), lambda s: let(told.plain(s), lambda p: judge(s, p, x["d"].isNull(), told))))


def _numeral_faults(t: Column, shown: Column, form: NumFormat, fits: Column, ambiguous: Column) -> list:
    """Why a cell isn't a numeral, as near as can be told from its characters."""
    seps = "".join("\\" + c for c in {*form.group, *form.decimal})
    lead = rf"^[+\-(]?[0-9{seps}]*(?:[eE][+\-]?[0-9]+)?"
    start = F.octet_length(F.regexp_extract(shown, lead, 0))
    return [
        (ambiguous, "malformed", "ambiguousSeparator", None, None),
        (~fits & ~shown.rlike("[0-9]"), "malformed", "noDigits", None, None),
        (~fits & (shown.contains("(") != shown.contains(")")), "malformed", "parenthesesUnbalanced", None, None),
        (~fits & shown.rlike(rf"^[+\-]?[0-9{seps}]+$"), "malformed", "groupSize", None, None),
        (~fits & (start < F.octet_length(shown)), "malformed", "unexpectedCharacter", start, F.octet_length(F.regexp_extract(shown, lead + "(.)", 1))),
        (~fits, "malformed", "trailingText", None, None),
    ]


def door_integer(text: Column, door: Door, form: NumFormat = INVARIANT) -> Column:
    return _integer(text, door, form)


@_door
def _integer(t: Column, door: Door, form: NumFormat) -> Column:
    low, high = INTEGERS[door]
    wide = lambda n: F.lit(str(n)).cast("decimal(38,0)")
    hexed, binary = r"^(?:0[xX]|&[hH])0*([0-9a-fA-F]+)$", r"^0[bB]0*([01]+)$"

    def judge(shown: Column, plain: Column, ambiguous: Column, form: NumFormat) -> Column:
        fits, real = shown.rlike(form.pattern(fraction=False)), shown.rlike(form.pattern(fraction=True))
        size = F.coalesce(F.regexp_extract(plain, r"[eE]\+?(-?[0-9]+)$", 1).try_cast("int"), F.lit(0))
        zero = plain.rlike("^-?0+([eE].*)?$")
        value = F.when(zero, wide(0)).when(size <= 40, plain.try_cast("decimal(38,0)"))
        if form.has(RADIX_PREFIX):
            bits = (high - low).bit_length()
            number = F.when(shown.rlike(hexed), F.when(F.char_length(F.regexp_extract(shown, hexed, 1)) <= 16, F.conv(F.regexp_extract(shown, hexed, 1), 16, 10)))
            number = number.when(shown.rlike(binary), F.when(F.char_length(F.regexp_extract(shown, binary, 1)) <= 64, F.conv(F.regexp_extract(shown, binary, 1), 2, 10))).try_cast("decimal(38,0)")
            if low < 0:  # two's complement in the type's own width
                number = let(number, lambda n: F.when(n > wide(high), F.when(n < wide(1 << bits), n - wide(1 << bits))).otherwise(n))
            radix = shown.rlike("^(?:0[xX]|&[hH])[0-9a-fA-F]+$|^0[bB][01]+$")
            value = F.when(radix, number).otherwise(value)
        else:
            radix = F.lit(False)
        known = F.struct(fits.alias("fits"), real.alias("real"), radix.alias("radix"), zero.alias("zero"), size.alias("size"), value.cast("decimal(38,0)").alias("value"))

        def fault(k: Column) -> Column:
            v = k["value"]
            # Decimals of 38 digits hold every type's range; a numeral past them is past the type.
            over = v.isNull() | (v > wide(high)) | (v < wide(low))
            negative = plain.startswith("-") & ~k["radix"]
            good = k["fits"] | k["radix"]
            point = F.octet_length(F.substring_index(shown, form.decimal, 1))
            faults = _numeral_faults(t, shown, form, good | k["real"], ambiguous)
            faults += [(~good, "malformed", "fractionNotAllowed", point, F.octet_length(shown) - point), (~k["radix"] & (k["size"] < 0) & ~k["zero"], "malformed", "notWhole", None, None)]
            if low == 0:
                faults.append((negative & ~k["zero"], "out_of_range", "negativeNotAllowed", None, None))
            faults += [(over & negative, "out_of_range", "tooSmall", None, None), (over, "out_of_range", "tooLarge", None, None)]
            return _result(t, door, F.when(~over, v), faults)

        return let(known, fault)

    return _numeral(t, form, judge)


def door_real(text: Column, door: Door, form: NumFormat = INVARIANT) -> Column:
    return _real(text, door, form)


@_door
def _real(t: Column, door: Door, form: NumFormat) -> Column:
    top = 3.4028234663852886e38 if door is Door.F32 else 1.7976931348623157e308

    def judge(shown: Column, plain: Column, ambiguous: Column, form: NumFormat) -> Column:
        value = plain.try_cast("double")
        value = F.when(shown.contains(form.percent), value / 100).otherwise(value) + F.lit(0.0)
        known = F.struct(shown.rlike(form.pattern(percent=True)).alias("fits"), value.alias("value"))
        return let(known, lambda k: _result(t, door, F.when(F.abs(k["value"]) <= F.lit(top), k["value"]), [*_numeral_faults(t, shown, form, k["fits"], ambiguous), (F.abs(k["value"]) > F.lit(top), "out_of_range", "tooLarge", None, None)]))

    return _numeral(t, form, judge)


def door_decimal(text: Column, form: NumFormat = INVARIANT, precision: int = 38, scale: int = 10) -> Column:
    """Exact decimals. The declared Spark type bounds them: a nonzero digit past its scale is out of range, never rounded."""
    if not 0 <= scale <= 18 or not scale < precision <= 38:
        raise DeclarationError("a decimal has a scale from 0 to 18 and a precision over it, up to 38")
    return _decimal(text, form, precision, scale)


@_door
def _decimal(t: Column, form: NumFormat, precision: int, scale: int) -> Column:
    kind = f"decimal({precision},{scale})"
    mantissa, power = r"^-?([0-9]*)\.?([0-9]*)", r"[eE]\+?(-?[0-9]+)$"

    def judge(shown: Column, plain: Column, ambiguous: Column, form: NumFormat) -> Column:
        whole, part = F.regexp_extract(plain, mantissa, 1), F.regexp_extract(plain, mantissa, 2)
        digits = F.ltrim(F.concat(whole, part), F.lit("0"))
        # Digits behind the point once the exponent and a percent sign have moved it, less zeros at the end.
        e = F.coalesce(F.regexp_extract(plain, power, 1).try_cast("int"), F.lit(0)) - F.when(shown.contains(form.percent), 2).otherwise(0)
        left = F.char_length(part) - e - (F.char_length(digits) - F.char_length(F.rtrim(digits, F.lit("0"))))
        value = F.when(digits == "", F.lit(0).cast(kind)).when(e.between(-60, 60), F.concat(F.regexp_extract(plain, mantissa, 0), F.lit("e"), e.cast("string")).try_cast(kind))
        known = F.struct(shown.rlike(form.pattern(percent=True)).alias("fits"), value.alias("value"), ((digits != "") & (left > scale)).alias("lost"))
        return let(known, lambda k: _result(t, Door.DECIMAL, F.when(~k["lost"], k["value"]), [*_numeral_faults(t, shown, form, k["fits"], ambiguous), (k["lost"], "out_of_range", "tooPrecise", None, None), (k["value"].isNull(), "out_of_range", "tooLarge", None, None)], kind))

    return _numeral(t, form, judge)


@_door
def door_uuid(t: Column) -> Column:
    low = F.lower(t)
    dashed, bare = low.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), low.rlike("^[0-9a-f]{32}$")
    value = F.when(dashed, low).when(bare, F.regexp_replace(low, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))
    size = ~F.char_length(t).isin(32, 36)
    return _result(t, Door.UUID, value, [(size, "malformed", "wrongLength", None, None), (value.isNull(), "malformed", "unexpectedCharacter", None, None)])


def _fraction_ns(t: Column, pattern: str) -> Column:
    return F.rpad(F.coalesce(F.regexp_extract(t, pattern, 1), F.lit("")), 9, "0").try_cast("bigint")


def _date_or_fault(iso: Column) -> Column:
    return iso.try_cast("date")


@_door
def door_timestamp(t: Column, options: DateOptions = STRICT) -> Column:
    sep = "[Tt ]" if SPACE_SEPARATOR in options.flags else "[Tt]"
    zone = r"(?:[Zz]|[+-][0-9]{2}:[0-9]{2}" + ("|[+-][0-9]{2}" if HOUR_OFFSET in options.flags else "") + ")"
    day = r"[0-9]{4}-[0-9]{2}-[0-9]{2}" + ("|[0-9]{8}" if COMPACT_DATE in options.flags else "")
    full = rf"^({day}){sep}([0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}})(\.[0-9]{{1,9}})?({zone})$"
    fits = t.rlike(full)
    d = F.regexp_extract(t, full, 1)
    d = F.when(F.char_length(d) == 8, F.regexp_replace(d, "^(.{4})(.{2})(.{2})$", "$1-$2-$3")).otherwise(d)
    offset = F.upper(F.regexp_extract(t, full, 4))
    offset = F.when(F.char_length(offset) == 3, F.concat(offset, F.lit(":00"))).otherwise(offset)
    iso = F.concat(d, F.lit("T"), F.regexp_extract(t, full, 2), F.substring(F.regexp_extract(t, full, 3), 1, 7), offset)
    value = F.when(fits, iso.try_cast("timestamp"))
    no_zone = t.rlike(rf"^({day}){sep}[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}(\.[0-9]+)?$")
    faults = [
        (no_zone, "malformed", "componentMissing", None, None),
        (~fits, "malformed", "unexpectedCharacter", None, None),
        (_date_or_fault(d).isNull(), "out_of_range", "nonexistentDate", None, None),
        (value.isNull(), "out_of_range", "timeFieldOutOfRange", None, None),
    ]
    return _result(t, Door.TIMESTAMP, value, faults)


def timestamp_nanos(text: Column) -> Column:
    """The nanoseconds within a timestamp's microsecond, which Spark's type cannot hold."""
    return F.pmod(_fraction_ns(trimmed(text), r"\.([0-9]{1,9})"), F.lit(1000))


@_door
def door_unix(t: Column, precision: str = "s") -> Column:
    per = {"s": 1, "ms": 1000, "us": 1_000_000, "ns": 1_000_000_000}
    if precision not in per:
        raise DeclarationError(f"no such precision: {precision}")
    fits = t.rlike(r"^[+-]?[0-9]+$")
    # 22 digits hold every instant in nanoseconds.
    n = F.when(F.char_length(t) <= 23, t.try_cast("decimal(22,0)"))
    micros = (F.floor(n / F.lit(1000)) if precision == "ns" else n * F.lit(1_000_000 // per[precision])).try_cast("bigint")
    # Years 1 to 9999.
    inside = micros.between(-62_135_596_800_000_000, 253_402_300_799_999_999)
    value = F.when(inside, F.timestamp_micros(F.when(inside, micros)))
    return _result(t, Door.UNIX, value, [(~fits, "malformed", "unexpectedCharacter", None, None), (value.isNull(), "out_of_range", "outsideWindow", None, None)])


def serial_timestamp(serial: Column, epoch: int = 1900) -> Column:
    """An instant, to the microsecond, of a spreadsheet's day number; null where it names none."""
    s = serial.cast("decimal(28,12)")
    days = F.floor(s)
    rest = F.round((s - days) * F.lit(86_400_000_000), 0).cast("bigint")
    if epoch == 1900:
        base = F.when(s >= 61, F.lit(-25_569)).when((s >= 1) & (s < 60), F.lit(-25_568))
    else:
        base = F.when(s >= 0, F.lit(-24_107))
    inside = s < (2_958_466 if epoch == 1900 else 2_957_004)
    return F.when(inside, F.timestamp_micros((days.cast("bigint") + base) * F.lit(86_400_000_000) + rest))


@_door
def door_excel_serial(t: Column, epoch: int = 1900) -> Column:
    if epoch not in (1900, 1904):
        raise DeclarationError("an epoch is 1900 or 1904")
    fits = t.rlike(r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$")
    n = t.try_cast("double")
    value = serial_timestamp(F.when((n >= 0) & (n < 1e7), n), epoch)
    faults = [(~fits, "malformed", "unexpectedCharacter", None, None), (n < 0, "malformed", "negativeNotAllowed", None, None), (value.isNull(), "out_of_range", "dateFieldOutOfRange", None, None)]
    return _result(t, Door.EXCEL_SERIAL, value, faults)


@_door
def door_date(t: Column, options: DateOptions = STRICT) -> Column:
    compact = COMPACT_DATE in options.flags
    fits = t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$" + (r"|^[0-9]{8}$" if compact else ""))
    iso = F.when(t.rlike("^[0-9]{8}$"), F.regexp_replace(t, "^(.{4})(.{2})(.{2})$", "$1-$2-$3")).otherwise(t)
    value = F.when(fits, _date_or_fault(iso))
    month, day = F.substring(iso, 6, 2).try_cast("int"), F.substring(iso, 9, 2).try_cast("int")
    field = ~month.between(1, 12) | ~day.between(1, 31) | iso.startswith("0000")
    return _result(t, Door.DATE, value, [(~fits, "malformed", "unexpectedCharacter", None, None), (field, "out_of_range", "dateFieldOutOfRange", None, None), (value.isNull(), "out_of_range", "nonexistentDate", None, None)])


def _ordered(t: Column, order: str, options: DateOptions) -> tuple[Column, Column]:
    """An ISO date from separated fields, and whether the cell has their shape. Year-first cells are read as such always."""
    if order not in (YMD, MDY, DMY):
        raise DeclarationError(f"no such order: {order}")
    for month, name in options.months:
        t = F.regexp_replace(t, r"(?i)(?<=^|[^\p{L}])" + "".join("\\" + c if not c.isalnum() else c for c in name) + r"(?=$|[^\p{L}])", str(month))
    first = r"^([0-9]{4})([-/.])([0-9]{1,2})\2([0-9]{1,2})$"
    year = "[0-9]{4}|[0-9]{2}" if options.pivot else "[0-9]{4}"
    last = rf"^([0-9]{{1,2}})([-/. ])([0-9]{{1,2}})\2({year})$"
    early = rf"^({year})([-/. ])([0-9]{{1,2}})\2([0-9]{{1,2}})$"
    part = lambda p, k: F.regexp_extract(t, p, k)
    iso = lambda y, m, d: F.concat(y, F.lit("-"), F.lpad(m, 2, "0"), F.lit("-"), F.lpad(d, 2, "0"))

    def full(y: Column) -> Column:
        if not options.pivot:
            return y
        two = F.lit(options.pivot // 100 * 100) + y.try_cast("int")
        return F.when(F.char_length(y) == 2, F.lpad(F.when(two > options.pivot, two - 100).otherwise(two).cast("string"), 4, "0")).otherwise(y)

    out = F.when(t.rlike(first), iso(part(first, 1), part(first, 3), part(first, 4)))
    if order == YMD:
        out = out.when(t.rlike(early), iso(full(part(early, 1)), part(early, 3), part(early, 4)))
    else:
        m, d = (1, 3) if order == MDY else (3, 1)
        out = out.when(t.rlike(last), iso(full(part(last, 4)), part(last, m), part(last, d)))
    return out, out.isNotNull()


@_door
def door_date_ordered(t: Column, order: str = YMD, options: DateOptions = STRICT) -> Column:
    iso, fits = _ordered(t, order, options)
    value = _date_or_fault(iso)
    month, day = F.substring(iso, 6, 2).try_cast("int"), F.substring(iso, 9, 2).try_cast("int")
    field = ~month.between(1, 12) | ~day.between(1, 31)
    return _result(t, Door.DATE_ORDERED, value, [(~fits, "malformed", "unexpectedCharacter", None, None), (field, "out_of_range", "dateFieldOutOfRange", None, None), (value.isNull(), "out_of_range", "nonexistentDate", None, None)])


_CLOCK = r"([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(?:\.([0-9]{1,9}))?)?(?:\p{IsWhite_Space}*([AaPp])\.?[Mm]\.?)?"


@_door
def door_datetime(t: Column, order: str = YMD, options: DateOptions = STRICT) -> Column:
    """A civil date and time without a zone; no zone is invented."""
    shape = rf"^(.+?)(?:[Tt]|\p{{IsWhite_Space}}+){_CLOCK}$"
    iso, fits = _ordered(F.when(t.rlike(shape), F.regexp_extract(t, shape, 1)).otherwise(t), order, options)
    timed = t.rlike(shape)
    hour = F.regexp_extract(t, shape, 2).try_cast("int")
    half = F.lower(F.regexp_extract(t, shape, 6))
    hour = F.when(half == "", hour).when((hour < 1) | (hour > 12), F.lit(99)).when(half == "p", F.pmod(hour, F.lit(12)) + 12).otherwise(F.pmod(hour, F.lit(12)))
    second = F.regexp_extract(t, shape, 4)
    clock = F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), F.regexp_extract(t, shape, 3), F.lit(":"), F.when(second == "", "00").otherwise(second), F.when(F.regexp_extract(t, shape, 5) != "", F.concat(F.lit("."), F.substring(F.regexp_extract(t, shape, 5), 1, 6))).otherwise(""))
    date = _date_or_fault(iso)
    value = F.when(timed, F.concat(iso, F.lit(" "), clock)).otherwise(iso).try_cast("timestamp_ntz")
    faults = [(~fits, "malformed", "unexpectedCharacter", None, None), (date.isNull(), "out_of_range", "nonexistentDate", None, None), (value.isNull(), "out_of_range", "timeFieldOutOfRange", None, None)]
    return _result(t, Door.DATETIME, F.when(date.isNotNull(), value), faults)


@_door
def door_time(t: Column) -> Column:
    """Nanoseconds since midnight of a 24-hour clock."""
    shape = r"^([0-9]{2}):([0-9]{2})(?::([0-9]{2})(?:\.([0-9]{1,9}))?)?$"
    fits = t.rlike(shape)
    h, m, s = (F.regexp_extract(t, shape, k).try_cast("bigint") for k in (1, 2, 3))
    value = F.when((h < 24) & (m < 60) & (F.coalesce(s, F.lit(0)) < 60), ((h * 60 + m) * 60 + F.coalesce(s, F.lit(0))) * 1_000_000_000 + _fraction_ns(t, shape.replace("([0-9]{2}):", "[0-9]{2}:").replace(":([0-9]{2})", ":[0-9]{2}").replace("[0-9]{2}:([0-9]{2})", "[0-9]{2}:[0-9]{2}")))
    return _result(t, Door.TIME, value, [(~fits, "malformed", "unexpectedCharacter", None, None), (value.isNull(), "out_of_range", "timeFieldOutOfRange", None, None)])


@_door
def door_duration(t: Column) -> Column:
    """Nanoseconds of an ISO 8601 duration of weeks, days, hours, minutes and seconds; years and months have no fixed length."""
    shape = r"^([+-]?)P(?=[0-9T])(?:([0-9]+)W)?(?:([0-9]+)D)?(?:T(?=[0-9])(?:([0-9]+)H)?(?:([0-9]+)M)?(?:([0-9]+)(?:\.([0-9]{1,9}))?S)?)?$"
    fits = t.rlike(shape)
    group = lambda k: F.regexp_extract(t, shape, k)
    # A group that isn't there is 0; one of more digits than 64-bit nanoseconds can have is null.
    part = lambda k: F.when(group(k) == "", F.lit(0).cast("decimal(18,0)")).otherwise(group(k).try_cast("decimal(18,0)"))
    seconds = part(2) * 604_800 + part(3) * 86_400 + part(4) * 3600 + part(5) * 60 + part(6)
    seconds = F.when(seconds <= 10_000_000_000, seconds).try_cast("decimal(11,0)")
    fraction = F.rpad(group(7), 9, "0").try_cast("bigint")
    sign = F.when(group(1) == "-", -1).otherwise(1)
    value = F.when(fits, (sign * (seconds * F.lit(1_000_000_000) + fraction)).try_cast("bigint"))
    calendar = t.rlike(r"^[+-]?P.*[0-9][YM]") & ~t.rlike(r"T[0-9HMS.]*$")
    return _result(t, Door.DURATION, value, [(~fits & calendar, "malformed", "unknownUnit", None, None), (~fits, "malformed", "unexpectedCharacter", None, None), (value.isNull(), "out_of_range", "tooLarge", None, None)])


def door_text(raw: Column) -> Column:
    """The bytes as they are, where they are UTF-8; nothing is trimmed, and no bytes are an empty cell."""
    valid = F.is_valid_utf8(raw)
    # Replacement characters that the text has itself make way for others of as many bytes; only faults leave any.
    own = F.replace(raw.cast("string"), F.lit("\ufffd"), F.lit("\ufffc"))
    bad = F.octet_length(F.regexp_extract(F.make_valid_utf8(own), "^[^�]*", 0))
    reason = F.when(F.octet_length(raw) == 0, "empty").when(~valid, "malformed")
    detail = F.when(F.octet_length(raw) == 0, "blank").when(~valid, "invalidUtf8")
    value = F.when(reason.isNull(), raw.cast("string"))
    return F.struct(value.alias("value"), reason.alias("reason"), detail.alias("detail"), F.when(reason == "empty", 0).when(reason.isNotNull(), bad).cast("int").alias("offset"), F.when(reason == "empty", 0).when(reason.isNotNull(), 1).cast("int").alias("len"))


def _plain(s: Column, form: NumFormat, behind: int) -> tuple[Column, Column] | None:
    """Whether a cell is in the notation's plainest spelling with up to so many decimals, and it in digits, sign and point.

    None for notations that leave a doubt about that spelling.
    """
    if form.has(SEPARATOR_DETECT) or form.minus != "-" or form.plus != "+" or form.zero != "0":
        return None
    fraction = rf"(?:{re.escape(form.decimal)}[0-9]{{1,{behind}}})?" if behind else ""
    text = F.replace(s, F.lit(form.group), F.lit("")) if form.group else s
    if form.decimal != "." and behind:
        text = F.replace(text, F.lit(form.decimal), F.lit("."))
    return s.rlike(rf"\A-?{form.whole()}{fraction}\z"), text


_EDGES = rf"\A{SPACE}|{SPACE}\z"
_TWO = "[0-9]{2}"


def _lanes(kind: Door, s: Column, **how: object) -> tuple[Column | None, list[tuple[Column, str, str, Column | None, Column | None]]]:
    """The value of a cell in the door's plainest spelling, else null; and frequent faults: when, reason, detail, span."""
    form = how.get("form") or INVARIANT
    tidy = (F.octet_length(s) > 0) & ~s.rlike(_EDGES)
    faults: list[tuple[Column, str, str, Column | None, Column | None]] = []
    if kind in INTEGERS or kind in (Door.F32, Door.F64, Door.DECIMAL):
        scale = 0 if kind in INTEGERS else how.get("scale", 10) if kind is Door.DECIMAL else 15
        plain = _plain(s, form, scale)
        if plain is None:
            return None, faults
        fits, text = plain
        if not form.currency:
            # Radix prefixes may be of letters alone; all else needs a digit. Letters but for an exponent's are in no numeral,
            # nor is what stands between two digits here.
            faults.append((tidy & ~s.rlike(r"[0-9]|\A&"), "malformed", "noDigits", None, None))
            faults.append((tidy & s.rlike(r"\A[A-DF-Za-df-z][^()]*\z"), "malformed", "unexpectedCharacter", F.lit(0), F.lit(1)))
            ahead = F.octet_length(F.regexp_extract(s, r"\A-?[0-9]+", 0))
            faults.append((tidy & s.rlike(r"\A-?(?!0[xXbB])[0-9]+[-A-DF-Za-df-z:/_][^()]*[0-9A-Za-z]\z"), "malformed", "unexpectedCharacter", ahead, F.lit(1)))
        if kind in INTEGERS:
            if form.decimal == ".":
                point = F.instr(s, ".") - 1
                faults.append((s.rlike(rf"\A-?{form.whole()}\.[0-9]{{1,15}}\z"), "malformed", "fractionNotAllowed", point, F.octet_length(s) - point))
            low, high = INTEGERS[kind]
            value = text.try_cast("bigint")
            return F.when(fits & (~s.startswith("-") if low == 0 else F.lit(True)), F.when(value.between(max(low, -(1 << 63)), min(high, (1 << 63) - 1)), value).try_cast(SPARK_TYPE[kind])), faults
        if kind is Door.DECIMAL:
            return F.when(fits, text.try_cast(f"decimal({how.get('precision', 38)},{scale})")), faults
        value = text.try_cast("double") + F.lit(0.0)
        return F.when(fits & (F.char_length(s) < 30), value.try_cast(SPARK_TYPE[kind])), faults
    if kind is Door.BOOL:
        low = F.lower(s)
        value = F.when(low.isin(*TRUE), True).when(low.isin(*FALSE), False)
        return value, [(tidy, "malformed", "notRecognized", None, None)]
    if kind is Door.UUID:
        h = "[0-9a-fA-F]"
        bare = F.concat_ws("-", *(F.substring(F.lower(s), a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
        value = F.when(s.rlike(rf"\A{h}{{8}}-{h}{{4}}-{h}{{4}}-{h}{{4}}-{h}{{12}}\z"), F.lower(s)).when(s.rlike(rf"\A{h}{{32}}\z"), bare)
        return value, [(tidy & ~F.char_length(s).isin(32, 36), "malformed", "wrongLength", None, None), (tidy, "malformed", "unexpectedCharacter", None, None)]
    if kind in (Door.DATE, Door.DATE_ORDERED):
        value = F.when(s.rlike(rf"\A[0-9]{{4}}-{_TWO}-{_TWO}\z") & ~s.startswith("0000"), s.try_cast("date"))
        options, order = how.get("options") or STRICT, how.get("order") or YMD
        if kind is Door.DATE_ORDERED and order != YMD:
            shape = r"\A([0-9]{1,2})([-/. ])([0-9]{1,2})\2([0-9]{4})\z"
            iso = F.regexp_replace(s, shape, "$4-$1-$3" if order == MDY else "$4-$3-$1")
            value = F.coalesce(value, F.when(s.rlike(shape) & ~s.endswith("0000"), iso.try_cast("date")))
        plainly = kind is Door.DATE and COMPACT_DATE not in options.flags or kind is Door.DATE_ORDERED and not options.months
        if plainly:  # without two digits a cell has no date's shape
            faults.append((tidy & ~s.rlike("[0-9][-/. ]" if kind is Door.DATE_ORDERED else rf"\A[0-9]{{4}}-{_TWO}-{_TWO}\z"), "malformed", "unexpectedCharacter", None, None))
        return value, faults
    if kind is Door.TIMESTAMP:
        clock = rf"{_TWO}:{_TWO}:{_TWO}(?:\.[0-9]{{1,6}})?"
        return F.when(s.rlike(rf"\A[0-9]{{4}}-{_TWO}-{_TWO}T{clock}(?:Z|[+-]{_TWO}:{_TWO})\z"), s.try_cast("timestamp")), [(tidy & ~s.rlike("[0-9]:[0-9]"), "malformed", "unexpectedCharacter", None, None)]
    if kind is Door.DATETIME:
        return F.when(s.rlike(rf"\A[0-9]{{4}}-{_TWO}-{_TWO}[T ](?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:\.[0-9]{{1,6}})?\z") & ~s.startswith("0000"), s.try_cast("timestamp_ntz")), []
    if kind is Door.TIME:
        number = lambda at: F.substring(s, at, 2).try_cast("bigint")
        nanos = ((number(1) * 60 + number(4)) * 60 + number(7)) * 1_000_000_000 + F.rpad(F.substring(s, 10, 9), 9, "0").try_cast("bigint")
        return F.when(s.rlike(r"\A(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:\.[0-9]{1,9})?\z"), nanos), [(tidy & ~s.rlike("[0-9]:[0-9]"), "malformed", "unexpectedCharacter", None, None)]
    if kind is Door.UNIX:
        per = {"s": 1_000_000, "ms": 1000, "us": 1}.get(how.get("precision") or "s")
        micros = s.try_cast("bigint") * per if per else F.floor(s.try_cast("bigint") / 1000).cast("bigint")
        most = {"s": 11, "ms": 14, "us": 17, "ns": 15}[how.get("precision") or "s"]
        value = F.when(s.rlike(rf"\A[0-9]{{1,{most}}}\z"), F.when(micros <= 253_402_300_799_999_999, F.timestamp_micros(micros)))
        return value, [(tidy & ~s.rlike("[0-9]"), "malformed", "unexpectedCharacter", None, None)]
    if kind is Door.EXCEL_SERIAL:
        return F.when(s.rlike(r"\A[0-9]{1,7}(?:\.[0-9]{1,12})?\z"), serial_timestamp(s.try_cast("double"), how.get("epoch") or 1900)), []
    return None, faults


FIELDS = ("value", "reason", "offset", "len", "detail")


def _leaf(value: Column, reason: Column, offset: Column, n: Column, detail: Column) -> Column:
    return F.struct(value.alias("value"), reason.alias("reason"), detail.alias("detail"), offset.alias("offset"), n.alias("len"))


def judged(kind: Door, raw: Column, leaf: Callable[..., Column] = _leaf, **how: object) -> Column:
    """leaf(value, reason, offset, len, detail) of the door's verdict, which is never computed twice."""
    options: Mapping = {k: v for k, v in how.items() if v is not None}
    target = f"decimal({options.get('precision', 38)},{options.get('scale', 10)})" if kind is Door.DECIMAL else SPARK_TYPE[kind]
    none = lambda t: F.lit(None).cast(t)
    good = lambda v: leaf(v.cast(target), none("string"), none("int"), none("int"), none("string"))
    bytes_ = raw.cast("binary")
    if kind is Door.TEXT:
        plain = (F.octet_length(bytes_) > 0) & F.is_valid_utf8(bytes_)
        return F.when(plain, good(bytes_.cast("string"))).otherwise(let(door_text(bytes_), lambda x: leaf(*(x[f] for f in FIELDS))))
    s = bytes_.cast("string")
    value, faults = _lanes(kind, s, **options)
    out = None
    if value is not None:
        out = F.when(value.isNotNull(), good(value))
    for when, reason, detail, start, n in faults:
        bad = leaf(none(target), F.lit(reason), (F.lit(0) if start is None else start).cast("int"), (F.octet_length(s) if n is None else n).cast("int"), F.lit(detail))
        # The lanes' faults tell places in the bytes as they are, so these have to be text.
        when = F.is_valid_utf8(bytes_) & when
        out = F.when(when, bad) if out is None else out.when(when, bad)
    full = let(_door_of(kind, bytes_, options), lambda x: leaf(*(x[f] for f in FIELDS)))
    return full if out is None else out.otherwise(full)


def door(kind: Door, raw: Column, **how: object) -> Column:
    """The door of this kind on a cell's bytes (or text)."""
    return judged(kind, raw, **how)


def _door_of(kind: Door, raw: Column, options: Mapping) -> Column:
    """The door's full rules."""
    text = F.make_valid_utf8(raw)
    if kind in INTEGERS:
        return door_integer(text, kind, **options)
    if kind in (Door.F32, Door.F64):
        return door_real(text, kind, **options)
    return {
        Door.BOOL: door_bool, Door.DECIMAL: door_decimal, Door.UUID: door_uuid, Door.TIMESTAMP: door_timestamp, Door.UNIX: door_unix, Door.EXCEL_SERIAL: door_excel_serial,
        Door.DATE: door_date, Door.DATE_ORDERED: door_date_ordered, Door.DATETIME: door_datetime, Door.TIME: door_time, Door.DURATION: door_duration,
    }[kind](text, **options)
