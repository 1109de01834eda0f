"""What typed workbook cells say: kinds of number formats, serials as dates and times, and canonical text."""

from __future__ import annotations

import math
import re
from datetime import date, datetime, timedelta

NUMBER, DATE_TIME, ELAPSED, TEXT = "number", "datetime", "elapsed", "text"

_DAY = 86_400_000_000_000


def builtin(number: int) -> str:
    """The kind of a built-in format; those of other languages' dates are dates."""
    if 14 <= number <= 22 or 27 <= number <= 36 or number in (45, 47) or 50 <= number <= 58:
        return DATE_TIME
    if number == 46:
        return ELAPSED
    return TEXT if number == 49 else NUMBER


def classify(code: str) -> str:
    """The kind of a custom format by its first section: letters of dates and times outside of quotes and brackets."""
    first = re.split(r";(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)", code)[0]
    plain = re.sub(r'"[^"]*"?|\\.|_.|\*.', "", first)
    if re.search(r"\[(h+|m+|s+)\]", plain, re.I):
        return ELAPSED
    plain = re.sub(r"\[[^\]]*\]", "", plain)
    if plain.strip() == "@":
        return TEXT
    if re.search(r"general", plain, re.I):
        return NUMBER
    return DATE_TIME if re.search(r"[ymdhs]", plain, re.I) else NUMBER


def snapped(fraction_of: float) -> int:
    """Nanoseconds of a serial's fraction of a day: of the times that store as the same double, the roundest."""
    whole = int(fraction_of // 1)
    exact = (fraction_of - whole) * 86_400
    for digits in range(10):
        seconds = round(exact, digits)
        if whole + seconds / 86_400 == fraction_of:
            return round(seconds * 1_000_000_000)
    return round(exact * 1_000_000_000)


def from_serial(serial: float, epoch: int) -> tuple[date, int] | None:
    """Day and nanoseconds, or None where the serial names none."""
    if serial < 0 or serial >= (2_958_466 if epoch == 1900 else 2_957_004):
        return None
    day, ns = int(serial // 1), snapped(serial)
    if ns >= _DAY:
        day, ns = day + 1, ns - _DAY
    if epoch == 1904:
        return date(1904, 1, 1) + timedelta(days=day), ns
    if day < 1 or day == 60:
        return None
    return date(1899, 12, 31 if day < 60 else 30) + timedelta(days=day), ns


def number_text(x: float) -> str:
    """A number's shortest text: whole ones plain below 1e16, exponents without plus or leading zeros outside of 1e-4 to 1e16."""
    if not math.isfinite(x):
        return "NaN" if math.isnan(x) else "inf" if x > 0 else "-inf"
    if x == int(x) and abs(x) < 1e16:
        return str(int(x))
    return re.sub(r"e([+-])0*", lambda m: "e" + m[1].strip("+"), repr(x))


def clock_text(ns: int) -> str:
    seconds, rest = divmod(ns, 1_000_000_000)
    out = f"{seconds // 3600:02}:{seconds // 60 % 60:02}:{seconds % 60:02}"
    return out + (f".{rest:09}".rstrip("0") if rest else "")


def wall_text(day: date, ns: int) -> str:
    return f"{day.isoformat()}T{clock_text(ns)}"


def span_text(ns: int) -> str:
    """An ISO 8601 duration of days, hours, minutes and seconds."""
    sign, ns = ("-", -ns) if ns < 0 else ("", ns)
    days, rest = divmod(ns, _DAY)
    h, rest = divmod(rest, 3_600_000_000_000)
    m, rest = divmod(rest, 60_000_000_000)
    s = f"{rest / 1e9:.9f}".rstrip("0").rstrip(".")
    clock = (f"{h}H" if h else "") + (f"{m}M" if m else "") + (f"{s}S" if rest else "")
    return sign + "P" + (f"{days}D" if days else "") + (f"T{clock}" if clock else "" if days else "T0S")


_WALL = re.compile(r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}):(\d{2})(?::(\d{2})(?:\.(\d{1,9}))?)?)?(Z|[+-]\d{2}:\d{2})?$")


def parse_wall(text: str) -> tuple[date, int] | None:
    """An ISO date with or without a time; one with a zone is read as UTC."""
    m = _WALL.match(text.strip())
    if not m:
        return None
    try:
        day = date.fromisoformat(m[1])
    except ValueError:
        return None
    h, mi, s = int(m[2] or 0), int(m[3] or 0), int(m[4] or 0)
    if h > 23 or mi > 59 or s > 59:
        return None
    ns = ((h * 60 + mi) * 60 + s) * 1_000_000_000 + int((m[5] or "").ljust(9, "0"))
    if m[6] and m[6] != "Z":
        minutes = int(m[6][1:3]) * 60 + int(m[6][4:])
        at = datetime(day.year, day.month, day.day) - timedelta(minutes=minutes if m[6][0] == "+" else -minutes)
        day, ns = at.date(), ns + (at.hour * 60 + at.minute) * 60_000_000_000
        if ns >= _DAY:
            day, ns = day + timedelta(days=1), ns - _DAY
    return day, ns


_SPAN = re.compile(r"^([+-]?)P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)(?:\.(\d{1,9}))?S)?)?$")


def parse_span(text: str) -> int | None:
    m = _SPAN.match(text.strip())
    if not m or text.strip().endswith(("P", "T")):
        return None
    d, h, mi, s = (int(m[k] or 0) for k in (2, 3, 4, 5))
    ns = d * _DAY + ((h * 60 + mi) * 60 + s) * 1_000_000_000 + int((m[6] or "").ljust(9, "0"))
    return -ns if m[1] == "-" else ns
