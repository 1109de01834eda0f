"""Constraints on cast values: the numeric bounds, multiples, lengths and enumerations of an OpenAPI schema."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from decimal import ROUND_CEILING, ROUND_FLOOR, Decimal, InvalidOperation, localcontext

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.functions.doors import let, trimmed
from sluice.types import INTEGERS, REALS, SPARK_TYPE, DeclarationError, Door

ROUNDINGS = ("strict", "midpoint", "floor", "ceiling")


@dataclass(frozen=True)
class Constraints:
    """Numbers are given as text, so that they are exact. ``enum=()`` lets nothing through, None everything."""

    minimum: str | None = None
    exclusive_minimum: str | None = None
    maximum: str | None = None
    exclusive_maximum: str | None = None
    multiple_of: str | None = None
    rounding: str = "strict"
    min_length: int | None = None
    max_length: int | None = None
    trim: bool = False
    enum: Sequence[str] | None = None
    case_sensitive: bool = False

    def check(self, door: Door) -> None:
        numeric = [self.minimum, self.exclusive_minimum, self.maximum, self.exclusive_maximum, self.multiple_of]
        text = [self.min_length, self.max_length]
        if self.rounding not in ROUNDINGS:
            raise DeclarationError(f"no such rounding: {self.rounding}")
        if door is Door.TEXT:
            if any(x is not None for x in numeric):
                raise DeclarationError("text has no numeric bounds")
            if any(x is not None and x < 0 for x in text):
                raise DeclarationError("a length is at least 0")
        elif door in INTEGERS or door in REALS:
            if any(x is not None for x in text) or self.trim:
                raise DeclarationError("numbers have no length")
            for x in [*(x for x in numeric if x is not None), *(self.enum or ())]:
                try:
                    if not Decimal(x).is_finite():
                        raise InvalidOperation
                except InvalidOperation:
                    raise DeclarationError(f"not a number: {x!r}") from None
            if self.multiple_of is not None and Decimal(self.multiple_of) <= 0:
                raise DeclarationError("multipleOf is over 0")
        else:
            raise DeclarationError(f"a {door.value} column takes no constraints")


def _folded(text: str) -> str:
    """Simple case folding: one character for one, as translate() can do it."""
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _first(rules: Sequence[tuple[Column, str]]) -> Column:
    out = F.lit(None).cast("string")
    for when, keyword in reversed(rules):
        out = F.when(when, keyword).otherwise(out)
    return out


def _scale(kind: str) -> int:
    return int(kind.rstrip(")").split(",")[1]) if kind.startswith("decimal") else 0


def _compare(v: Column, door: Door, kind: str, bound: str) -> tuple[Column, Column, Column]:
    """Whether a value is under, at and over a bound, both taken as the decimals that they are.

    A real is the shortest decimal that reads back as it. Rounding keeps order, so a real that isn't the bound's
    nearest one lies on the same side of the bound as of that; for the nearest one itself the two decimals are compared
    here. Exact values lie on a grid of their scale, and so does what a finer bound is rounded to.
    """
    b = Decimal(bound)
    if door in (Door.F32, Door.F64):
        near = float(np.float32(float(b))) if door is Door.F32 else float(b)
        shortest = Decimal(repr(float(near))) if door is Door.F64 else Decimal(str(np.float32(near))) if np.isfinite(near) else b
        x = v.cast("double")
        same = x == F.lit(near)
        side = (shortest > b) - (shortest < b) if np.isfinite(near) else 0
        return (x < F.lit(near)) | (same & F.lit(side < 0)), same & F.lit(side == 0), (x > F.lit(near)) | (same & F.lit(side > 0))
    scale = _scale(kind)
    step = Decimal(1).scaleb(-scale)
    with localcontext() as exact:
        exact.prec = 400
        low, high = ((b / step).to_integral_value(r) * step for r in (ROUND_FLOOR, ROUND_CEILING))
        if abs(b) >= Decimal(10) ** (38 - scale):
            return F.lit(b > 0), F.lit(False), F.lit(b < 0)
        number = lambda d: F.lit(f"{d:f}").cast(f"decimal(38,{scale})")
        x = v.cast(f"decimal(38,{scale})")
        if low == high:
            return x < number(low), x == number(low), x > number(low)
        return x <= number(low), F.lit(False), x >= number(high)


def _numeric(v: Column, door: Door, rules: Constraints, kind: str) -> tuple[list[tuple[Column, str]], Column, Column, Column]:
    """What a number breaks, what is delivered for it, whether that was moved, and its place in an enumeration.

    Steps are counted in decimals of 34 digits, of which reals have 18 behind the point, others as many as the rules and the
    type have; values that those cannot hold have the remainder of their nearest double.
    """
    delivered, adjusted, late = v, F.lit(False), []
    if rules.multiple_of is not None:
        m = Decimal(rules.multiple_of)
        wide = f"decimal(34,{max(_scale(kind), min(18, max(0, -m.as_tuple().exponent)))})" if door not in (Door.F32, Door.F64) else "decimal(34,18)"
        m18 = F.lit(f"{m:f}").try_cast(wide)
        x = v.cast("string").try_cast(wide)
        fits = x.isNotNull() & (m18 > 0) & (x.cast("double") == v.cast("double"))
        near, step = v.cast("double"), F.lit(float(m))
        away = F.when(fits, F.try_mod(x, m18))
        rest = F.try_mod(near, step)
        whole = F.when(fits, away == 0).otherwise(rest == 0)
        if rules.rounding == "strict":
            late.append((~whole, "multipleOf"))
        else:

            def moved(x: Column, m: Column, away: Column) -> Column:
                low = x - F.when(away < 0, away + m).otherwise(away)
                past = x - low
                even = F.try_mod(F.floor(F.try_divide(low, m)), F.lit(2)) == 0
                near = F.when(past > m - past, low + m).when(past < m - past, low).when(even, low).otherwise(low + m)
                return {"floor": low, "ceiling": low + m, "midpoint": near}[rules.rounding]

            there = F.when(fits, moved(x, m18, away).try_cast(kind)).otherwise(moved(near, step, rest).try_cast(kind))
            delivered = F.when(whole, v).otherwise(there)
            adjusted = ~whole
            late.append((delivered.isNull(), "multipleOf"))
            if door in INTEGERS:
                a, b = INTEGERS[door]
                late.append(((delivered < F.lit(a).cast("decimal(20,0)")) | (delivered > F.lit(b).cast("decimal(20,0)")), "multipleOf"))
    broken = []
    for bound, keyword, which in ((rules.minimum, "minimum", (0,)), (rules.exclusive_minimum, "exclusiveMinimum", (0, 1)), (rules.maximum, "maximum", (2,)), (rules.exclusive_maximum, "exclusiveMaximum", (1, 2))):
        if bound is not None:
            sides = _compare(delivered, door, kind, bound)
            broken.append((sides[which[0]] if len(which) == 1 else sides[which[0]] | sides[which[1]], keyword))
    broken += late
    index = F.lit(None).cast("int")
    if rules.enum is not None:
        index = F.when(F.lit(False), 0)
        for i, entry in reversed(list(enumerate(rules.enum))):
            index = F.when(_compare(delivered, door, kind, entry)[1], i).otherwise(index)
        broken.append((index.isNull(), "enum"))
    return broken, delivered, adjusted, index


def checked(cell: Column, raw: Column, door: Door, rules: Constraints, kind: str | None = None) -> Column:
    """The door's structure with ``keyword``, ``adjusted`` and ``enum_index``; of several broken rules the first in order.

    A violated cell has its value as cast. A cell that isn't cast, and one that no door judged, has no check.
    """
    rules.check(door)
    kind = kind or SPARK_TYPE[door]
    text = door is Door.TEXT

    def judge(c: Column) -> Column:
        ok = c["reason"].isNull()
        if text:
            v = trimmed(c["value"]) if rules.trim else c["value"]
            n = F.char_length(v)
            broken = [(n < rules.min_length, "minLength")] if rules.min_length is not None else []
            broken += [(n > rules.max_length, "maxLength")] if rules.max_length is not None else []
            adjusted, delivered, index = F.lit(False), v, F.lit(None).cast("int")
            if rules.enum is not None:
                fold = (lambda s: s) if rules.case_sensitive else _folded
                shown = v if rules.case_sensitive else F.lower(v)
                index = F.when(F.lit(False), 0)
                for i, entry in reversed(list(enumerate(rules.enum))):
                    index = F.when(shown == fold(entry), i).otherwise(index)
                delivered = F.coalesce(F.get(F.array(*map(F.lit, rules.enum)), index), v) if rules.enum else v
                broken.append((index.isNull(), "enum"))
            span = F.octet_length(c["value"]) - F.octet_length(F.regexp_replace(c["value"], r"^\p{IsWhite_Space}+", "")) if rules.trim else F.lit(0)
            length = F.octet_length(v)
            cast = c["value"]
        else:
            broken, delivered, adjusted, index = _numeric(c["value"], door, rules, kind)
            span, length, cast = F.lit(0), F.octet_length(raw), c["value"]
        keyword = _first(broken)
        found = F.struct(keyword.alias("keyword"), delivered.alias("delivered"), adjusted.alias("adjusted"), index.alias("index"))
        return let(
            F.when(ok, found),
            lambda k: F.struct(
                F.when(k["keyword"].isNotNull(), cast).otherwise(F.when(ok, k["delivered"])).cast(kind).alias("value"),
                F.coalesce(c["reason"], F.when(k["keyword"].isNotNull(), "violation")).alias("reason"),
                c["detail"].alias("detail"),
                F.coalesce(c["offset"], F.when(k["keyword"].isNotNull(), span)).cast("int").alias("offset"),
                F.coalesce(c["len"], F.when(k["keyword"].isNotNull(), length)).cast("int").alias("len"),
                k["keyword"].alias("keyword"),
                F.when(ok & k["keyword"].isNull(), k["adjusted"]).alias("adjusted"),
                F.when(ok & k["keyword"].isNull(), k["index"]).cast("int").alias("enum_index"),
            ),
        )

    return let(cell, judge)
