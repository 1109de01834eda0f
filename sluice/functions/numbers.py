"""Declared notations of numbers, as regular expressions and as the steps that bring a cell to plain digits."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.types import DeclarationError

# The flags of a notation.
GROUPING, PARENS, EXPONENT, RADIX_PREFIX, PERCENT, SEPARATOR_DETECT, CURRENCY, TRAILING_SIGN = 1, 2, 4, 8, 16, 32, 64, 128
RETIRED, INDIAN = 256, 512
ALL = GROUPING | PARENS | EXPONENT | RADIX_PREFIX | PERCENT | CURRENCY

SPACE = r"\p{IsWhite_Space}"


@dataclass(frozen=True)
class NumFormat:
    """Symbols and permissions. ``flags`` may hold INDIAN for Indian groups; Western ones hold otherwise."""

    decimal: str = "."
    group: str = ","
    flags: int = ALL
    currency: str = ""
    currency_decimal: str = ""
    currency_group: str = ""
    minus: str = "-"
    plus: str = "+"
    percent: str = "%"
    zero: str = "0"

    def __post_init__(self):
        if self.flags & RETIRED:
            raise DeclarationError("flag 256 is retired")
        if self.flags & ~1023:
            raise DeclarationError(f"unknown flags in {self.flags}")
        if not self.decimal or self.decimal == self.group:
            raise DeclarationError("the decimal separator must be there and differ from the group separator")
        if any(len(x.encode()) > 8 for x in (self.decimal, self.group, self.minus, self.plus, self.percent)) or len(self.currency.encode()) > 16:
            raise DeclarationError("a symbol is too long")

    def has(self, flag: int) -> bool:
        return bool(self.flags & flag)

    def _integer(self, group: str) -> str:
        if not self.has(GROUPING) or not group:
            return "[0-9]+"
        g = re.escape(group)
        if self.has(INDIAN):
            return rf"(?:[0-9]+|[1-9][0-9]?(?:{g}[0-9]{{2}})*{g}[0-9]{{3}})"
        return rf"(?:[0-9]+|[1-9][0-9]{{0,2}}(?:{g}[0-9]{{3}})+)"

    def whole(self) -> str:
        """A pattern of the whole part, with groups where they are allowed."""
        return self._integer(self.group)

    def _signs(self) -> str:
        return rf"(?:{re.escape(self.plus)}|{re.escape(self.minus)})"

    def _body(self, group: str, decimal: str, fraction: bool) -> str:
        whole = self._integer(group)
        if not fraction:
            return whole
        d = re.escape(decimal)
        return rf"(?:{whole}(?:{d}[0-9]*)?|{d}[0-9]+)"

    def pattern(self, fraction: bool = True, percent: bool = False) -> str:
        """A Java regular expression of the whole trimmed cell, without radix prefixes; Western digits."""
        exponent = "(?:[eE][+-]?[0-9]+)?" if self.has(EXPONENT) else ""
        part = rf"{SPACE}*{re.escape(self.percent)}" if percent and self.has(PERCENT) else None
        share = rf"(?:{part})?" if part else ""
        plain = self._body(self.group, self.decimal, fraction) + exponent + share
        signed = rf"{self._signs()}?{plain}"
        forms = [signed]
        if self.has(TRAILING_SIGN):
            forms.append(rf"{plain}{self._signs()}")
        if self.has(PARENS):
            forms.append(rf"\({plain}\)")
        if self.has(CURRENCY) and self.currency:
            money = self._body(self.currency_group or self.group, self.currency_decimal or self.decimal, fraction) + exponent
            c = re.escape(self.currency)
            either = rf"(?:{c}{SPACE}*{money}|{money}{SPACE}*{c})"
            forms.append(rf"{self._signs()}?{either}")
            forms.append(rf"{c}{SPACE}*{self._signs()}{money}")
            if self.has(PARENS):
                forms.append(rf"\({either}\)")
        return "^(?:" + "|".join(forms) + ")$"

    def digits(self, t: Column) -> Column:
        """Native digits as Western ones."""
        if self.zero == "0":
            return t
        first = ord(self.zero)
        return F.translate(t, "".join(chr(first + i) for i in range(10)), "0123456789")

    def detected(self, t: Column) -> Column:
        """A cell whose separators are told from itself, in the notation of ``.`` and ``,``; null where they can't be."""
        dots = F.size(F.split(t, r"\.")) - 1
        commas = F.size(F.split(t, ",")) - 1
        last_dot, last_comma = F.length(F.substring_index(t, ".", -1)), F.length(F.substring_index(t, ",", -1))
        swapped = F.translate(t, ".,", ",.")
        right = F.when(dots == 1, F.regexp_extract(t, r"\.([0-9]*)", 1)).otherwise(F.regexp_extract(t, ",([0-9]*)", 1))
        whole = F.regexp_extract(t, "([0-9]*)[.,]", 1)
        single_decimal = F.when(F.char_length(right) != 3, True).when(whole == "0", True)
        return (
            F.when((dots == 0) & (commas == 0), t)
            .when((dots > 0) & (commas > 0), F.when(last_dot < last_comma, t).otherwise(swapped))
            .when(dots > 1, swapped)
            .when(commas > 1, t)
            .when(single_decimal, F.when(dots == 1, t).otherwise(swapped))
        )

    def plain(self, t: Column) -> Column:
        """A cell that fits the pattern, as sign, digits, point and exponent."""
        money = F.lit(False)
        if self.has(CURRENCY) and self.currency:
            money = t.contains(self.currency)
            t = F.replace(t, F.lit(self.currency), F.lit(""))
        negative = t.contains("(") | t.startswith(self.minus) | (t.endswith(self.minus) if self.has(TRAILING_SIGN) else F.lit(False))
        if self.has(CURRENCY) and self.currency:
            negative = negative | F.regexp_replace(t, rf"^{SPACE}+", "").startswith(self.minus)
        t = F.regexp_replace(t, rf"[()]|{SPACE}+|{re.escape(self.percent)}", "")
        t = F.regexp_replace(t, rf"^{self._signs()}", "")
        if self.has(TRAILING_SIGN):
            t = F.regexp_replace(t, rf"{self._signs()}$", "")

        def normal(group: str, decimal: str) -> Column:
            out = F.replace(t, F.lit(group), F.lit("")) if group else t
            return F.replace(out, F.lit(decimal), F.lit(".")) if decimal != "." else out

        out = normal(self.group, self.decimal)
        if self.currency and (self.currency_group or self.currency_decimal):
            out = F.when(money, normal(self.currency_group or self.group, self.currency_decimal or self.decimal)).otherwise(out)
        return F.concat(F.when(negative, "-").otherwise(""), out)


INVARIANT = NumFormat()
EUROZONE = NumFormat(decimal=",", group=".")
