"""Suggesting a plan from a sample: an aggregate over all columns and doors, then rules on the counts. Never applied by itself."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions.doors import DMY, MDY, YMD, door, trimmed
from sluice.functions.numbers import EUROZONE, INVARIANT, NumFormat
from sluice.plans.columns import Column
from sluice.types import Door, StructuralFailure

SAMPLE, MOST = 1000, 4096
#: Integer doors by preference, then the real one; each in the notation with a decimal point and the one with a comma.
NUMBERS = (Door.I32, Door.I64, Door.F64)
NOTATIONS = {"point": INVARIANT, "comma": EUROZONE}


@dataclass(frozen=True)
class Suggestion:
    """What one column's cells fit. param tells the candidates where ambiguous: notations or date orders."""

    door: Door
    status: str
    matched: int
    sampled: int
    param: tuple[str, ...] = ()


def _ok(cell: SparkColumn, kind: Door, **how: object) -> SparkColumn:
    return door(kind, cell, **how)["reason"].isNull()


def _tally(text: SparkColumn, declared: NumFormat | None, cell: SparkColumn | None = None) -> list[SparkColumn]:
    """Counts for a column's text; blank cells don't count.

    cell: the workbook cell that the text is of; a typed number there fits every notation by its value, and other typed
    cells fit no number door.
    """
    t = trimmed(text)
    full = text.isNotNull() & (t != "")
    numeric, typed, by_value = full, F.lit(False), None
    if cell is not None:
        from sluice.sources.workbook import typed_door

        typed = F.coalesce(cell["kind"] != "text", F.lit(False))
        by_value = lambda kind: (cell["kind"] == "number") & typed_door(cell, Column(0, kind))["reason"].isNull()
    count = lambda when, key: F.count_if(F.coalesce(when, F.lit(False))).alias(key)
    out = [count(full, "sampled"), count(full & F.is_valid_utf8(text), "text"), count(full & _ok(text, Door.BOOL), "bool")]
    for key, form in NOTATIONS.items() if declared is None else (("declared", declared),):
        # A digit after a leading zero is an identifier's, and a whole number that 64 bits don't hold loses digits as a real.
        numeric = full & ~form.digits(t).rlike(rf"^[^0-9{re.escape(form.decimal)}]*0[0-9]")
        long = _past_64_bits(t, form)
        for kind in NUMBERS:
            fits = numeric & _ok(text, kind, form=form)
            fits = fits & ~long if kind is Door.F64 else fits
            out.append(count(fits if by_value is None else F.when(typed, full & by_value(kind)).otherwise(fits), f"{kind.value}|{key}"))
    out += [count(full & _ok(text, Door.DATE), "date")]
    out += [count(full & _ok(text, Door.DATE_ORDERED, order=o), o) for o in (YMD, MDY, DMY)]
    out += [count(full & _ok(text, Door.TIMESTAMP), "timestamp"), count(full & _ok(text, Door.UUID), "uuid")]
    seen = full & ~typed & F.lit(declared is None)
    return [*out, count(seen & text.contains(","), "comma"), count(seen & text.contains("."), "dot")]


def _past_64_bits(t: SparkColumn, form: NumFormat) -> SparkColumn:
    """Whether a cell is a whole number of this notation, without an exponent, past 64 bits."""
    shown = form.digits(t)
    whole = shown.rlike(form.pattern(fraction=False)) & ~shown.rlike("[0-9][eE]")
    digits = F.ltrim(F.regexp_replace(shown, "[^0-9]", ""), F.lit("0"))
    top = F.when(form.plain(shown).startswith("-"), F.lit(str(1 << 63))).otherwise(F.lit(str((1 << 63) - 1)))
    return whole & ((F.char_length(digits) > 19) | ((F.char_length(digits) == 19) & (digits > top)))


def suggest_typed(frame: DataFrame, columns: Sequence[str]) -> dict[str, Suggestion]:
    """A suggestion for each column of workbook cells of a frame that is a sample."""
    counts = tally(frame, columns, cells=True)
    return {name: _judge(counts[name], None) for name in columns}


def _judge(n: Mapping[str, int], declared: NumFormat | None) -> Suggestion:
    total = n["sampled"]
    doors = {k: v for k, v in n.items() if k not in ("sampled", "text", "comma", "dot")}
    best = max(doors.values(), default=0)
    resolved = lambda kind, *param: Suggestion(kind, "resolved", total, total, param)
    all_of = lambda key: n[key] == total
    number_of = lambda key: next((kind for kind in NUMBERS if f"{kind.value}|{key}" in n and all_of(f"{kind.value}|{key}")), None)
    if total:
        if all_of("bool"):
            return resolved(Door.BOOL)
        if declared is not None:
            # The declared notation is the whole rule: nothing is left open.
            if kind := number_of("declared"):
                return resolved(kind, "declared")
        else:
            point, comma = number_of("point"), number_of("comma")
            if point and comma and (n["comma"] or n["dot"]):
                return Suggestion(point, "ambiguous", total, total, ("point", "comma"))
            if point:
                return resolved(point, *(["point"] if n["comma"] else []))
            if comma:
                return resolved(comma, "comma")
        if all_of("date"):
            return resolved(Door.DATE)
        if all_of(YMD):
            return resolved(Door.DATE_ORDERED, YMD)
        if orders := tuple(o for o in (MDY, DMY) if all_of(o)):
            return Suggestion(Door.DATE_ORDERED, "resolved" if len(orders) == 1 else "ambiguous", total, total, orders)
        for kind in (Door.TIMESTAMP, Door.UUID):
            if all_of(kind.value):
                return resolved(kind)
        if not best and all_of("text"):
            return resolved(Door.TEXT)
    return Suggestion(Door.TEXT, "unresolved", best, total)


def tally(frame: DataFrame, columns: Sequence[str], formats: Mapping[str, NumFormat] | None = None, cells: bool = False) -> dict[str, Counter]:
    """The counts of each column of a sample. Columns of one notation are stacked, so that the doors are planned once for all of them."""
    formats = formats or {}
    out = {name: Counter() for name in columns}
    for declared in {formats.get(name) for name in columns}:
        own = [name for name in columns if formats.get(name) == declared]
        stacked = frame.select(F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(f"`{name}`").alias("x")) for i, name in enumerate(own)))).alias("s")).select("s.i", "s.x")
        x = F.col("x")
        asked = _tally(F.when(x["kind"] != "empty", x["raw"].cast("string")), None, x) if cells else _tally(x, declared)
        for r in stacked.groupBy("i").agg(*asked).collect():  # a row per column
            out[own[r["i"]]] = Counter({k: v for k, v in r.asDict().items() if k != "i"})
    return out


def suggest(frame: DataFrame, columns: Sequence[str] | None = None, rows: int = SAMPLE, formats: Mapping[str, NumFormat] | None = None, order: Sequence[str] = ()) -> tuple[dict[str, Suggestion], bool]:
    """A suggestion for each text column of frame's first rows, and whether rows lie past them.

    The sample is taken once, at most MOST rows; ``order`` names the columns that put the rows in order, without which
    the first rows are those of frame's own order.
    """
    columns = list(columns or [c for c in frame.columns if c not in order])
    rows = min(max(1, rows), MOST)
    first = (frame.orderBy(*order) if order else frame).select(*(F.col(f"`{c}`").cast("string").alias(c) for c in columns)).limit(rows + 1).collect()  # at most MOST + 1 rows
    sample = frame.sparkSession.createDataFrame([tuple(r) for r in first[:rows]], ", ".join(f"`{c}` string" for c in columns))
    counts = tally(sample, columns, formats)
    return {name: _judge(counts[name], (formats or {}).get(name)) for name in columns}, len(first) > rows


def suggest_source(reader, rows: int = SAMPLE, formats: Mapping[str, NumFormat] | None = None) -> tuple[dict[str, Suggestion], bool]:
    """For the first records of the first source of a delimited reader without a plan; a failure among them raises, one past them doesn't."""
    rows = min(max(1, rows), MOST)
    names = reader.header().names
    first = reader.records(first=True).orderBy("_record").limit(rows + 1).collect()  # at most MOST + 1 rows
    if broken := next((r for r in first[:rows] if r["failure"] is not None), None):
        raise StructuralFailure(str(broken["failure"].asDict()))
    cells = [[c["raw"] for c in r["cells"]] for r in first[:rows]]
    width = len(names) or max(map(len, cells), default=0)
    names = names or [f"c{i}" for i in range(width)]
    keys = [str(i) for i in range(width)]
    frame = reader.sources.sparkSession.createDataFrame([tuple([*c, *[None] * width][:width]) for c in cells], ", ".join(f"`{k}` binary" for k in keys) or "none string")
    frame = frame.select(*(F.col(f"`{k}`").cast("string").alias(k) for k in keys))
    given = {str(i): formats[n] for i, n in enumerate(names) if formats and n in formats}
    counts = tally(frame, keys, given)
    return {n: _judge(counts[str(i)], given.get(str(i))) for i, n in enumerate(names)}, len(first) > rows


def plan_of(found: Mapping[str, Suggestion], order: str | None = None) -> list[Column]:
    """A plan: resolved columns have their door, others are text; a declared order settles dates that it fits."""
    out = []
    for name, s in found.items():
        ok = s.status == "resolved" or (s.status == "ambiguous" and s.door is Door.DATE_ORDERED and order in s.param)
        if not ok:
            out.append(Column(name, Door.TEXT, name))
            continue
        form = EUROZONE if s.param == ("comma",) else None
        dates = (order if order in s.param else s.param[0]) if s.door is Door.DATE_ORDERED else None
        out.append(Column(name, s.door, name, form=form, order=dates))
    return out
