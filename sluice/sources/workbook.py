"""Workbooks (XLSX, ODS and Numbers) as DataFrames: a task reads a sheet's XML as a stream, the plan's expressions judge its cells.

The format is told by the package, not by its name. A cell has a kind: text, number, bool, wall (date and time), clock, span,
error, or none; a formula whose result wasn't stored is uncached.
"""

from __future__ import annotations

import io
import math
import re
import zipfile
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.constraints import checked
from sluice.functions.doors import door, let, serial_timestamp
from sluice.operators.suggest import MOST, SAMPLE, Suggestion, suggest_typed
from sluice.operators.verdicts import Typed
from sluice.plans.columns import Column, Header, bind
from sluice.sources import serials
from sluice.sources.framing import Failure
from sluice.sources.numbers_document import Damaged, NumbersDocument
from sluice.types import INTEGERS, DeclarationError, Door, NoSheet, StructuralFailure

WIDEST = 16_384
CELL = "struct<kind: string, raw: binary, quoted: boolean, num: double, day: date, nanos: long, uncached: boolean>"
RECORDS = f"_source string, _record long, _line long, _width int, _expected int, _epoch int, cells array<{CELL}>, failure struct<kind: string, record: long, line: long, byte: long, expected: int, found: int>"
_CELL = pa.struct([("kind", pa.string()), ("raw", pa.binary()), ("quoted", pa.bool_()), ("num", pa.float64()), ("day", pa.date32()), ("nanos", pa.int64()), ("uncached", pa.bool_())])
_FAILURE = pa.struct([("kind", pa.string()), ("record", pa.int64()), ("line", pa.int64()), ("byte", pa.int64()), ("expected", pa.int32()), ("found", pa.int32())])

#: Bytes of a package that a task takes whole; Spark's files as rows end there too.
LARGEST = (1 << 31) - 1

# The spellings of errors in cells.
ERRORS = ("#NULL!", "#DIV/0!", "#VALUE!", "#REF!", "#NAME?", "#NUM!", "#N/A", "#GETTING_DATA")


class Package(Exception):
    """A package that cannot be read, with the failure's kind."""

    def __init__(self, kind: str):
        super().__init__(kind)
        self.kind = kind


@dataclass(frozen=True)
class Range:
    """Rows and columns from 1, ends included; 0 leaves a side open."""

    first_row: int = 0
    first_column: int = 0
    last_row: int = 0
    last_column: int = 0

    @classmethod
    def parse(cls, text: str) -> Range:
        m = re.fullmatch(r"([A-Z]{1,3})([1-9][0-9]{0,6}):([A-Z]{1,3})([1-9][0-9]{0,6})", text)
        if not m:
            raise DeclarationError(f"no range: {text!r}")
        a, b = column_number(m[1]), column_number(m[3])
        if max(a, b) > WIDEST or a > b or int(m[2]) > int(m[4]):
            raise DeclarationError(f"no range: {text!r}")
        return cls(int(m[2]), a, int(m[4]), b)


@dataclass(frozen=True)
class SheetOptions:
    has_header: bool = True
    skip: int = 0
    header_row: int = 0
    skip_empty_rows: bool = True
    range: Range = Range()
    tokens: tuple[str, ...] = ()


def column_number(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _attribute(e: ET.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if _local(k) == name), None)


def cell(kind: str, text: str = "", num: float | None = None, day=None, nanos: int | None = None, uncached: bool = False) -> dict:
    return {"kind": kind, "raw": text.encode(), "quoted": False, "num": num, "day": day, "nanos": nanos, "uncached": uncached}


NOTHING = cell("empty")


class Book:
    """An open package: its format, date system and sheets."""

    def __init__(self, data: bytes):
        if data[:8] == b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
            raise Package("encrypted")
        if data[:2] != b"PK":
            raise Package("not_a_zip")
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile:
            raise Package("container") from None
        self.names = {n.lstrip("/").lower(): n for n in self.zip.namelist()}
        if any(i.flag_bits & 1 for i in self.zip.infolist()):
            raise Package("encrypted")
        self.strings: list[str] | None = None
        if "index/document.iwa" in self.names:
            self.format, self.epoch = "numbers", 1900
            try:
                self.numbers = NumbersDocument(self.zip, self.names)
            except Damaged as e:
                raise Package(e.kind) from None
            self.sheets = [(name, hidden) for name, hidden, _ in self.numbers.tables]
        elif "content.xml" in self.names:
            self.format = "ods"
            self.epoch = 1900
            self.sheets = [(_attribute(t, "name") or "", False) for t in self._tables()]
        elif "xl/workbook.bin" in self.names:
            raise Package("not_a_workbook")  # the binary kind of workbook
        elif "[content_types].xml" in self.names or "xl/workbook.xml" in self.names:
            self.format = "xlsx"
            self._workbook()
        else:
            raise Package("not_a_workbook")

    def open(self, part: str) -> io.BufferedIOBase:
        if part.lstrip("/").lower() not in self.names:
            raise Package("missing_part")
        return self.zip.open(self.names[part.lstrip("/").lower()])

    def part(self, name: str) -> ET.Element:
        with self.open(name) as f:
            return ET.parse(f).getroot()

    def _tables(self) -> Iterator[ET.Element]:
        with self.open("content.xml") as f:
            for event, e in ET.iterparse(f, ("start", "end")):
                if _local(e.tag) == "table" and event == "start":
                    yield e
                elif event == "end" and _local(e.tag) in ("table-row", "table"):
                    e.clear()

    def _workbook(self) -> None:
        root = "xl/workbook.xml"
        if "_rels/.rels" in self.names:
            for r in self.part("_rels/.rels"):
                if (r.get("Type") or "").endswith("/officeDocument"):
                    root = (r.get("Target") or root).lstrip("/")
        book = self.part(root)
        if _local(book.tag) != "workbook":
            raise Package("not_a_workbook")
        self.base = root.rpartition("/")[0]
        rels = f"{self.base}/_rels/{root.rpartition('/')[2]}.rels"
        self.targets = {r.get("Id"): (r.get("Target") or "", (r.get("Type") or "").rpartition("/")[2]) for r in self.part(rels)} if rels.lower() in self.names else {}
        self.epoch = 1900
        self.sheets, self.parts = [], []
        for e in book.iter():
            if _local(e.tag) == "workbookPr" and (e.get("date1904") or "").lower() in ("1", "true"):
                self.epoch = 1904
            if _local(e.tag) == "sheet":
                target, kind = self.targets.get(_attribute(e, "id"), ("", ""))
                if kind == "worksheet":
                    self.sheets.append((e.get("name") or "", (e.get("state") or "visible") != "visible"))
                    self.parts.append(target.lstrip("/") if target.startswith("/") else f"{self.base}/{target}")
        self.styles = self._styles()

    def _related(self, kind: str) -> str | None:
        return next((t.lstrip("/") if t.startswith("/") else f"{self.base}/{t}" for t, k in self.targets.values() if k == kind), None)

    def _styles(self) -> list[str]:
        where = self._related("styles")
        if where is None or where.lower() not in self.names:
            return []
        root = self.part(where)
        codes = {int(e.get("numFmtId") or 0): e.get("formatCode") or "" for e in root.iter() if _local(e.tag) == "numFmt"}
        kinds = lambda n: serials.classify(codes[n]) if n in codes else serials.builtin(n)
        return [kinds(int(x.get("numFmtId") or 0)) for e in root if _local(e.tag) == "cellXfs" for x in e]

    def _strings(self) -> list[str]:
        if self.strings is None:
            where = self._related("sharedStrings")
            self.strings = [_rich(si) for si in self.part(where)] if where and where.lower() in self.names else []
        return self.strings

    def sheet(self, which: int | str) -> int:
        if isinstance(which, str):
            found = [i for i, (n, _) in enumerate(self.sheets) if n == which]
            if not found:
                raise NoSheet(f"no sheet {which!r}")
            return found[0]
        if not 0 <= which < len(self.sheets):
            raise NoSheet(f"no sheet {which}")
        return which

    def rows(self, which: int | str, first: int = 0) -> Iterator[tuple[int, int, dict[int, dict]]]:
        """Row number from 1, how often it repeats, and its cells by column from 1; cells of rows ahead of the first aren't made."""
        return {"xlsx": self._xlsx, "ods": self._ods, "numbers": self._numbers}[self.format](self.sheet(which), first)

    def _numbers(self, which: int, first: int) -> Iterator[tuple[int, int, dict[int, dict]]]:
        try:
            for row, cells in self.numbers.rows(which):
                if row < first:
                    continue
                yield row, 1, {c: cell(*v) for c, v in cells.items()}
        except Damaged as e:
            raise Package(e.kind) from None

    def _number(self, x: float, style: str) -> dict:
        if not math.isfinite(x):
            raise ValueError(x)
        if style == serials.ELAPSED:
            ns = round(x * 86_400_000_000_000) if abs(x) < 100_000 else None
            return cell("span", serials.span_text(ns), x, nanos=ns) if ns is not None else cell("number", serials.number_text(x), x)
        if style == serials.DATE_TIME and x >= 0:
            if x < 1 and self.epoch == 1900:
                ns = serials.snapped(x)
                return cell("clock", serials.clock_text(ns), x, nanos=ns)
            if (wall := serials.from_serial(x, self.epoch)) is not None:
                return cell("wall", serials.wall_text(*wall), x, wall[0], wall[1])
        return cell("number", serials.number_text(x), x)

    def _xlsx(self, which: int, first: int) -> Iterator[tuple[int, int, dict[int, dict]]]:
        at = 0
        with self.open(self.parts[which]) as f:
            for _, e in ET.iterparse(f, ("end",)):
                if _local(e.tag) != "row":
                    continue
                at = int(e.get("r") or at + 1)
                if at < first:
                    e.clear()
                    continue
                cells, column = {}, 0
                for c in e:
                    if _local(c.tag) == "c":
                        ref = re.match("[A-Za-z]+", c.get("r") or "")
                        column = column_number(ref[0].upper()) if ref else column + 1
                        value = self._xlsx_cell(c)
                        if value is not None and column <= WIDEST:
                            cells[column] = value
                yield at, 1, cells
                e.clear()

    def _xlsx_cell(self, c: ET.Element) -> dict | None:
        parts = {_local(x.tag): x for x in c}
        kind, v = c.get("t") or "n", parts.get("v")
        text = v.text or "" if v is not None else ""
        style = int(c.get("s") or 0)
        style = self.styles[style] if style < len(self.styles) else serials.NUMBER
        if kind == "inlineStr":
            return cell("text", _rich(parts["is"])) if "is" in parts else None
        if "f" in parts and text == "" and kind != "str":
            return cell("empty", uncached=True)
        if kind == "str":
            return cell("text", text) if v is not None or "f" in parts else None
        if v is None or text == "":
            return None
        if kind == "s":
            try:
                return cell("text", self._strings()[int(text)])
            except (IndexError, ValueError):
                raise Package("shared_string") from None
        if kind == "b":
            return cell("bool", "true" if text.strip() in ("1", "true") else "false", 1.0 if text.strip() in ("1", "true") else 0.0)
        if kind == "e":
            return cell("error", text)
        if kind == "d":
            wall = serials.parse_wall(text)
            return cell("wall", serials.wall_text(*wall), None, *wall) if wall else cell("text", text)
        try:
            return self._number(float(text), style)
        except ValueError:
            return cell("text", text)

    def _ods(self, which: int, first: int) -> Iterator[tuple[int, int, dict[int, dict]]]:
        table, at, depth = -1, 0, 0
        with self.open("content.xml") as f:
            for event, e in ET.iterparse(f, ("start", "end")):
                name = _local(e.tag)
                if name == "table":
                    if event == "start":
                        table += depth == 0
                        depth += 1
                    else:
                        depth -= 1
                        e.clear()
                        if table == which and depth == 0:
                            return
                elif name == "table-row" and event == "end" and depth == 1:
                    if table == which:
                        times = int(_attribute(e, "number-rows-repeated") or 1)
                        cells, column = {}, 0
                        for c in e if at + times >= first else ():
                            if _local(c.tag) in ("table-cell", "covered-table-cell"):
                                wide = int(_attribute(c, "number-columns-repeated") or 1)
                                value = _ods_cell(c)
                                if value is not None and (value["kind"] != "empty" or value["uncached"]):
                                    for k in range(column + 1, min(column + wide, WIDEST) + 1):
                                        cells[k] = value
                                column += wide
                        yield at + 1, times, cells
                        at += times
                    e.clear()


def _rich(e: ET.Element) -> str:
    """A string's runs, without its phonetic ones."""
    out = []
    for x in e:
        if _local(x.tag) == "t":
            out.append(x.text or "")
        elif _local(x.tag) == "r":
            out += [t.text or "" for t in x if _local(t.tag) == "t"]
    return "".join(out)


def _ods_text(c: ET.Element) -> str:
    def inner(e: ET.Element) -> str:
        out = [e.text or ""]
        for x in e:
            name = _local(x.tag)
            if name == "s":
                out.append(" " * int(_attribute(x, "c") or 1))
            elif name == "tab":
                out.append("\t")
            elif name == "line-break":
                out.append("\n")
            elif name not in ("annotation", "note"):
                out.append(inner(x))
            out.append(x.tail or "")
        return "".join(out)

    return "\n".join(inner(p) for p in c if _local(p.tag) == "p")


def _ods_cell(c: ET.Element) -> dict | None:
    kind, formula = _attribute(c, "value-type"), _attribute(c, "formula")
    text = _ods_text(c)
    has_text = any(_local(p.tag) == "p" for p in c)
    if kind in ("float", "currency", "percentage"):
        value = _attribute(c, "value")
        try:
            if value and not math.isfinite(float(value)):
                return cell("text", value)
            return cell("number", serials.number_text(float(value)), float(value)) if value else cell("empty", uncached=formula is not None)
        except ValueError:
            return cell("text", value)
    if kind == "date":
        value = _attribute(c, "date-value")
        wall = serials.parse_wall(value or "")
        return cell("wall", serials.wall_text(*wall), None, *wall) if wall else cell("text", value) if value else cell("empty", uncached=formula is not None)
    if kind == "time":
        value = _attribute(c, "time-value")
        ns = serials.parse_span(value or "")
        return cell("span", serials.span_text(ns), nanos=ns) if ns is not None else cell("text", value) if value else cell("empty", uncached=formula is not None)
    if kind == "boolean":
        value = _attribute(c, "boolean-value")
        return cell("bool", value, 1.0 if value == "true" else 0.0) if value else cell("empty", uncached=formula is not None)
    if not has_text:
        return cell("empty", uncached=True) if formula is not None else None
    return cell("error", text) if text in ERRORS and formula is not None else cell("text", text) if text or kind == "string" else None


def _reading(data: bytes | None, which: int | str, options: SheetOptions) -> Iterator[tuple[int, int, list[dict | None]] | list[str] | Failure | int]:
    """The date system, the header, then delivered rows (number, row, cells), then a failure if the package broke."""
    area, number, header = options.range, 0, options.has_header
    skip, discard = options.skip, options.header_row
    if data is None:
        yield Failure("too_large", 0, 0, 0)
        return
    try:
        book = Book(data)
        yield book.epoch
        for row, times, cells in book.rows(which, area.first_row):
            if area.last_row and row > area.last_row:
                break
            first = max(row, area.first_row or 1)
            last = min(row + times - 1, area.last_row or row + times - 1)
            if first > last:
                continue
            left, right = area.first_column or 1, area.last_column or WIDEST
            inside = {c - left: v for c, v in cells.items() if left <= c <= right}
            inside = {c: v for c, v in inside.items() if v["kind"] != "empty" or v["uncached"]}
            if not inside and options.skip_empty_rows:
                skip -= min(skip, last - first + 1)
                continue
            width = max(inside, default=-1) + 1
            line = [inside.get(c) for c in range(width)]
            # Repeats that no row comes of are counted, not walked.
            passed = min(skip, last - first + 1)
            skip, first = skip - passed, first + passed
            passed = min(discard, last - first + 1)
            discard, first = discard - passed, first + passed
            if header and first <= last:
                header, first = False, first + 1
                yield [v["raw"].decode() if v else "" for v in line]
            for k in range(first, last + 1):
                yield number, k, line
                number += 1
        if header:
            yield []
    except Package as e:
        yield Failure(e.kind, number, 0, 0)
    except ET.ParseError:
        yield Failure("xml", number, 0, 0)
    except (zlib.error, zipfile.BadZipFile, EOFError):
        yield Failure("deflate", number, 0, 0)
    except NotImplementedError:
        yield Failure("method", number, 0, 0)


def _sheet_reader(which: int | str, options: SheetOptions):
    def batch(source: str, rows: list, epoch: int, failure: Failure | None) -> pa.RecordBatch:
        n = len(rows)
        columns = [[source] * n, [r[0] for r in rows], [r[1] for r in rows], [len(r[2]) for r in rows], [len(r[2]) for r in rows], [epoch] * n, [[c if c else NOTHING for c in r[2]] for r in rows], [None] * n]
        if failure is not None:
            for c, v in zip(columns, [source, failure.record, failure.line, None, None, epoch, None, failure.__dict__], strict=True):
                c.append(v)
        types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(_CELL), _FAILURE]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["_source", "_record", "_line", "_width", "_expected", "_epoch", "cells", "failure"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for source, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows, failure, epoch = [], None, 1900
                for r in _reading(data, which, options):
                    if isinstance(r, Failure):
                        failure = r
                    elif isinstance(r, int):
                        epoch = r
                    elif not isinstance(r, list):
                        rows.append(r)
                        if len(rows) == 4096:
                            yield batch(source, rows, epoch, None)
                            rows = []
                if rows or failure is not None:
                    yield batch(source, rows, epoch, failure)

    return run


def _snapped(days: SparkColumn) -> SparkColumn:
    """Nanoseconds of a serial's fraction of a day: of the times that store as the same double, the roundest."""
    whole = F.floor(days)
    exact = (days - whole) * F.lit(86_400.0)
    rounds = [F.round(exact, k) for k in range(10)]
    found = F.coalesce(*(F.when(whole + r / F.lit(86_400.0) == days, r) for r in rounds), rounds[-1])
    return F.round(found * F.lit(1e9), 0).try_cast("bigint")


def typed_door(c: SparkColumn, column: Column, epoch: int | SparkColumn = 1900) -> SparkColumn:
    """The cast matrix: text cells go through the door, typed ones by their kind; what has no place in it is malformed.

    A number is the shortest decimal that reads back as it; ``raw`` has it as text.
    """
    d, kind, num, ns = column.door, c["kind"], c["num"], c["nanos"]
    refused = lambda reason, detail=None: F.struct(F.lit(reason).alias("reason"), F.lit(detail).cast("string").alias("detail"))
    good = F.lit(None).cast("struct<reason: string, detail: string>")
    target = column.spark_type
    shown = c["raw"].cast("string")
    # Numbers documents may have cells without a number, which no door takes.
    is_number = (kind == "number") & ~F.isnan(F.coalesce(num, F.lit(0.0)))
    whole = is_number & (num % F.lit(1.0) == 0)
    # Below 10**38 decimals of 38 digits have every whole number that a double can be.
    exact = F.when(whole & (F.abs(num) < F.lit(1e38)), shown.try_cast("decimal(38,0)"))
    bad = refused("malformed")
    judged = door(d, F.when(kind == "text", c["raw"]), **column.options())
    wall = F.timestamp_micros(F.unix_date(c["day"]) * F.lit(86_400_000_000) + F.floor(ns / 1000).cast("bigint"))
    day_number = F.when((num >= 0) & (num < F.lit(1e7)), num)
    value, fault = F.lit(None).cast(target), F.when(F.lit(True), bad)
    if d in INTEGERS:
        low, high = (F.lit(str(x)).cast("decimal(20,0)") for x in INTEGERS[d])
        value = F.when(exact.between(low, high), exact)
        negative = refused("out_of_range", "negativeNotAllowed" if INTEGERS[d][0] == 0 else "tooSmall")
        fault = F.when(~is_number, bad).when(~whole, refused("malformed", "fractionNotAllowed")).when(value.isNull() & (num < 0), negative).when(value.isNull(), refused("out_of_range", "tooLarge"))
    elif d in (Door.F32, Door.F64):
        top = 3.4028234663852886e38 if d is Door.F32 else 1.7976931348623157e308
        value = F.when(is_number & (F.abs(num) <= F.lit(top)), num + F.lit(0.0))
        fault = F.when(~is_number, bad).when(value.isNull(), refused("out_of_range", "tooLarge"))
    elif d is Door.DECIMAL:
        read = door(d, F.when(is_number, c["raw"]), precision=column.decimal[0], scale=column.decimal[1])
        value = read["value"]
        fault = F.when(~is_number, bad).when(value.isNull(), F.struct(read["reason"].alias("reason"), read["detail"].alias("detail")))
    elif d is Door.BOOL:
        value = F.when(kind.isin("bool", "number") & num.isin(0.0, 1.0), num == 1)
        fault = F.when(value.isNull(), bad)
    elif d in (Door.TIMESTAMP, Door.EXCEL_SERIAL, Door.DATE, Door.DATE_ORDERED):
        if isinstance(epoch, int):
            serial = serial_timestamp(day_number, epoch)
        else:
            serial = F.when(epoch == 1904, serial_timestamp(day_number, 1904)).otherwise(serial_timestamp(day_number, 1900))
        instant = F.when(kind == "wall", wall).when(is_number, serial)
        value = instant.cast("date") if d in (Door.DATE, Door.DATE_ORDERED) else instant
        fault = F.when(is_number & (num < 0), refused("malformed", "negativeNotAllowed")).when(is_number & instant.isNull(), refused("out_of_range", "dateFieldOutOfRange")).when(~kind.isin("wall", "number"), bad)
    elif d is Door.TIME:
        day = 86_400_000_000_000
        part = F.when(day_number < 2_958_466, _snapped(day_number))
        value = F.when(kind.isin("wall", "clock"), ns).when((kind == "span") & ns.between(0, day - 1), ns).when(is_number, F.pmod(part, F.lit(day)))
        fault = F.when(is_number & (num < 0), refused("malformed", "negativeNotAllowed")).when(kind.isin("span", "number") & value.isNull(), refused("out_of_range", "timeFieldOutOfRange")).when(value.isNull(), bad)
    elif d is Door.DURATION:
        # Days in the digits that they are shown with, to the nanosecond.
        days = F.when(is_number & (F.abs(num) < 110_000), shown.try_cast("decimal(24,18)"))
        nanos = (F.round(days * F.lit(86_400), 9).try_cast("decimal(22,9)") * F.lit(1_000_000_000)).try_cast("bigint")
        value = F.when(kind.isin("clock", "span"), ns).when(is_number, nanos)
        fault = F.when(is_number & value.isNull(), refused("out_of_range", "tooLarge")).when(value.isNull(), bad)
    elif d is Door.UNIX:
        read = door(d, F.when(whole, F.coalesce(exact.cast("string"), F.lit("9" * 38))), precision=column.precision or "s")
        value = F.when(kind == "wall", wall).when(whole, read["value"])
        fault = F.when(is_number & ~whole, refused("malformed", "notWhole")).when(is_number & value.isNull(), refused("out_of_range", "outsideWindow")).when(value.isNull(), bad)
    elif d is Door.DATETIME:
        value = F.when(kind == "wall", wall.cast("timestamp_ntz"))
        fault = F.when(kind != "wall", bad)
    elif d is Door.TEXT:
        value = shown
        fault = F.when(F.lit(False), bad)
    x = F.struct(judged.alias("j"), value.try_cast(target).alias("v"), F.coalesce(fault, good).alias("f"))
    is_text = kind == "text"
    n = F.octet_length(c["raw"])
    return let(
        x,
        lambda r: F.struct(
            F.when(is_text, r["j"]["value"]).otherwise(F.when(r["f"].isNull(), r["v"])).alias("value"),
            F.when(is_text, r["j"]["reason"]).otherwise(r["f"]["reason"]).alias("reason"),
            F.when(is_text, r["j"]["detail"]).otherwise(r["f"]["detail"]).alias("detail"),
            F.when(is_text, r["j"]["offset"]).otherwise(F.when(r["f"].isNotNull(), 0)).cast("int").alias("offset"),
            F.when(is_text, r["j"]["len"]).otherwise(F.when(r["f"].isNotNull(), n)).cast("int").alias("len"),
        ),
    )


class TypedSheet(Typed):
    """Sheet rows under a plan; tokens meet text cells only, and a formula without a stored result is uncached."""

    def __init__(self, records: DataFrame, plan: Sequence[Column], tokens: Sequence[str] = (), epoch: int | SparkColumn = 1900):
        self.plan, self.long_rows = list(plan), "reject"
        self.frame = records.select("_source", "_record", "_line", "_width", "_expected", *(self._cell(c, tokens, epoch).alias(c.name) for c in self.plan))

    @staticmethod
    def _cell(column: Column, tokens: Sequence[str], epoch: int | SparkColumn) -> SparkColumn:
        tokens = column.tokens if column.tokens is not None else tuple(tokens)
        c = F.coalesce(F.get("cells", F.lit(column.source)), F.struct(*(F.lit(None).cast(t).alias(n) for n, t in (p.split(": ") for p in CELL[7:-1].split(", ")))))

        def judged(c: SparkColumn) -> SparkColumn:
            empty = c["kind"].isNull() | (c["kind"] == "empty")
            token = (c["kind"] == "text") & c["raw"].isin(*(t.encode() for t in tokens)) if tokens else F.lit(False)
            asked = ~empty & ~token
            v = typed_door(c, column, epoch)
            if column.constraints is not None:
                v = checked(v, c["raw"], column.door, column.constraints, column.spark_type)
            origin = F.when(F.coalesce(c["uncached"], F.lit(False)), "uncached").when(token, "token").otherwise("cell")
            fields = ["value", "reason", "offset", "len", "detail"] + (["keyword", "adjusted", "enum_index"] if column.constraints is not None else [])
            other = {"reason": F.lit("empty"), "offset": F.lit(0), "len": F.lit(0)}
            pick = lambda x, f: F.when(x["a"], x["v"][f]).otherwise(other[f]) if f in other else F.when(x["a"], x["v"][f])
            return let(F.struct(v.alias("v"), asked.alias("a")), lambda x: F.struct(*(pick(x, f).alias(f) for f in fields), origin.alias("origin"), c["raw"].alias("raw")))

        return let(c, judged)


def _listed(data: bytes | None) -> list[tuple]:
    """Index, name, hidden, format, date system and failure of each sheet."""
    if data is None:
        return [(None, None, None, None, None, "too_large")]
    try:
        book = Book(data)
    except Package as e:
        return [(None, None, None, None, None, e.kind)]
    except ET.ParseError:
        return [(None, None, None, None, None, "xml")]
    except (zlib.error, zipfile.BadZipFile, EOFError):
        return [(None, None, None, None, None, "deflate")]
    return [(i, name, hidden, book.format, book.epoch, None) for i, (name, hidden) in enumerate(book.sheets)]


class Workbook:
    """Workbooks of one shape: a row per package with its name and its bytes."""

    def __init__(self, sources: DataFrame):
        self.sources = sources

    @classmethod
    def open(cls, spark: SparkSession, path: str | Sequence[str], most: int = LARGEST) -> Workbook:
        """Packages over ``most`` bytes aren't read; their failure is ``too_large``."""
        if not 0 < most <= LARGEST:
            raise DeclarationError(f"a package has from 1 to {LARGEST} bytes")
        files = spark.read.format("binaryFile").load(path)
        small = files.where(F.col("length") <= most).select(F.col("path").alias("_source"), F.col("content").alias("_bytes"))
        large = files.where(F.col("length") > most).select(F.col("path").alias("_source"), F.lit(None).cast("binary").alias("_bytes"))
        return cls(small.unionByName(large))

    @classmethod
    def from_bytes(cls, spark: SparkSession, data: bytes | dict[str, bytes]) -> Workbook:
        return cls(spark.createDataFrame(list((data if isinstance(data, dict) else {"bytes": data}).items()), "_source string, _bytes binary"))

    def sheets(self) -> DataFrame:
        """A row per sheet: source, index, name, hidden, and the package's format and date system; a row with ``failure`` for a package that cannot be read."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for source, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    found = _listed(data)
                    columns = list(zip(*found, strict=True)) if found else [()] * 6
                    types = [pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.int32(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array([source] * len(found), pa.string()), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["_source", "sheet", "name", "hidden", "format", "epoch", "failure"])

        return self.sources.mapInArrow(run, "_source string, sheet int, name string, hidden boolean, format string, epoch int, failure string")

    def header(self, which: int | str = 0, options: SheetOptions = SheetOptions()) -> Header:
        """The header of the first package by name; a package that breaks ahead of it raises."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for data in b.column(1).to_pylist():
                    first = next((x for x in _reading(data, which, options) if not isinstance(x, int)), [])
                    broken = first.kind if isinstance(first, Failure) else None
                    yield pa.RecordBatch.from_arrays([pa.array([first if isinstance(first, list) else []], pa.list_(pa.string())), pa.array([broken], pa.string())], ["names", "failure"])

        row = self.sources.orderBy("_source").limit(1).mapInArrow(run, "names array<string>, failure string").first()
        if row and row["failure"]:
            raise StructuralFailure(row["failure"])
        return Header(row["names"] if row and options.has_header else [])

    def suggest(self, which: int | str = 0, options: SheetOptions = SheetOptions(), rows: int = SAMPLE) -> tuple[dict[str, Suggestion], bool]:
        """A suggestion for each of the header's columns (by ordinal without one) from the sheet's first rows, and whether rows lie past them.

        Text cells are judged as in delimited text; typed numbers fit every notation by their value, other typed cells
        their own doors. A failure among the rows looked at raises.
        """
        if rows < 0 or rows > MOST:
            raise DeclarationError(f"a sample has up to {MOST} rows")
        names = self.header(which, options).names
        first = self.records(which, options).orderBy("_source", "_record").limit(max(1, rows) + 1)
        first = first.select("_source", "_record", "_width", "cells", "failure").collect()  # at most MOST + 1 rows
        if broken := next((r for r in first[: max(1, rows)] if r["failure"] is not None), None):
            raise StructuralFailure(str(broken["failure"].asDict()))
        sample = [r["cells"] for r in first[: max(1, rows)]]
        width = len(names) or max(map(len, sample), default=0)
        names = names or [f"c{i}" for i in range(width)]
        cells = [[c[i].asDict() if i < len(c) else None for i in range(width)] for c in sample]
        frame = self.sources.sparkSession.createDataFrame([tuple(r) for r in cells], ", ".join(f"`{i}` {CELL}" for i in range(width)) or "none string")
        found = suggest_typed(frame, [str(i) for i in range(width)])
        return {n: found[str(i)] for i, n in enumerate(names)}, len(first) > max(1, rows)

    def records(self, which: int | str = 0, options: SheetOptions = SheetOptions()) -> DataFrame:
        return self.sources.mapInArrow(_sheet_reader(which, options), RECORDS)

    def read(self, which: int | str, plan: Sequence[Column], options: SheetOptions = SheetOptions(), epoch: int | None = None) -> TypedSheet:
        """epoch: the date system for numbers on date columns; each package's own where it isn't given."""
        by_name = any(isinstance(c.source, str) for c in plan)
        bound = bind(plan, self.header(which, options) if by_name else None)
        return TypedSheet(self.records(which, options).where("failure IS NULL"), bound, options.tokens, F.col("_epoch") if epoch is None else epoch)

    def failures(self, which: int | str = 0, options: SheetOptions = SheetOptions()) -> DataFrame:
        return self.records(which, options).where("failure IS NOT NULL").select("_source", "failure.*")
