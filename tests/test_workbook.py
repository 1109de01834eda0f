"""Workbooks made with the standard library: kinds of cells, ranges, repeats, formulas, failures."""

from datetime import date, datetime

import pytest

from sluice.plans.columns import Column
from sluice.sources import serials
from sluice.sources.workbook import Range, SheetOptions, Workbook
from sluice.plans.sample_packages import ods_bytes, xlsx_bytes
from sluice.types import DeclarationError, Door, NoSheet

ROWS = [["id", "name", "when", "flag"], [1.0, "a", date(2024, 1, 2), True], [2.5, None, datetime(2024, 1, 2, 6), False], [None, "é", None, None]]
PLAN = [Column("id", Door.I32), Column("name"), Column("when", Door.TIMESTAMP), Column("flag", Door.BOOL)]


@pytest.mark.parametrize("make", [xlsx_bytes, ods_bytes])
def test_both_formats(spark, make):
    t = Workbook.from_bytes(spark, make(ROWS)).read("Data", PLAN)
    got = [tuple(r) for r in t.values().collect()]
    assert got == [(1, "a", datetime(2024, 1, 2), True), (None, None, datetime(2024, 1, 2, 6), False), (None, "é", None, None)]
    assert [(r["plan_column"], r["reason"], r["detail"]) for r in t.problems().collect()] == [(0, "malformed", "fractionNotAllowed")]


def test_sheets_and_names(spark):
    w = Workbook.from_bytes(spark, xlsx_bytes([["a"]], [("Hidden", "hidden"), ("Very", "veryHidden"), ("Last", "visible")], date1904=True))
    assert [(r["name"], r["hidden"], r["epoch"]) for r in w.sheets().orderBy("sheet").collect()] == [("Data", False, 1904), ("Hidden", True, 1904), ("Very", True, 1904), ("Last", False, 1904)]
    with pytest.raises(Exception, match="no sheet"):
        w.read("Nope", [Column(0)], epoch=1900).values().collect()


def test_shared_strings_formulas_and_gaps(spark):
    raw = '<row r="2"><c r="B2" t="s"><v>0</v></c><c r="D2"><f>1+1</f></c></row><row r="5"><c r="A5" t="str"><f>x</f><v></v></c><c r="B5" t="e"><v>#N/A</v></c><c r="C5" s="3"><v>1.5</v></c><c r="D5" s="2"><v>0.25</v></c></row>'
    t = Workbook.from_bytes(spark, xlsx_bytes([], raw=raw, strings=["<r><t>ri</t></r><r><t>ch</t></r><rPh><t>no</t></rPh>"])).read(0, [Column(1), Column(2, Door.DURATION), Column(3, Door.TIME)], SheetOptions(has_header=False))
    got = [(r["_line"], r["c1"]["value"], r["c2"]["value"], r["c3"]["value"], r["c3"]["origin"]) for r in t.frame.collect()]
    assert got == [(2, "rich", None, None, "uncached"), (5, "#N/A", 129_600_000_000_000, 21_600_000_000_000, "cell")]


def test_a_missing_shared_string_breaks_the_sheet(spark):
    w = Workbook.from_bytes(spark, {"x": xlsx_bytes([], raw='<row r="1"><c r="A1"><v>1</v></c></row><row r="2"><c r="A2" t="s"><v>9</v></c></row>'), "y": b"no", "z": xlsx_bytes([[1]])[:-40]})
    o = SheetOptions(has_header=False)
    assert [r["_source"] for r in w.read(0, [Column(0, Door.I32)], o, epoch=1900).frame.collect()] == ["x"]
    assert {r["_source"]: r["kind"] for r in w.failures(0, o).collect()} == {"x": "shared_string", "y": "not_a_zip", "z": "container"}


def test_ranges_skips_and_header_rows(spark):
    rows = [["title"], [], ["junk", 1.0], ["a", "b"], [1.0, 2.0], [3.0, 4.0], ["total", 6.0]]
    w = Workbook.from_bytes(spark, xlsx_bytes(rows))
    t = w.read("Data", [Column("b", Door.I32)], SheetOptions(skip=1, header_row=0, range=Range.parse("A3:B6")))
    assert [r["b"] for r in t.values().collect()] == [2, 4]
    assert [r["b"] for r in w.read("Data", [Column("b", Door.I32)], SheetOptions(header_row=2, range=Range(last_row=6))).values().collect()] == [2, 4]
    for bad in ("a1:B2", "A0:B2", "B1:A2", "A1", "XFE1:XFE2"):
        with pytest.raises(DeclarationError):
            Range.parse(bad)


def test_repeats_are_counted(spark):
    raw = '<table:table-row table:number-rows-repeated="2"><table:table-cell office:value-type="float" office:value="7" table:number-columns-repeated="3"/></table:table-row><table:table-row table:number-rows-repeated="1048570"><table:table-cell table:number-columns-repeated="16384"/></table:table-row>'
    t = Workbook.from_bytes(spark, ods_bytes([], raw=raw)).read(0, [Column(2, Door.I32), Column(3, Door.I32)], SheetOptions(has_header=False))
    assert [(r["c2"], r["c3"]) for r in t.values().collect()] == [(7, None), (7, None)]


def test_tokens_meet_text_cells_only(spark):
    t = Workbook.from_bytes(spark, xlsx_bytes([["-"], [7.0]])).read(0, [Column(0, tokens=("-", "7"))], SheetOptions(has_header=False))
    assert [(r["c0"]["value"], r["c0"]["origin"]) for r in t.frame.collect()] == [(None, "token"), ("7", "cell")]


def test_no_such_sheet_is_told():
    from sluice.sources.workbook import Book

    with pytest.raises(NoSheet):
        Book(xlsx_bytes([["a"]])).sheet(3)


@pytest.mark.parametrize(
    "code, kind",
    [('#,##0 "h"', "number"), ('h "hours"', "datetime"), ("[$-409]m/d/yy h:mm AM/PM;@", "datetime"), ("[Red]0.00;[Blue]-0.00", "number"), ("0.00_);\\(0.00\\)", "number"), ("yyyy\\-mm\\-dd", "datetime"), ('"Year "yyyy', "datetime"), ("mm:ss.0", "datetime"), ("[hh]:mm", "elapsed"), ("General", "number"), ("@", "text")],
)
def test_formats(code, kind):
    assert serials.classify(code) == kind


def test_serials_and_texts():
    assert serials.from_serial(60, 1900) is None
    assert serials.from_serial(45292.75, 1900) == (date(2024, 1, 1), 64_800_000_000_000)
    assert serials.from_serial(45292 + 86399 / 86400, 1900) == (date(2024, 1, 1), 86_399_000_000_000)
    assert serials.from_serial(0, 1904) == (date(1904, 1, 1), 0)
    assert [serials.number_text(x) for x in (1.0, 0.5, 1.5e300, 1e15)] == ["1", "0.5", "1.5e300", "1000000000000000"]
    assert serials.span_text(serials.parse_span("-P1DT6H30M15.5S")) == "-P1DT6H30M15.5S"
    assert serials.parse_wall("2024-01-02T01:00:00+02:00") == (date(2024, 1, 1), 82_800_000_000_000)
