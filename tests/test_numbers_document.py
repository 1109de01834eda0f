"""Numbers documents, packed here by a writer of the same layout."""

import io
import struct
import zipfile
from datetime import datetime
from decimal import Decimal

import pytest

from sluice.plans.columns import Column
from sluice.plans.sample_packages import document, number, pack_decimal, part, row, snap, stored
from sluice.sources.numbers_document import Damaged, decimal, unsnap
from sluice.sources.workbook import SheetOptions, Workbook
from sluice.types import Door


ROWS = [
    row(0, [stored(3, ids=[(3, 1)]), stored(2, dec="1.25"), None, stored(5, sec=86_400.5)]),
    row(3, [stored(9, ids=[(4, 5)]), stored(10, dec="-3e2"), stored(6, dbl=1.0), stored(5, sec=3_600.0, ids=[(15, 7)])]),
    row(4, [stored(3, ids=[(3, 2)]), stored(8), stored(7, dbl=90.5), stored(0)]),
]


def test_cells_of_every_kind(spark):
    plan = [Column(0), Column(1, Door.F64), Column(2), Column(3, Door.TEXT), Column(3, Door.TIMESTAMP)]
    t = Workbook.from_bytes(spark, document(ROWS)).read("Sheet 1", plan, SheetOptions(has_header=False))
    got = [(r["_line"], r["c0"], r["c1"], r["c2"], r["c3"], r["c3_2"]) for r in t.values("_line").collect()]
    assert got == [
        (1, "id", 1.25, None, "2001-01-02T00:00:00.5", datetime(2001, 1, 2, 0, 0, 0, 500_000)),
        (4, "rich", -300.0, "true", "01:00:00", None),
        (5, "é text", None, "PT1M30.5S", None, None),
    ]


def test_tables_are_sheets(spark):
    rows = Workbook.from_bytes(spark, document(ROWS, tables=2, hidden=1)).sheets().orderBy("sheet").collect()
    assert [(r["name"], r["hidden"], r["format"]) for r in rows] == [("Sheet 1 - Table 1", True, "numbers"), ("Sheet 1 - Table 2", True, "numbers")]


def test_a_string_that_is_not_there_breaks_the_table(spark):
    w = Workbook.from_bytes(spark, document([ROWS[0], row(1, [stored(3, ids=[(3, 9)])])]))
    o = SheetOptions(has_header=False)
    assert w.read(0, [Column(0)], o, epoch=1900).values().count() == 1
    assert [r["kind"] for r in w.failures(0, o).collect()] == ["shared_string"]


def test_blocks_and_decimals():
    assert unsnap(snap(b"a" * 200)) == b"a" * 200
    assert unsnap(number(11) + b"\x04ab" + bytes([(5 << 2 | 1) & 255, 2])) == b"ab" * 5 + b"a"
    for bad in (b"\x05\x00a", number(4) + b"\x00a\x01\x09"):
        with pytest.raises(Damaged):
            unsnap(bad)
    assert [decimal(pack_decimal(x)) for x in ("0", "-1.5", "123456789012345678", "1e-20")] == [0.0, -1.5, 123456789012345678.0, 1e-20]
