"""Small workbooks for tests and queries, with the standard library: XLSX, ODS and Numbers.

Fixed values: namespaces, names of parts, types and fields are the formats' own.
"""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Sequence
from datetime import date, datetime
from decimal import Decimal
from xml.sax.saxutils import escape, quoteattr


def letters(n: int) -> str:
    """Column letters from 0 on."""
    out = ""
    n += 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def serial(d: date) -> float:
    days = (date(d.year, d.month, d.day) - date(1899, 12, 30)).days
    return days + (d.hour * 3600 + d.minute * 60 + d.second) / 86400 if isinstance(d, datetime) else float(days)


def _xlsx_cell(ref: str, v: object) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, date):
        return f'<c r="{ref}" s="1"><v>{serial(v)!r}</v></c>'
    if isinstance(v, (int, float)):
        return f'<c r="{ref}"><v>{v!r}</v></c>'
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'


def xlsx_bytes(rows: Sequence[Sequence[object]], sheets: Sequence[tuple[str, str]] = (), raw: str | None = None, date1904: bool = False, strings: Sequence[str] = ()) -> bytes:
    """raw: the sheet's rows as XML instead of rows. sheets: further empty ones with their states."""
    body = raw if raw is not None else "".join(f'<row r="{i}">' + "".join(_xlsx_cell(f"{letters(j)}{i}", v) for j, v in enumerate(row)) + "</row>" for i, row in enumerate(rows, 1))
    every = [("Data", "visible"), *sheets]
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006/relationships"
    n = len(every)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"/>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{package}"><Relationship Id="r" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><workbookPr date1904="{int(date1904)}"/><sheets>' + "".join(f'<sheet name={quoteattr(s)} sheetId="{i}" state="{state}" r:id="rId{i}"/>' for i, (s, state) in enumerate(every, 1)) + "</sheets></workbook>")
        links = "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, n + 1))
        links += f'<Relationship Id="st" Type="{rel}/styles" Target="styles.xml"/>' + (f'<Relationship Id="ss" Type="{rel}/sharedStrings" Target="sharedStrings.xml"/>' if strings else "")
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}">{links}</Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><numFmts count="1"><numFmt numFmtId="164" formatCode="[hh]:mm"/></numFmts><cellXfs count="4"><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="20"/><xf numFmtId="164"/></cellXfs></styleSheet>')
        if strings:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">' + "".join(f"<si>{s}</si>" for s in strings) + "</sst>")
        for i in range(1, n + 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{main}"><sheetData>{body if i == 1 else ""}</sheetData></worksheet>')
    return out.getvalue()


def _ods_cell(v: object) -> str:
    if v is None:
        return "<table:table-cell/>"
    if isinstance(v, bool):
        return f'<table:table-cell office:value-type="boolean" office:boolean-value="{str(v).lower()}"><text:p>{v}</text:p></table:table-cell>'
    if isinstance(v, date):
        return f'<table:table-cell office:value-type="date" office:date-value="{v.isoformat()}"><text:p>{v}</text:p></table:table-cell>'
    if isinstance(v, (int, float)):
        return f'<table:table-cell office:value-type="float" office:value="{v!r}"><text:p>{v}</text:p></table:table-cell>'
    return f'<table:table-cell office:value-type="string"><text:p>{escape(str(v))}</text:p></table:table-cell>'


def ods_bytes(rows: Sequence[Sequence[object]], raw: str | None = None) -> bytes:
    body = raw if raw is not None else "".join("<table:table-row>" + "".join(map(_ods_cell, row)) + "</table:table-row>" for row in rows)
    names = " ".join(f'xmlns:{p}="urn:oasis:names:tc:opendocument:xmlns:{p}:1.0"' for p in ("office", "table", "text"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("mimetype", "application/vnd.oasis.opendocument.spreadsheet")
        z.writestr("content.xml", f'<office:document-content {names}><office:body><office:spreadsheet><table:table table:name="Data">{body}</table:table></office:spreadsheet></office:body></office:document-content>')
    return out.getvalue()


# Numbers: messages of numbered fields, in blocks of a compression without matches.


def number(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def field(k, v):
    return number(k << 3) + number(v) if isinstance(v, int) else number(k << 3 | 2) + number(len(v)) + v


def ref(i):
    return field(1, i)


def snap(data):
    out = number(len(data))
    for a in range(0, len(data), 60):
        piece = data[a : a + 60]
        out += bytes([(len(piece) - 1) << 2]) + piece
    return out


def part(objects):
    stream = b""
    for i, kind, payload in objects:
        head = field(1, i) + field(2, field(1, kind) + field(3, len(payload)))
        stream += number(len(head)) + head + payload
    out = b""
    for a in range(0, len(stream), 5000):
        block = snap(stream[a : a + 5000])
        out += b"\0" + len(block).to_bytes(3, "little") + block
    return out


def pack_decimal(text):
    sign, digits, exponent = Decimal(text).as_tuple()
    whole = int("".join(map(str, digits))) | (exponent + 0x1820) << 113 | sign << 127
    return whole.to_bytes(16, "little")


def stored(kind, *, dec=None, dbl=None, sec=None, ids=()):
    flags, body = 0, b""
    if dec is not None:
        flags, body = flags | 1, body + pack_decimal(dec)
    if dbl is not None:
        flags, body = flags | 2, body + struct.pack("<d", dbl)
    if sec is not None:
        flags, body = flags | 4, body + struct.pack("<d", sec)
    for bit, i in sorted(ids):
        flags, body = flags | 1 << bit, body + struct.pack("<I", i)
    return bytes([5, kind]) + bytes(6) + struct.pack("<I", flags) + body


def row(index, cells):
    offsets, storage = b"", b""
    for c in cells:
        offsets += struct.pack("<h", len(storage) if c else -1)
        storage += c or b""
    return field(5, field(1, index) + field(6, storage) + field(7, offsets))


def document(rows, tables=1, hidden=0):
    """A Numbers package of one sheet, whose tables all have these rows."""
    strings = field(3, field(1, 1) + field(3, "id".encode())) + field(4, ref(31))
    more = field(3, field(1, 2) + field(3, "é text".encode()))
    rich = field(3, field(1, 5) + field(9, ref(41)))
    formats = field(3, field(1, 7) + field(6, field(1, 261) + field(14, b"'day' HH:mm")))
    store = field(3, field(1, field(1, 0) + field(2, ref(50))) + field(2, 256)) + field(4, ref(30)) + field(17, ref(40)) + field(22, ref(60))
    objects = [(1, 1, field(1, ref(10))), (10, 2, field(1, b"Sheet 1") + b"".join(field(2, ref(20 + k)) for k in range(tables)) + field(2, ref(99)) + field(25, hidden))]
    for k in range(tables):
        objects += [(20 + k, 6000, field(2, ref(25 + k))), (25 + k, 6001, field(4, store) + field(8, f"Table {k + 1}".encode()))]
    objects += [(30, 6005, strings), (31, 6011, more), (40, 6005, rich), (41, 6218, field(1, ref(42))), (42, 2001, field(3, b"ri") + field(3, b"ch")), (60, 6005, formats), (50, 6002, b"".join(rows))]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("Index/Document.iwa", part(objects[:2]))
        z.writestr("Index/Tables/Tile.iwa", part(objects[2:]))
    return out.getvalue()
