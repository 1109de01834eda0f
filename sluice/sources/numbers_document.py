"""Apple Numbers documents: objects in Snappy chunks, tables in tiles, cells in their packed storage (version 5).

All of a package's objects are read into one dictionary by identifier; a table is what has rows, so each table of a
sheet is listed as a sheet.
"""

from __future__ import annotations

import re
import struct
import zipfile
from collections.abc import Iterator
from datetime import date, timedelta

from sluice.sources import serials

# Fixed values of the format: object types, cell types, and kinds of date formats.
DOCUMENT, SHEET, CUSTOM_FORMATS, TABLE_INFO, TABLE_MODEL, TILE = 1, 2, 222, 6000, 6001, 6002
EMPTY, SPANNED, NUMBER, TEXT, DATE, BOOL, DURATION, ERROR, RICH, CURRENCY = 0, 1, 2, 3, 5, 6, 7, 8, 9, 10
DATE_FORMATS = (261, 272)
TILE_ROWS, WIDEST = 256, 16_384

_DAY = 86_400_000_000_000


class Damaged(Exception):
    """A chunk, message or object that isn't as the format has it; kind is the failure's."""

    def __init__(self, kind: str = "iwa"):
        super().__init__(kind)
        self.kind = kind


def unsnap(block: bytes) -> bytes:
    """A Snappy block without a frame."""
    size, at = varint(block, 0)
    out = bytearray()
    while at < len(block):
        tag = block[at]
        at += 1
        if tag & 3 == 0:
            n = tag >> 2
            if n >= 60:
                width = n - 59
                n = int.from_bytes(block[at : at + width], "little")
                at += width
            out += block[at : at + n + 1]
            at += n + 1
            continue
        if tag & 3 == 1:
            n, back = (tag >> 2 & 7) + 4, (tag >> 5) << 8 | block[at]
            at += 1
        else:
            width = 2 if tag & 3 == 2 else 4
            n, back = (tag >> 2) + 1, int.from_bytes(block[at : at + width], "little")
            at += width
        if not 0 < back <= len(out):
            raise Damaged
        if back >= n:
            start = len(out) - back
            out += out[start : start + n]
        else:  # the copy runs into itself
            piece = bytes(out[-back:])
            out += (piece * (n // back + 1))[:n]
    if len(out) != size:
        raise Damaged
    return bytes(out)


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise Damaged
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7


class Message:
    """A Protocol Buffers message: the values of each field number in order."""

    def __init__(self, data: bytes):
        self.fields: dict[int, list] = {}
        at = 0
        while at < len(data):
            tag, at = varint(data, at)
            kind = tag & 7
            if kind == 0:
                value, at = varint(data, at)
            elif kind in (1, 5):
                width = 8 if kind == 1 else 4
                value, at = int.from_bytes(data[at : at + width], "little"), at + width
            elif kind == 2:
                n, at = varint(data, at)
                value, at = data[at : at + n], at + n
            else:
                raise Damaged
            if at > len(data):
                raise Damaged
            self.fields.setdefault(tag >> 3, []).append(value)

    def all(self, number: int) -> list:
        return self.fields.get(number, [])

    def bytes(self, number: int) -> bytes:
        found = self.all(number)
        return found[0] if found and isinstance(found[0], bytes) else b""

    def int(self, number: int, default: int = 0) -> int:
        found = self.all(number)
        return found[0] if found and isinstance(found[0], int) else default

    def message(self, number: int) -> Message:
        return Message(self.bytes(number))

    def references(self, number: int) -> list[int]:
        return [Message(x).int(1) for x in self.all(number)]


def objects(part: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Identifier, type and first message of every object of a part."""
    stream, at = bytearray(), 0
    while at < len(part):
        if part[at] != 0 or at + 4 > len(part):
            raise Damaged
        n = int.from_bytes(part[at + 1 : at + 4], "little")
        if at + 4 + n > len(part):
            raise Damaged
        stream += unsnap(part[at + 4 : at + 4 + n])
        at += 4 + n
    data, at = bytes(stream), 0
    while at < len(data):
        n, at = varint(data, at)
        head, at = Message(data[at : at + n]), at + n
        for k, info in enumerate(map(Message, head.all(2))):
            size = info.int(3)
            if at + size > len(data):
                raise Damaged
            if k == 0:
                yield head.int(1), info.int(1), data[at : at + size]
            at += size


def decimal(raw: bytes) -> float:
    """A 128-bit decimal: a sign, an exponent over 6176, and 113 bits of digits; infinities are no number either."""
    whole = int.from_bytes(raw, "little")
    # Four set bits behind the sign tell an infinity, five no number.
    if whole >> 123 & 0xF == 0xF:
        return float("nan")
    exponent = (whole >> 113 & 0x3FFF) - 0x1820
    digits = whole & ((1 << 113) - 1)
    return float(f"{'-' if whole >> 127 else ''}{digits}e{exponent}")


# The letters that fields of date patterns have in Unicode's locale data (UTS 35, date field symbols), by
# the table's groups of fields.
FIELDS_OF_DATES = {"era": "G", "year": "yYuUr", "quarter": "Qq", "month": "MLl", "week": "wW", "day": "dDFg", "weekday": "Eec"}
FIELDS_OF_TIMES = {"period": "abB", "hour": "hHKkjJC", "minute": "m", "second": "sSA", "zone": "zZOvVXx"}


def shows_time_only(form: Message) -> bool:
    """Whether a cell's format shows a clock without a day: a field of times and no field of dates."""
    if form.int(1) not in DATE_FORMATS:
        return False
    if form.int(12):
        return True
    pattern = (form.bytes(14) or form.bytes(18)).decode("utf-8", "replace")
    # What stands between apostrophes is text.
    letters = set(re.sub("'[^']*(?:'|$)", "", pattern))
    shown = {name for table in (FIELDS_OF_DATES, FIELDS_OF_TIMES) for name, of in table.items() if letters.intersection(of)}
    return bool(shown) and shown.isdisjoint(FIELDS_OF_DATES)


class NumbersDocument:
    """The tables of a package, and their rows."""

    def __init__(self, package: zipfile.ZipFile, names: dict[str, str]):
        self.known: dict[int, tuple[int, bytes]] = {}
        for low, name in names.items():
            if low.endswith(".iwa"):
                for i, kind, payload in objects(package.read(name)):
                    self.known[i] = (kind, payload)
        if self.known.get(1, (0, b""))[0] != DOCUMENT:
            raise Damaged("not_a_workbook")
        self.document = self.get(1)
        self.tables: list[tuple[str, bool, Message]] = []
        for s in self.document.references(1):
            sheet = self.get(s, SHEET)
            models = [self.get(self.get(d).references(2)[0], TABLE_MODEL) for d in sheet.references(2) if self.known.get(d, (0, b""))[0] == TABLE_INFO]
            for model in models:
                name = sheet.bytes(1).decode()
                self.tables.append((f"{name} - {model.bytes(8).decode()}" if len(models) > 1 else name, bool(sheet.int(25)), model))

    def get(self, i: int, kind: int | None = None) -> Message:
        if i not in self.known or (kind is not None and self.known[i][0] != kind):
            raise Damaged
        return Message(self.known[i][1])

    def _entries(self, store: Message, number: int) -> Iterator[Message]:
        for reference in store.references(number)[:1]:
            listed = self.get(reference)
            for source in (listed, *(self.get(x) for x in listed.references(4))):
                yield from map(Message, source.all(3))

    def _custom(self) -> dict[bytes, Message]:
        found = self.document.message(8).references(12)
        if not found:
            return {}
        listed = self.get(found[0], CUSTOM_FORMATS)
        return dict(zip(listed.all(1), (Message(x).message(3) for x in listed.all(2)), strict=False))

    def rows(self, which: int) -> Iterator[tuple[int, dict[int, tuple]]]:
        """Row number from 1 and cells by column from 1, as (kind, text, number, day, nanoseconds)."""
        store = self.tables[which][2].message(4)
        strings = {e.int(1): e.bytes(3).decode("utf-8", "replace") for e in self._entries(store, 4)}
        rich = {}
        for e in self._entries(store, 17):
            for payload in e.references(9):
                storage = self.get(self.get(payload).references(1)[0])
                rich[e.int(1)] = b"".join(storage.all(3)).decode("utf-8", "replace")
        custom = self._custom()
        timed = set()
        for e in self._entries(store, 22):
            form = e.message(6)
            own = form.all(41)
            if shows_time_only(custom.get(own[0], form) if own else form):
                timed.add(e.int(1))
        tiles = store.message(3)
        height = max(1, tiles.int(2, TILE_ROWS))
        placed = sorted((t.int(1), t.references(2)[0]) for t in map(Message, tiles.all(1)))
        for number, reference in placed:
            for row in map(Message, self.get(reference, TILE).all(5)):
                offsets, storage = row.bytes(7), row.bytes(6)
                if not offsets and not storage and row.all(4):
                    raise Damaged
                step = 4 if row.int(8) else 1
                cells = {}
                for column, at in enumerate(struct.unpack(f"<{len(offsets) // 2}h", offsets[: len(offsets) // 2 * 2])[:WIDEST], 1):
                    if at >= 0 and (value := self._cell(storage[at * step :], strings, rich, timed)) is not None:
                        cells[column] = value
                yield number * height + row.int(1) + 1, cells

    @staticmethod
    def _cell(raw: bytes, strings: dict[int, str], rich: dict[int, str], timed: set[int]) -> tuple | None:
        if not raw:
            return None
        if raw[0] != 5 or len(raw) < 12:
            raise Damaged
        kind, flags, at = raw[1], int.from_bytes(raw[8:12], "little"), 12
        try:
            value = seconds = None
            if flags & 1:
                value, at = decimal(raw[at : at + 16]), at + 16
            if flags & 2:
                double, at = struct.unpack_from("<d", raw, at)[0], at + 8
                value = double if value is None else value
            if flags & 4:
                seconds, at = struct.unpack_from("<d", raw, at)[0], at + 8
            ids: dict[int, int] = {}
            for bit in range(3, 20):
                if flags >> bit & 1:
                    ids[bit], at = struct.unpack_from("<I", raw, at)[0], at + 4
        except struct.error:
            raise Damaged from None
        if kind in (EMPTY, SPANNED):
            return None
        if kind in (TEXT, RICH):
            bit, listed = (3, strings) if kind == TEXT else (4, rich)
            if bit in ids and ids[bit] not in listed:
                raise Damaged("shared_string")
            return ("text", listed[ids[bit]] if bit in ids else "", None, None, None)
        if kind == DATE:
            return None if seconds is None else _wall(seconds, ids.get(15) in timed)
        if kind == BOOL:
            yes = value is not None and value > 0
            return ("bool", "true" if yes else "false", float(yes), None, None)
        if kind == ERROR:
            return ("error", "#VALUE!", None, None, None)
        if kind == DURATION and value is not None:
            ns = round(value * 1e9)
            return ("span", serials.span_text(ns), None, None, ns) if abs(ns) < 1 << 63 else ("number", serials.number_text(value), value, None, None)
        return None if value is None else ("number", serials.number_text(value), value, None, None)


def _wall(seconds: float, clock: bool) -> tuple:
    days, rest = divmod(seconds, 86_400)
    ns = round(rest * 1e9)
    if ns >= _DAY:
        days, ns = days + 1, ns - _DAY
    try:
        day = date(2001, 1, 1) + timedelta(days=int(days))
    except OverflowError:
        return ("number", serials.number_text(seconds), seconds, None, None)
    if clock:
        return ("clock", serials.clock_text(ns), None, None, ns)
    return ("wall", serials.wall_text(day, ns), None, day, ns)
