"""Bytes to records and cells. One framer reads one source; it is the only part that isn't a Catalyst expression.

A quote opens a cell only as its first byte; inside, two quotes are one and a lone one closes; what follows up to the
separator or the line's end is as it stands. A line ends with LF, CR LF or CR. A source that breaks gives every intact
record first, then its failure, and nothing after it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from sluice.plans.dialect import Dialect

#: Bytes 0x80 to 0x9F of Windows-1252 after the WHATWG table; the five that it leaves open are the C1 controls.
_OPEN_1252 = (0x81, 0x8D, 0x8F, 0x90, 0x9D)


_LINE_END = re.compile(rb"\r\n|\r|\n")


@dataclass(frozen=True)
class Failure:
    kind: str
    record: int
    line: int
    byte: int
    expected: int | None = None
    found: int | None = None


@dataclass(frozen=True)
class Record:
    """number: all records count, with skipped blank ones; line: the one that it starts on, from 1."""

    number: int
    line: int
    byte: int
    cells: list[bytes]
    quoted: list[bool]


def transcode(data: bytes, encoding: str) -> tuple[bytes, int | None]:
    """UTF-8, and the byte of the original where it isn't that encoding (with what stands ahead of it)."""
    if encoding == "utf-8":
        return data, None
    if encoding == "latin-1":
        return data.decode("latin-1").encode(), None
    if encoding == "windows-1252":
        known = "".join(chr(b) if b in _OPEN_1252 else bytes([b]).decode("cp1252") for b in range(256))
        return data.decode("latin-1").translate(dict(enumerate(known))).encode(), None
    try:
        return data.decode("utf-16-le").encode(), None
    except UnicodeDecodeError as e:
        return data[: e.start].decode("utf-16-le").encode(), e.start


def _pattern(dialect: Dialect) -> re.Pattern[bytes]:
    s = re.escape(dialect.separator.encode())
    bare = rb"[^" + s + rb"\r\n]*"
    cell = rb'"((?:[^"]|"")*+)"(' + bare + rb")|(" + bare + rb")" if dialect.quoting else rb"()()(" + bare + rb")"
    return re.compile(rb"(?:" + cell + rb")(" + s + rb"|\r\n|\r|\n|\Z)")


def one_record(data: bytes, dialect: Dialect, at: int, match=None) -> tuple[list[bytes], list[bool], int, bool]:
    """The cells of the record from a byte on, which of them are quoted, where it ends, and whether it does: the last cell of one that doesn't is what there is of it."""
    separator = dialect.separator.encode()
    match = match or _pattern(dialect).match
    end = len(data)
    cells: list[bytes] = []
    quoted: list[bool] = []
    while True:
        m = match(data, at)
        inner, rest, bare, stop = m.groups()
        if bare is None:
            cells.append(inner.replace(b'""', b'"') + rest)
            quoted.append(True)
        elif dialect.quoting and bare.startswith(b'"'):
            cells.append(data[at + 1 :].replace(b'""', b'"'))
            quoted.append(True)
            return cells, quoted, end, False
        else:
            cells.append(bare)
            quoted.append(False)
        at = m.end()
        if stop != separator:
            return cells, quoted, at, True
        if at == end:  # a separator at the very end opens an empty cell
            cells.append(b"")
            quoted.append(False)
            return cells, quoted, at, True


def records(data: bytes, dialect: Dialect, start: int = 0) -> Iterator[Record | Failure]:
    """All records from a byte on, without any policy; lines and numbers from 1 and 0 there."""
    separator = dialect.separator.encode()
    at, number, line = start, 0, 1
    if not dialect.quoting or b'"' not in data:
        # No cell can hold a line's end.
        for whole in (data[start:] if start else data).splitlines(keepends=True):
            body = whole.rstrip(b"\r\n")
            cells = body.split(separator)
            yield Record(number, line, at, cells, [False] * len(cells))
            number, line, at = number + 1, line + 1, at + len(whole)
        return
    match = _pattern(dialect).match
    # A line without a quote is a record of its own.
    plain = re.compile(rb'[^"\r\n]*(?:\r\n|\r|\n|\Z)').match
    end = len(data)
    while at < end:
        first = at
        if m := plain(data, at):
            at = m.end()
            cells = m[0].rstrip(b"\r\n").split(separator)
            yield Record(number, line, first, cells, [False] * len(cells))
            number, line = number + 1, line + 1
            continue
        cells, quoted, at, done = one_record(data, dialect, at, match)
        if not done:
            yield Failure("unclosed_quote", number, line, first)
            return
        yield Record(number, line, first, cells, quoted)
        number, line = number + 1, line + 1
        if any(b"\n" in c or b"\r" in c for c, q in zip(cells, quoted, strict=True) if q):
            # Line ends in cells, of which the record's own is none.
            line += len(_LINE_END.findall(data, first, at)) - (data[at - 1] in b"\r\n")


def frame(data: bytes, dialect: Dialect) -> Iterator[Record | Failure | list[bytes]]:
    """The header (a list, [] without a record), then data records, and at last a failure if the source broke.

    Records' cells are not cut or filled; a row that the policies reject is a failure.
    """
    data, bad = transcode(data, dialect.encoding)
    start = 3 if dialect.encoding in ("utf-8", "utf-16le") and data[:3] == b"\xef\xbb\xbf" else 0
    line = 0
    for _ in range(dialect.skip):
        m = re.compile(rb"[^\r\n]*(?:\r\n|\r|\n|\Z)").match(data, start)
        if start >= len(data):
            break
        start, line = m.end(), line + 1
    width: int | None = None
    waiting = dialect.has_header
    discard = dialect.header_row
    last, lines = -1, 1
    for r in records(data, dialect, start):
        if isinstance(r, Failure):
            yield Failure("encoding", r.record, line + r.line, bad) if bad is not None else Failure(r.kind, r.record, line + r.line, r.byte)
            return
        number, at = r.number, line + r.line
        last, lines = number, r.line + 1
        if len(r.cells) == 1 and not r.cells[0] and not r.quoted[0] and dialect.skip_blank_lines:
            continue
        if sum(map(len, r.cells)) > dialect.longest_record:
            yield Failure("row_too_long", number, at, r.byte)
            return
        if discard:
            discard -= 1
            continue
        if width is None:
            width = len(r.cells)
            if waiting:
                waiting = False
                if any(not _utf8(c) for c in r.cells):
                    yield Failure("encoding", number, at, r.byte)
                    return
                yield r.cells
                continue
        if (len(r.cells) < width and dialect.short_rows == "reject") or (len(r.cells) > width and dialect.long_rows == "reject"):
            yield Failure("column_count", number, at, r.byte, width, len(r.cells))
            return
        yield Record(number, at, r.byte, r.cells, r.quoted)
    if waiting:
        yield []
    if bad is not None:
        # Every record ahead of the bad byte is intact; it lies past the last one's start.
        yield Failure("encoding", last + 1, line + lines, bad)


def _utf8(cell: bytes) -> bool:
    try:
        cell.decode()
    except UnicodeDecodeError:
        return False
    return True
