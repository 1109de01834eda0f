"""One file read by several tasks: byte ranges that end with a line, whose quotes a first pass tells.

Spark's text reader cuts a file at line feeds. Whether such a range begins inside a quoted cell depends on all ranges ahead
of it, so the first pass scans each range both ways and keeps little: how it ends, how many records and lines it has, where
each width first occurs, and what a record that is open at its end, or was open at its beginning, has in it. Those notes are
put in order for each file, which tells every range's state and first numbers, the file's width and its first failure.
The second pass frames ranges as the notes say. Records that lie in several ranges are framed apart, from their pieces.
Both passes take a range in slices of whole lines, so that a task holds a slice and the record that is open at its end,
however large the range is.

Encodings have to be one byte a character or UTF-8. A file whose head (skipped lines, discarded records, the header) isn't
complete in its first range is left to the reader of whole files.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.plans.dialect import Dialect
from sluice.sources.framing import Failure, Record, one_record, records, transcode

#: Ranges whose notes are broadcast at once, some 100 bytes each; files beyond are read in groups of as many.
RANGES = 500_000
#: Bytes of a range that are framed at once.
SLICE = 4 << 20
_ENDS = re.compile(rb"\r\n|\r|\n")
NOTES = "_source string, start long, notes string"
PLAN = "_source string, start long, entry int, number long, line long, width int, stop long, open long, crossing boolean, whole boolean, header array<binary>, failure struct<kind: string, record: long, line: long, byte: long, expected: int, found: int>"


def lines_of(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The lines of files without their line feeds, and the range that each one is in."""
    lines = spark.read.option("lineSep", "\n").text(paths)
    return lines.select(F.col("_metadata.file_path").alias("_source"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("line"))


def _ranges(batches: Iterator[pa.RecordBatch], extra: int = 0) -> Iterator[tuple[tuple, Iterator[bytes]]]:
    """Ranges as key (source, start, file's size, and further columns) and slices, which have to be taken ahead of the next range."""

    def parts() -> Iterator[tuple[tuple, pa.Array]]:
        for batch in batches:
            starts = batch.column(1).to_numpy()
            sources = batch.column(0).dictionary_encode().indices.to_numpy()
            cuts = np.flatnonzero((starts[1:] != starts[:-1]) | (sources[1:] != sources[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if a != b:
                    yield tuple(batch.column(i)[a].as_py() for i in range(3 + extra)), batch.column(3 + extra).slice(a, b - a)

    for key, own in groupby(parts(), lambda part: part[0]):
        yield key, _slices(lines for _, lines in own)


def _slices(parts: Iterable[pa.Array]) -> Iterator[bytes]:
    """Lines with their feeds, in slices of SLICE bytes and the rest of a line."""
    held, size = [], 0
    for lines in parts:
        ends = np.cumsum(pc.binary_length(lines).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        a = before = 0
        while a < len(lines):
            b = min(int(np.searchsorted(ends, before + SLICE - size)) + 1, len(lines))
            held.append(b"\n".join(lines.slice(a, b - a).to_pylist()) + b"\n")
            size += int(ends[b - 1]) - before
            a, before = b, int(ends[b - 1])
            if size >= SLICE:
                yield b"".join(held)
                held, size = [], 0
    if held:
        yield b"".join(held)


class _Open:
    """A record that goes on in the next slice, or has: its cells only where they are kept."""

    def __init__(self, number: int, line: int, byte: int, keep: bool):
        self.number, self.line, self.byte, self.keep = number, line, byte, keep
        self.width, self.length = 1, 0
        self.quoted: list[bool] = []
        self._done: list[bytes] = []
        self._last: list[bytes] = []

    def add(self, cells: list[bytes], quoted: list[bool]) -> None:
        """What a slice has of it; the first cell goes on with the last one."""
        self.width, self.length = self.width + len(cells) - 1, self.length + sum(map(len, cells))
        if self.keep:
            self.quoted += quoted[1:] if self.quoted else quoted
            self._last.append(cells[0])
            for c in cells[1:]:
                self._done.append(b"".join(self._last))
                self._last = [c]

    @property
    def cells(self) -> list[bytes]:
        return [*self._done, b"".join(self._last)]


class _Walk:
    """The records of a range, slice by slice. A slice ends with a line, so that at its end a record is over or in a quoted cell.

    Numbers and bytes are from 0 at the range's beginning, lines from 1. What slices have of a record that lies in several of
    them is put together only while `keep` is set.
    """

    def __init__(self, dialect: Dialect, first: bool, inside: bool, keep: bool):
        self.dialect, self.keep, self.skip = dialect, keep, dialect.skip if first else 0
        self.number = self.line = self.byte = 0
        #: The record that was open at the range's beginning, whether it still is, and where it ends in the slice.
        self.lead, self.leading, self.end = _Open(-1, 0, 0, False), inside, 0
        self.open: _Open | None = None

    def records(self, data: bytes) -> Iterator[Record | _Open]:
        """The records that end in the next slice; the caller takes all of them, or goes no further."""
        at = lines = number = 0
        while self.skip and at < len(data):
            m = _ENDS.search(data, at)
            at, lines, self.skip = m.end() if m else len(data), lines + 1, self.skip - 1
        done = True
        if self.leading or self.open is not None:
            cells, quoted, end, done = one_record(b'"' + data, self.dialect, 0)
            (self.lead if self.leading else self.open).add(cells, quoted)
            at, lines = end - 1, len(_ENDS.findall(data, 0, end - 1))
            if self.leading:
                self.leading, self.end = not done, at
            elif done:
                whole, self.open = self.open, None
                yield whole
        for r in records(data, self.dialect, at) if done else ():
            if isinstance(r, Failure):
                cells, quoted, _, _ = one_record(data, self.dialect, r.byte)
                self.open = _Open(self.number + r.record, self.line + lines + r.line, self.byte + r.byte, self.keep)
                self.open.add(cells, quoted)
                number = r.record + 1
            else:
                number = r.number + 1
                yield Record(self.number + r.number, self.line + lines + r.line, self.byte + r.byte, r.cells, r.quoted)
        self.number, self.line, self.byte = self.number + number, self.line + len(_ENDS.findall(data)), self.byte + len(data)


@dataclass
class _Note:
    """What a range has when it is entered in one state."""

    exit: int = 0
    records: int = 0
    lead_done: bool = True
    lead_cells: int = 0
    lead_length: int = 0
    widths: dict[int, tuple[int, int, int]] = field(default_factory=dict)
    long: tuple[int, int, int] | None = None
    open: tuple[int, int, int, int, int] | None = None
    head: bool = True
    width: int | None = None
    header: list[str] | None = None
    broken_header: tuple[int, int, int] | None = None


class _Notes:
    """The note of a range that is entered in one state, slice by slice."""

    def __init__(self, dialect: Dialect, first: bool, inside: bool):
        self.dialect, self.discard = dialect, dialect.header_row if first else 0
        self.note = _Note(head=not first)
        self.walk = _Walk(dialect, first, inside, first)

    def add(self, data: bytes) -> None:
        note, dialect = self.note, self.dialect
        for r in self.walk.records(data):
            across = isinstance(r, _Open)
            width = r.width if across else len(r.cells)
            if not across and width == 1 and not r.cells[0] and not r.quoted[0] and dialect.skip_blank_lines:
                continue
            if (r.length if across else sum(map(len, r.cells))) > dialect.longest_record and note.long is None:
                note.long = r.number, r.line, r.byte
            if self.discard:
                self.discard -= 1
            elif not note.head:
                note.head, note.width, self.walk.keep = True, width, False
                if dialect.has_header:
                    try:
                        note.header = [c.decode() for c in r.cells]
                    except UnicodeDecodeError:
                        note.broken_header = r.number, r.line, r.byte
            elif width not in note.widths:
                note.widths[width] = r.number, r.line, r.byte

    def done(self) -> dict:
        walk, note = self.walk, self.note
        note.lead_done, note.lead_cells, note.lead_length = not walk.leading, walk.lead.width - 1, walk.lead.length
        note.records, note.exit = walk.number, int(walk.leading or walk.open is not None)
        if walk.open is not None:
            note.open = walk.open.number, walk.open.line, walk.open.byte, walk.open.width, walk.open.length
        return note.__dict__


def _take_notes(dialect: Dialect):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (source, start, size), slices in _ranges(batches):
            # A range without a quote, entered inside a cell, is inside it all along.
            both = [_Notes(dialect, start == 0, inside) for inside in ((False, True) if dialect.quoting and start else (False,))]
            length = raw = lines = 0
            for part in slices:
                data = transcode(part, dialect.encoding)[0]
                for notes in both:
                    notes.add(data)
                length, raw, lines = length + len(data), raw + len(part), lines + len(_ENDS.findall(data))
            states = [notes.done() for notes in both]
            notes = {"size": length, "raw": raw, "file": size, "lines": lines, "states": states if len(states) == 2 else [*states, {}]}
            yield pa.RecordBatch.from_pydict({"_source": [source], "start": pa.array([start], pa.int64()), "notes": [json.dumps(notes)]})

    return run


def _in_order(dialect: Dialect):
    """The plan of a file from the notes of its ranges; the row with start -1 has the header and the first failure."""

    def wrong(width: int, expected: int | None) -> bool:
        return expected is not None and ((width < expected and dialect.short_rows == "reject") or (width > expected and dialect.long_rows == "reject"))

    def run(table: pa.Table) -> pa.Table:
        source = table.column("_source")[0].as_py()
        notes = sorted((start, json.loads(text)) for start, text in zip(table.column("start").to_pylist(), table.column("notes").to_pylist(), strict=True))
        # The text reader leaves a byte order mark out; a last line may lack its feed, which the ranges have always.
        marked = dialect.encoding == "utf-8" and notes[0][1]["file"] - sum(n["raw"] for _, n in notes) >= 2
        state, number, line, byte = 0, 0, 0, 3 if marked else 0
        width, opened, failures, rows = None, None, [], []
        first = notes[0][1]["states"][0]
        whole = not first["head"] and len(notes) > 1
        for start, n in notes:
            own = n["states"][state]
            rows.append([source, start, state, number, line, opened[0] if opened else None, False])
            if state:
                opened = (*opened[:3], opened[3] + own["lead_cells"], opened[4] + own["lead_length"])
                if own["lead_done"]:
                    if opened[4] > dialect.longest_record:
                        failures.append((opened[0], "row_too_long", opened[1], opened[2], None, None))
                    elif wrong(opened[3], width):
                        failures.append((opened[0], "column_count", opened[1], opened[2], width, opened[3]))
                    opened = None
            if start == 0:
                width = own["width"]
                if own["broken_header"]:
                    k, at, b = own["broken_header"]
                    failures.append((k, "encoding", at, byte + b, None, None))
            if own.get("long"):
                k, at, b = own["long"]
                failures.append((number + k, "row_too_long", line + at, byte + b, None, None))
            for found, (k, at, b) in own["widths"].items():
                if wrong(int(found), width):
                    failures.append((number + k, "column_count", line + at, byte + b, width, int(found)))
            if own["open"]:
                k, at, b, cells, length = own["open"]
                opened = number + k, line + at, byte + b, cells, length
                rows[-1][6] = True
            number, line, byte, state = number + own["records"], line + n["lines"], byte + n["size"], own["exit"]
        if opened:
            failures.append((opened[0], "unclosed_quote", opened[1], opened[2], None, None))
        failure = min(failures, default=None, key=lambda f: f[0])
        told = None if failure is None or whole else {"kind": failure[1], "record": failure[0], "line": failure[2], "byte": failure[3], "expected": failure[4], "found": failure[5]}
        stop = failure[0] if failure else None
        header = [c.encode() for c in first["header"]] if first["header"] is not None else None
        out = [(s, start, entry, k, at, width, stop, lead, crossing, whole, None, None) for s, start, entry, k, at, lead, crossing in rows]
        out.append((source, -1, 0, 0, 0, width, stop, None, False, whole, header, told))
        types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.list_(pa.binary()), pa.struct([("kind", pa.string()), ("record", pa.int64()), ("line", pa.int64()), ("byte", pa.int64()), ("expected", pa.int32()), ("found", pa.int32())])]
        names = [x.split()[0] for x in PLAN.split(", ") if ":" not in x.split()[0]]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return run


def plan_of(lines: DataFrame, dialect: Dialect) -> DataFrame:
    return lines.mapInArrow(_take_notes(dialect), NOTES).groupBy("_source").applyInArrow(_in_order(dialect), PLAN)


_PLANNED = ["entry", "number", "line", "width", "stop", "open", "crossing"]


def dealt(lines: DataFrame, plan: DataFrame, which: SparkColumn) -> DataFrame:
    """Lines with what the plan says of their range; plan has at most RANGES rows."""
    own = plan.where((F.col("start") >= 0) & ~F.col("whole") & which).select("_source", "start", *(F.col(c).alias(f"_{c}") for c in _PLANNED))
    return lines.join(F.broadcast(own), ["_source", "start"]).select("_source", "start", "size", *(f"_{c}" for c in _PLANNED), "line")


def framed(dialect: Dialect, batch, rows_at_once: int):
    """The records that lie in one range each; batch(source, rows, width) makes a record batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (source, start, _, entry, number, line, width, stop, *_), slices in _ranges(batches, len(_PLANNED)):
            walk = _Walk(dialect, start == 0, bool(entry), True)
            discard, waiting = (dialect.header_row, dialect.has_header) if start == 0 else (0, False)
            over = False
            for part in slices:
                rows: list[Record] = []
                for r in walk.records(transcode(part, dialect.encoding)[0]):
                    if over := stop is not None and number + r.number >= stop:
                        break
                    cells = r.cells
                    if len(cells) == 1 and not cells[0] and not r.quoted[0] and dialect.skip_blank_lines:
                        continue
                    if discard:
                        discard -= 1
                    elif waiting:
                        waiting = False
                    else:
                        rows.append(Record(number + r.number, line + r.line, r.byte, cells, r.quoted))
                        if len(rows) == rows_at_once:
                            yield batch(source, rows, width)
                            rows = []
                if rows:
                    yield batch(source, rows, width)
                if over or (walk.open is not None and stop is not None and number + walk.open.number >= stop):
                    break

    return run


PIECES = "_source string, record long, start long, slice int, line long, width int, piece binary"


def pieces(dialect: Dialect):
    """The parts of records that lie in several ranges."""
    schema = pa.schema([("_source", pa.string()), ("record", pa.int64()), ("start", pa.int64()), ("slice", pa.int32()), ("line", pa.int64()), ("width", pa.int32()), ("piece", pa.binary())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (source, start, _, entry, number, line, width, stop, opened, crossing), slices in _ranges(batches, len(_PLANNED)):

            def piece(record: int, k: int, at: int | None, data: bytes) -> pa.RecordBatch:
                return pa.RecordBatch.from_pylist([dict(zip(names, (source, record, start, k, at, width, data), strict=True))], schema)  # noqa: B023

            walk = _Walk(dialect, start == 0, bool(entry), False)
            held: list[tuple[int, bytes]] = []
            for k, part in enumerate(slices):
                data, leading, before = transcode(part, dialect.encoding)[0], walk.leading, walk.byte
                for _ in walk.records(data):
                    pass
                if leading and (stop is None or opened < stop):
                    yield piece(opened, k, None, data[: walk.end])
                last = walk.open if crossing and walk.open is not None and (stop is None or number + walk.open.number < stop) else None
                if last is None:
                    held = []
                elif last.byte < before:
                    held.append((k, data))
                else:
                    held = [(k, data[last.byte - before :])]
            for k, data in held:
                yield piece(number + last.number, k, line + last.line, data)

    return run


def joined(dialect: Dialect, batch):
    """A record from its pieces."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("start", "slice", "line", "piece")), strict=True), key=lambda r: r[:2])
        cells, quoted, _, _ = one_record(b"".join(p for *_, p in rows), dialect, 0)
        record = Record(table.column("record")[0].as_py(), rows[0][2], 0, cells, quoted)
        return pa.Table.from_batches([batch(table.column("_source")[0].as_py(), [record], table.column("width")[0].as_py())])

    return run
