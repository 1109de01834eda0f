"""The framer against a byte-at-a-time machine, and its rules one by one."""

import random

import pytest

from sluice.plans.dialect import Dialect
from sluice.sources.framing import Failure, Record, frame
from sluice.types import DeclarationError

BARE = Dialect(has_header=False, skip_blank_lines=False, short_rows="pad", long_rows="report")


def machine(data: bytes, sep: int = 44) -> tuple[list[list[bytes]], bool]:
    """Records and whether a quote stays open, one byte after another."""
    rows, row, cell, state, started, i = [], [], bytearray(), "start", False, 0
    while i < len(data):
        b = data[i]
        started = True
        if state == "start" and b == 34:
            state = "in"
        elif state == "in" and b == 34:
            if data[i + 1 : i + 2] == b'"':
                cell.append(34)
                i += 1
            else:
                state = "bare"
        elif state == "in":
            cell.append(b)
        elif b == sep:
            row.append(bytes(cell))
            cell, state = bytearray(), "start"
        elif b in (10, 13):
            if b == 13 and data[i + 1 : i + 2] == b"\n":
                i += 1
            rows.append([*row, bytes(cell)])
            row, cell, state, started = [], bytearray(), "start", False
        else:
            cell.append(b)
            state = "bare"
        i += 1
    if state == "in":
        return rows, True
    if started:
        rows.append([*row, bytes(cell)])
    return rows, False


def cells(data: bytes, dialect: Dialect = BARE):
    got = list(frame(data, dialect))
    return [r.cells for r in got if isinstance(r, Record)], [r for r in got if isinstance(r, Failure)]


def test_quote_soup():
    rng = random.Random(5)
    for _ in range(4000):
        data = bytes(rng.choice(b'",\r\nab') for _ in range(rng.randrange(24)))
        want, open_ = machine(data)
        got, failures = cells(data)
        assert (got, bool(failures)) == (want, open_), data


def test_rfc_4180():
    rng = random.Random(6)
    for width in (1, 2, 3, 7, 12):
        rows = [["".join(rng.choice('ab,"\n\r é') for _ in range(rng.randrange(5))) for _ in range(width)] for _ in range(60)]
        text = "".join(",".join('"' + c.replace('"', '""') + '"' for c in r) + "\r\n" for r in rows)
        assert cells(text.encode())[0] == [[c.encode() for c in r] for r in rows]


@pytest.mark.parametrize(
    "data, want",
    [
        (b'"x"y"z,w"\n', [[b'x"y"z'.replace(b'x"', b"x"), b'w"']]),
        (b'12" pipe,1\n', [[b'12" pipe', b"1"]]),
        (b"\xef\xbb\xbfa,b", [[b"a", b"b"]]),
        (b"a,", [[b"a", b""]]),
        (b"a\rb\r\nc\nd", [[b"a"], [b"b"], [b"c"], [b"d"]]),
        (b"", []),
    ],
)
def test_rules(data, want):
    assert cells(data)[0] == want


def test_lines_count_quoted_line_ends_and_records_count_blanks():
    got = [r for r in frame(b'h\n"a\n\r\nb"\n\nc\n', Dialect()) if isinstance(r, Record)]
    assert [(r.number, r.line) for r in got] == [(1, 2), (3, 6)]


def test_skip_knows_no_quotes():
    assert [r if isinstance(r, list) else r.cells for r in frame(b'a "title\nskipped,record\nid\n1\n', Dialect(skip=1, header_row=1))] == [[b"id"], [b"1"]]


@pytest.mark.parametrize("data, kind, record", [(b'a,b\n1,2\n"x', "unclosed_quote", 2), (b"a,b\n1,2\n3\n4,5\n", "column_count", 2), (b"\xff\n1\n", "encoding", 0)])
def test_failures_come_last(data, kind, record):
    got = list(frame(data, Dialect()))
    assert isinstance(got[-1], Failure)
    assert (got[-1].kind, got[-1].record) == (kind, record)


def test_encodings():
    one = lambda data, name: list(frame(data, Dialect(has_header=False, encoding=name)))
    assert one(b"\x80\x81\xe9\n", "windows-1252")[0].cells == ["€\x81é".encode()]
    assert one(b"\x80\xe9\n", "latin-1")[0].cells == ["\x80é".encode()]
    assert one("aé\n".encode("utf-16-le"), "utf-16le")[0].cells == ["aé".encode()]
    broken = one("a\n".encode("utf-16-le") + b"\x00\xd8", "utf-16le")
    assert broken[0].cells == [b"a"]
    assert (broken[-1].kind, broken[-1].byte) == ("encoding", 4)


def test_a_header_alone_and_nothing():
    assert list(frame(b"a,b\n", Dialect())) == [[b"a", b"b"]]
    assert list(frame(b"", Dialect())) == [[]]


@pytest.mark.parametrize("bad", [{"separator": '"'}, {"separator": "ab"}, {"short_rows": "cut"}, {"encoding": "utf-16be"}, {"skip": -1}])
def test_dialects_that_cannot_be(bad):
    with pytest.raises(DeclarationError):
        Dialect(**bad)
