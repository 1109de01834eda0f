"""Large files by ranges: the same records, lines and failures however many ranges there are."""

import random

import pytest

from sluice.plans.columns import Column
from sluice.plans.dialect import Dialect
from sluice.sources.delimited import Delimited
from sluice.sources.framing import Failure, frame

PARTS, COST = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"


@pytest.fixture
def cut(spark):
    """Sets the size of a range; the session's own comes back."""
    before = {k: spark.conf.get(k) for k in (PARTS, COST)}

    def set_to(n):
        spark.conf.set(PARTS, str(n))
        spark.conf.set(COST, "1")

    yield set_to
    for k, v in before.items():
        spark.conf.set(k, v)


def told(reader):
    rows = sorted((r["_record"], r["_line"], r["_width"], r["_expected"], [c["raw"] and bytes(c["raw"]) for c in r["cells"]], [c["quoted"] for c in r["cells"]]) for r in reader.records().where("failure IS NULL").collect())
    return rows, [tuple(r)[1:] for r in reader.failures().collect()]


def plain(data, dialect):
    rows, failures, expected = [], [], None
    for r in frame(data, dialect):
        if isinstance(r, list):
            expected = len(r)
        elif isinstance(r, Failure):
            failures.append((r.kind, r.record, r.line, r.byte, r.expected, r.found))
        else:
            expected = expected or len(r.cells)
            rows.append((r.number, r.line, len(r.cells), expected, r.cells, r.quoted))
    return sorted(rows), failures


def soup(seed, n=400, breaks=True):
    rng = random.Random(seed)
    cells = [b"a", b"", b'"q"', b'"two\nlines"', b'"a ""b"" c"', b'x"y', b'"z"tail', b'"\r\n,\r"', b'"' + b"long " * 30 + b'\n"', "é".encode()]
    ends = [b"\n", b"\n", b"\r\n", b"\r"]
    out = b"h1,h2,h3\n"
    for _ in range(n):
        width = 3 if not breaks or rng.random() > 0.002 else rng.choice([1, 2, 4])
        out += b",".join(rng.choice(cells) for _ in range(width)) + rng.choice(ends)
        if rng.random() < 0.05:
            out += b"\n"
    return out


DIALECTS = [Dialect(), Dialect(short_rows="pad", long_rows="report"), Dialect(has_header=False, skip_blank_lines=False, short_rows="pad", long_rows="truncate"), Dialect(skip=2, header_row=1, short_rows="pad", long_rows="truncate"), Dialect(quoting=False, short_rows="pad", long_rows="report"), Dialect(encoding="latin-1"), Dialect(longest_record=120)]


@pytest.mark.parametrize("number", range(len(DIALECTS)))
def test_ranges_change_nothing(spark, tmp_path, cut, number):
    dialect = DIALECTS[number]
    data = soup(number)
    (tmp_path / "a b.csv").write_bytes(data)
    want = plain(data, dialect)
    assert want[0]
    for size in (1 << 20, len(data) // 3, len(data) // 50):
        cut(size)
        reader = Delimited.open(spark, str(tmp_path), dialect)
        assert bool(reader.large) == (size < len(data))
        assert told(reader) == want, size
        if dialect.has_header:
            names = next(iter(frame(data, dialect)))
            assert reader.header().names == [n.decode() for n in names]


@pytest.mark.parametrize("data", [b"", b"h\n", b"\xef\xbb\xbfa,b\n1,2\n" * 1 + b"3,4\n" * 40 + b"5\n", b"a,b\n" + b"1,2\n" * 40 + b'3,"open\n' + b"4,5\n" * 40, b'a,"b\n' + b"x\n" * 50 + b'"\n1,2\n' * 3, b'"a\n' * 50, b"a,b\n" + b'1,"' + b"line\n" * 100 + b'"\n2,3\n', b"a\xff,b\n" + b"1,2\n" * 40, b"a\n" + b"1\n" * 40 + b"2"])
def test_odd_files(spark, tmp_path, cut, data):
    (tmp_path / "f.csv").write_bytes(data)
    for dialect in (Dialect(), Dialect(has_header=False)):
        want = plain(data, dialect)
        cut(23)
        assert told(Delimited.open(spark, str(tmp_path), dialect)) == want, dialect


def test_a_plan_over_large_and_small_files(spark, tmp_path, cut):
    for i in range(4):
        (tmp_path / f"f{i}.csv").write_bytes(b"id,v\n" + b"".join(b'%d,"%s"\n' % (1000 * i + k, b"x\ny" if k % 7 == 0 else b"1.5") for k in range(200 if i % 2 else 5)))
    cut(300)
    reader = Delimited.open(spark, str(tmp_path)).bind([Column("id"), Column("v")])
    assert len(reader.large[0]) == 2
    got = sorted((int(r["id"]), r["v"]) for r in reader.read().values().collect())
    assert got == sorted((1000 * i + k, "x\ny" if k % 7 == 0 else "1.5") for i in range(4) for k in range(200 if i % 2 else 5))
    reader.require_intact()
