"""Ranges in slices: the same records, lines and failures however small the slices are, and none held whole."""

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from test_ranges import DIALECTS, plain, soup

from sluice.plans.columns import Column
from sluice.plans.dialect import Dialect
from sluice.sources import delimited, ranges
from sluice.sources.delimited import ROWS, Delimited, _batch
from sluice.sources.ranges import NOTES, _in_order, _ranges, _take_notes, framed, joined, pieces

ODD = [b"a,b\n" + b"1,2\n" * 40 + b'3,"open\n' + b"4,5\n" * 40, b'a,"b\n' + b"x\n" * 50 + b'"\n1,2\n' * 3, b'"a\n' * 50, b"a,b\n" + b'1,"' + b'li""ne\n' * 100 + b'"x,"y\n\n"\n2,3\n', b"a\xff,b\n" + b"1,2\n" * 40, b"a\n" + b"1\n" * 40 + b"2", b'a,b\r\n1,"' + b'""\r\n' * 60 + b'"\r\n2,"' + b"z\r" * 60 + b'"\r\n']


def cut(data, parts):
    """Lines without feeds, with the byte where the range that each one begins in does."""
    size, at, out = len(data) // parts + 1, 0, []
    for line in data.removesuffix(b"\n").split(b"\n"):
        out.append((at // size * size, line))
        at += len(line) + 1
    return out


def batches(rows, more=()):
    """Batches of a few lines each, as Spark gives them."""
    for i in range(0, len(rows), 5):
        own = rows[i : i + 5]
        columns = [pa.array(["f"] * len(own)), pa.array([s for s, _ in own], pa.int64()), pa.array([0] * len(own), pa.int64())]
        yield pa.RecordBatch.from_arrays([*columns, *(pa.array([x[s] for s, _ in own]) for x in more), pa.array([line for _, line in own], pa.binary())], [str(k) for k in range(4 + len(more))])


def told(data, dialect, parts):
    lines = cut(data, parts)
    notes = pa.Table.from_batches(list(_take_notes(dialect)(batches(lines))))
    assert notes.column_names == [x.split()[0] for x in NOTES.split(", ")]
    plan = _in_order(dialect)(notes).to_pylist()
    if plan[0]["whole"]:
        return None
    own = [{r["start"]: r[k] for r in plan if r["start"] >= 0} for k in ("entry", "number", "line", "width", "stop", "open", "crossing")]

    def batch(source, rows, width):
        return _batch(source, rows, width or 0, None, None)

    found = list(framed(dialect, batch, ROWS)(batches(lines, own)))
    marked = [(s, line) for s, line in lines if own[6][s] or own[0][s]]
    across = list(pieces(dialect)(batches(marked, own)))
    if across:
        table = pa.Table.from_batches(across)
        for k in sorted(set(table.column("record").to_pylist())):
            found += joined(dialect, batch)(table.filter(pc.equal(table.column("record"), k))).to_batches()
    rows = sorted((r["_record"], r["_line"], r["_width"], r["_expected"], [c["raw"] for c in r["cells"]], [c["quoted"] for c in r["cells"]]) for b in found for r in b.to_pylist())
    return rows, [tuple(plan[-1]["failure"].values())] if plan[-1]["failure"] else []


@pytest.mark.parametrize("size", [1, 9, 64, 1000])
def test_slices_change_nothing(monkeypatch, size):
    monkeypatch.setattr(ranges, "SLICE", size)
    known = 0
    for dialect in (*DIALECTS, Dialect(has_header=False)):
        for data in (*(soup(seed, 120) for seed in range(2)), *ODD):
            for parts in (1, 3, 20):
                got = told(data, dialect, parts)
                known += got is not None
                assert got is None or got == plain(data, dialect), (dialect, data[:40], parts)
    assert known > 150


def test_no_range_is_held_whole(monkeypatch):
    monkeypatch.setattr(ranges, "SLICE", 100)
    data = soup(1)
    got = [(key, [len(part) for part in own]) for key, own in _ranges(batches(cut(data, 3)))]
    assert len(got) == 3 and sum(sum(own) for _, own in got) == len(data)
    assert max(max(own) for _, own in got) < 100 + max(map(len, data.split(b"\n"))) + 1


def test_a_file_of_one_partition_is_not_framed_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(delimited, "WHOLE", 1000)
    data = b"id,v\n" + b"".join(b'%d,"x\ny"\n' % k for k in range(300))
    (tmp_path / "f.csv").write_bytes(data)
    reader = Delimited.open(spark, str(tmp_path)).bind([Column("id"), Column("v")])
    assert reader.large and reader.sources.isEmpty()
    assert sorted((int(r["id"]), r["v"]) for r in reader.read().values().collect()) == [(k, "x\ny") for k in range(300)]
