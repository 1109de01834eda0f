"""Plans over framed text: routing, problems, failures, constraints, suggestion, streams."""

import pytest
from pyspark.sql import functions as F

from sluice.functions.constraints import Constraints
from sluice.functions.numbers import EUROZONE
from sluice.operators.suggest import plan_of, suggest
from sluice.plans.columns import Column, Header, bind, named
from sluice.plans.dialect import Dialect
from sluice.sources.delimited import Delimited, read_delimited
from sluice.types import AmbiguousColumn, CheckedColumn, Door, NoColumn, PlanError, StructuralFailure


def read(spark, data, plan, dialect=Dialect()):
    return Delimited.from_bytes(spark, data, dialect).bind(plan).read()


def test_what_went_wrong_is_listed_in_order(spark):
    d = Dialect(skip=1, header_row=1, short_rows="pad", long_rows="report", tokens=("NA",))
    data = b'title\nskipped,record\nid,n,note\n1,NA,"two\nlines"\nx,300,y\n7\n8,9,z,extra\n12a,1,ok,more,cells\n'
    t = read(spark, data, [Column(1, Door.U8), Column(0, Door.I32), Column(2)], d)
    got = [(r["_line"], r["plan_column"], r["reason"], r["expected"], r["found"]) for r in t.ordered_problems().collect()]
    assert got == [(6, 0, "out_of_range", None, None), (6, 1, "malformed", None, None), (8, None, "long_row", 3, 4), (9, None, "long_row", 3, 5), (9, 1, "malformed", None, None)]
    assert [(r["n"], r["id"], r["note"]) for r in t.values().collect()] == [(None, 1, "two\nlines"), (None, None, "y"), (None, 7, None), (9, 8, "z"), (1, None, "ok")]
    assert t.fault_counts().first().asDict() == {"n": 1, "id": 2, "note": 0}


def test_tokens_are_exact_unquoted_bytes(spark):
    t = read(spark, b'n\n"NA"\nNA\nna\n NA\n""\n', [Column(0)], Dialect(tokens=("NA",)))
    assert [(r["n"]["value"], r["n"]["reason"], r["n"]["origin"]) for r in t.frame.collect()] == [("NA", None, "cell"), (None, "empty", "token"), ("na", None, "cell"), (" NA", None, "cell"), (None, "empty", "cell")]


def test_column_tokens_replace_the_dialects(spark):
    t = read(spark, b"a,b,c\nNA,NA,NA\n-,-,-\n", [Column(0), Column(1, tokens=()), Column(2, tokens=("-",))], Dialect(tokens=("NA",)))
    assert [[r[c]["origin"] for c in "abc"] for r in t.frame.collect()] == [["token", "cell", "cell"], ["cell", "cell", "token"]]


def test_long_rows_are_cut_and_short_ones_padded(spark):
    t = read(spark, b'1\n2,"\xff"""\n', [Column(0, Door.I32), Column(1)], Dialect(has_header=False, long_rows="truncate"))
    assert [(r["c0"]["value"], r["c1"]["origin"]) for r in t.frame.collect()] == [(1, "padded"), (2, "padded")]


def test_rows_before_a_failure_and_nothing_after(spark):
    d = Delimited.from_bytes(spark, {"a": b"x,y\n1,2\n3\n4,5\n", "b": b"x,y\n6,7\n"}).bind([Column(0, Door.I32)])
    assert sorted(r["x"] for r in d.read().values().collect()) == [1, 6]
    assert [(r["_source"], r["kind"], r["record"], r["line"], r["expected"], r["found"]) for r in d.failures().collect()] == [("a", "column_count", 2, 3, 2, 1)]
    with pytest.raises(StructuralFailure):
        d.require_intact()


def test_partitions_change_nothing(spark, tmp_path):
    for i in range(6):
        (tmp_path / f"f{i}.csv").write_bytes(b"id,v\n" + b"".join(b"%d,%s\n" % (100 * i + k, b"x" if k % 7 == 0 else b"1.5") for k in range(50)))
    plan = named(id=Door.I64, v=Door.F64)
    t = read_delimited(spark, str(tmp_path), plan)
    whole = sorted(map(tuple, t.values().collect()), key=str)
    d = Delimited.open(spark, str(tmp_path))
    d.sources = d.sources.repartition(5)
    assert sorted(map(tuple, d.bind(plan).read().values().collect()), key=str) == whole
    assert len(whole) == 300


def test_only_planned_cells_are_sent(spark):
    d = Delimited.from_bytes(spark, b"a,b,c\n1,2,3\n").bind([Column(1, Door.I32)])
    assert [x and x["raw"] for x in d.records().first()["cells"]] == [None, b"2"] or d.records().first()["cells"][0]["raw"] is None


def test_headers_and_plans():
    h = Header(["a", "b", "a"])
    assert h.ordinal("a") == 0
    assert h.require("b") == 1
    with pytest.raises(AmbiguousColumn) as e:
        h.require("a")
    assert e.value.positions == (0, 2)
    with pytest.raises(NoColumn):
        h.ordinal("A")
    assert [c.name for c in bind([Column(1), Column("b"), Column(0)], h)] == ["b", "b_2", "a"]
    for bad in (Column(3), Column(-1), Column(0, Door.TEXT, form=EUROZONE), Column(0, Door.BOOL, constraints=Constraints(minimum="1")), Column(0, Door.I32, order="mdy")):
        with pytest.raises(PlanError):
            bind([bad], h)


CONSTRAINED = [
    (Door.I32, {"maximum": "10"}, ["11", "7", "x"], [(11, "maximum"), (7, None), (None, None)]),
    (Door.I32, {"minimum": "6", "exclusive_maximum": "12"}, ["7", "12", "5"], [(7, None), (12, "exclusiveMaximum"), (5, "minimum")]),
    (Door.F64, {"multiple_of": "0.5", "rounding": "midpoint"}, ["1.3", "1.25", "1.75"], [(1.5, None), (1.0, None), (2.0, None)]),
    (Door.F64, {"multiple_of": "0.5"}, ["1.3", "1.5"], [(1.3, "multipleOf"), (1.5, None)]),
    (Door.I8, {"multiple_of": "5", "rounding": "ceiling"}, ["127", "3", "-3"], [(127, "multipleOf"), (5, None), (0, None)]),
    (Door.I32, {"enum": ()}, ["7"], [(7, "enum")]),
    (Door.F64, {"enum": ("10", "0.3")}, ["10.0", "0.3", "15"], [(10.0, None), (0.3, None), (15.0, "enum")]),
    (Door.TEXT, {"trim": True, "max_length": 1}, ["  ab ", " é "], [("  ab ", "maxLength"), ("é", None)]),
    (Door.TEXT, {"enum": ("Yes",)}, ["yES", "no"], [("Yes", None), ("no", "enum")]),
    (Door.TEXT, {"enum": ("Yes",), "case_sensitive": True}, ["yES", "Yes"], [("yES", "enum"), ("Yes", None)]),
    (Door.TEXT, {"enum": ("b", "A", "a")}, ["a", "A"], [("A", None), ("A", None)]),
    (Door.TEXT, {"enum": ("01", "1.0")}, ["1", "1.0"], [("1", "enum"), ("1.0", None)]),
]


@pytest.mark.parametrize("kind, rules, cells, want", CONSTRAINED)
def test_constraints(spark, kind, rules, cells, want):
    t = read(spark, ("v\n" + "\n".join(cells) + "\n").encode(), [Column(0, kind, constraints=Constraints(**rules))])
    assert [(r["v"]["value"], r["v"]["keyword"]) for r in t.frame.collect()] == want
    with pytest.raises(CheckedColumn):
        t.value("v")


def test_blank_cells_are_never_violations(spark):
    t = read(spark, b"a,b\nNA,abc\nabc\n", [Column(0, constraints=Constraints(min_length=3)), Column(1, constraints=Constraints(min_length=3))], Dialect(short_rows="pad", tokens=("NA",)))
    assert [[r[c]["reason"] for c in "ab"] for r in t.frame.collect()] == [["empty", None], [None, "empty"]]
    assert t.problems().count() == 0


def test_suggestions(spark):
    rows = [("1", "1,5", "007", "1/2/2024", "2024-01-01", "yes", "a"), ("2", "2,25", "12", "3/4/2024", "2024-02-01", "no", "1")]
    found, more = suggest(spark.createDataFrame(rows, "i string, e string, z string, d string, iso string, b string, m string"))
    assert not more
    told = {k: (s.door, s.status) for k, s in found.items()}
    assert told["i"] == (Door.I32, "resolved")
    assert told["iso"] == (Door.DATE, "resolved")
    assert told["b"] == (Door.BOOL, "resolved")
    assert told["d"] == (Door.DATE_ORDERED, "ambiguous")
    assert told["e"] == (Door.F64, "resolved")
    assert found["e"].param == ("comma",)
    assert told["z"][1] == "unresolved"
    assert told["m"][1] == "unresolved"
    plan = {c.name: c.door for c in plan_of(found, order="dmy")}
    assert plan["d"] is Door.DATE_ORDERED
    assert plan["z"] is Door.TEXT


def test_stream_reads_each_file_once(spark, tmp_path):
    from sluice.streaming.delimited import stream_delimited, write_stream

    (tmp_path / "in").mkdir()
    plan = [Column(0, Door.I32, "a"), Column(1, Door.I32, "b")]
    for n in (1, 2):
        (tmp_path / "in" / f"{n}.csv").write_text(f"h,k\n{n},x\n{n}0,5\n")
        typed = stream_delimited(spark, str(tmp_path / "in"), plan)
        write_stream(typed, str(tmp_path / "values"), str(tmp_path / "problems"), str(tmp_path / "checkpoint")).awaitTermination()
        values = sorted((r["a"], r["b"]) for r in spark.read.parquet(str(tmp_path / "values")).collect()) if n == 2 else None
    assert values == [(1, None), (2, None), (10, 5), (20, 5)] or sorted(values, key=str) == sorted([(1, None), (2, None), (10, 5), (20, 5)], key=str)
    assert spark.read.parquet(str(tmp_path / "problems")).count() == 2


def test_pruned_plan_reads_values_only(spark):
    t = read(spark, b"a,b\n1,2\n", [Column(0, Door.I32), Column(1, Door.I32)])
    plan = t.frame.select(F.col("a.value"))._jdf.queryExecution().optimizedPlan().toString()
    assert "AS b#" not in plan
