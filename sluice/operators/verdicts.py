"""Planned columns over framed records: cells to verdicts, values and problems, all as DataFrame expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from sluice.functions.constraints import checked
from sluice.functions.doors import FIELDS, door, judged, let
from sluice.plans.columns import Column
from sluice.types import CheckedColumn, Door

ROW = ["_source", "_record", "_line", "_width", "_expected"]


def verdict(cell: SparkColumn, column: Column, tokens: Sequence[str] = ()) -> SparkColumn:
    """The structure of one cell: a null cell is padded, a token stands for no value, the door judges the rest."""
    tokens = column.tokens if column.tokens is not None else tuple(tokens)
    raw = cell["raw"]
    none = lambda t: F.lit(None).cast(t)
    extra = {"keyword": "string", "adjusted": "boolean", "enum_index": "int"} if column.constraints is not None else {}

    def told(value: SparkColumn, reason: SparkColumn, offset: SparkColumn, n: SparkColumn, detail: SparkColumn, origin: str = "cell", more: Sequence[SparkColumn] = ()) -> SparkColumn:
        more = more or [none(t) for t in extra.values()]
        return F.struct(value.alias("value"), reason.alias("reason"), offset.alias("offset"), n.alias("len"), detail.alias("detail"), *(m.alias(k) for m, k in zip(more, extra, strict=True)), F.lit(origin).alias("origin"), raw.alias("raw"))

    def unasked(origin: str) -> SparkColumn:
        return told(none(column.spark_type), F.lit("empty"), F.lit(0), F.lit(0), none("string"), origin)

    if column.constraints is None:
        asked = judged(column.door, raw, told, **column.options())
    else:
        asked = let(checked(door(column.door, raw, **column.options()), raw, column.door, column.constraints, column.spark_type), lambda v: told(*(v[f] for f in FIELDS), more=[v[k] for k in extra]))
    out = F.when(cell.isNull(), unasked("padded"))
    if tokens:
        out = out.when(~cell["quoted"] & raw.isin(*(t.encode() for t in tokens)), unasked("token"))
    return out.otherwise(asked)


class Typed:
    """Records under a bound plan. Each planned column is a structure with value, reason, span, detail, origin and raw."""

    def __init__(self, records: DataFrame, plan: Sequence[Column], tokens: Sequence[str] = (), long_rows: str = "reject", cell_at=None):
        self.plan, self.long_rows = list(plan), long_rows
        at = cell_at or (lambda i: F.when(F.lit(i) < F.least(F.col("_width"), F.col("_expected")), F.get("cells", F.lit(i))))
        # Two steps, so that a cell is taken out of its record once.
        cells = records.select(*ROW, *(at(c.source).alias(f"_cell {i}") for i, c in enumerate(self.plan)))
        self.frame = cells.select(*ROW, *(verdict(F.col(f"`_cell {i}`"), c, tokens).alias(c.name) for i, c in enumerate(self.plan)))

    def _column(self, name: str) -> Column:
        return next(c for c in self.plan if c.name == name)

    def value(self, name: str) -> SparkColumn:
        """A column's values, null where not cast; refused where constraints make a value ambiguous."""
        if self._column(name).constraints is not None:
            raise CheckedColumn(f"{name} has constraints: read it with checked()")
        return F.col(f"`{name}`.value")

    def checked(self, name: str) -> SparkColumn:
        return F.col(f"`{name}`")

    def values(self, *keep: str) -> DataFrame:
        """All columns' values; a violated one is null here and told by problems()."""
        ok = lambda c: F.when(F.col(f"`{c.name}`.reason").isNull(), F.col(f"`{c.name}`.value")).alias(c.name)
        return self.frame.select(*keep, *map(ok, self.plan))

    def rows(self) -> Iterator[Row]:
        """The rows one by one on the driver, a partition at a time, each with its columns' verdicts."""
        return self.frame.toLocalIterator(prefetchPartitions=True)

    def for_each_row(self, use: Callable[[Row], None]) -> None:
        """Calls use with every row, in the tasks."""
        self.frame.foreach(use)

    def fault_counts(self) -> DataFrame:
        """One row: for each column, how many cells have a problem."""
        bad = lambda c: F.count_if(F.col(f"`{c.name}`.reason").isNotNull() & (F.col(f"`{c.name}`.reason") != "empty")).alias(c.name)
        return self.frame.agg(*map(bad, self.plan))

    def problems(self) -> DataFrame:
        """What went wrong, a row for each: by source and record, the row's own first, then by plan column.

        Blank, token and padded cells are no problem; an uncached one is. A long row is one where rows are reported.
        """
        none = F.lit(None)
        entries = [
            F.when(
                (F.col(f"`{c.name}`.reason").isNotNull() & (F.col(f"`{c.name}`.reason") != "empty")) | (F.col(f"`{c.name}`.origin") == "uncached"),
                F.struct(
                    F.lit(i).alias("plan_column"),
                    F.lit(c.source).alias("source_column"),
                    F.col(f"`{c.name}`.reason").alias("reason"),
                    F.col(f"`{c.name}`.detail").alias("detail"),
                    F.col(f"`{c.name}`.origin").alias("origin"),
                    F.col(f"`{c.name}`.offset").alias("offset"),
                    F.col(f"`{c.name}`.len").alias("len"),
                    F.col(f"`{c.name}`.raw").alias("raw"),
                    (F.col(f"`{c.name}`.keyword") if c.constraints is not None else none.cast("string")).alias("keyword"),
                    none.cast("int").alias("expected"),
                    none.cast("int").alias("found"),
                ),
            )
            for i, c in enumerate(self.plan)
        ]
        if self.long_rows == "report":
            empty = [none.cast("int").alias("plan_column"), none.cast("int").alias("source_column"), F.lit("long_row").alias("reason"), *(none.cast("string").alias(x) for x in ("detail", "origin")), *(none.cast("int").alias(x) for x in ("offset", "len")), none.cast("binary").alias("raw"), none.cast("string").alias("keyword")]
            entries.insert(0, F.when(F.col("_width") > F.col("_expected"), F.struct(*empty, F.col("_expected").cast("int").alias("expected"), F.col("_width").cast("int").alias("found"))))
        rows = self.frame.select("_source", "_record", "_line", F.explode(F.filter(F.array(*entries), lambda x: x.isNotNull())).alias("p"))
        return rows.select("_source", "_record", "_line", "p.*")

    def ordered_problems(self) -> DataFrame:
        return self.problems().orderBy("_source", "_record", F.asc_nulls_first("plan_column"))


def texts(*names: str) -> list[Column]:
    return [Column(n, Door.TEXT) for n in names]
