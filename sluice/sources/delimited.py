"""Delimited text as DataFrames: sources are framed in Arrow batches.

A file of up to WHOLE bytes that fits one of Spark's partitions (``spark.sql.files.maxPartitionBytes``) is framed at once; a
larger one is read by ranges (``sluice.sources.ranges``), of which a task holds a slice at a time. UTF-16 and compressed files,
which can't be cut, are always whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators.verdicts import Typed
from sluice.plans.columns import Column, Header, bind
from sluice.plans.dialect import Dialect
from sluice.sources.framing import Failure, Record, frame
from sluice.sources.ranges import PIECES, RANGES, dealt, framed, joined, lines_of, pieces, plan_of
from sluice.types import StructuralFailure
from sluice.working import materialise

RECORDS = "_source string, _record long, _line long, _width int, _expected int, cells array<struct<raw: binary, quoted: boolean>>, failure struct<kind: string, record: long, line: long, byte: long, expected: int, found: int>"

_CELL = pa.struct([("raw", pa.binary()), ("quoted", pa.bool_())])
_FAILURE = pa.struct([("kind", pa.string()), ("record", pa.int64()), ("line", pa.int64()), ("byte", pa.int64()), ("expected", pa.int32()), ("found", pa.int32())])
#: Records of a batch.
ROWS = 4096


def _batch(source: str, rows: list[Record], expected: int, failure: Failure | None, keep: frozenset[int] | None) -> pa.RecordBatch:
    """keep: the ordinals that the plan reads; other cells are left out, so that they are never sent."""
    if keep is None:
        cells, quoted = [c for r in rows for c in r.cells], [q for r in rows for q in r.quoted]
        places = [0]
        for r in rows:
            places.append(places[-1] + len(r.cells))
    else:
        top = max(keep, default=-1) + 1
        cells = [c if i in keep else None for r in rows for i, c in enumerate(r.cells[:top])]
        quoted = [q for r in rows for q in r.quoted[:top]]
        places = [0]
        for r in rows:
            places.append(places[-1] + min(top, len(r.cells)))
    flat = pa.StructArray.from_arrays([pa.array(cells, pa.binary()), pa.array(quoted, pa.bool_())], fields=list(_CELL))
    lists = pa.ListArray.from_arrays(pa.array(places, pa.int32()), flat)
    n = len(rows)
    columns = [pa.array([source] * n, pa.string()), pa.array([r.number for r in rows], pa.int64()), pa.array([r.line for r in rows], pa.int64()), pa.array([len(r.cells) for r in rows], pa.int32()), pa.array([expected] * n, pa.int32()), lists, pa.nulls(n, _FAILURE)]
    names = ["_source", "_record", "_line", "_width", "_expected", "cells", "failure"]
    if failure is not None:
        last = [pa.array([source], pa.string()), pa.array([failure.record], pa.int64()), pa.array([failure.line], pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.list_(_CELL)), pa.array([failure.__dict__], _FAILURE)]
        columns = [pa.concat_arrays([a, b.cast(a.type)]) for a, b in zip(columns, last, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names)


def _framer(dialect: Dialect, keep: frozenset[int] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list[Record] = []
                expected, failure = None, None
                for r in frame(data, dialect) if data is not None else [Failure("too_large", 0, 0, 0)]:
                    if isinstance(r, list):
                        expected = len(r)
                    elif isinstance(r, Failure):
                        failure = r
                    else:
                        expected = len(r.cells) if expected is None else expected
                        rows.append(r)
                        if len(rows) == ROWS:
                            yield _batch(source, rows, expected, None, keep)
                            rows = []
                if rows or failure is not None:
                    yield _batch(source, rows, expected or 0, failure, keep)

    return run


def _headers(dialect: Dialect):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                first = next(iter(frame(data or b"", dialect)), [])
                names = [c.decode() for c in first] if isinstance(first, list) else None
                yield pa.RecordBatch.from_arrays([pa.array([source]), pa.array([names], pa.list_(pa.string()))], ["_source", "names"])

    return run


#: Bytes of a file that one task can take whole.
LARGEST = (1 << 31) - 1
#: Bytes of a file that is framed whole though it could be cut.
WHOLE = 32 << 20
_COMPRESSED = (".gz", ".bz2", ".zst", ".lz4", ".snappy", ".deflate")


def _partition_bytes(spark: SparkSession) -> int:
    text = spark.conf.get("spark.sql.files.maxPartitionBytes", "128m").lower()
    m = re.fullmatch(r"(\d+)([kmgtp]?)b?", text)
    return int(m[1]) << 10 * " kmgtp".index(m[2] or " ")


class Delimited:
    """Sources of one dialect. The header is read first and the plan bound after; nothing is inferred."""

    def __init__(self, sources: DataFrame, dialect: Dialect = Dialect(), large: Sequence[list[str]] = ()):
        """sources: a row per source with its name and its bytes. large: groups of paths of files that are read by ranges."""
        self.sources, self.dialect, self.large = sources, dialect, list(large)
        self.plan: list[Column] | None = None
        self._planned: list[tuple[DataFrame, DataFrame, bool]] | None = None

    @classmethod
    def open(cls, spark: SparkSession, path: str | Sequence[str], dialect: Dialect = Dialect()) -> Delimited:
        def whole(paths: str | Sequence[str]) -> DataFrame:
            return spark.read.format("binaryFile").load(paths)

        most = LARGEST if dialect.encoding == "utf-16le" else min(WHOLE, _partition_bytes(spark))
        name, content = F.col("_metadata.file_path").alias("_source"), F.col("content").alias("_bytes")
        files = whole(path)
        small = files.where(F.col("length") <= most).select(name, content)
        over = [(r["path"], r["length"]) for r in files.where(F.col("length") > most).select("path", "length").orderBy("path").collect()]  # a row per large file
        kept = [p for p, n in over if n <= LARGEST and (most == LARGEST or p.lower().endswith(_COMPRESSED))]
        lost = [p for p, n in over if n > LARGEST and (most == LARGEST or p.lower().endswith(_COMPRESSED))]
        if kept:
            small = small.unionByName(whole(kept).select(name, content))
        if lost:
            small = small.unionByName(whole(lost).select(name, F.lit(None).cast("binary").alias("_bytes")))
        groups: list[list[str]] = []
        room = 0
        for p, n in over:
            if p not in kept and p not in lost:
                cuts = n // most + 2
                if not groups or cuts > room:
                    groups.append([])
                    room = RANGES
                groups[-1].append(p)
                room -= cuts
        return cls(small, dialect, groups)

    @classmethod
    def from_bytes(cls, spark: SparkSession, data: bytes | dict[str, bytes], dialect: Dialect = Dialect()) -> Delimited:
        rows = list((data if isinstance(data, dict) else {"bytes": data}).items())
        return cls(spark.createDataFrame(rows, "_source string, _bytes binary"), dialect)

    def _ranged(self) -> list[tuple[DataFrame, DataFrame, bool]]:
        """Lines, plan, and whether records cross ranges, for each group of large files; planned when first asked."""
        if self._planned is None:
            self._planned = []
            for paths in self.large:
                lines = lines_of(self.sources.sparkSession, paths)
                plan = materialise(plan_of(lines, self.dialect), "ranges")
                known = plan.agg(F.max(F.col("crossing") & ~F.col("whole")).alias("c"), F.collect_set(F.when(F.col("whole"), F.col("_source"))).alias("w")).first()
                if known["w"]:  # files without a whole head in their first range
                    files = self.sources.sparkSession.read.format("binaryFile").load(paths).where(F.col("_metadata.file_path").isin(known["w"]))
                    name = F.col("_metadata.file_path").alias("_source")
                    self.sources = self.sources.unionByName(files.where(F.col("length") <= LARGEST).select(name, F.col("content").alias("_bytes"))).unionByName(files.where(F.col("length") > LARGEST).select(name, F.lit(None).cast("binary").alias("_bytes")))
                self._planned.append((lines, plan, bool(known["c"])))
        return self._planned

    def header(self) -> Header:
        """The header of the first source by name; an empty one without a record or a header."""
        if not self.dialect.has_header:
            return Header([])
        heads = [plan.where("start = -1 AND NOT whole").select("_source", F.col("header").cast("array<string>").alias("names")) for _, plan, _ in self._ranged()]
        first = self.sources.orderBy("_source").limit(1).mapInArrow(_headers(self.dialect), "_source string, names array<string>")
        for head in heads:
            first = first.unionByName(head.orderBy("_source").limit(1))
        first = first.orderBy("_source").first()
        return Header(first["names"] or [] if first else [])

    def bind(self, plan: Sequence[Column]) -> Delimited:
        if self.plan is not None:
            raise ValueError("already bound")
        header = self.header() if self.dialect.has_header else None
        out = Delimited(self.sources, self.dialect, self.large)
        out.plan, out._planned = bind(plan, header), self._planned
        return out

    def records(self, first: bool = False) -> DataFrame:
        """Framed records, and failures as rows without cells. first: of the first source by name alone (of a large one, what its first range has)."""
        keep = None if self.plan is None else frozenset(c.source for c in self.plan)
        planned = self._ranged()
        sources, only = self.sources, F.lit(True)
        if first:
            names = sources.select("_source")
            for _, plan, _ in planned:
                names = names.unionByName(plan.select("_source"))
            least = names.agg(F.min("_source").alias("s")).first()["s"]
            sources, only = sources.where(F.col("_source") == least), (F.col("_source") == F.lit(least)) & (F.col("start") <= 0)
        out = sources.mapInArrow(_framer(self.dialect, keep), RECORDS)

        def batch(source: str, rows: list[Record], width: int | None) -> pa.RecordBatch:
            return _batch(source, rows, width or 0, None, keep)

        for lines, plan, crossing in planned:
            out = out.unionByName(dealt(lines, plan, only).mapInArrow(framed(self.dialect, batch, ROWS), RECORDS))
            if crossing and not first:
                parts = dealt(lines, plan, F.col("crossing") | (F.col("entry") == 1)).mapInArrow(pieces(self.dialect), PIECES)
                out = out.unionByName(parts.groupBy("_source", "record").applyInArrow(joined(self.dialect, batch), RECORDS))
            broken = plan.where(F.col("start") == -1).where("failure IS NOT NULL").where(only)
            empty = {"_width": "int", "_expected": "int", "cells": "array<struct<raw: binary, quoted: boolean>>"}
            out = out.unionByName(broken.select("_source", F.col("failure.record").alias("_record"), F.col("failure.line").alias("_line"), *(F.lit(None).cast(t).alias(n) for n, t in empty.items()), "failure"))
        return out

    def read(self) -> Typed:
        if self.plan is None:
            raise ValueError("unbound: bind a plan first")
        return Typed(self.records().where("failure IS NULL"), self.plan, self.dialect.tokens, self.dialect.long_rows)

    def failures(self) -> DataFrame:
        return self.records().where("failure IS NOT NULL").select("_source", "failure.*")

    def require_intact(self) -> Delimited:
        """Raises with the first failure by source, if there is one."""
        if broken := self.failures().orderBy("_source").limit(1).collect():
            raise StructuralFailure(str(broken[0].asDict()))
        return self


def read_delimited(spark: SparkSession, path: str | Sequence[str], plan: Sequence[Column], dialect: Dialect = Dialect()) -> Typed:
    return Delimited.open(spark, path, dialect).bind(plan).read()
