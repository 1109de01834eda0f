"""Best-fit packing of tokenized documents into sequences of a fixed length, online, with a bounded number of open bins.

Open bins lie in stacks by free space; a bitset has a bit for every free space that occurs. A piece goes to the bin with
the least free space that still holds it: the lowest set bit from the piece's length on. A bin without free space
closes; when ``open_bins`` are open and a piece needs another, the fullest one closes first, the lowest set bit.

Each task packs its own documents. The pieces of a bin go out when it closes, so a task holds the pieces of its open bins
and no more; those that are open when its documents end go out marked. A second pass packs the marked ones of all tasks
again in the same way, in as many tasks as there are ``TOGETHER`` of them, so that what is left part-filled doesn't grow with
the number of tasks that read the documents. A document longer than a sequence is cut into full pieces from its end, so
that its first piece may be shorter; no other is cut.

Defined cases: a null text is an empty one, and has the end id alone; repeated rows are packed each; an empty table gives
no rows; other columns than id and text aren't read. Of bins with the same free space the last opened is taken.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import bounded_batches, claim, documents, filled, materialise, text_slices
from sluice.llm.tokenizing import SLICE, encode

LENGTH = 2048
OPEN_BINS = 1024
#: Pieces of bins left open that one task of the second pass packs.
TOGETHER = 50_000

SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class Bins:
    """Open bins in a bitset keyed by free space."""

    def __init__(self, length: int = LENGTH, open_bins: int = OPEN_BINS, first: int = 0):
        self.length, self.open_bins, self.next = length, open_bins, first
        self.bits, self.open = 0, 0
        self.closed: list[int] = []
        self.stacks: list[list[int]] = [[] for _ in range(length + 1)]

    def _take(self, free: int) -> int:
        stack = self.stacks[free]
        number = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        self.open -= 1
        return number

    def put(self, size: int) -> tuple[int, int]:
        """The bin of a piece and the place in it."""
        if not 0 < size <= self.length:
            raise ValueError(f"a piece of {size} doesn't fit a bin of {self.length}")
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            free, number = self.length, self.next
            self.next += 1
            if self.open >= self.open_bins and size < self.length:
                self.closed.append(self._take((self.bits & -self.bits).bit_length() - 1))
        if left := free - size:
            self.stacks[left].append(number)
            self.bits |= 1 << left
            self.open += 1
        else:
            self.closed.append(number)
        return number, self.length - free


def cut(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """Start and length of a document's pieces."""
    first = n % length or min(n, length)
    return [(0, first)] + [(a, length) for a in range(first, n, length)]


class _Held:
    """The pieces of open bins, as rows that go out when their bin closes."""

    def __init__(self, length: int, open_bins: int, first: int, with_ids: bool):
        self.bins, self.rows, self.with_ids = Bins(length, open_bins, first), {}, with_ids

    def put(self, doc: int | None, k: int, start: int, size: int, crc: int, ids: bytes | None) -> None:
        number, offset = self.bins.put(size)
        self.rows.setdefault(number, []).append((doc, k, start, size, crc, number, offset, ids))

    def out(self, end: bool = False) -> pa.RecordBatch:
        """The rows of bins that have closed; at the end, of those still open."""
        numbers = list(self.rows) if end else self.bins.closed
        rows = [r for n in numbers for r in self.rows.pop(n)]
        self.bins.closed = []
        types = [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.binary()]
        columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
        names = [*(x.split()[0] for x in SCHEMA.split(", ")), "ids"]
        columns, names = (columns, names) if self.with_ids else (columns[:-1], names[:-1])
        return pa.RecordBatch.from_arrays([*columns, pa.array([end] * len(rows), pa.bool_())], [*names, "open"])


def _pack(path: str, split: str, end: int, length: int, open_bins: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        claim("tokens")
        held = _Held(length, open_bins, TaskContext.get().partitionId() << 32, with_ids)
        for batch in batches:
            for part in text_slices(batch, most=SLICE):
                ids, counts = encode(filled(part.column("text")), path, split, end, np.uint32)
                raw, at = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B"), 0
                for doc, n in zip(part.column("doc_id").to_pylist(), counts.tolist(), strict=True):
                    for k, (start, size) in enumerate(cut(n, length)):
                        piece = raw[4 * (at + start) : 4 * (at + start + size)]
                        held.put(doc, k, start, size, zlib.crc32(piece), bytes(piece) if with_ids else None)
                    at += n
                yield held.out()
        yield held.out(end=True)

    return run


def _pack_again(length: int, open_bins: int, with_ids: bool):
    """For pieces of bins that were left open; their new bins have numbers of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = _Held(length, open_bins, 1 << 62 | TaskContext.get().partitionId() << 32, with_ids)
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            ids = batch.column("ids").to_pylist() if with_ids else [None] * batch.num_rows
            for row in zip(*columns, ids, strict=True):
                held.put(*row)
            yield held.out()
        yield held.out(end=True)

    return run


def best_fit(docs: DataFrame, tokenizer: str, split: str = "spaces", end: int = 0, length: int = LENGTH, open_bins: int = OPEN_BINS, with_ids: bool = False) -> DataFrame:
    """One row per piece, with its sequence and place; with_ids: its ids too, as little-endian 32-bit integers."""
    bounded_batches(docs.sparkSession)
    schema = SCHEMA + ", ids binary" * with_ids
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    packed = materialise(rows.mapInArrow(_pack(tokenizer, split, end, length, open_bins, with_ids), schema + ", open boolean"), "packed")
    left = packed.where("open")
    count = left.count()
    # Large pieces first, as they find room best then.
    again = left.drop("open").repartition(count // TOGETHER + 1).sortWithinPartitions(F.desc("length"), "doc_id", "piece").mapInArrow(_pack_again(length, open_bins, with_ids), schema + ", open boolean")
    return packed.where("NOT open").unionByName(again).drop("open")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return best_fit(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
