"""Token-id storage: frequency-ranked ids in a byte-aligned variable-length code whose control bytes stand apart.

An id is replaced by its rank among all ids of the corpus (the most frequent is 0), so frequent ids take one byte. A
block of at most ``BLOCK_IDS`` ids has two parts: *control*, a byte for every four ids with two bits each for the
length less one, and *data*, the ids' low bytes in a row. Decoding looks the lengths of four ids up by control byte,
sums them to places, and gathers the bytes, all in numpy.

The file format is a folder with two tables that Spark's commit protocol writes, so lost executors leave no halves:
``blocks`` (part, block, n_ids, control, data, and per document its id and number of ids) in ascending id order, and
``ranks`` (rank, id, count), one row per id that occurs, at most the vocabulary.

Defined cases: a null text is an empty one, and has the end id alone; repeated rows follow each other, ordered by the
CRC of their ids; texts of any length go over several blocks; an empty table gives empty files and no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.llm.common import bounded_batches, claim, documents, filled, materialise, partitions, text_slices, work_path
from sluice.llm.tokenizing import SLICE, encode

#: Ids that a block gathers before it is closed; documents are never cut.
BLOCK_IDS = 1 << 18

#: Lengths of the four ids of each control byte.
LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data of unsigned 32-bit ranks."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    length = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    four = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    four[: len(ranks)] = length - 1
    four = four.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    wide = ranks.view(np.uint8).reshape(-1, 4)
    return control.tobytes(), wide[np.arange(4) < length[:, None]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    length = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    ends = np.cumsum(length, dtype=np.int32 if n < 1 << 29 else np.int64)
    if n and ends[-1] != len(data):
        raise ValueError(f"a block of {n} ids has {len(data)} bytes, not {ends[-1]}")
    raw = np.frombuffer(data, np.uint8)
    at = ends - length
    out = raw[at].astype(np.uint32)
    more = np.flatnonzero(length > 1)
    for k in (1, 2, 3):
        if not len(more):
            break
        out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
        more = more[length[more] > k + 1]
    return out


def _tokens(path: str, split: str, end: int, kind: np.dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("tokens")
        for batch in batches:
            for part in text_slices(batch, most=SLICE):
                ids, counts = encode(filled(part.column("text")), path, split, end, kind.type)
                places = np.concatenate([[0], np.cumsum(counts)])
                raw = ids.tobytes()
                own = [raw[kind.itemsize * a : kind.itemsize * b] for a, b in zip(places[:-1], places[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(own, pa.binary())], ["doc_id", "ids"])

    return run


def _count(vocabulary: int, kind: np.dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), kind), minlength=vocabulary)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], ["id", "n"])

    return run


BLOCKS = "part int, block int, n_ids long, doc_ids array<long>, counts array<long>, control binary, data binary"


def _blocks(rank_of: np.ndarray, kind: np.dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block = TaskContext.get().partitionId(), 0
        held: list[bytes] = []
        docs: list[int | None] = []
        size = 0

        def closed() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), kind)
            control, data = pack(rank_of[ids])
            row = [part, block, len(ids), docs, [len(x) // kind.itemsize for x in held], control, data]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            names = [x.split()[0] for x in BLOCKS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                held.append(ids)
                docs.append(doc)
                size += len(ids) // kind.itemsize
                if size >= BLOCK_IDS:
                    yield closed()
                    held, docs, size, block = [], [], 0, block + 1
        if held:
            yield closed()

    return run


def write(docs: DataFrame, path: str, tokenizer: str, split: str = "spaces", end: int = 1) -> None:
    """Encodes every text and writes the files at path, in ascending order of doc_id. split: see ``tokenizing``.

    Ids travel in two bytes each where the vocabulary allows it, else in four.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    bounded_batches(spark)
    vocabulary = max(Tokenizer.from_file(tokenizer).get_vocab_size(), end + 1)
    kind = np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tokens = materialise(rows.mapInArrow(_tokens(tokenizer, split, end, kind), "doc_id long, ids binary"), "tokens")
    # One row per id of the vocabulary.
    counts = tokens.select("ids").mapInArrow(_count(vocabulary, kind), "id int, n long").groupBy("id").agg(F.sum("n").alias("count"))
    found = sorted(((r["count"], -r["id"]) for r in counts.collect()), reverse=True)
    rank_of = np.zeros(vocabulary, np.uint32)
    rank_of[[-i for _, i in found]] = np.arange(len(found))
    spark.createDataFrame([(k, -i, n) for k, (n, i) in enumerate(found)], "rank int, id int, count long").coalesce(1).write.parquet(f"{path}/ranks")
    ordered = tokens.repartitionByRange(partitions(spark), F.col("doc_id")).sortWithinPartitions(F.col("doc_id"), F.crc32("ids"), F.col("ids"))
    ordered.mapInArrow(_blocks(rank_of, kind), BLOCKS).write.parquet(f"{path}/blocks")


def _decode(id_of: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = id_of[unpack(row["control"], row["data"], row["n_ids"])]
                ends = np.cumsum(np.array(row["counts"], np.int64))
                own = [ids[a:b].astype("<u4").tobytes() for a, b in zip(ends - row["counts"], ends, strict=True)]
                n = len(own)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array([row["part"]] * n, pa.int32()),
                        pa.array([row["block"]] * n, pa.int32()),
                        pa.array(ends - row["counts"]),
                        pa.array(row["counts"], pa.int64()),
                        pa.array([zlib.crc32(x) for x in own], pa.int64()),
                        pa.array(own, pa.binary()),
                    ],
                    ["doc_id", "part", "block", "place", "n_tokens", "ids_crc32", "ids"],
                )

    return run


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """One row per document: doc_id, ``start``, ``n_tokens``, ``ids_crc32``, and ``ids`` as little-endian 32-bit integers."""
    bounded_batches(spark)
    ranks = spark.read.parquet(f"{path}/ranks").collect()
    id_of = np.zeros(max(1, len(ranks)), np.uint32)
    for r in ranks:
        id_of[r["rank"]] = r["id"]
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    rows = blocks.mapInArrow(_decode(id_of), "doc_id long, part int, block int, place long, n_tokens long, ids_crc32 long, ids binary")
    # A row per block; parts first, so that no task numbers all blocks.
    sizes = blocks.select("part", "block", "n_ids")
    within = sizes.withColumn("_in", F.sum("n_ids").over(Window.partitionBy("part").orderBy("block")) - F.col("n_ids"))
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("_n")).collect()  # a row per partition
    first, total = [], 0
    for r in sorted(parts):
        first.append((r["part"], total))
        total += r["_n"]
    firsts = spark.createDataFrame(first, "part int, _before long")
    starts = within.join(F.broadcast(firsts), "part").select("part", "block", (F.col("_in") + F.col("_before")).alias("_start"))
    out = rows.join(starts, ["part", "block"])
    return out.select("doc_id", (F.col("_start") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = work_path(spark, "token-store")
    write(documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"), split="words")
    return read(spark, path, with_ids=False)
