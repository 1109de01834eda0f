"""What the operators of this subpackage share: working tables, bounded Arrow batches, words and hashes."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch; Spark's own limit of bytes in a batch (64 MB by default) holds besides.
BATCH_ROWS = 2500
#: Bytes of text that a worker turns into arrays at once.
SLICE_BYTES = 4 << 20
#: White space of every contract here, as a regular expression class.
SPACE = r"\x20\x09-\x0D"

_U = np.uint64
GOLD = _U(0x9E3779B97F4A7C15)


#: Folders of sessions without a shared one.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; only where it is unset, a local one (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        application = spark.sparkContext.applicationId
        if application not in _LOCAL:
            _LOCAL[application] = "file://" + tempfile.mkdtemp(prefix="sluice-")
        base = _LOCAL[application]
    return base


def work_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, removed when the session's process ends."""
    path = f"{shared_dir(spark).rstrip('/')}/sluice-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended before
        pass


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: it cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files of plans that are done with; else they stay until the driver happens to collect garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bounded_batches(spark: SparkSession) -> None:
    """Holds the session's Arrow batches at BATCH_ROWS rows at most, from here on: plans are lazy, so it can't be put back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def spread_join(left: DataFrame, right: DataFrame, key: str, weight: str, rows: int) -> DataFrame:
    """left with right's columns and ``_copy``, null where right lacks the key; hot keys are dealt to several tasks.

    right: at most one row for a key, whose ``weight`` is how many rows of left have it; rows: their sum. A key with more
    than a quarter of a task's share is copied as often as it has such quarters; there are at most four such keys for a
    task, so their table is broadcast. Which copy a row meets follows from the row's own values.
    """
    quarter = max(1, rows // (4 * partitions(left.sparkSession)))
    hot = right.where(F.col(weight) > quarter).select(key, F.ceil(F.col(weight) / quarter).cast("int").alias("_copies"))
    spread = F.pmod(F.xxhash64(*(c for c in left.columns if c != "_row")), F.col("_copies")).cast("int")
    dealt = left.join(F.broadcast(hot), key, "left").withColumn("_copy", F.coalesce(spread, F.lit(0))).drop("_copies")
    copies = right.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.when(F.col(weight) > quarter, F.ceil(F.col(weight) / quarter).cast("int") - 1).otherwise(0))))
    return dealt.join(copies, [key, "_copy"], "left")


def text_slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that no part has much over ``most`` bytes of text; a single longer text stays whole."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
        give_back()


def give_back() -> None:
    """Returns freed memory to the system: idle workers of earlier stages would hold it beside the busy ones."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


#: What operators keep in a worker from task to task, by operator.
_KEPT: dict[str, Callable[[], None]] = {}


def keeps(operator: str, forget: Callable[[], None]) -> None:
    """Tells that an operator keeps something in a worker, and how to let go of it."""
    _KEPT[operator] = forget


def claim(operator: str = "") -> None:
    """Lets go of what other operators keep in this worker, at the beginning of a task."""
    for other, forget in _KEPT.items():
        if other != operator:
            forget()
    give_back()


def filled(column: pa.Array) -> pa.Array:
    """Texts with null as empty, with 64-bit offsets from 0 on: ascii_lower misreads slices of larger arrays."""
    whole = pa.concat_arrays([pa.array([], pa.large_string()), column.cast(pa.large_string())])
    return pc.fill_null(whole, "")


def words(column: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Offsets (one more than texts) into the words of all texts, and those words, A-Z lower-cased.

    Words are maximal runs without ``SPACE``; other letters and spaces beyond ASCII stay as they are.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(filled(column)))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.flatten()
    offsets = offsets - offsets[0]
    if len(flat):
        full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
        if not full.all():
            before = np.concatenate([[0], np.cumsum(full)])
            offsets, flat = before[offsets], flat.filter(pa.array(full))
    return offsets, flat.dictionary_encode()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64 bits, in place."""
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def word_hashes(encoded: pa.DictionaryArray) -> np.ndarray:
    """64 bits for every word, equal in all processes."""
    import xxhash

    h = xxhash.xxh3_64_intdigest
    own = np.fromiter((h(w) for w in encoded.dictionary.to_pylist()), np.uint64, len(encoded.dictionary))
    return own[encoded.indices.to_numpy()] if len(encoded) else np.empty(0, np.uint64)


def extend(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a run of words from that of the run without its last word, and that word's."""
    return mix(context * GOLD + word)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
