"""Rendezvous (highest random weight) sharding of stable record keys over weighted shards, in DataFrame functions only.

A key's score at a shard is ``-weight / ln(u)``, with u in (0, 1) from the MD5 of key and shard number; the shard with the
highest score gets the record. A shard's share follows its weight, a record's place depends on its key and the shards
alone, and when a shard is added, only records that it wins move: a share of ``w_new / sum(w)``.

``slot`` numbers a shard's records from 0 without gaps, by buckets of the hash of key, text and the partition that a row was
read in: rows are numbered within (shard, bucket), and a table of at most shards x buckets counts gives each bucket's first
slot, so no task sees a whole shard, nor all rows of a key or all equal rows. Rows are written to the shared folder with
their buckets first, about 60 bytes each, so that numbers and counts are of the same rows. Texts don't travel: their size
and CRC are taken where they are read.

Defined cases: a null text has size 1 and the CRC of an empty text; null keys have one stable place of their own;
repeated rows go to one shard, into slots of their own; of equal scores the lowest shard's counts; an empty table gives no
rows; other columns aren't read. Equal texts under different keys may go to different shards: this is the ``key`` law.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.llm.common import documents, materialise, partitions

#: Buckets of a shard at least; with more partitions, as many as those.
BUCKETS = 512
_BITS = 48


def score(key: Column, shard: int, weight: float = 1.0) -> Column:
    digest = F.md5(F.concat(key, F.lit(f":{shard}")).cast("binary"))
    h = F.conv(F.substring(digest, 1, _BITS // 4), 16, 10).cast("long")
    return F.lit(-float(weight)) / F.ln((h.cast("double") + F.lit(0.5)) / F.lit(float(1 << _BITS)))


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The number of the winning shard; of equal scores the lowest number."""
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("every shard needs a weight over 0")
    scores = F.array(*(score(key, i, w) for i, w in enumerate(weights)))
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def rendezvous(docs: DataFrame, weights: Sequence[float], new_weight: float = 1.0, key: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """One row per row of docs: key, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``.

    ``grown_shard`` is the shard after one more of ``new_weight`` has come; it is decided from the scores alone.
    """
    buckets = buckets or max(BUCKETS, partitions(docs.sparkSession))
    own, k = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(key).cast("string"), F.lit("null"))
    rows = docs.select(
        F.col(key).alias("_key"),
        (F.octet_length(own) + 1).cast("long").alias("size"),
        F.crc32(own.cast("binary")).alias("text_crc32"),
        shard_of(k, list(weights)).alias("shard"),
        shard_of(k, [*weights, new_weight]).alias("grown_shard"),
        F.pmod(F.xxhash64(k, own, F.spark_partition_id()), F.lit(buckets)).cast("int").alias("_bucket"),
    )
    rows = materialise(rows, "dealt")
    # The counts travel as one row per shard, bucket and task.
    counts = rows.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    first = counts.select("shard", "_bucket", (F.sum("_n").over(Window.partitionBy("shard").orderBy("_bucket")) - F.col("_n")).alias("_first"))
    numbered = rows.withColumn("_k", F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy("_key", "text_crc32")))
    # At most shards x buckets rows, so it is broadcast.
    return numbered.join(F.broadcast(first), ["shard", "_bucket"]).select(
        F.col("_key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_first") + F.col("_k") - 1).cast("long").alias("slot"), "grown_shard"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendezvous(documents(spark, sf_dir), [1.0] * 8)
