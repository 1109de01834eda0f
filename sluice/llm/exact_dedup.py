"""Exact dedup by skew-safe combining: within a partition, then among salted digest groups, then over all salts.

Texts are equal when they are identical after deletion of every character of ``[\\x20\\x09-\\x0D]``. Each of the three
merges groups by digest *and* full normalised text, so two texts with one digest stay apart at every stage:

1. rows of one partition (the partial aggregation ahead of the first shuffle); the salt is the partition's number, so a
   partition sends each of its texts once, however many copies it has,
2. rows of one (digest, salt, text) group: a text that all partitions have reaches ``salts`` tasks,
3. the winners of the salts of one (digest, text).

Rows then find their group. Where the third merge found one text for a digest, the digest is enough, as all rows that
have it have that text; where it found several, rows and winners meet by digest and full text. Digests with more rows than
a quarter of a task's share are dealt to several tasks: their winners, at most four for each task, go out as copies.

Defined cases: a null text counts as empty; all texts without other characters than white space are one group.
Of equal texts the row with the most code points in the original text, then the smallest id stays; null ids come
last. Of repeated rows with one id and one text, all are ``kept`` false but one (they meet in one task, as rows of a
hundred bytes without their texts). An empty table gives no rows. Other columns than id and text aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.llm.common import SPACE, documents, materialise, partitions, spread_join

SALTS = 16
_STEP = 10**20
_ABOVE = 1 << 63


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), f"[{SPACE}]+", "")


def _rank(id_column: str, text: str) -> Column:
    """One number that is larger the earlier a row comes in its group: code points, then small ids, then none."""
    length = F.char_length(F.coalesce(F.col(text), F.lit(""))).cast("decimal(10,0)")
    number = lambda n, digits: F.lit(str(n)).cast(f"decimal({digits},0)")
    own = F.coalesce(number(_ABOVE, 20) - F.col(id_column).cast("long").cast("decimal(19,0)"), number(0, 20))
    return (length * number(_STEP, 21) + own).cast("decimal(38,0)")


def _id_of(rank: Column) -> Column:
    own = rank % F.lit(str(_STEP)).cast("decimal(21,0)")
    return F.when(own > 0, (F.lit(str(_ABOVE)).cast("decimal(20,0)") - own).cast("long"))


def _merged(rows: DataFrame, salts: int) -> DataFrame:
    """A row for each digest and text: the best rank, and how many rows have it."""
    n = partitions(rows.sparkSession)
    salted = rows.select("_digest", "_norm", "_rank", (F.spark_partition_id() % salts).alias("_salt"))
    salted = salted.groupBy("_digest", "_salt", "_norm").agg(F.max("_rank").alias("_rank"), F.count(F.lit(1)).alias("_n"))
    return salted.repartition(n, "_digest").groupBy("_digest", "_norm").agg(F.max("_rank").alias("_best"), F.sum("_n").alias("group_size"))


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text: str = "text", salts: int = SALTS, digest_bits: int = 256, carry: bool = False) -> DataFrame:
    """One row per row of docs: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    digest_bits: how much of the digest groups rows; less than 256 only to test digests that collide. carry: also ``_row``,
    a structure of the row's own columns.
    """
    spark = docs.sparkSession
    own = [F.struct(*docs.columns).alias("_row")] if carry else []
    rows = docs.select(F.col(id_column).cast("long").alias("_id"), _rank(id_column, text).alias("_rank"), normalised(text).alias("_norm"), *own)
    rows = rows.withColumn("text_sha256", F.sha2(F.col("_norm").cast("binary"), 256)).withColumn("_digest", F.unhex(F.substring("text_sha256", 1, digest_bits // 4)))
    sha = F.lower(F.hex("_digest")).alias("text_sha256") if digest_bits >= 256 else F.col("text_sha256")
    found = _merged(rows, salts).groupBy("_digest").agg(F.count(F.lit(1)).alias("_texts"), F.max("_best").alias("_best"), F.sum("group_size").alias("group_size"))
    winners = materialise(found, "winners")
    known = winners.agg(F.sum("group_size").alias("rows"), F.count_if(F.col("_texts") > 1).alias("clashes")).first()
    one = winners.where("_texts = 1").drop("_texts")
    narrow = ["_id", "_rank", "_digest", *(["text_sha256"] if digest_bits < 256 else []), *(["_row"] if carry else [])]
    joined = spread_join(rows.select(*narrow), one, "_digest", "group_size", known["rows"] or 0)
    if known["clashes"]:
        clash = winners.where("_texts > 1").select("_digest")
        several = rows.join(clash, "_digest", "left_semi")
        met = several.join(_merged(several, salts), ["_digest", "_norm"]).select(*narrow, F.lit(0).alias("_copy"), "_best", "group_size")
        joined = joined.where("_best IS NOT NULL").select(met.columns).unionByName(met)
    # Repeated rows of one id: the first alone is kept.
    same = Window.partitionBy("_digest", "_copy", "_id", "_rank").orderBy("_best")
    return joined.withColumn("_k", F.row_number().over(same)).select(
        F.col("_id").alias(id_column),
        _id_of(F.col("_best")).alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        ((F.col("_rank") == F.col("_best")) & (F.col("_k") == 1)).alias("kept"),
        sha,
        *(["_row"] if carry else []),
    )


def deduplicated(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    return exact_groups(docs, id_column, text, carry=True).where("kept").select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
  FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size
  FROM d WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
