"""A corpus pipeline: toxic texts go, exact copies go, near copies go, sources are mixed, the rest is packed.

Each stage takes the rows that the one before kept and returns the columns of ``documents``; the last returns a row for
each piece of a packed sequence. Further columns stay with their rows, whatever they are called.

Defined cases, stage by stage: a null text counts as an empty one everywhere. It is not toxic; all null, empty and blank
texts are one group of exact copies, of which the smallest id stays; it links with nothing; it has no words, so mixing takes
it; it is packed as its end id alone. Rows without an id stay in the first three stages unless their text says otherwise,
and are drawn together in mixing. Repeated rows: one of them stays after exact dedup. Ties: the smallest id stays. An empty
table gives no rows at any stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import exact_dedup, mixing, packing, toxicity, trie_join
from sluice.llm.common import materialise


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier doesn't reject."""
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row that stays."""
    return exact_dedup.deduplicated(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one with the smallest doc_id; rows without an id stay."""
    return trie_join.representatives(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture to target weights takes."""
    return mixing.sampled(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a sequence."""
    return packing.best_fit(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", not_toxic),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("mixing", mixture),
    ("packing", packed),
]

#: The first stage learns a classifier, the last uses a tokenizer; neither is SQL. tests/llm holds a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"pipeline-{name}")
    return docs
