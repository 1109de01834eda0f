"""Delimited files as they arrive: each new file is a source with its own dialect state, framed once and judged by a plan."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sluice.operators.verdicts import Typed
from sluice.plans.columns import Column, bind
from sluice.plans.dialect import Dialect
from sluice.sources.delimited import Delimited

_FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_delimited(spark: SparkSession, folder: str, plan: Sequence[Column], dialect: Dialect = Dialect(), files_per_trigger: int = 64) -> Typed:
    """A streaming read. Sources are named by ordinal, as a stream has no header to bind names to before it starts."""
    bound = bind(plan)
    files = spark.readStream.format("binaryFile").schema(_FILES).option("maxFilesPerTrigger", files_per_trigger).load(folder)
    reader = Delimited(files.select(F.col("path").alias("_source"), F.col("content").alias("_bytes")), dialect)
    reader.plan = bound
    return reader.read()


def write_stream(typed: Typed, values: str, problems: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Each batch's values and problems to two tables of Parquet files, once for each batch number."""

    def each(batch: DataFrame, number: int) -> None:
        part = Typed.__new__(Typed)
        part.plan, part.long_rows, part.frame = typed.plan, typed.long_rows, batch.persist()
        part.values("_source", "_record").write.mode("overwrite").parquet(f"{values}/batch={number}")
        part.problems().write.mode("overwrite").parquet(f"{problems}/batch={number}")
        batch.unpersist()

    return start(typed.frame, each, checkpoint, trigger)


def start(frame: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    return frame.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
