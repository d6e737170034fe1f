"""Ingestion of change records as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def follow(spark: SparkSession, source: str, kind: T.StructType, log: str, checkpoint: str, on_batch: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Appends Parquet change files that appear under ``source`` to the log at ``log`` and ends
    when none is left (run it again for more, or on a schedule).

    A batch is written under its number, so that one that is repeated after a failure replaces
    itself; replay (plans.changelog) is a plan over all batches at read time."""

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{log}/batch={number:012d}")
        if on_batch is not None:
            on_batch(rows, number)

    stream = spark.readStream.schema(kind).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def log(spark: SparkSession, kind: T.StructType, path: str) -> DataFrame:
    """The records of all batches."""
    return spark.read.schema(kind).option("basePath", path).parquet(path).select(*kind.names)
