"""What the text operators share: words, materialised tables, Arrow text views, components."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.rolling import BASE, SPREAD, slices

#: White space that separates words, as a regular expression for the JVM.
SPACE = r"[\x20\x09-\x0D]+"
#: The same bytes for numpy.
BLANK = re.compile(rb"[\x20\x09-\x0D]")
SPACE_BYTES = np.zeros(256, bool)
SPACE_BYTES[[0x20, *range(0x09, 0x0E)]] = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the context's, else on
    one machine a temporary one. A cluster has to name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        base = context.getCheckpointDir()
        if not base:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="marlstone-"))
            base = context.getCheckpointDir()
    return base.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table that no later plan reads."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts the lineage and
    survives the loss of executors. The path is kept in the attribute ``stored_at``."""
    path = new_path(df.sparkSession, tag)
    df.write.option("compression", codec).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def forget(*tables: DataFrame) -> None:
    for t in tables:
        remove(t.sparkSession, t.stored_at)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of steps whose tables are written: it does so once the
    driver has collected the garbage that points to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def words(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text as an array; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_views(batch: pa.RecordBatch, column: str, most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Views of a string column without copies: (first row, end row, bytes, offsets from 0),
    in slices of about ``most`` bytes and whole rows; a null has no bytes."""
    array = batch.column(column)
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if len(array) == 0:
        return
    if array.null_count:
        array = array.fill_null("")
    wide = pa.types.is_large_string(array.type)
    _, ends, data = array.buffers()
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(array):
        end = int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1
        end = min(max(end, row + 1), len(array))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in the bytes of several texts, and the first word of each text
    (one more entry at the end). A word never crosses texts."""
    inside = ~SPACE_BYTES[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = offsets[1:-1]
    edge = edge[edge < len(data)]
    begins[edge] = inside[edge]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = offsets[1:-1] - 1
    last = last[last >= 0]
    ends[last] = inside[last]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def word_hashes_of(text: bytes, most: int = 1 << 20) -> np.ndarray:
    """The hash of each word of a text, made of about ``most`` bytes at a time: pieces end at white
    space, so that only a word of that size costs more memory."""
    parts, at = [], 0
    while at < len(text):
        end = at + most
        if end < len(text):
            gap = BLANK.search(text, end)
            end = gap.start() if gap else len(text)
        data = np.frombuffer(text, np.uint8)[at:end]
        starts, ends, _ = word_bounds(data, np.array([0, len(data)]))
        parts.append(slices(SPREAD[data], starts, ends, BASE))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each linked node can reach, by alternating large-star
    and small-star steps over links (a, b) of longs. Nodes without links are absent.

    Each step is an aggregation by node (combined before the shuffle) and an equi-join that AQE
    can split on a hot node; only two numbers a round reach the driver."""
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    seen = None
    for _ in range(rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        # Every larger neighbour of a node is tied to the node's smallest neighbour.
        large = both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        joined = large.join(least, F.col("u") == F.col("k"))
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        small = materialize(small, "small")
        now = small.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        forget(edges, large)
        edges = small
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").union(roots.select(F.col("root").alias("node"), "root").distinct())


def same(a: Column, b: Column) -> Column:
    """Equality that holds between nulls too."""
    return a.eqNullSafe(b)


LONG, STRING, INT, BINARY, BOOLEAN, DOUBLE = T.LongType(), T.StringType(), T.IntegerType(), T.BinaryType(), T.BooleanType(), T.DoubleType()


def schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])
