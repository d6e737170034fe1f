"""Sparse vectors as postings, and search by dot product."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def postings(vectors: DataFrame) -> DataFrame:
    """(key, dim, value) of sparse vectors (key, sparse{indices, values}); of repeated dimensions
    in one vector the last counts."""
    rows = vectors.where(F.col("sparse").isNotNull()).select("key", F.posexplode(F.arrays_zip("sparse.indices", "sparse.values")).alias("at", "x"))
    rows = rows.select("key", F.col("x.indices").alias("dim"), "at", F.col("x.values").cast("double").alias("value"))
    return rows.groupBy("key", "dim").agg(F.max_by("value", "at").alias("value"))


def dense_postings(vectors: DataFrame, least: float) -> DataFrame:
    """(key, dim, value) of the components of dense vectors with a magnitude over ``least``."""
    rows = vectors.select("key", F.posexplode("vector").alias("dim", "v")).select("key", "dim", F.col("v").cast("double").alias("value"))
    return rows.where(F.abs("value") > least)


def gathered(rows: DataFrame) -> DataFrame:
    """(key, sparse) of postings, in order of dimensions."""
    sorted_ = F.array_sort(F.collect_list(F.struct("dim", "value")))
    rows = rows.groupBy("key").agg(sorted_.alias("p"))
    return rows.select("key", F.struct(F.col("p.dim").alias("indices"), F.col("p.value").alias("values")).alias("sparse"))


def query_frame(spark: SparkSession, indices: Sequence[int], values: Sequence[float]) -> DataFrame:
    """A query's dimensions; repeated ones add up, since each is a factor of its own."""
    total: dict[int, float] = {}
    for i, v in zip(indices, values, strict=True):
        total[i] = total.get(i, 0.0) + float(v)
    return spark.createDataFrame(sorted(total.items()), "dim int, weight double")


def scores(rows: DataFrame, query: DataFrame) -> DataFrame:
    """(key, score): negated dot product of postings with a query (dim, weight), for vectors that
    share a dimension with it. A query is one vector, so it is broadcast."""
    hits = rows.join(F.broadcast(query), "dim")
    return hits.groupBy("key").agg((-F.sum(F.col("value") * F.col("weight"))).alias("score"))


def top_k(rows: DataFrame, query: DataFrame, k: int, keep: DataFrame | None = None) -> DataFrame:
    """The k vectors of least (score, key). ``keep`` (key) filters before the ranking."""
    found = scores(rows if keep is None else rows.join(keep.select("key"), "key", "left_semi"), query)
    return found.orderBy("score", "key").limit(max(k, 0))
