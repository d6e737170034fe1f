"""Fusion of dense and sparse rankings by reciprocal ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Added to a rank before its reciprocal is taken.
FUSION_K = 60


def ranked(rows: DataFrame, name: str) -> DataFrame:
    """(key, name): the rank of at most a few rows (key, score) from 1."""
    return rows.select("key", F.row_number().over(W.orderBy("score", "key")).alias(name))


def fuse(dense: DataFrame, sparse: DataFrame, k: int, fusion_k: float = FUSION_K) -> DataFrame:
    """The k keys of least score, the negated sum of 1 / (fusion_k + rank) over both rankings.

    ``dense`` holds the best 2 k by distance and ``sparse`` the best 2 k at least. If dense has
    fewer than k, only the best k of sparse take part. Equal scores go by dense rank, then by
    sparse rank. Both are top-k results, so the windows see a few rows."""
    d = ranked(dense, "dense_rank").where(F.col("dense_rank") <= 2 * k)
    short = d.agg((F.count("*") < k).alias("short"))
    s = ranked(sparse, "sparse_rank").join(F.broadcast(short)).where(F.col("sparse_rank") <= F.when(F.col("short"), k).otherwise(2 * k)).drop("short")
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(float(fusion_k)) + F.col(c)), F.lit(0.0))
    both = d.join(s, "key", "full_outer").select("key", (-(part("dense_rank") + part("sparse_rank"))).alias("score"), "dense_rank", "sparse_rank")
    return both.orderBy("score", F.col("dense_rank").asc_nulls_last(), F.col("sparse_rank").asc_nulls_last()).limit(max(k, 0))
