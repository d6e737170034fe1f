"""Dense nearest neighbours: exact for one query, exact for a batch, and by hashing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.functions import distance as D
from marlstone.functions.metadata import matches

#: Vectors and queries of one group of the batch join.
VECTORS, QUERIES = 50_000, 2_000
#: Queries of a group whose distances are held at once.
BLOCK = 64
#: Candidates a query considers before a filter, if it is to be applied after the ranking.
EF = 64


def scored(vectors: DataFrame, query: Sequence[float], metric: str = "cosine") -> DataFrame:
    """vectors (key, vector, ...) with score, the distance to a query; those without a vector go."""
    return vectors.where(F.col("vector").isNotNull()).withColumn("score", D.distance(metric, F.col("vector"), D.literal(query)))


def top_k(
    vectors: DataFrame,
    query: Sequence[float],
    k: int,
    metric: str = "cosine",
    condition: Mapping[str, object] | Column | None = None,
    filter_mode: str = "pre",
    ef: int = EF,
) -> DataFrame:
    """The k nearest vectors in order of (score, key). ``pre`` filters first and is exact; ``post``
    ranks max(ef, k) and then filters, so that fewer than k may come back."""
    keep = None if condition is None else condition if isinstance(condition, Column) else matches(F.col("metadata"), condition)
    if k <= 0:
        return scored(vectors, query, metric).limit(0)
    if keep is not None and filter_mode == "pre":
        vectors = vectors.where(keep)
    ranked = scored(vectors, query, metric).orderBy("score", "key")
    if keep is not None and filter_mode == "post":
        ranked = ranked.limit(max(ef, k)).where(keep).orderBy("score", "key")
    return ranked.limit(k)


def smallest(row: np.ndarray, k: int) -> np.ndarray:
    """Places of the k least values in order; equal ones stay in order of places, NaN comes last."""
    if k < len(row):
        limit = np.partition(row, k - 1)[k - 1]
        if not np.isnan(limit):
            near = np.flatnonzero(row <= limit)
            return near[np.argsort(row[near], kind="stable")[:k]]
    return np.argsort(row, kind="stable")[:k]


def within(row: np.ndarray, k: int, slack: float) -> np.ndarray:
    """Places of values up to ``slack`` above the k-th least, in order of places."""
    if k < len(row):
        limit = np.partition(row, k - 1)[k - 1] + slack
        if np.isfinite(limit):
            return np.flatnonzero(row <= limit)
    return np.arange(len(row))


def knn_join(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """(query_id, rank, key, score): the k nearest of vectors (key, vector) for every query
    (query_id, vector), exactly.

    Vectors and queries are dealt into tiles by hash; each pair of tiles is one group, whose
    distances numpy computes for BLOCK queries at a time and cuts to k a query. Only k rows a query and tile go on
    to the final ranking, so that neither side has to fit in a task or be broadcast. A matrix product finds
    the rows that may be among the k, ties and all; those are measured again one by one, so that equal
    vectors are equally far in any tile and rank by key."""
    n, m = vectors.count(), queries.count()
    tiles, blocks = max(1, -(-n // VECTORS)), max(1, -(-m // QUERIES))
    tile = lambda c, t: F.pmod(F.xxhash64(c), F.lit(t)).cast("int")
    every = lambda t: F.explode(F.sequence(F.lit(0), F.lit(t - 1)))
    left = vectors.where(F.col("vector").isNotNull()).select(tile("key", tiles).alias("tile"), every(blocks).alias("block"), "key", "vector")
    right = queries.select(every(tiles).alias("tile"), tile("query_id", blocks).alias("block"), "query_id", "vector")
    matrix, to_rows, slack, longest = D.matrix, D.to_rows, D.slack, D.longest
    key_type, id_type = vectors.schema["key"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    if k <= 0:
        return vectors.sparkSession.createDataFrame([], f"query_id {id_type}, rank int, key {key_type}, score double")

    def nearest(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or asked.empty:
            return pd.DataFrame({"query_id": asked["query_id"][:0], "key": rows["key"][:0], "score": np.zeros(0)})
        rows = rows.sort_values("key", kind="stable").reset_index(drop=True)
        keys, data = rows["key"].to_numpy(), np.stack(rows["vector"].to_numpy())
        length = longest(data)
        asked_for, ids = np.stack(asked["vector"].to_numpy()), asked["query_id"].to_numpy()
        parts = []
        for at in range(0, len(ids), BLOCK):
            found = matrix(metric, asked_for[at : at + BLOCK], data)
            for i, row in enumerate(found):
                q = asked_for[at + i]
                near = within(row * row if metric == "euclidean" else row, k, slack(metric, q, length))
                exact = to_rows(metric, q, data[near])
                best = smallest(exact, k)
                parts.append(pd.DataFrame({"query_id": np.repeat(ids[at + i], len(best)), "key": keys[near[best]], "score": exact[best]}))
        return pd.concat(parts)

    pairs = left.groupBy("tile", "block").cogroup(right.groupBy("tile", "block")).applyInPandas(nearest, f"query_id {id_type}, key {key_type}, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "key"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "key", "score")


def approximate_top_k(vectors: DataFrame, query: Sequence[float], k: int, bucket: float = 1.0, tables: int = 4) -> DataFrame:
    """About the k nearest by euclidean distance, through locality-sensitive hashing. An option for
    vectors with clusters; measure recall against top_k() before relying on it."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    rows = vectors.where(F.col("vector").isNotNull()).withColumn("features", array_to_vector("vector"))
    lsh = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=42)
    found = lsh.fit(rows).approxNearestNeighbors(rows, Vectors.dense([float(x) for x in query]), k, distCol="score")
    return found.drop("features", "hashes").orderBy("score", "key")
