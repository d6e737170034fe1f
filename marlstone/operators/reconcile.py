"""What vectors lack an object, and what objects lack a vector."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Mapper = Callable[[Column], Column]


def identity(key: Column) -> Column:
    return key


def orphaned_vectors(vectors: DataFrame, objects: DataFrame, mapper: Mapper = identity, prefix: str = "") -> DataFrame:
    """(key) of vectors whose mapped key is no object's; the prefix narrows the objects only."""
    there = objects.where(F.col("key").startswith(prefix)) if prefix else objects
    there = there.select(F.col("key").alias("_object")).distinct()
    return vectors.select("key").distinct().join(there, mapper(F.col("key")) == F.col("_object"), "left_anti")


def orphaned_objects(vectors: DataFrame, objects: DataFrame, mapper: Mapper = identity, prefix: str = "") -> DataFrame:
    """(key) of objects that no vector's mapped key names."""
    rows = objects.where(F.col("key").startswith(prefix)) if prefix else objects
    named = vectors.select(mapper(F.col("key")).alias("_named")).distinct()
    return rows.select("key").distinct().join(named, F.col("key") == F.col("_named"), "left_anti")
