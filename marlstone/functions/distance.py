"""Distances of dense vectors as column expressions, in doubles over stored floats."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "euclidean", "dotproduct")


def literal(vector: Sequence[float]) -> Column:
    """A query vector as an array of doubles; its values pass through 32-bit floats, as stored
    vectors do."""
    return F.array(*[F.lit(float(x)) for x in np.asarray(vector, np.float32)]).cast("array<double>")


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(doubles(v), lambda x: x * x)))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """1 - cosine similarity; 1 where either vector is zero. Norms may be given if stored."""
    na, nb = norm(a) if norm_a is None else norm_a, norm(b) if norm_b is None else norm_b
    return F.when((na == 0) | (nb == 0), F.lit(1.0)).otherwise(1.0 - dot(a, b) / (na * nb))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))))


def dotproduct(a: Column, b: Column) -> Column:
    """The negated dot product, so that less is nearer."""
    return -dot(a, b)


def distance(metric: str, a: Column, b: Column) -> Column:
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    return {"cosine": cosine, "euclidean": euclidean, "dotproduct": dotproduct}[metric](a, b)


def to_rows(metric: str, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Distances of a query to rows, in doubles. Each is summed along its own row, so that equal rows
    are equally far wherever they stand; those of matrix() can differ in the last bits."""
    q, r = query.astype(np.float64), np.ascontiguousarray(rows, np.float64)
    if metric == "euclidean":
        return np.sqrt(((r - q) ** 2).sum(1))
    products = (r * q).sum(1)
    if metric == "dotproduct":
        return -products
    scale = np.sqrt((q * q).sum()) * np.sqrt((r * r).sum(1))
    return np.where(scale == 0, 1.0, 1.0 - products / np.where(scale == 0, 1.0, scale))


def longest(rows: np.ndarray) -> float:
    return float(np.sqrt(np.einsum("ij,ij->i", rows, rows, dtype=np.float64).max(initial=0.0)))


def slack(metric: str, query: np.ndarray, length: float) -> float:
    """Twice what a value of matrix(), for euclidean its square, can be off, and more; ``length`` is
    that of the longest row."""
    rounding = 16 * np.finfo(np.float64).eps * (len(query) + 8)
    return rounding if metric == "cosine" else rounding * (longest(query[None, :]) + length) ** 2


def matrix(metric: str, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Distances of all queries to all rows, in doubles."""
    q, r = queries.astype(np.float64), rows.astype(np.float64)
    if metric == "dotproduct":
        return -(q @ r.T)
    if metric == "euclidean":
        square = (q * q).sum(1)[:, None] + (r * r).sum(1)[None, :] - 2 * (q @ r.T)
        return np.sqrt(np.maximum(square, 0))
    if metric != "cosine":
        raise ValueError(f"unknown metric: {metric}")
    scale = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(r, axis=1)[None, :]
    return np.where(scale == 0, 1.0, 1.0 - (q @ r.T) / np.where(scale == 0, 1.0, scale))
