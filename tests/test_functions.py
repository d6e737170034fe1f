"""Column functions: values that do not depend on tables."""

import json
import math
import zlib

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.functions import distance as D
from marlstone.functions import objects as O
from marlstone.functions.metadata import is_operators, matches


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def vec(*x):
    return F.array(*[F.lit(float(v)) for v in x])


def test_distances(spark):
    for expression, want in [
        (D.norm(vec(3, 4)), 5),
        (D.cosine(vec(1, 0), vec(-1, 0)), 2),
        (D.cosine(vec(1, 0), vec(0, 1)), 1),
        (D.cosine(vec(0, 0), vec(0, 1)), 1),
        (D.cosine(vec(3, 4), vec(4, 3)), 1 - 24 / 25),
        (D.euclidean(vec(0, 0), vec(3, 4)), 5),
        (D.dotproduct(vec(2, 3), vec(4, 5)), -23),
    ]:
        assert value(spark, expression) == pytest.approx(want)


def test_matrix_agrees_with_columns(spark):
    r = np.random.default_rng(1)
    a, b = r.normal(size=(3, 5)), r.normal(size=(4, 5))
    b[2] = 0
    for metric in D.METRICS:
        m = D.matrix(metric, a, b)
        for i in range(3):
            for j in range(4):
                assert m[i, j] == pytest.approx(value(spark, D.distance(metric, vec(*a[i]), vec(*b[j]))), abs=1e-9)
    with pytest.raises(ValueError):
        D.distance("manhattan", vec(1), vec(1))


@pytest.mark.parametrize(
    ("key", "want"),
    [("a.html", "text/html"), ("archive.tar.gz", "application/gzip"), ("FILE.PNG", "image/png"), ("noext", "application/octet-stream"), (".gitignore", "application/octet-stream"), ("x.", "application/octet-stream"), ("a.json", "application/json"), ("a.b/c", "application/octet-stream")],
)
def test_types(spark, key, want):
    assert value(spark, O.guess_type(F.lit(key))) == want
    assert value(spark, O.content_type(F.lit("a/b"), F.lit(key))) == "a/b"


@pytest.mark.parametrize(("data", "start", "end", "want"), [(b"hello world", 0, 5, b"hello"), (b"abc", 0, 100, b"abc"), (b"abc", 0, 0, b""), (b"abc", 2, 1, b""), (b"abc", 5, 9, b""), (b"abc", 1, None, b"bc"), (b"", 0, 4, b""), (bytes(range(256)), 250, 300, bytes(range(250, 256)))])
def test_ranges(spark, data, start, end, want):
    assert bytes(value(spark, O.byte_range(F.lit(data), start, end))) == want


@pytest.mark.parametrize(
    ("header", "want"),
    [("bytes=0-4", (206, 0, 5)), ("bytes=5-", (206, 5, 11)), ("bytes=100-200", (416, None, None)), ("bytes=0-999", (206, 0, 11)), ("bytes=-5", (200, 0, 11)), ("bytes=5-2", (416, None, None)), ("nonsense", (200, 0, 11)), (None, (200, 0, 11))],
)
def test_http_ranges(spark, header, want):
    assert tuple(value(spark, O.http_range(F.lit(header).cast("string"), F.lit(11)))) == want


def test_tags_and_checksums(spark):
    assert value(spark, O.etag(F.lit(b"hello"))) == '"5d41402abc4b2a76b9719d911017c592"'
    assert value(spark, F.crc32(F.lit(b"123456789"))) == 0xCBF43926 == zlib.crc32(b"123456789")


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=st.binary(max_size=60), chunk=st.integers(1, 20))
def test_chunks_round_trip(spark, data, chunk):
    rows = spark.createDataFrame([(bytearray(data),)], "data binary").select(F.explode(O.chunks(F.col("data"), chunk)).alias("c")).select("c.*")
    back = rows.agg(O.concat_chunks(F.col("no"), F.col("bytes")).alias("d")).first().d
    assert bytes(back) == data and rows.count() == math.ceil(len(data) / chunk)


@pytest.mark.parametrize(("seconds", "want"), [(0.05, 1050), (3600.0, 3_601_000), (None, None), (0.0, None), (-1.0, 0)])
def test_deadlines(spark, seconds, want):
    assert value(spark, O.expires_at(1000, F.lit(seconds).cast("double"))) == want


def test_expiry_is_strict(spark):
    assert [value(spark, O.live(F.lit(x).cast("long"), 1000)) for x in (999, 1000, 1001, None)] == [False, True, True, True]


CASES = [
    ({"x": 5}, {"x": 5}, True),
    ({"x": 5}, {"x": {"$ne": 5}}, False),
    ({"x": 5}, {"x": 5.0}, True),
    ({"x": 1.5}, {"x": 1.5}, True),
    ({"x": "5"}, {"x": 5}, False),
    ({"x": 5}, {"x": "5"}, False),
    ({"x": True}, {"x": 1}, False),
    ({"x": 1}, {"x": True}, False),
    ({"x": True}, {"x": True}, True),
    ({"x": None}, {"x": None}, True),
    ({}, {"x": None}, False),
    ({"year": 2000}, {"year": {"$gte": 1990, "$lt": 2010}}, True),
    ({"year": 2010}, {"year": {"$gte": 1990, "$lt": 2010}}, False),
    ({"x": "hello"}, {"x": {"$gt": 5}}, False),
    ({}, {"x": {"$gt": 5}}, False),
    ({}, {"x": {"$ne": 5}}, True),
    ({}, {"x": {"$nin": [5]}}, True),
    ({"x": 5}, {"x": {"$nin": []}}, True),
    ({"x": 5}, {"x": {"$in": []}}, False),
    ({"x": 5}, {"x": {"$in": [4, "5", 5]}}, True),
    ({"x": "a"}, {"x": {"$in": ["a"]}, "y": {"$ne": 1}}, True),
    ({"x": 5}, {}, True),
    (None, {}, False),
    (None, {"x": {"$ne": 1}}, False),
    ({"x": {}}, {"x": {}}, False),
    ({"x": {"k": 1}}, {"x": {"other": 1}}, False),
    ({"a.b": 1}, {"a.b": 1}, True),
    ({"a": {"b": 1}}, {"a.b": 1}, False),
    ({"x": [5]}, {"x": 5}, False),
    ({"x": 10**30}, {"x": {"$gt": 10**29}}, True),
]


def test_filters(spark):
    rows = [(i, None if m is None else json.dumps(m)) for i, (m, _, _) in enumerate(CASES)]
    d = spark.createDataFrame(rows, "i int, m string").withColumn("m", F.parse_json("m"))
    for i, (m, condition, want) in enumerate(CASES):
        got = d.where(F.col("i") == i).select(matches(F.col("m"), condition).alias("v")).first().v
        assert got is want, (m, condition)


def test_operator_objects():
    assert is_operators({"$gt": 1}) and not is_operators({}) and not is_operators({"$gt": 1, "x": 2}) and not is_operators([1])
