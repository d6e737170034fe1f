"""Schemas of stored tables."""

from pyspark.sql import types as T

SPARSE = T.StructType([T.StructField("indices", T.ArrayType(T.IntegerType())), T.StructField("values", T.ArrayType(T.DoubleType()))])

#: Log of objects: one row a put, delete, or transaction mark.
OBJECT_LOG = T.StructType(
    [
        T.StructField("seq", T.LongType(), False),
        T.StructField("txn_id", T.LongType()),
        T.StructField("op", T.StringType(), False),
        T.StructField("bucket", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("data", T.BinaryType()),
        T.StructField("size", T.LongType()),
        T.StructField("etag", T.StringType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("content_disposition", T.StringType()),
        T.StructField("last_modified", T.LongType()),
        T.StructField("expires_at_ms", T.LongType()),
        T.StructField("crc", T.LongType()),
    ]
)

#: Log of vectors. metadata is JSON text; null is no metadata, which is not {}.
VECTOR_LOG = T.StructType(
    [
        T.StructField("seq", T.LongType(), False),
        T.StructField("txn_id", T.LongType()),
        T.StructField("op", T.StringType(), False),
        T.StructField("index_name", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("vector", T.ArrayType(T.FloatType())),
        T.StructField("norm", T.DoubleType()),
        T.StructField("sparse", SPARSE),
        T.StructField("metadata", T.StringType()),
    ]
)
