"""Listing of keys in order, by prefix and delimiter, in pages."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Items of a page when a caller names none.
MAX_KEYS = 1000


def eligible(objects: DataFrame, prefix: str = "", start_after: str | None = None) -> DataFrame:
    """The rows whose key has the prefix and lies after ``start_after``; both reach the scan."""
    out = objects.where(F.col("key").startswith(prefix)) if prefix else objects
    return out.where(F.col("key") > start_after) if start_after else out


def items(objects: DataFrame, prefix: str = "", delimiter: str | None = None, start_after: str | None = None) -> DataFrame:
    """(item, is_prefix, n_keys, last_key): keys, and common prefixes up to the first delimiter
    after the prefix, each once. Keys of one common prefix are neighbours in order of keys, so the
    order of items is that of their first keys."""
    rows = eligible(objects, prefix, start_after)
    if not delimiter:
        return rows.select(F.col("key").alias("item"), F.lit(False).alias("is_prefix"), F.lit(1).cast("long").alias("n_keys"), F.col("key").alias("last_key"))
    rest = F.col("key").substr(F.lit(len(prefix) + 1), F.length("key"))
    at = F.instr(rest, delimiter)
    item = F.when(at > 0, F.concat(F.lit(prefix), rest.substr(F.lit(1), at + (len(delimiter) - 1)))).otherwise(F.col("key"))
    rows = rows.select(item.alias("item"), (at > 0).alias("is_prefix"), "key")
    return rows.groupBy("item", "is_prefix").agg(F.count("*").alias("n_keys"), F.max("key").alias("last_key"))


@dataclass
class Page:
    """One page of a listing. Empty lists are None; key_count leaves common prefixes out."""

    contents: list[dict] | None
    common_prefixes: list[str] | None
    is_truncated: bool
    key_count: int
    max_keys: int
    next_continuation_token: str | None = None
    name: str | None = None
    prefix: str | None = None
    delimiter: str | None = None
    continuation_token: str | None = None
    start_after: str | None = None
    ignored: dict = field(default_factory=dict)


def page_rows(objects: DataFrame, prefix: str = "", delimiter: str | None = None, start_after: str | None = None, max_keys: int = MAX_KEYS) -> DataFrame:
    """(ordinal, item, is_prefix, n_keys, last_key, is_truncated) of a page. It is truncated when a
    key is left after the page is full, even one under a common prefix that is on it."""
    top = items(objects, prefix, delimiter, start_after).orderBy("item", "is_prefix").limit(max_keys + 1)
    rows = top.withColumn("ordinal", F.row_number().over(W.orderBy("item", "is_prefix")))
    more = F.max(F.when(F.col("ordinal") > max_keys, True).when(F.col("ordinal") == max_keys, F.col("n_keys") > 1).otherwise(False)).over(W.partitionBy())
    return rows.withColumn("is_truncated", more).where(F.col("ordinal") <= max_keys).select("ordinal", "item", "is_prefix", "n_keys", "last_key", "is_truncated")


def list_page(
    objects: DataFrame,
    prefix: str | None = None,
    delimiter: str | None = None,
    max_keys: int | None = None,
    start_after: str | None = None,
    continuation_token: str | None = None,
    name: str | None = None,
    token_of_contents: bool = False,
    **ignored,
) -> Page:
    """A page of live objects (key, size, etag, last_modified). A continuation token overrides
    start_after. The next token is the last key consumed, so that pages never repeat a common
    prefix; ``token_of_contents`` takes the last listed key instead."""
    most = MAX_KEYS if max_keys is None else max_keys
    after = continuation_token or start_after
    said = dict(max_keys=most, name=name, prefix=prefix or None, delimiter=delimiter, continuation_token=continuation_token, start_after=start_after, ignored=ignored)
    if most <= 0:
        return Page(None, None, not eligible(objects, prefix or "", after).isEmpty(), 0, **said)
    rows = page_rows(objects, prefix or "", delimiter, after, most).orderBy("ordinal").collect()
    keys = [r.item for r in rows if not r.is_prefix]
    found = {}
    if keys:
        spark = objects.sparkSession
        wanted = F.broadcast(spark.createDataFrame([(k,) for k in keys], "key string"))
        found = {r["key"]: r for r in objects.join(wanted, "key", "left_semi").select("key", "size", "etag", "last_modified").collect()}
    contents = [{"key": k, "etag": found[k].etag, "last_modified": found[k].last_modified, "size": found[k]["size"]} for k in keys]
    prefixes = sorted(r.item for r in rows if r.is_prefix)
    truncated = bool(rows) and bool(rows[0].is_truncated)
    token = None
    if truncated:
        token = (keys[-1] if keys else None) if token_of_contents else max(r.last_key for r in rows)
    return Page(contents or None, prefixes or None, truncated, len(contents), next_continuation_token=token, **said)


def key_page(vectors: DataFrame, prefix: str | None = None, start_after: str | None = None, max_keys: int | None = None) -> tuple[list[str], bool, str | None]:
    """Keys of vectors in order, whether more follow, and the key to go on after. An empty
    start_after counts here: it leaves out the empty key."""
    most = MAX_KEYS if max_keys is None else max_keys
    rows = vectors.where(F.col("key").startswith(prefix)) if prefix else vectors
    rows = rows if start_after is None else rows.where(F.col("key") > start_after)
    keys = [r[0] for r in rows.select("key").orderBy("key").limit(most + 1).collect()]
    truncated = len(keys) > most
    keys = keys[:most]
    return keys, truncated, keys[-1] if truncated and keys else None
