"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Benchmark items are short and documents long, so a sketch of a document would hardly hold anything
of an item. The sketch is the item's: its shingles' least hashes (bottom-k MinHash). A contaminated
document holds need = ceil(THRESHOLD n) of an item's n shingles at least, so it holds one at least
of any n - need + 1 of them. Items are partitioned by size, by powers of two, and the items of a
partition have sketches of as many minima as its largest size asks for: none is missed. Documents
look up their own hashes in the sketches, only those up to the largest minimum that any has. What
they meet is a candidate pair, and for candidate pairs alone the shingles themselves (their words,
not hashes) are intersected and counted.

Defined results: null and empty texts have no shingles and no pairs; texts of one to four words
are one shingle; rows with the same doc_id count as one document, and of the same item_id as one
item; a null doc_id or item_id has no pairs; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import forget, materialize, same, words

#: Words of a shingle, and the share of an item's shingles that makes a document contaminated.
WIDTH, THRESHOLD = 5, 0.8
#: Rows of sketches (16 bytes each) up to which they are broadcast; above, Spark shuffles.
BROADCAST_ROWS = 1_000_000


def needed(n: Column, threshold: float) -> Column:
    """Of n shingles of an item, how many a contaminated document has at least."""
    return F.greatest(F.ceil(n * threshold - 1e-9), F.lit(1)).cast("int")


def starts(w: Column) -> Column:
    return F.sequence(F.lit(1), F.greatest(F.size(w) - (WIDTH - 1), F.lit(1)))


def shingled(df: DataFrame, key: str) -> DataFrame:
    """(key, w): the words of each row that has any."""
    return df.where(F.col(key).isNotNull()).select(F.col(key), words(F.lower("text")).alias("w")).where(F.size("w") > 0)


def shingles(w: Column) -> Column:
    """The distinct shingles of a text's words."""
    return F.array_distinct(F.transform(starts(w), lambda i: F.array_join(F.slice(w, i, WIDTH), " ")))


def hashes(w: Column) -> Column:
    """The hash of each shingle."""
    return F.transform(starts(w), lambda i: F.xxhash64(F.slice(w, i, WIDTH)))


def sketches(items: DataFrame, threshold: float) -> DataFrame:
    """(item_id, h): the minima of each item, from its distinct shingles (item_id, s, h)."""
    sized = items.groupBy("item_id").agg(F.count("*").cast("int").alias("n"), F.sort_array(F.collect_list("h")).alias("h"))
    largest = F.pow(F.lit(2.0), F.floor(F.log2(F.col("n").cast("double"))) + 1).cast("int") - 1
    return sized.select("item_id", F.explode(F.slice("h", F.lit(1), largest - needed(largest, threshold) + 1)).alias("h"))


def candidates(docs: DataFrame, sketch: DataFrame) -> DataFrame:
    """(doc_id, item_id) of documents that hold a minimum of an item's sketch."""
    most, n = sketch.agg(F.max("h"), F.count("*")).first()
    h = F.filter(hashes(F.col("w")), lambda x: x <= F.lit(most).cast("long"))
    rows = shingled(docs, "doc_id").select("doc_id", F.explode(h).alias("x"))
    small = F.broadcast(sketch) if n <= BROADCAST_ROWS else sketch
    return rows.join(small, F.col("x") == F.col("h")).select("doc_id", "item_id").distinct()


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (doc_id, item_id, n_item, n_shared, containment) of documents that hold the
    threshold's share of an item's distinct shingles."""
    w = F.col("w")
    both = F.transform(starts(w), lambda i: F.struct(F.array_join(F.slice(w, i, WIDTH), " ").alias("s"), F.xxhash64(F.slice(w, i, WIDTH)).alias("h")))
    bench = materialize(shingled(items, "item_id").select("item_id", F.explode(both).alias("x")).select("item_id", "x.*").distinct(), "items")
    sketch = materialize(sketches(bench, threshold), "sketches")
    found = materialize(candidates(docs, sketch), "candidates")
    forget(sketch)
    # Exact containment, for candidate pairs only.
    whole = bench.groupBy(F.col("item_id").alias("i")).agg(F.collect_list("s").alias("item"))
    texts = shingled(docs.select(F.col("doc_id").alias("d"), "text"), "d")
    pairs = texts.join(found, F.col("d") == F.col("doc_id")).select("doc_id", "item_id", "w")
    pairs = pairs.join(whole, F.col("item_id") == F.col("i"))
    shared = pairs.select("doc_id", "item_id", F.size("item").alias("n_item"), F.array_intersect("item", shingles(w)).alias("s"))
    counted = shared.select("doc_id", "item_id", "n_item", F.explode("s").alias("s")).groupBy("doc_id", "item_id", "n_item").agg(F.countDistinct("s").alias("n_shared"))
    counted = counted.where(F.col("n_shared") >= needed(F.col("n_item"), threshold))
    return counted.select("doc_id", "item_id", F.col("n_item").cast("long").alias("n_item"), "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that hold no item, with their columns."""
    bad = leaks(docs, items, threshold).select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(bad, same(docs["doc_id"], F.col("__bad")), "left_anti")
