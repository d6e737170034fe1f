"""Mixing sources to target weights by hash-threshold histograms.

Every row gets a 128-bit hash; words are summed by source and hash bucket; the bucket in which a
source's budget ends is found by a running sum over at most 4096 buckets; only the rows of that
bucket are summed again by the next digits, and so on until no boundary bucket can be split.
A row is taken once more than its source's whole repeats when its hash lies under the threshold.
Nothing is sorted, and rows are never collected; a step moves one row a source and bucket.

Defined results: a null text has no words and takes nothing; null sources are one source, the
last; rows with the same doc_id share a hash and are taken together; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.llm.common import SPACE, forget, materialize, same

#: Hex digits of the hash that one level of the histogram resolves (16 ** 3 buckets).
DIGITS = 3
#: No row is taken more often than this, and no target is above this share of its source.
MOST = 3
#: A row counts as short when it has at most 1 / SHORT of the words still missing.
SHORT = 4
#: Weights of the sources in order of their names, repeating.
WEIGHTS = (1, 2, 3)


def word_count(text: Column) -> Column:
    """Number of words of a text; a null has none."""
    return F.coalesce(F.size(F.array_remove(F.split(text, SPACE), "")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """Adds target to (source, source_size): shares of all words by weight, where a target stops
    at ``most`` times its source's size and the excess is shared again by weight.

    Sources are taken in order of size by weight: those that stop come first, and the rest share
    what these leave. It works on one row a source."""
    everything = W.partitionBy()
    order = W.partitionBy().orderBy(F.col("_cap") / F.col("_w"), "_n")
    left = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    n = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("_n") - 1, F.lit(len(weights))) + 1).cast("int"))
    level = (F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(left)
    d = sources.withColumn("_n", n).withColumn("_w", weight).withColumn("_cap", (F.col("source_size") * most).cast("double"))
    d = d.withColumn("_all", F.sum("source_size").over(everything).cast("double")).withColumn("_level", level)
    d = d.withColumn("_stops", F.col("_cap") <= F.col("_level") * F.col("_w"))
    # The level of the first source that does not stop holds for all after it.
    d = d.withColumn("_rest", F.min(F.when(~F.col("_stops"), F.struct((F.col("_cap") / F.col("_w")).alias("r"), F.col("_n").alias("n"), F.col("_level").alias("level")))).over(everything)["level"])
    return d.select("source", "source_size", F.when(F.col("_stops"), F.col("_cap")).otherwise(F.col("_rest") * F.col("_w")).alias("target"))


def thresholds(sized: DataFrame, budgets: DataFrame, over: bool) -> DataFrame:
    """(source, threshold, rest): rows (source, size, h) with h under the threshold have about
    ``budget`` words (source, budget), ``rest`` fewer. The group of equal hashes at which the
    budget ends is left, or with ``over`` taken where that comes nearer to the budget."""
    depth = DIGITS
    state = budgets.select("source", F.col("budget").alias("left"), F.lit("").alias("prefix"), F.lit(None).cast("string").alias("threshold"))
    old = None
    while True:
        cut = F.substring("h", 1, depth)
        # Only the rows of a source's boundary bucket are summed again.
        open_ = state.where("threshold IS NULL").select(F.col("source").alias("_s"), F.col("left"), "prefix")
        inside = sized.where("size > 0").join(open_, same(sized.source, F.col("_s")) & F.col("h").startswith(F.col("prefix")))
        sums = inside.groupBy("source", "left", "prefix", cut.alias("bucket")).agg(F.sum("size").alias("words"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        up_to = F.sum("words").over(W.partitionBy("source").orderBy("bucket"))
        sums = sums.withColumn("up_to", up_to).where(F.col("up_to") > F.col("left"))
        first = sums.groupBy("source").agg(F.min(F.struct("bucket", "up_to", "words", "left", "lo", "hi")).alias("b"))
        rest = F.col("b.left") - (F.col("b.up_to") - F.col("b.words"))
        taken = F.concat(F.col("b.hi"), F.lit("~"))
        settled = F.when(F.col("b.lo") == F.col("b.hi"), F.when(F.lit(over) & (rest * 2 >= F.col("b.words")), taken).otherwise(F.col("b.lo")))
        found = first.select(F.col("source").alias("_f"), rest.alias("_rest"), F.col("b.bucket").alias("_bucket"), settled.alias("_settled"))
        joined = state.join(found, same(state.source, F.col("_f")), "left")
        state = joined.select(
            "source",
            F.coalesce("_rest", "left").alias("left"),
            F.coalesce("_bucket", "prefix").alias("prefix"),
            # A source whose budget is never exceeded takes all its rows.
            F.when(F.col("threshold").isNotNull(), F.col("threshold")).when(F.col("_bucket").isNull(), F.lit("~")).otherwise(F.col("_settled")).alias("threshold"),
        )
        state = materialize(state, "thresholds")
        if old is not None:
            forget(old)
        old = state
        if state.where("threshold IS NULL").isEmpty():
            return state.select("source", "threshold", F.col("left").alias("rest"))
        depth += DIGITS


def hashed(doc_id: Column) -> Column:
    """The 128-bit hash of a row, as 32 hex digits."""
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary"))


def decide(docs: DataFrame, weights=WEIGHTS, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """The sized rows (doc_id, source, size, h) and a row for each source (source, source_size,
    target, whole, threshold). The text is read once; later steps read the narrow table."""
    narrow = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), hashed(F.col("doc_id")).alias("h"))
    sized = materialize(narrow, "sized")
    goals = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goals = materialize(goals.withColumn("whole", F.floor(F.least(ratio, F.lit(float(most)))).cast("long")), "targets")
    budgets = goals.select("source", (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget"))
    rows = sized.select("source", "size", "h")
    marks = thresholds(rows, budgets, False).withColumnRenamed("source", "_m").withColumnsRenamed({"threshold": "_t", "rest": "_r"})
    # A second, nested budget: what the long text at the first threshold left goes to rows that
    # are short against it, so that a source misses its target by less than such a row.
    short = rows.join(marks, same(rows.source, F.col("_m"))).where((F.col("h") >= F.col("_t")) & (F.col("size") * SHORT <= F.col("_r"))).select("source", "size", "h")
    fine = thresholds(short, marks.select(F.col("_m").alias("source"), F.col("_r").alias("budget")), True)
    fine = fine.select(F.col("source").alias("_n"), F.col("threshold").alias("_u"))
    marks = marks.join(fine, same(F.col("_m"), F.col("_n")), "left")
    rule = F.struct(F.col("_t").alias("first"), F.col("_u").alias("second"), (F.col("_r") / SHORT).alias("short")).alias("threshold")
    return sized, goals.join(marks, same(goals.source, F.col("_m"))).select(goals["*"], rule)


def times(h: Column, size: Column, whole: Column, threshold: Column, most: int = MOST) -> Column:
    """How often a row is taken: its source's whole repeats, and once more under a threshold."""
    once = (h < threshold["first"]) | ((size <= threshold["short"]) & (h < threshold["second"]))
    return F.least(whole + once.cast("long"), F.lit(most).cast("long"))


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target and taken (words taken, repeats counted) of each row."""
    sized, plan = decide(docs, weights, most)
    plan = plan.withColumnRenamed("source", "_p")
    out = sized.join(plan, same(sized.source, F.col("_p")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * times(F.col("h"), F.col("size"), F.col("whole"), F.col("threshold"), most)).alias("taken"))


def repeat(docs: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """The mixed rows with the columns of docs, each as often as it is taken."""
    _, plan = decide(docs, weights, most)
    plan = plan.select(F.struct("source", "whole", "threshold").alias("__plan"))
    joined = docs.join(plan, same(docs["source"].cast("string"), F.col("__plan.source")))
    n = times(hashed(docs["doc_id"]), word_count(docs["text"]), F.col("__plan.whole"), F.col("__plan.threshold"), most)
    return joined.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), n.cast("int")))).select(*[docs[c] for c in docs.columns])
