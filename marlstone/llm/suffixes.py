"""Suffix-array deduplication by a depth-limited most-significant-digit radix sort.

A suffix is a start in a text's tokens - its bytes, or its words - ordered only through its first
tokens up to the threshold: its window. A digit is the name (64-bit hash) of a stretch of the
window's text; passes refine groups of suffixes by one digit after the other and go on only with
groups of two or more:

1. The first digit names the window's anchor: of its strings of ANCHOR tokens, the one with the
   least hash, the leftmost of equal ones. Neighbouring starts share anchors, so one row stands for
   a run of suffixes. Anchors found once are dropped with all their suffixes.
2. The second digit names all the text that a run covers. Runs with equal text are groups of equal
   windows, one for each of their starts. Only one row for each distinct text goes on.
3. The last digit names the window itself, for the runs that share an anchor but not the text.

Equal groups that remain are exactly the repeated windows (two digits of 64 bits decide). Every pass
is an aggregation by the digit, combined before the shuffle, so copies of a passage in a third of
all rows cost one row a task; the joins that mark rows are equi-joins that AQE splits on hot keys.
What is found travels as ranges of starts and as masks of 64 starts.

Windows of DEPTH bytes say which bytes go. Windows of WORDS words that start in two documents say
how many words lie in passages that documents share (n_shared_words), and how many a policy that
keeps the first document's would remove (n_later_words).

Defined results: a null text is empty; texts shorter than a window lose nothing; repeated rows
are copies of each other and both lose what they share, but are one document where documents are
counted; a null doc_id counts as one document, the largest; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import LONG, STRING, forget, materialize, release, schema, word_hashes_of
from marlstone.llm.rolling import BASE, SPREAD, WORD_BASE, sliding_least, slices, windows

#: Bytes of a window, and of an anchor in it; words of a window, and of an anchor in it.
DEPTH, ANCHOR = 400, 256
WORDS, WORD_ANCHOR = 50, 20
#: Starts of a text that are held in memory at a time.
SEGMENT = 1 << 20
PLACE = np.uint64(24)
#: The id of documents without one.
NONE = np.iinfo(np.int64).max


class Bytes:
    """The tokens of a text are its bytes."""

    base = BASE

    def __init__(self, text: bytes):
        self.text = text
        self.data = np.frombuffer(text, np.uint8)

    def __len__(self) -> int:
        return len(self.data)

    def values(self, a: int, b: int) -> np.ndarray:
        return SPREAD[self.data[a:b]]

    def names(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The names of stretches of the text."""
        found = [xxhash.xxh3_64_intdigest(self.text[x:y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        return np.array(found, np.uint64)


class Words:
    """The tokens of a text are its words, each by its hash."""

    base = WORD_BASE

    def __init__(self, text: bytes):
        self.hashes = word_hashes_of(text)

    def __len__(self) -> int:
        return len(self.hashes)

    def values(self, a: int, b: int) -> np.ndarray:
        return self.hashes[a:b]

    def names(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low = int(a[0])
        return slices(self.hashes[low : int(b[-1])], a - low, b - low, BASE)


def runs(tokens, depth: int, anchor: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Anchor's name, first and last start of each run of suffixes that share an anchor."""
    for at in range(0, len(tokens) - depth + 1, SEGMENT):
        h = windows(tokens.values(at, at + SEGMENT + depth - 1), anchor, tokens.base)
        # A hash's upper bits with its place below them: the least is the leftmost of equals.
        least = sliding_least((h >> PLACE << PLACE) | np.arange(len(h), dtype=np.uint64), depth - anchor + 1)
        place = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
        change = np.flatnonzero(np.diff(place)) + 1
        first = np.concatenate([[0], change])
        last = np.concatenate([change - 1, [len(place) - 1]])
        yield h[place[first]], first + at, last + at


RUNS = schema(key=LONG, covers=LONG, doc=LONG, rid=LONG, lo=LONG, hi=LONG)


def to_runs(kind, depth: int, anchor: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in RUNS.names]
            rows = 0
            for doc, rid, text in zip(batch.column("doc").to_numpy(), batch.column("rid").to_numpy(), batch.column("text").to_pylist(), strict=True):
                if text is None or len(text) < depth:
                    continue
                tokens = kind(text)
                for key, first, last in runs(tokens, depth, anchor):
                    covers = tokens.names(first, last + depth)
                    n = len(key)
                    for o, x in zip(out, (key.view(np.int64), covers.view(np.int64), np.full(n, doc), np.full(n, rid), first, last), strict=True):
                        o.append(x)
                    rows += n
                if rows >= 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], names=RUNS.names)
                    out, rows = [[] for _ in RUNS.names], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], names=RUNS.names)

    return scan


SUFFIXES = schema(key=LONG, window=LONG, doc=LONG, far=LONG, rid=LONG, start=LONG)


def to_suffixes(kind, depth: int):
    """Rows (doc, rid, text, keys, los, his, fars) become one row a start, with its window's name."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tokens = kind(row["text"])
                order = np.argsort(np.array(row["los"], np.int64), kind="stable")
                keys, los, his, fars = (np.array(row[c], np.int64)[order] for c in ("keys", "los", "his", "fars"))
                # Stretches of starts that lie together are hashed together, a segment at a time.
                cut = np.flatnonzero((np.diff(los) > SEGMENT // 16) | (np.diff(los // SEGMENT) > 0)) + 1
                for part in np.split(np.arange(len(los)), cut):
                    a, b = los[part[0]], his[part].max()
                    h = windows(tokens.values(a, b + depth), depth, tokens.base)
                    n = his[part] - los[part] + 1
                    starts = np.repeat(los[part] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                    columns = (np.repeat(keys[part], n), h[starts - a].view(np.int64), np.full(len(starts), row["doc"]), np.repeat(fars[part], n), np.full(len(starts), row["rid"]), starts)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=SUFFIXES.names)

    return scan


def masked(rows: DataFrame, *names: tuple[str, Column]) -> DataFrame:
    """(rid, part, a mask for each name) of rows (rid, start): the starts of 64, one bit each."""
    bit = F.expr("shiftleft(1L, cast(pmod(start, 64) as int))")
    masks = [F.bit_or(F.when(which, bit).otherwise(F.lit(0).cast("long"))).alias(name) for name, which in names]
    return rows.groupBy("rid", F.floor(F.col("start") / 64).alias("part")).agg(*masks)


def repeated_starts(texts: DataFrame, kind=Bytes, depth: int = DEPTH, anchor: int = ANCHOR) -> tuple[DataFrame, DataFrame]:
    """Of texts (doc, rid, text as bytes), the starts whose windows start elsewhere too: ranges
    (rid, lo, hi, later) and masks of single ones (rid, part, any, later). With Words, elsewhere is
    another document, and ``later`` marks those that also start in one with a smaller id."""
    spark = texts.sparkSession
    across = kind is Words
    all_runs = texts.select("doc", "rid", "text").mapInArrow(to_runs(kind, depth, anchor), RUNS)
    all_runs = materialize(all_runs if across else all_runs.drop("doc"), "runs")
    if across:
        several_of = lambda first, last: F.col(first) < F.col(last)
        span = [F.min("doc").alias("first"), F.max("doc").alias("last")]
        found = several_of("first", "last")
    else:
        span, found = [F.count("*").alias("n")], F.col("n") > 1
    on = F.col("key") == F.col("k")
    # First digit.
    anchors = all_runs.groupBy("key").agg(*span, F.min("covers").alias("a"), F.max("covers").alias("b"))
    anchors = materialize(anchors.where(found).select(F.col("key").alias("k"), (F.col("a") != F.col("b")).alias("splits")), "anchors")
    several = materialize(all_runs.join(anchors, on).drop("k"), "several")
    forget(all_runs, anchors)
    release(spark)
    # Second digit.
    one = [] if across else [F.min(F.struct("rid", "lo", "hi")).alias("one")]
    covers = materialize(several.groupBy("key", "covers", "splits").agg(*span, *one), "covers")
    if across:
        equal = covers.where(found | F.col("splits")).select(F.col("key").alias("k"), F.col("covers").alias("c"), "first", "last")
        marked = several.join(equal, on & (F.col("covers") == F.col("c")))
        marked = materialize(marked.select("key", "splits", "doc", "rid", "lo", "hi", "first", "last"), "marked")
        whole = marked.where(found).select("rid", "lo", "hi", (F.col("doc") > F.col("first")).alias("later"))
        # Last digit: the rows of each distinct text's first document under a shared anchor; all
        # windows of the other documents are later ones already.
        left = marked.where(F.col("splits") & (F.col("doc") == F.col("first"))).select("key", "rid", "lo", "hi", "last")
    else:
        equal = covers.where(found).select(F.col("key").alias("k"), F.col("covers").alias("c"))
        whole = materialize(several.join(equal, on & (F.col("covers") == F.col("c"))).select("rid", "lo", "hi", F.lit(False).alias("later")), "whole")
        # Last digit: starts of one run for each distinct text under a shared anchor.
        left = covers.where("splits").select("key", "one.*", F.lit(0).cast("long").alias("last"))
    if not across:
        forget(several)
        release(spark)
    left = left.groupBy("rid").agg(*[F.collect_list(c).alias(d) for c, d in (("key", "keys"), ("lo", "los"), ("hi", "his"), ("last", "fars"))])
    left = left.withColumnRenamed("rid", "r")
    once = texts.select("doc", "rid", "text").join(left, F.col("rid") == F.col("r")).drop("r").dropDuplicates(["rid"])
    suffixes = once.mapInArrow(to_suffixes(kind, depth), SUFFIXES)
    suffixes = materialize(suffixes if across else suffixes.drop("doc", "far"), "suffixes")
    if across:
        forget(several)
    release(spark)
    span = [F.min("doc").alias("first"), F.max("far").alias("last")] if across else [F.count("*").alias("n")]
    twice = suffixes.groupBy("key", "window").agg(*span).where(found).select(F.col("key").alias("k"), F.col("window").alias("w"), *(["first"] if across else []))
    single = suffixes.join(twice, on & (F.col("window") == F.col("w")))
    later = F.col("doc") > F.col("first") if across else F.lit(False)
    single = materialize(masked(single, ("any", F.lit(True)), ("later", later)), "single")
    forget(suffixes, covers)
    release(spark)
    return whole, single


def spans(ranges: list[tuple[int, int]], depth: int) -> list[tuple[int, int]]:
    """Maximal runs of tokens that lie in a window, for first and last starts of windows."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b + depth))
        else:
            out.append((a, b + depth))
    return out


def ranges_of(parts: list[int], masks: list[int]) -> list[tuple[int, int]]:
    """Ranges of starts whose bits are set."""
    if not parts:
        return []
    bits = np.unpackbits(np.array(masks, "<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, bit = np.nonzero(bits)
    starts = np.sort(np.array(parts, np.int64)[row] * 64 + bit)
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1) + 1
    return list(zip(starts[np.concatenate([[0], cut])].tolist(), starts[np.concatenate([cut - 1, [len(starts) - 1]])].tolist(), strict=True))


RESULT = schema(doc_id=LONG, n_bytes=LONG, n_removed=LONG, n_spans=LONG, kept_sha256=STRING, n_shared_words=LONG, n_later_words=LONG)


def cut(depth: int, words: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                text, digest, at, removed = r["text"] or b"", hashlib.sha256(), 0, 0
                found = spans([(x["lo"], x["hi"]) for x in r["b_ranges"] or []] + ranges_of(*columns(r["b_masks"], "part", "any")), depth)
                for a, b in found:
                    digest.update(text[at:a])
                    at, removed = b, removed + b - a
                digest.update(text[at:])
                ranges, masks = r["w_ranges"] or [], r["w_masks"]
                shared = spans([(x["lo"], x["hi"]) for x in ranges] + ranges_of(*columns(masks, "part", "any")), words)
                later = spans([(x["lo"], x["hi"]) for x in ranges if x["later"]] + ranges_of(*columns(masks, "part", "later")), words)
                rows.append((r["doc_id"], len(text), removed, len(found), digest.hexdigest(), sum(b - a for a, b in shared), sum(b - a for a, b in later)))
            kinds = [pa.int64()] * 4 + [pa.string()] + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], names=RESULT.names)

    return scan


def columns(rows: list[dict] | None, *names: str) -> list[list[int]]:
    return [[r[n] for r in rows or []] for n in names]


def by_rid(whole: DataFrame, single: DataFrame, tag: str) -> DataFrame:
    """What was found of a text in one row: ranges and masks."""
    ranges = whole.select(F.col("rid").alias(f"{tag}_r"), F.struct("lo", "hi", "later").alias("x"), F.lit(None).cast(single.select(F.struct("part", "any", "later")).schema[0].dataType).alias("y"))
    masks = single.select(F.col("rid"), F.lit(None).cast(ranges.schema["x"].dataType), F.struct("part", "any", "later"))
    return ranges.union(masks).groupBy(f"{tag}_r").agg(F.collect_list("x").alias(f"{tag}_ranges"), F.collect_list("y").alias(f"{tag}_masks"))


def deduplicate(docs: DataFrame, depth: int = DEPTH, anchor: int = ANCHOR, words: int = WORDS, word_anchor: int = WORD_ANCHOR) -> DataFrame:
    """A row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the bytes that
    no repeated window of ``depth`` bytes covers), and the words that windows of ``words`` words
    cover: n_shared_words by those that start in another document, n_later_words by those that
    start in a document with a smaller id."""
    doc = F.coalesce("doc_id", F.lit(int(NONE))).alias("doc")
    texts = docs.select("doc_id", doc, F.xxhash64("doc_id", "text").alias("rid"), F.col("text").cast("binary").alias("text"))
    w = by_rid(*repeated_starts(texts, Words, words, word_anchor), "w")
    b = by_rid(*repeated_starts(texts, Bytes, depth, anchor), "b")
    joined = texts.join(b, F.col("rid") == F.col("b_r"), "left").join(w, F.col("rid") == F.col("w_r"), "left")
    return joined.select("doc_id", "text", "b_ranges", "b_masks", "w_ranges", "w_masks").mapInArrow(cut(depth, words), RESULT)
