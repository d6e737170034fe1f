"""Toxicity by maximum-scoring segments of token log-odds.

Training counts in how many toxic and clean labelled texts a word (or its first 4, 5 or 6 letters)
occurs; log-odds with an informative Dirichlet prior, the words' shares in both kinds, score those
that tell the kinds apart. Each toxic text then credits its most telling words, and only words that
some texts credit stay: words that merely keep company with these in copies of a text do not. Scoring walks a text once: a token scores its log-odds less a drift, so
that ordinary text runs downhill, and the linear-time scan finds all maximal segments. Segments are
judged as in local alignment: a segment of score S in n tokens has about K n exp(-lambda S) equals
by chance. Lambda and K are those that make the highest segments of clean training texts likeliest;
where too few of these have any segment, lambda follows from their token scores. A text's statistic adds up its segments'
rarity; a logistic curve over it, fitted on the training rows, gives the score.

Labels are fitted on at most SAMPLE labelled rows, taken by hash: these can be broadcast, so that
the corpus's text never moves. Everything else is over all rows. Only words and numbers of words
reach the model; labels, lang, source and doc_id do not.

Defined results: a null or empty text scores as one without any segment; a null doc_id counts as
held out; null labels are ignored, of several labels of a document the largest counts; without both
kinds of labels every text scores 0; repeated rows are separate rows; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import DOUBLE, INT, LONG, STRING, forget, materialize, schema

#: Labelled rows that training takes at most (about). The model's words and stems each tell and occur in
#: LEAST_TEXTS of these: no more than their word occurrences by LEAST_TEXTS.
SAMPLE = 200_000
#: Weight of the prior in texts; of a scored word: least signed root of the likelihood ratio, least
#: texts it occurs in, least texts that credit it.
PRIOR, LEAST_ROOT, LEAST_TEXTS, LEAST_CREDITS = 50.0, 4.5, 4, 2
#: A text credits words whose log-odds come this near to its most telling ones.
CLOSE = 0.5
#: Drift of a token's score, and bounds of its log-odds.
DRIFT, LOW, HIGH = 0.1, -1.0, 8.0
STEMS = (4, 5, 6)
#: K, and clean texts with a segment that it takes to estimate it and lambda instead.
K, LEAST_MAXIMA = 0.1, 30
WORD = re.compile(r"[^\W\d_]+")
#: Distinct words whose scores a task keeps.
CACHE = 500_000


def folded(doc_id: Column) -> Column:
    """Whether a document is held out from training: crc32 of its id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def features(words: set[str]) -> set[str]:
    """Words, and stems marked by a leading dash."""
    return words | {f"-{w[:n]}" for w in words for n in STEMS if len(w) >= n}


COUNTS = schema(word=STRING, toxic=LONG, clean=LONG)


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def emit() -> pa.RecordBatch:
        words = list(counts[0].keys() | counts[1].keys())
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([counts[k][w] for w in words], pa.int64()) for k in (1, 0))], names=COUNTS.names)

    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            counts[1 if toxic else 0].update(features(set(WORD.findall((text or "").lower()))))
        if len(counts[0]) + len(counts[1]) > CACHE:
            yield emit()
            counts = (Counter(), Counter())
    yield emit()


def segments(places: list[int], scores: list[float], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first token, end, score) of a text whose tokens score -drift
    but for those at ``places``: the linear-time scan of Ruzzo and Tompa, over these alone."""
    # Each stacked segment: start, end, sum before it, sum up to its end, index of the segment
    # below it with a smaller sum before.
    stack: list[tuple[int, int, float, float, int]] = []
    total, at = 0.0, 0
    for p, s in zip(places, scores, strict=True):
        total -= drift * (p - at)
        at = p + 1
        if s <= 0:
            total += s
            continue
        start, before = p, total
        total += s
        while True:
            k = len(stack) - 1
            while k >= 0 and stack[k][2] >= before:
                k = stack[k][4]
            if k < 0 or stack[k][3] >= total:
                stack.append((start, at, before, total, k))
                break
            start, before = stack[k][0], stack[k][2]
            del stack[k:]
    return [(a, b, after - before) for a, b, before, after, _ in stack]


class Scorer:
    """Scores tokens by a lexicon of words and stems: {word: log-odds}."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.known: dict[str, float] = {}

    def word(self, w: str) -> float:
        """The log-odds of the most telling of a word and its stems; 0 where none tells."""
        get = self.lexicon.get
        return max(get(w, 0.0), get("-" + w[:4], 0.0), get("-" + w[:5], 0.0), get("-" + w[:6], 0.0))

    def text(self, text: str | None) -> tuple[int, list[float], list[tuple[int, int, float]]]:
        """Tokens of a text, the scores of those that tell, and its segments."""
        words = WORD.findall((text or "").lower())
        known = self.known
        if len(known) > CACHE:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = self.word(w)
        places = [i for i, w in enumerate(words) if known[w]]
        scores = [known[words[i]] - DRIFT for i in places]
        return len(words), scores, segments(places, scores)


def statistic(n: int, found: list[float], rate: float, k: float = K) -> float:
    """How rare a text's segments are: log(1 + sum of 1 / (k n exp(-rate S))); 0 without any."""
    base = math.log(k * max(n, 1))
    top = max(0.0, max(found, default=0.0) * rate - base)
    return top + math.log(math.exp(-top) + sum(math.exp(s * rate - base - top) for s in found))


#: Bins of token scores, from LOW - DRIFT to HIGH.
BINS = 64


def bin_of(score: float) -> int:
    return min(max(int((score - LOW + DRIFT) / (HIGH - LOW + DRIFT) * BINS), 0), BINS - 1)


SCANNED = schema(toxic=INT, n=INT, found=T.ArrayType(DOUBLE), bins=T.ArrayType(INT))


def scan_training(lexicon: dict):
    """Tokens, segments' scores and binned scores of the tokens that tell, of each training row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon)
        for batch in batches:
            rows = [scorer.text(t) for t in batch.column("text").to_pylist()]
            found = pa.array([[s for *_, s in parts] for _, _, parts in rows], pa.list_(pa.float64()))
            bins = pa.array([[*map(bin_of, scores)] for _, scores, _ in rows], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([n for n, *_ in rows], pa.int32()), found, bins], names=SCANNED.names)

    return scan


def credits(lexicon: dict):
    """The words and stems that each toxic row credits: the most telling ones."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                found = [w for w in features(set(WORD.findall((text or "").lower()))) if w in lexicon]
                top = max((lexicon[w] for w in found), default=0.0)
                counts.update(w for w in found if lexicon[w] >= top - CLOSE)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    return scan


def decay(counts: dict[int, int]) -> float:
    """lambda: the positive root of mean(exp(lambda score)) = 1 over the clean tokens' scores."""
    width = (HIGH - LOW + DRIFT) / BINS
    scores = np.array([-DRIFT if b < 0 else LOW - DRIFT + (b + 0.5) * width for b in counts])
    share = np.array(list(counts.values()), float)
    share = share / share.sum() if share.sum() else share
    low, high = 1e-3, 1.0
    if not len(scores) or scores.max() <= 0 or (share * scores).sum() >= 0:
        return 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (share * np.exp(mid * scores)).sum() < 1 else (low, mid)
    return low


def extremes(maxima: list[tuple[float, int, int]], rate: float) -> tuple[float, float]:
    """lambda and K that make the highest segments of clean texts likeliest, from (score, texts,
    their tokens), where 0 stands for texts without a segment: the chance that a text of n tokens
    has none above s is exp(-K n exp(-lambda s))."""
    score, texts, tokens = (np.array(x, float) for x in zip(*maxima, strict=True)) if maxima else [np.zeros(0)] * 3
    have = score > 0
    n = texts[have].sum()
    if n < LEAST_MAXIMA:
        return rate, K
    best = (-math.inf, rate, K)
    for x in np.geomspace(rate / 8, rate * 8, 385):
        k = n / (tokens * np.exp(-x * score)).sum()
        best = max(best, (n * math.log(k) + n * math.log(x) - x * (texts * score)[have].sum(), x, k))
    return float(best[1]), float(best[2])


def fit(values: dict[tuple[int, int], int]) -> tuple[float, float]:
    """Slope and offset of a logistic curve over binned statistics: {(bin, toxic): rows}."""
    if len({t for _, t in values}) < 2:
        return 0.0, -50.0
    x = np.array([b / 4 for b, _ in values])
    y = np.array([t for _, t in values], float)
    w = np.array(list(values.values()), float)
    mean, scale = (w * x).sum() / w.sum(), max(math.sqrt((w * (x - x.mean()) ** 2).sum() / w.sum()), 1e-6)
    z = (x - mean) / scale
    theta = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(theta[0] * z + theta[1], -30, 30)))
        grad = np.array([(w * (y - p) * z).sum(), (w * (y - p)).sum()]) - 1e-2 * theta
        h = w * p * (1 - p)
        hess = np.array([[(h * z * z).sum(), (h * z).sum()], [(h * z).sum(), h.sum()]]) + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        theta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    slope = max(theta[0], 0.0) / scale
    return slope, theta[1] - slope * mean


class Model:
    def __init__(self, lexicon: dict, rate: float, slope: float, offset: float, k: float = K):
        self.lexicon, self.rate, self.slope, self.offset, self.k = lexicon, rate, slope, offset, k

    def statistic(self, n: int, found: list[float]) -> float:
        return min(statistic(n, found, self.rate, self.k), TOP)

    def expected(self, n: int, score: float) -> float:
        """The e-value of a segment: how many as high a text of n tokens has by chance."""
        return self.k * n * math.exp(-min(self.rate * score, 700))

    def probability(self, x: float) -> float:
        return 1 / (1 + math.exp(-min(max(self.slope * x + self.offset, -50), 50)))


def training(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic) of the labelled rows outside the held-out fold, about ``sample`` at most."""
    known = labels.where(F.col("toxic").isNotNull() & ~folded(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = materialize(known.select(F.col("doc_id").alias("_l"), (F.col("toxic") > 0).cast("int").alias("toxic")), "labels")
    share = min(1.0, sample / max(known.count(), 1))
    known = known.where(F.pmod(F.xxhash64("_l", F.lit(7)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))
    # At most about SAMPLE rows of twelve bytes.
    return docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("_l")).select("text", "toxic")


def lexicon(rows: DataFrame) -> dict[str, float]:
    """{word or stem: log-odds} of the words that tell toxic texts and are credited."""
    counts = materialize(rows.mapInArrow(count_words, COUNTS).groupBy("word").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).where(F.col("t") + F.col("c") >= LEAST_TEXTS), "words")
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = float(sizes.get(1, 0)), float(sizes.get(0, 0))
    if not toxic or not clean:
        return {}
    both = F.col("t") + F.col("c")
    prior = F.lit(PRIOR) * both / F.lit(toxic + clean)
    odds = lambda x, n: F.log((x + prior) / F.greatest(F.lit(n + PRIOR) - x - prior, F.lit(0.5)))
    part = lambda x, n: F.when(x > 0, x * F.log(x / n)).otherwise(F.lit(0.0))
    rest, all_ = F.lit(toxic + clean) - both, toxic + clean
    ratio = part(F.col("t"), both * toxic / all_) + part(F.col("c"), both * clean / all_) + part(toxic - F.col("t"), rest * toxic / all_) + part(clean - F.col("c"), rest * clean / all_)
    scored = counts.withColumn("delta", odds(F.col("t"), toxic) - odds(F.col("c"), clean)).withColumn("root", F.sqrt(F.greatest(2 * ratio, F.lit(0.0))))
    top = scored.where((F.col("root") >= LEAST_ROOT) & (F.col("delta") > 0)).select("word", "delta").collect()
    found = {r.word: r.delta for r in top}
    named = rows.where("toxic = 1").select("text").mapInArrow(credits(found), schema(word=STRING, n=LONG)).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_CREDITS).collect()
    return {r.word: min(found[r.word], HIGH) for r in named}


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    rows = materialize(training(docs, labels, sample), "training")
    words = lexicon(rows)
    if not words:
        return Model({}, 1.0, 0.0, -50.0)
    scanned = materialize(rows.mapInArrow(scan_training(words), SCANNED), "scanned")
    forget(rows)
    clean = scanned.where("toxic = 0")
    bins = clean.select(F.explode("bins").alias("b")).groupBy("b").agg(F.count("*").alias("n")).collect()
    tokens = clean.agg(F.sum(F.col("n").cast("long") - F.size("bins"))).first()[0] or 0
    rate = decay({-1: tokens} | {r.b: r.n for r in bins})
    top = F.coalesce(F.round(F.array_max("found") * 16) / 16, F.lit(0.0)).alias("top")
    maxima = clean.groupBy(top).agg(F.count("*").alias("texts"), F.sum(F.col("n").cast("long")).alias("tokens")).collect()
    rate, k = extremes([(r.top, r.texts, r.tokens) for r in maxima], rate)
    stats = scanned.mapInArrow(to_statistics(rate, k), schema(toxic=INT, x=DOUBLE)).groupBy(F.round(F.col("x") * 4).cast("int").alias("b"), "toxic").agg(F.count("*").alias("n")).collect()
    slope, offset = fit({(r.b, r.toxic): r.n for r in stats})
    forget(scanned)
    return Model(words, rate, slope, offset, k)


#: Statistics beyond this are as good as certain.
TOP = 250.0


def to_statistics(rate: float, k: float = K):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [min(statistic(n, found, rate, k), TOP) for n, found in zip(batch.column("n").to_pylist(), batch.column("found").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(x, pa.float64())], names=["toxic", "x"])

    return scan


#: The e-value up to which a segment is significant.
SIGNIFICANT = 0.05
SEGMENT = T.StructType([T.StructField("start", INT), T.StructField("end", INT), T.StructField("score", DOUBLE), T.StructField("e_value", DOUBLE)])
SCORES = schema(doc_id=LONG, score=DOUBLE, n_segments=INT, top_start=INT, top_end=INT, segments=T.ArrayType(SEGMENT))


def to_scores(model: Model):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.lexicon)
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                n, _, parts = scorer.text(text)
                x = model.statistic(n, [s for *_, s in parts])
                rare = [p for p in parts if model.expected(n, p[2]) < SIGNIFICANT]
                top = max(rare, key=lambda p: p[2], default=(0, 0, 0.0))
                found = [{"start": a, "end": b, "score": s, "e_value": model.expected(n, s)} for a, b, s in sorted(rare)]
                out.append((model.probability(x), len(rare), top[0], top[1], found))
            segment = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64())])
            kinds = (pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(segment))
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=SCORES.names)

    return scan


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, and its significant passages: their number,
    the tokens of the highest (from, to; 0, 0 where there is none), and segments, an array of the
    start, end, score and e-value of all in order."""
    model = train(docs, labels, sample)
    scored = docs.select("doc_id", "text").mapInArrow(to_scores(model), SCORES)
    return scored.select("doc_id", folded(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_segments", "top_start", "top_end", "segments")


def rejects(model: Model):
    """A column expression of a text: whether the model calls it toxic."""
    @F.pandas_udf("boolean")
    def toxic(texts: pd.Series) -> pd.Series:
        scorer = Scorer(model.lexicon)
        out = []
        for t in texts:
            n, _, parts = scorer.text(t)
            out.append(model.probability(model.statistic(n, [s for *_, s in parts])) >= 0.5)
        return pd.Series(out)

    return toxic


def clean(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that are not toxic, with their columns."""
    return docs.where(~rejects(train(docs, labels, sample))(docs["text"]))
