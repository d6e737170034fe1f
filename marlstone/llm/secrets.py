"""Secret scans: patterns, and a battery of randomness tests with false-discovery control.

Patterns find assignments, access keys and hex runs. Beyond these, every run of LEAST or more
characters of the usual encodings is a candidate, or what the patterns' spans leave of it. Its encoding is inferred from its characters
(digits, hex, base 32, base 36, base 62, base 64), and three tests ask whether the symbols are drawn
from that alphabet at random: chi-squared for equal shares, runs above and below the alphabet's
middle, and correlation of neighbours. Their p-values are combined by Fisher's method.

A random token passes the battery with a uniform p-value; words and numbers in order pile up near
zero. Distinct candidates are counted by encoding, length and p-value over all texts, so that copies
count once; in each stratum of encoding and length the share of random ones follows from the upper
half of the p-values, and a candidate is reported from the least p-value at which the expected share
of others, among all reported and in the last bin, is at most ALPHA.

A stratum with too few candidates for that is held to a null model: tokens of its encoding and length
put together from ordinary words of the corpus and numbers. A candidate is reported from the least
p-value that at most STRICT of them reach and at which as many of them as the stratum has candidates
would give at most ALPHA times the reported ones. A single clear token is thus reported; short
tokens, where ordinary words pass too often, are not.

Defined results: a null text is empty and has no spans; very long runs are tested whole; repeated
rows are separate rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.common import INT, LONG, STRING, materialize, schema

# The base patterns and the least lengths of their matches.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
KINDS = ("assign", "access", "hex")

#: Candidates: runs of these characters, this long at least.
LEAST = 20
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}")
#: Expected share of false discoveries, bins of p-values, and how many candidates of a stratum must
#: lie in the upper half of the p-values before their number means anything.
ALPHA, BINS, STRATUM = 0.1, 50, 5
#: Null model: share of ordinary tokens that may reach a reported p-value, how many are made for a
#: stratum (a stratum of many candidates gets more), and the longest (longer ones pass less often).
STRICT, ORDINARY, MOST_ORDINARY, LONGEST = 0.01, 2000, 100_000, 256
#: Ordinary words: of all words of whole texts those that most texts have. The JVM matches the pattern.
WORD, VOCABULARY = r"(?<![A-Za-z0-9+/_-])[A-Za-z]{2,19}(?![A-Za-z0-9+/_-])", 2000
#: Words for small corpora, with some that are hexadecimal.
COMMON = (
    "the of and to in is for that on with as this are from at by not have was will can all use one more time when which data file name value key user test path "
    "home page read write open close index table list string number first last next order part line text word server client request response error message "
    "ace add added bad bed cab cafe dad dead deaf decade face facade fade fed feed beef"
).split()
#: Alphabets by name, smallest first. The order is the symbols' order for the tests.
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = {
    "digits": DIGITS,
    "hex": DIGITS + LOWER[:6],
    "hex_upper": DIGITS + UPPER[:6],
    "base32": UPPER + DIGITS[2:8],
    "base36": DIGITS + LOWER,
    "base36_upper": DIGITS + UPPER,
    "base62": DIGITS + LOWER + UPPER,
    "base64": UPPER + LOWER + DIGITS + "+/",
    "base64_url": UPPER + LOWER + DIGITS + "-_",
}
PLACES = {name: {c: i for i, c in enumerate(a)} for name, a in ALPHABETS.items()}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of the base patterns, leftmost and without overlaps in a kind."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    # A run of 20 characters is found by one scan; a hex run lies in one.
    if RUN.search(text):
        found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def encoding(token: str) -> str | None:
    """The smallest alphabet that holds all symbols of a token."""
    symbols = set(token)
    return next((name for name, a in PLACES.items() if symbols <= a.keys()), None)


def tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi_squared(places: list[int], k: int) -> float:
    """p-value of equal shares: the statistic's exact mean and variance, through the cube root."""
    n = len(places)
    x = sum(c * c for c in Counter(places).values()) * k / n - n
    mean, variance = k - 1, 2 * (k - 1) * (n - 1) / n
    # A gamma variable with this mean and variance, by Wilson and Hilferty.
    shape = mean * mean / variance
    z = ((max(x, 0.0) / mean) ** (1 / 3) - (1 - 1 / (9 * shape))) * 3 * math.sqrt(shape)
    return tail(z)


def runs(places: list[int], k: int) -> float:
    """Two-sided p-value of the number of runs above and below the alphabet's middle."""
    high = [2 * p >= k for p in places]
    n, above = len(high), sum(high)
    below = n - above
    if not above or not below:
        return 2.0 ** (1 - n)
    mean = 2 * above * below / n + 1
    variance = (mean - 1) * (mean - 2) / (n - 1)
    count = 1 + sum(a != b for a, b in zip(high, high[1:]))
    return min(1.0, 2 * tail(abs(count - mean) / math.sqrt(variance))) if variance > 0 else 1.0


def serial(places: list[int], k: int) -> float:
    """Two-sided p-value of the correlation of neighbours, against the alphabet's moments."""
    mean, variance = (k - 1) / 2, (k * k - 1) / 12
    n = len(places)
    r = sum((a - mean) * (b - mean) for a, b in zip(places, places[1:])) / variance
    return min(1.0, 2 * tail(abs(r) / math.sqrt(n - 1)))


def battery(token: str, name: str) -> float:
    """Fisher's combination of the three tests for a token of an encoding."""
    places = [PLACES[name][c] for c in token]
    k = len(ALPHABETS[name])
    x = -sum(math.log(max(p, 1e-300)) for p in (chi_squared(places, k), runs(places, k), serial(places, k)))
    # Chi-squared with six degrees of freedom at 2 x.
    return math.exp(-x) * (1 + x + x * x / 2)


def length_band(n: int) -> int:
    """Bands of lengths, four to a doubling."""
    return int(4 * math.log2(n))


CANDIDATE = T.StructType([T.StructField("start", INT), T.StructField("end", INT), T.StructField("encoding", STRING), T.StructField("band", INT), T.StructField("bin", INT), T.StructField("token", LONG)])
FOUND = schema(doc_id=LONG, base=STRING, n_assign=LONG, n_access=LONG, n_hex=LONG, candidates=T.ArrayType(CANDIDATE))


def bin_of(token: str, name: str) -> int:
    return min(int(battery(token, name) * BINS), BINS - 1)


def outside(start: int, end: int, taken: list[tuple[int, int, str]], first: int) -> Iterator[tuple[int, int]]:
    """The parts of a run that spans sorted by start, from the first that may reach it, leave."""
    for a, b, _ in taken[first:]:
        if a >= end:
            break
        if b > start:
            if a > start:
                yield start, a
            start = b
    if start < end:
        yield start, end


def candidates(text: str, taken: list[tuple[int, int, str]]) -> list[dict]:
    """Parts of runs outside the base spans with their encoding, the bin of their p-value and a hash."""
    out, first, reach = [], 0, []
    for _, b, _ in taken:
        reach.append(max(b, reach[-1] if reach else 0))
    for m in RUN.finditer(text):
        # Spans before this one end before the run, and so before all that follow.
        while first < len(taken) and reach[first] <= m.start():
            first += 1
        for start, end in outside(m.start(), m.end(), taken, first):
            token = text[start:end].rstrip("=")
            name = encoding(token) if len(token) >= LEAST else None
            if name is not None:
                out.append({"start": start, "end": end, "encoding": name, "band": length_band(len(token)), "bin": bin_of(token, name), "token": int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "big", signed=True)})
    return out


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    struct = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("encoding", pa.string()), ("band", pa.int32()), ("bin", pa.int32()), ("token", pa.int64())])
    for batch in batches:
        base, counts, more = [], [], []
        for text in batch.column("text").to_pylist():
            spans = base_spans(text or "")
            base.append(",".join(f"{k}:{a}:{b}" for a, b, k in spans))
            counts.append([sum(k == kind for *_, k in spans) for kind in KINDS])
            more.append(candidates(text or "", spans))
        columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(3)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, pa.string()), *columns, pa.array(more, pa.list_(struct))], names=FOUND.names)


class Ordinary:
    """Tokens of an encoding and length made of words and numbers, the same in every run."""

    def __init__(self, vocabulary: list[str]):
        self.vocabulary = sorted({*vocabulary, *COMMON})

    def number(self, r: random.Random) -> str:
        kind = r.randrange(4)
        if kind == 0:
            return str(r.randrange(10 ** r.randint(1, 4)))
        if kind == 1:
            return f"{r.randrange(1000):06d}"
        if kind == 2:
            return f"{r.randint(1970, 2030)}{r.randint(1, 12):02d}{r.randint(1, 28):02d}"
        return str(r.randrange(10)) * r.randint(2, 4)

    def tokens(self, name: str, band: int, n: int) -> Iterator[str]:
        """At most n tokens of the least length of a band; the encoding is the smallest that holds them."""
        r = random.Random(f"{name} {band}")
        symbols = set(ALPHABETS[name])
        words = [v for w in self.vocabulary for v in (w, w.capitalize(), w.upper()) if symbols.issuperset(v)]
        joins = ["", *(c for c in "+/-_" if c in symbols)]
        length = min(max(LEAST, math.ceil(2 ** (band / 4))), LONGEST)
        for _ in range(10 * n):
            share, join, parts, size = (r.choice((0.1, 0.3, 0.5)) if words else 1.0), r.choice(joins), [], 0
            while size < length:
                part = "".join(c for c in self.number(r) if c in symbols) if r.random() < share else r.choice(words)
                parts.append(part)
                size += len(part) + (len(join) if part else 0)
            token = join.join(p for p in parts if p)[:length]
            if len(token) == length and encoding(token) == name:
                yield token
                n -= 1
                if not n:
                    return

    def passed(self, name: str, band: int, n: int) -> list[float]:
        """By bin, the share of n tokens that reach it; the token in question counts as one."""
        bins = Counter(bin_of(t, name) for t in self.tokens(name, band, n))
        made, out, reached = bins.total(), [1.0] * BINS, 0
        for b in range(BINS - 1, -1, -1):
            reached += bins[b]
            out[b] = (1 + reached) / (1 + made)
        return out


def least_clear(bins: dict[int, int], passed: list[float], alpha: float) -> int | None:
    """The least bin from which the tokens of a small stratum are clear of the null model."""
    n, reported, best = sum(bins.values()), 0, None
    for b in range(BINS - 1, 0, -1):
        reported += bins.get(b, 0)
        if bins.get(b) and passed[b] <= STRICT and n * passed[b] <= alpha * reported:
            best = b
    return best


def few(bins: dict[int, int]) -> bool:
    """Whether too few candidates lie in the upper half for their number to mean anything."""
    return sum(n for b, n in bins.items() if b >= BINS // 2) < STRATUM


def thresholds(counts: dict[tuple[str, int], dict[int, int]], alpha: float = ALPHA, vocabulary: list[str] | None = None) -> dict[tuple[str, int], int]:
    """The least reported bin of each stratum of encoding and length that reports any, from counts
    of distinct candidates."""
    out = {}
    null = Ordinary(vocabulary or [])
    for stratum, bins in counts.items():
        # Random tokens fill all bins alike, so the upper half shows how many there are.
        upper = sum(n for b, n in bins.items() if b >= BINS // 2)
        if few(bins):
            if any(b and n for b, n in bins.items()):
                best = least_clear(bins, null.passed(*stratum, min(max(ORDINARY, 20 * sum(bins.values())), MOST_ORDINARY)), alpha)
                if best is not None:
                    out[stratum] = best
            continue
        each = upper / (BINS - BINS // 2)
        reported, best = 0, None
        for b in range(BINS - 1, -1, -1):
            reported += bins.get(b, 0)
            others = max(0.0, reported - each * (BINS - b))
            here = bins.get(b, 0)
            if reported and others <= alpha * reported and here - each <= alpha * here:
                best = b
        if best is not None:
            out[stratum] = best
    return out


def hexdigest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


RESULT = schema(doc_id=LONG, n_assign=LONG, n_access=LONG, n_hex=LONG, base_sha256=STRING, spans=STRING, n_random=INT)


def finish(least: dict[tuple[str, int], int]):
    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, spans, n = [], [], []
            for base, more in zip(batch.column("base").to_pylist(), batch.column("candidates").to_pylist(), strict=True):
                found = [c for c in more if c["bin"] >= least.get((c["encoding"], c["band"]), BINS)]
                parts = [(int(x.split(":")[1]), KINDS.index(x.split(":")[0]), x) for x in base.split(",") if x]
                parts += [(c["start"], len(KINDS), f"random:{c['start']}:{c['end']}") for c in found]
                digests.append(hexdigest(base))
                spans.append(",".join(x for *_, x in sorted(parts)))
                n.append(len(found))
            columns = [pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(n, pa.int32())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_assign", "n_access", "n_hex")), *columns], names=RESULT.names)

    return report


def ordinary_words(docs: DataFrame) -> list[str]:
    """The words that most texts have, each text read to its end."""
    words = F.transform(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lower)
    counts = docs.select(F.explode(F.array_distinct(words)).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return [r.w for r in counts.orderBy(F.col("n").desc(), "w").limit(VOCABULARY).collect()]


def find(docs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random of every row. The text is
    read once, and once more for its words if a stratum is small; strata are at most encodings x
    bands of length x bins, words at most VOCABULARY."""
    found = materialize(docs.select("doc_id", "text").mapInArrow(scan, FOUND), "spans")
    rows = found.select(F.explode("candidates").alias("c")).groupBy("c.encoding", "c.band", "c.bin").agg(F.countDistinct("c.token").alias("n")).collect()
    counts: dict[tuple[str, int], dict[int, int]] = {}
    for r in rows:
        counts.setdefault((r.encoding, r.band), {})[r.bin] = r.n
    vocabulary = ordinary_words(docs) if any(map(few, counts.values())) else []
    return found.mapInArrow(finish(thresholds(counts, alpha, vocabulary)), RESULT)
