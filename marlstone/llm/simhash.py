"""SimHash near-duplicates by tiled exact comparison of fingerprints.

Fingerprints are made where texts are read. Distinct ones are compared in tiles with numpy's
exclusive-or and bit count; tiles are ordered by population count, and pairs of tiles whose counts
differ by more than the radius are skipped. Tiles of all fingerprints would be quadratic in the
corpus, so they are laid inside bands: cut 64 bits into BLOCKS or more blocks, and two fingerprints
within RADIUS bits agree on all but RADIUS of them. For each choice of agreeing blocks, fingerprints
with the same bits there meet; the number of blocks weighs bands against comparisons in them.
No pair within the radius is lost. A band larger than TILE is cut into tiles by ranges of population
counts and by hash, and each pair of tiles is a group of its own, so that no task holds a band.

Links (a spanning forest of each group's) go through distributed connected components.

``representatives`` is to find texts whose five-word shingles are alike to 0.8, which the radius of
``near_duplicates`` misses half of. It searches fingerprints of shorter shingles within a wider
radius, and a second fingerprint, of other shingles, must confirm each link: unrelated texts seldom
pass the first test and hardly ever both, so that a large corpus isn't chained together.

Defined results: null and empty texts have fingerprint zero; repeated rows share a component; a
null doc_id takes part and never names a component (a component of null ids alone has null); an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.llm.common import LONG, connected_components, forget, materialize, release, schema

#: Words of a shingle, seed of its hash, bits that linked fingerprints may differ in.
WIDTH, SEED, RADIUS = 4, 42, 4
#: The same for representatives(): words of the searched and the confirming shingles, and radii.
NEAR_WIDTHS, NEAR_RADIUS, CONFIRM_RADIUS = (3, 2), 10, 12
#: Fingerprints whose comparison costs as much as one more band, and those a tile holds at most.
PER_BAND, TILE = 1024, 2048


def fingerprints_of(text: bytes | None, widths: tuple[int, ...] = (WIDTH,)) -> list[int]:
    """SimHashes of a UTF-8 text's word shingles of some widths as signed 64-bit integers."""
    words = (text or b"").lower().split()
    if not words:
        return [0] * len(widths)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    out = []
    for width in widths:
        n = max(len(words) - width + 1, 1)
        starts = np.concatenate([[0], ends[: n - 1] + 1])
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, map(slice, starts.tolist(), ends[-n:].tolist())), repeat(SEED)), np.uint64, n)
        ones = np.zeros(64, np.int64)
        for at in range(0, n, 4096):
            ones += np.unpackbits(hashes[at : at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(ones * 2 > n).view(">i8")[0]))
    return out


def fingerprint(text: bytes | None, width: int = WIDTH) -> int:
    return fingerprints_of(text, (width,))[0]


#: Columns of fingerprints: the one that is searched, and one that confirms.
VALUES = ("fp", "more")


def fingerprints(docs: DataFrame, widths: tuple[int, ...] = (WIDTH,)) -> DataFrame:
    """(doc_id, fp) of every row, and with two widths (doc_id, fp, more)."""
    kind = schema(doc_id=LONG, **dict.fromkeys(VALUES[: len(widths)], LONG))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprints_of(t, widths) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([f[i] for f in fps], pa.int64()) for i in range(len(widths)))], names=kind.names)

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(scan, kind)


def masks(n: int, radius: int = RADIUS) -> list[int]:
    """Masks of the bits that must agree: as many blocks as cost least for n fingerprints, where
    a fingerprint costs a row a mask, and in its band a comparison with PER_BAND others as much."""

    def cost(blocks: int) -> float:
        return math.comb(blocks, radius) * (1 + n / 2 ** (64 * (blocks - radius) / blocks) / PER_BAND)

    blocks = min(range(radius + 1, 2 * radius + 5), key=cost)
    edges = [64 * i // blocks for i in range(blocks + 1)]
    bits = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(bits, blocks - radius)]


def close_pairs(one: list[np.ndarray], two: list[np.ndarray], radii: tuple[int, ...], step: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs of two sorted-by-population arrays within the radius, tile by tile. Where
    there are confirming fingerprints beside them, these must be within their radius too."""
    a, b = [], []
    radius = radii[0]
    p, q = np.bitwise_count(one[0]), np.bitwise_count(two[0])
    for i in range(0, len(p), step):
        x = one[0][i : i + step]
        low, high = int(p[i]), int(p[min(i + step, len(p)) - 1])
        for j in range(0, len(q), step):
            if int(q[j]) > high + radius or int(q[min(j + step, len(q)) - 1]) < low - radius:
                continue
            u, v = np.nonzero(np.bitwise_count(x[:, None] ^ two[0][None, j : j + step]) <= radius)
            for k in range(1, len(radii)):
                sure = np.bitwise_count(one[k][u + i] ^ two[k][v + j]) <= radii[k]
                u, v = u[sure], v[sure]
            a.append(u + i)
            b.append(v + j)
    return np.concatenate(a or [np.zeros(0, np.int64)]), np.concatenate(b or [np.zeros(0, np.int64)])


def forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its component) that connect what the links a-b connect."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = np.minimum(new, new[label])
        new = new[new]
        if np.array_equal(new, label):
            node = np.flatnonzero(label != np.arange(n))
            return node, label[node]
        label = new


LINKS = schema(a=LONG, b=LONG)
GROUP = ("band", "key", "p1", "s1", "p2", "s2")


def compare(radii: tuple[int, ...]):
    """Rows sorted by group, side and population become links; one group is held at a time."""
    values = VALUES[: len(radii)]

    def links(side: np.ndarray, fps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        one, two = ([f[side == s] for f in fps] for s in (0, 1))
        if len(two[0]):
            a, b = close_pairs(one, two, radii)
            b = b + len(one[0])
        else:
            a, b = close_pairs(one, one, radii)
            keep = a < b
            a, b = a[keep], b[keep]
        both = np.concatenate([one[0], two[0]])
        node, root = forest(len(both), a, b)
        return both[node], both[root]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in (*GROUP, "side", *values)]
            if rest is not None:
                columns = [np.concatenate([x, y]) for x, y in zip(rest, columns, strict=True)]
            change = np.zeros(max(len(columns[0]) - 1, 0), bool)
            for c in columns[: len(GROUP)]:
                change |= c[1:] != c[:-1]
            cuts = [0, *(np.flatnonzero(change) + 1).tolist()]
            yield from done(columns, cuts)
            rest = [c[cuts[-1] :] for c in columns]
        if rest is not None:
            yield from done(rest, [0, len(rest[0])])

    def done(columns: list[np.ndarray], cuts: list[int]) -> Iterator[pa.RecordBatch]:
        side, fps = columns[len(GROUP)], [c.view(np.uint64) for c in columns[len(GROUP) + 1 :]]
        found = [links(side[i:j], [f[i:j] for f in fps]) for i, j in zip(cuts, cuts[1:]) if j - i > 1]
        if found:
            a, b = (np.concatenate(x).view(np.int64) for x in zip(*found, strict=True))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=LINKS.names)

    return scan


def links(distinct: DataFrame, n: int, radii: tuple[int, ...] = (RADIUS,), tile: int = TILE) -> DataFrame:
    """Links (a, b) between fingerprints (fp) that connect all pairs within the radius, and within
    the second radius by their confirming fingerprints (more)."""
    radius, values = radii[0], VALUES[: len(radii)]
    bands = masks(n, radius)
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("key")) for i, m in enumerate(bands)]))
    rows = distinct.select(*values, F.bit_count("fp").alias("pop"), keys.alias("x")).select("x.*", "pop", *values)
    counts = rows.groupBy("band", "key", "pop").agg(F.count("*").alias("n"))
    large = counts.groupBy("band", "key").agg(F.sum("n").alias("all")).where(F.col("all") > tile)
    large = materialize(large.select(F.col("band").alias("b"), F.col("key").alias("k")), "large")
    zero = [F.lit(0).alias(c) for c in ("p1", "s1", "p2", "s2")]
    if large.isEmpty():
        groups = rows.select("band", "key", *zero, F.lit(0).alias("side"), "pop", *values)
    else:
        on = (F.col("band") == F.col("b")) & (F.col("key") == F.col("k"))
        small = rows.join(large, on, "left_anti").select("band", "key", *zero, F.lit(0).alias("side"), "pop", *values)
        # Tiles of a large band: ranges of population counts with about half a tile of rows, those
        # that hold more salted by hash. A row meets the tiles whose counts its own can pair with.
        half = tile // 2
        before = F.sum("n").over(W.partitionBy("b", "k").orderBy("tp").rowsBetween(W.unboundedPreceding, -1))
        parts = counts.join(large, on).select("b", "k", F.col("pop").alias("tp"), "n")
        parts = parts.withColumn("t", F.floor(F.coalesce(before, F.lit(0)) / half).cast("int"))
        tiles = parts.groupBy("b", "k", "t").agg(F.min("tp").alias("low"), F.max("tp").alias("high"), F.ceil(F.sum("n") / half).cast("int").alias("tiles"))
        tiles = materialize(tiles, "tiles")
        own = on & F.col("pop").between(F.col("low"), F.col("high"))
        mine = rows.join(tiles, own).select("band", "key", "pop", *values, F.col("t").alias("p"), F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int").alias("s"))
        near = on & F.col("pop").between(F.col("low") - radius, F.col("high") + radius)
        meets = mine.join(tiles, near).select("band", "key", "pop", *values, "p", "s", "t", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("ts"))
        ahead = (F.col("p") < F.col("t")) | ((F.col("p") == F.col("t")) & (F.col("s") <= F.col("ts")))
        pick = lambda x, y: F.when(ahead, F.col(x)).otherwise(F.col(y))
        wide = meets.select("band", "key", pick("p", "t").alias("p1"), pick("s", "ts").alias("s1"), pick("t", "p").alias("p2"), pick("ts", "s").alias("s2"), F.when(ahead, 0).otherwise(1).alias("side"), "pop", *values)
        groups = small.union(wide)
    groups = groups.repartition(*GROUP).sortWithinPartitions(*GROUP, "side", "pop")
    return groups.select(*GROUP, "side", *values).mapInArrow(compare(radii), LINKS)


def components(fps: DataFrame, radii: tuple[int, ...] = (RADIUS,), tile: int = TILE) -> DataFrame:
    """(f, component_id): for each distinct fingerprint of (doc_id, fp), the smallest doc_id that it
    reaches over links. Of rows with equal fp the least ``more`` confirms."""
    values = VALUES[: len(radii)]
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), *[F.min(c).alias(c) for c in values[1:]]), "distinct")
    found = materialize(links(distinct.select(*values), distinct.count(), radii, tile), "close")
    release(fps.sparkSession)
    nodes = materialize(connected_components(found), "nodes")
    forget(found)
    least = nodes.join(distinct, F.col("node") == F.col("fp")).groupBy("root").agg(F.min("least").alias("id"))
    linked = nodes.join(least.withColumnRenamed("root", "r"), F.col("root") == F.col("r")).select("node", "id")
    out = distinct.join(linked, F.col("fp") == F.col("node"), "left")
    return materialize(out.select(F.col("fp").alias("f"), F.when(F.col("node").isNull(), F.col("least")).otherwise(F.col("id")).alias("component_id")), "components")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    fps = materialize(fingerprints(docs), "fingerprints")
    classes = components(fps, (radius,), tile)
    joined = fps.join(classes, F.col("fp") == F.col("f"))
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, widths: tuple[int, ...] = NEAR_WIDTHS, radii: tuple[int, ...] = (NEAR_RADIUS, CONFIRM_RADIUS), tile: int = TILE) -> DataFrame:
    """The row with the smallest doc_id of each group, with the columns of docs. Of rows that share
    that doc_id the one with the least text stays; rows without a doc_id cannot be named by a group
    and all stay."""
    fps = materialize(fingerprints(docs, widths), "fingerprints")
    classes = components(fps, radii, tile)
    stays = F.coalesce(F.bool_or(F.col("doc_id") == F.col("component_id")), F.lit(False))
    ids = fps.join(classes, F.col("fp") == F.col("f")).where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(stays.alias("stays"), F.count("*").alias("n"))
    # Ids that go or that several rows share are fewer than those that stay: Spark broadcasts them
    # while they are under its threshold, and texts move only beyond it.
    marked = materialize(ids.where(~F.col("stays") | (F.col("n") > 1)).select(F.col("doc_id").alias("__id"), "stays"), "marked")
    out = docs.join(marked.select("__id"), docs["doc_id"] == F.col("__id"), "left_anti")
    shared = marked.where("stays")
    if not shared.isEmpty():
        rows = docs.join(shared.select("__id"), docs["doc_id"] == F.col("__id"), "left_semi")
        one = F.min_by(F.struct(*[docs[c] for c in docs.columns]), F.struct(docs["text"], F.xxhash64(*[docs[c] for c in docs.columns])))
        out = out.union(rows.groupBy(docs["doc_id"]).agg(one.alias("__row")).select("__row.*"))
    return out
