"""Substring deduplication against a log-structured fingerprint index.

The index holds the hash of every 13-word window of the documents taken in so far, with the
smallest doc_id that has it, as immutable runs: bucketed tables of sorted hashes, packed a bucket a
row. A batch is hashed where its texts are read; each task sorts its windows, keeps one entry a
distinct window, and settles repeats inside the task at once, so that a window in a third of all
documents costs one entry a task. Entries are then merge-joined, bucket by bucket, with the runs
(whose buckets stay where they are); what the index lacks becomes a new run, and runs of like size
are compacted into one. A hit names the document that has the window; every hit is verified
against that document's text, byte by byte, before a word is removed. Hits stay in the bucket of the
index that found them, so that a run has a file a bucket, and are dealt to documents once, at the end.

Batches of ``deduplicate`` go by ascending doc_id, so that a run only holds smaller ids.

Defined results: a null text has no words; a null doc_id counts as the largest and is returned as
null; rows with the same doc_id count as one document and lose nothing to each other; texts under
13 words lose nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import BINARY, INT, LONG, STRING, materialize, release, schema, text_views, word_bounds
from marlstone.llm.rolling import BASE, SPREAD, WORD_BASE, mixed, slices, windows

#: Words of a window.
WIDTH = 13
#: Bytes of text hashed at a time, and windows that a task sorts at a time.
CHUNK, FLUSH = 1 << 19, 1_000_000
#: Windows and bytes of text that a bucket of the index or of documents gets on average.
PER_BUCKET, TEXT_PER_BUCKET = 400_000, 6_000_000
#: Entries of one row of a run: rows of a few megabytes keep Spark's buffers small.
PER_ROW = 200_000
#: Batches of deduplicate().
BATCHES = 3
NONE = np.iinfo(np.int64).max


def pack(values: np.ndarray) -> bytes:
    """uint64 values as byte planes, compressed: the planes that are mostly zero vanish."""
    planes = np.ascontiguousarray(np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.compress(planes.tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def pack_ids(ids: np.ndarray) -> bytes:
    """int64 values by their distance from the least."""
    least = ids.min() if len(ids) else np.int64(0)
    return int(least).to_bytes(8, "little", signed=True) + pack((ids - least).view(np.uint64))


def unpack_ids(data: bytes) -> np.ndarray:
    return unpack(data[8:]).view(np.int64) + np.int64(int.from_bytes(data[:8], "little", signed=True))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of several texts, and the first word of each text."""
    starts, ends, first = word_bounds(data, offsets)
    return slices(SPREAD[data], starts, ends, BASE), first


ENTRIES = schema(bucket=INT, kind=INT, keys=BINARY, docs=BINARY, sources=BINARY)
#: Kinds of rows: entries of a batch or run, and hits. ``bucket`` is one of the index, and of
#: documents once hits are dealt to these.
ENTRY, HIT = 0, 1


def by_bucket(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """(bucket, columns of its rows) in order of buckets, keeping the order of rows in each."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for b, *parts in zip(bucket[np.concatenate([[0], cuts])], *(np.split(c[order], cuts) for c in columns), strict=True):
        yield int(b), *parts


def hit_row(bucket: int, docs: np.ndarray, sources: np.ndarray, keys: np.ndarray) -> tuple:
    """Hits by document, packed. A hash's lower half is enough to mark a window in its document:
    what is marked is verified byte by byte."""
    order = np.lexsort((sources, docs))
    docs, sources = docs[order], sources[order]
    steps = pack_sorted(docs.view(np.uint64))
    return bucket, HIT, keys[order].astype("<u4").tobytes(), steps, pack_ids(sources)


def hit_rows(docs: np.ndarray, sources: np.ndarray, keys: np.ndarray, document_buckets: int) -> Iterator[tuple]:
    """Hits packed by bucket of documents."""
    for b, d, s, k in by_bucket(spread(docs, document_buckets), docs, sources, keys):
        yield hit_row(b, d, s, k)


def held_hits(docs: np.ndarray, sources: np.ndarray, keys: np.ndarray, home) -> Iterator[tuple]:
    """Hits packed in few rows for the index; home gives a row's bucket by its first document."""
    order = np.argsort(docs, kind="stable")
    docs, sources, keys = docs[order], sources[order], keys[order]
    for a in range(0, len(docs), PER_ROW):
        part = slice(a, a + PER_ROW)
        yield hit_row(home(docs[a]), docs[part], sources[part], keys[part])


def unpack_hits(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, sources and halves of hashes of some rows of hits."""
    docs = np.concatenate([np.zeros(0, np.int64), *(unpack_sorted(x).view(np.int64) for x in rows["docs"])])
    sources = np.concatenate([np.zeros(0, np.int64), *(unpack_ids(x) for x in rows["sources"])])
    return docs, sources, np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(x, "<u4") for x in rows["keys"])])


def spread(ids: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a document, pmod() in the JVM; buckets are odd in number, so that ids in
    steps of a power of two spread too."""
    return ids % buckets


def to_entries(buckets: int, width: int):
    shift = np.uint64(64 - (buckets - 1).bit_length()) if buckets > 1 else None

    def home(doc: np.int64) -> int:
        """A bucket for what a task settles by itself, which no window ties to one."""
        return int(mixed(np.array([doc], np.int64).view(np.uint64))[0] >> shift) if shift is not None else 0

    def flush(keys: np.ndarray, docs: np.ndarray) -> Iterator[tuple]:
        if np.any(np.diff(docs) < 0):
            order = np.argsort(docs, kind="stable")
            keys, docs = keys[order], docs[order]
        order = np.argsort(keys, kind="stable")
        keys, docs = keys[order], docs[order]
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        least = docs[np.flatnonzero(new)][np.cumsum(new) - 1]
        again = docs > least
        yield from held_hits(docs[again], least[again], keys[again], home)
        keys, docs = keys[new], docs[new]
        place = (keys >> shift).astype(np.int64) if shift is not None else np.zeros(len(keys), np.int64)
        for b, k, d in by_bucket(place, keys, docs):
            yield b, ENTRY, pack_sorted(k), pack_ids(d), None

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, docs, n = [], [], 0
        for batch in batches:
            ids = batch.column("doc_id").fill_null(NONE).to_numpy()
            for row, end, data, offsets in text_views(batch, "text", CHUNK):
                words, first = word_hashes(data, offsets)
                h = windows(words, width, WORD_BASE)
                text = np.repeat(np.arange(row, end), np.diff(first))
                whole = text[: len(h)] == text[len(text) - len(h) :]
                keys.append(h[whole])
                docs.append(ids[text[: len(h)][whole]])
                n += len(keys[-1])
                if n >= FLUSH:
                    yield table(flush(np.concatenate(keys), np.concatenate(docs)), ENTRIES)
                    keys, docs, n = [], [], 0
        if n:
            yield table(flush(np.concatenate(keys), np.concatenate(docs)), ENTRIES)

    return scan


def table(rows, kind) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in kind.names]
    types = {INT: pa.int32(), LONG: pa.int64(), BINARY: pa.binary(), STRING: pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, types[f.dataType]) for c, f in zip(columns, kind, strict=True)], names=kind.names)


def merged(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """All entries of some rows in order of hash, then of document."""
    if rows.empty:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys = np.concatenate([unpack_sorted(x) for x in rows["keys"]])
    docs = np.concatenate([unpack_ids(x) for x in rows["docs"]])
    if len(rows) == 1:
        return keys, docs
    order = np.lexsort((docs, keys))
    return keys[order], docs[order]


def run_rows(bucket: int, keys: np.ndarray, docs: np.ndarray) -> list[tuple]:
    """A bucket of a run: entries in order, a few rows."""
    cuts = range(0, len(keys), PER_ROW)
    return [(bucket, ENTRY, pack_sorted(keys[a : a + PER_ROW]), pack_ids(docs[a : a + PER_ROW]), None) for a in cuts]


def to_run(batch: pd.DataFrame, runs: pd.DataFrame) -> pd.DataFrame:
    """Merge-joins the entries of a batch in one bucket with those of the runs: hits, and a run of
    what the runs lack. All rows stay in the bucket."""
    local = batch["kind"] == HIT
    out = list(batch[local].itertuples(index=False, name=None))
    batch = batch[~local]
    if not batch.empty:
        bucket = int(batch["bucket"].iloc[0])
        keys, docs = merged(batch)
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        first = np.flatnonzero(new)
        source = docs[first].copy()
        known = np.zeros(len(first), bool)
        old, owners = merged(runs)
        if len(old):
            at = np.minimum(np.searchsorted(old, keys[first]), len(old) - 1)
            known = old[at] == keys[first]
            source[known] = np.minimum(source[known], owners[at[known]])
        source = source[np.cumsum(new) - 1]
        hit = docs > source
        out += held_hits(docs[hit], source[hit], keys[hit], lambda _: bucket)
        out += run_rows(bucket, keys[first][~known], docs[first][~known])
    return pd.DataFrame(out, columns=ENTRIES.names)


def compacted(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
    """One run of two: the smallest document of each hash, and the hits of both as they are."""
    rows = pd.concat([x for x in (one, two) if not x.empty])
    bucket = int(rows["bucket"].iloc[0])
    out = list(rows[rows["kind"] == HIT].itertuples(index=False, name=None))
    keys, docs = merged(rows[rows["kind"] == ENTRY])
    if len(keys):
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        out += run_rows(bucket, keys[new], docs[new])
    return pd.DataFrame(out, columns=ENTRIES.names)


def to_documents(document_buckets: int):
    """Deals held hits to buckets of documents, about FLUSH hits at a time."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                held.append(unpack_hits(batch.slice(i, 1).to_pandas()))
                n += len(held[-1][0])
                if n >= FLUSH:
                    yield table(hit_rows(*map(np.concatenate, zip(*held)), document_buckets), ENTRIES)
                    held, n = [], 0
        if n:
            yield table(hit_rows(*map(np.concatenate, zip(*held)), document_buckets), ENTRIES)

    return deal


def gathered(rows: pd.DataFrame) -> pd.DataFrame:
    """The hits of one bucket of documents in one row."""
    return pd.DataFrame([hit_row(int(rows["bucket"].iloc[0]), *unpack_hits(rows))], columns=ENTRIES.names)


class FingerprintIndex:
    """Runs of window hashes in tables of the warehouse, ``buckets`` files each at most. A run also
    holds the hits of the batches that made it, in the buckets that found them: by bucket of documents,
    each bucket would write a file for each of those, and the driver lists them all."""

    def __init__(self, spark: SparkSession, buckets: int, document_buckets: int, width: int = WIDTH):
        self.spark, self.width, self.document_buckets = spark, width, document_buckets
        self.buckets = 1 << max(0, (buckets - 1).bit_length())
        self.name = f"fingerprints_{uuid.uuid4().hex}"
        #: (table, level): a run of level n comes from two of level n - 1.
        self.runs: list[tuple[str, int]] = []
        self.made = 0

    def _save(self, rows: DataFrame) -> str:
        self.made += 1
        name = f"{self.name}_{self.made}"
        rows.write.format("parquet").option("compression", "uncompressed").bucketBy(self.buckets, "bucket").sortBy("bucket").saveAsTable(name)
        return name

    def _runs(self, kind: int) -> DataFrame:
        """Rows of a kind of all runs. A single run keeps its buckets; more are brought together."""
        out = None
        for name, _ in self.runs:
            rows = self.spark.read.table(name).where(F.col("kind") == kind)
            out = rows if out is None else out.union(rows)
        return self.spark.createDataFrame([], ENTRIES) if out is None else out

    def ingest(self, docs: DataFrame) -> None:
        """Takes in (doc_id, text). The ids must be larger than those taken in before for a hit to
        mean a smaller doc_id."""
        batch = docs.select("doc_id", "text").mapInArrow(to_entries(self.buckets, self.width), ENTRIES)
        runs = self._runs(ENTRY)
        name = self._save(batch.groupBy("bucket").cogroup(runs.groupBy("bucket")).applyInPandas(to_run, ENTRIES))
        del batch, runs
        self.runs.append((name, 0))
        release(self.spark)
        self.compact()

    def compact(self) -> None:
        """Joins the two newest runs while they are of one level; their buckets stay in place."""
        while len(self.runs) >= 2 and self.runs[-1][1] == self.runs[-2][1]:
            names, level = [n for n, _ in self.runs[-2:]], self.runs[-1][1]
            one, two = (self.spark.read.table(n).groupBy("bucket") for n in names)
            name = self._save(one.cogroup(two).applyInPandas(compacted, ENTRIES))
            self.runs[-2:] = [(name, level + 1)]
            for n in names:
                self.spark.sql(f"DROP TABLE {n}")

    def hits(self) -> DataFrame:
        """All hits, a row for each bucket of documents that has any."""
        dealt = self._runs(HIT).mapInArrow(to_documents(self.document_buckets), ENTRIES)
        return materialize(dealt.groupBy("bucket").applyInPandas(gathered, ENTRIES), "hits", "uncompressed")

    def drop(self) -> None:
        for n, _ in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {n}")
        self.runs = []


RESULT = schema(doc_id=LONG, n_words=LONG, n_removed=LONG, kept_sha256=STRING)
#: Kinds of rows of the last step, besides HIT: a document, and a document that hits name.
OWN, SOURCE = 2, 3


def first_of_each(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the first place of each."""
    return np.unique(keys, return_index=True)


def apply_hits(width: int):
    """One bucket of documents: verifies the hits against the bytes of the documents that they
    name, and removes the words that verified windows cover."""

    def verified(text: bytes, at: np.ndarray, k: np.ndarray, p: np.ndarray, source: bytes, sat: np.ndarray, sk: np.ndarray, sp: np.ndarray) -> np.ndarray:
        """Whether the windows at p of a document occur in another, byte by byte. Both texts have
        words joined by one space, which start at ``at`` and ``sat`` (and one more beyond the last);
        sk are the other's distinct window hashes in order, sp their first places. Windows that
        follow one another in both texts are compared at once, and singly where they differ."""
        equal = np.zeros(len(p), bool)
        if not len(sk):
            return equal
        j = np.minimum(np.searchsorted(sk, k[p]), len(sk) - 1)
        hit = np.flatnonzero(sk[j] == k[p])
        p, q = p[hit], sp[j[hit]]
        cuts = np.flatnonzero((np.diff(p) != 1) | (np.diff(q) != 1)) + 1

        def alike(x: int, y: int, n: int) -> bool:
            """Whether n words from x on are those from y on."""
            return text[at[x] : at[x + n] - 1] == source[sat[y] : sat[y + n] - 1]

        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(p)]):
            if a < b and alike(p[a], q[a], b - a + width - 1):
                equal[hit[a:b]] = True
            else:
                equal[hit[a:b]] = [alike(p[i], q[i], width) for i in range(a, b)]
        return equal

    def hashed(rows: pd.DataFrame) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray]]:
        """For each row its id, its words joined by one space, where these start, window hashes."""
        for i, t in zip(rows["id"], rows["text"], strict=True):
            t = b" ".join(bytes(t).split())
            data = np.frombuffer(t, np.uint8)
            starts, ends, _ = word_bounds(data, np.array([0, len(t)]))
            at = np.append(starts, len(t) + 1)
            yield i, t, at, windows(slices(SPREAD[data], starts, ends, BASE), width, WORD_BASE)

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        hits = rows[rows["kind"] == HIT]
        docs, names, keys = unpack_hits(hits)
        order = np.lexsort((keys, docs))
        docs, names, keys = docs[order], names[order], keys[order]
        sources: dict[int, list[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]] = {}
        for i, t, at, k in hashed(rows[rows["kind"] == SOURCE]):
            sources.setdefault(i, []).append((t, at, *first_of_each(k)))
        out = []
        for i, text, starts, k in hashed(rows[rows["kind"] == OWN]):
            n = len(starts) - 1
            a, b = np.searchsorted(docs, i, "left"), np.searchsorted(docs, i, "right")
            gone = np.zeros(n + 1, np.int64)
            if b > a and len(k):
                half = k.astype(np.uint32)
                mine, named = keys[a:b], names[a:b]
                at = np.searchsorted(mine, half)
                right = np.zeros(len(k), bool)
                # Hits of one half of a hash are tried in turn until one holds.
                while True:
                    place = np.flatnonzero((at < b - a) & ~right)
                    place = place[mine[at[place]] == half[place]]
                    if not len(place):
                        break
                    name = named[at[place]]
                    for s in np.unique(name):
                        p = place[name == s]
                        for source in sources.get(int(s), []):
                            right[p] |= verified(text, starts, k, p, *source)
                    at += 1
                place = np.flatnonzero(right)
                np.add.at(gone, place, 1)
                np.add.at(gone, np.minimum(place + width, n), -1)
            kept = np.cumsum(gone)[:-1] == 0
            tokens = text.split()
            digest = hashlib.sha256(b" ".join([tokens[x] for x in np.flatnonzero(kept)])).hexdigest()
            out.append((None if i == NONE else i, n, int(n - kept.sum()), digest))
        return pd.DataFrame(out, columns=RESULT.names).astype({"doc_id": "Int64"})

    return work


PAIRS = schema(bucket=INT, source=LONG)


def named_sources(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct documents that each packed row of hits names."""
    for batch in batches:
        rows = [(b, s) for b, x in zip(batch.column("bucket").to_pylist(), batch.column("sources").to_pylist(), strict=True) for s in np.unique(unpack_ids(x)).tolist()]
        yield table(rows, PAIRS)


def remove_hits(docs: DataFrame, hits: DataFrame, document_buckets: int, width: int = WIDTH) -> DataFrame:
    """A row for each of docs without the words that verified hits (a row a bucket) cover."""
    id_ = F.coalesce(F.col("doc_id"), F.lit(int(NONE)))
    texts = docs.select(id_.alias("id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    empty = F.lit(None).cast("binary")
    own = texts.select(F.pmod("id", F.lit(document_buckets)).cast("int").alias("bucket"), F.lit(OWN).alias("kind"), "id", "text", empty.alias("keys"), empty.alias("docs"), empty.alias("sources"))
    pairs = hits.select("bucket", "sources").mapInArrow(named_sources, PAIRS)
    needed = materialize(pairs.join(texts, F.col("source") == F.col("id")).select("bucket", "id", "text"), "sources")
    needed = needed.select("bucket", F.lit(SOURCE).alias("kind"), "id", "text", empty.alias("keys"), empty.alias("docs"), empty.alias("sources"))
    release(docs.sparkSession)
    packed = hits.select("bucket", "kind", F.lit(0).cast("long").alias("id"), empty.alias("text"), "keys", "docs", "sources")
    return own.union(needed).union(packed).groupBy("bucket").applyInPandas(apply_hits(width), RESULT)


def deduplicate(docs: DataFrame, width: int = WIDTH, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row, when documents come in order of
    doc_id in ``batches`` batches."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    cuts = [F.expr(f"approx_percentile(doc_id, {i / batches}, 1000)") for i in range(1, batches)]
    first = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)), *cuts).first()
    buckets = max(16, int(first[0]) // 6 // batches // PER_BUCKET)
    document_buckets = max(16, int(first[0]) // TEXT_PER_BUCKET) | 1
    index = FingerprintIndex(spark, buckets, document_buckets, width)
    edges = [None, *sorted({x for x in first[1:] if x is not None}), None]
    for low, high in zip(edges, edges[1:]):
        batch = docs
        if low is not None:
            batch = batch.where((F.col("doc_id") > low) | F.col("doc_id").isNull() if high is None else F.col("doc_id") > low)
        if high is not None:
            batch = batch.where(F.col("doc_id") <= high)
        index.ingest(batch)
    hits = index.hits()
    index.drop()
    release(spark)
    return remove_hits(docs, hits, document_buckets, width)
