"""Token ids in a binary format: frequency-ranked, byte-aligned, with separate control bytes.

Ids are replaced by their rank in the corpus, most frequent first, and ranks take one to four bytes,
little-endian. Control bytes hold the lengths of four ranks each, two bits a rank from the low bits
up; they are stored apart from the data bytes. A file is a Parquet file in the shared folder; its
rows are blocks of whole documents in ascending order of doc_id, and each shard starts a file:

    shard, block   int     place in the order; blocks of a shard follow each other
    start          long    ids in the shard before the block
    doc_ids        binary  int64 little-endian, one a document
    valid          binary  one byte a document: 0 where doc_id is null
    lengths        binary  int32 little-endian, ids of each document with the end id
    control, data  binary  the coded ranks

The ranks' table lies beside the files. Spark's writer commits whole files, so a lost executor
costs its unfinished file only. Decoding is a table lookup: 256 rows of four lengths.

Texts are cut into pieces with numpy as the tokenizer's pattern cuts them; its model works on each
distinct piece once, so encoding is a lookup as well. A piece is known by a 64-bit hash.

Defined results: a null or empty text has the end id alone; null doc_ids come first; rows with the
same doc_id follow each other in order of their texts; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import BINARY, INT, LONG, SPACE_BYTES, forget, materialize, new_path, release, schema, text_views, word_bounds
from marlstone.llm.rolling import BASE, SPREAD, shared, slices

#: The id that ends each document.
END = 2
#: Ids of a block after which the next documents start a new one, distinct pieces kept, and bytes
#: of text encoded at a time.
BLOCK, CACHE, CHUNK = 250_000, 400_000, 1 << 20
#: Bytes of text that a shard gets on average.
SHARD = 32_000_000


# Classes of bytes, by which words are cut as the tokenizer's pattern cuts them: runs of letters,
# single numbers, runs of other characters. It is done here for printable characters below U+0100;
# words with any other, with an apostrophe (contractions) or with "<|" (special tokens) are HARD
# and go through the tokenizer whole.
LETTER, NUMBER, OTHER, HARD = 1, 2, 3, 4
ONE = np.full(256, HARD, np.uint8)
ONE[0x21:0x7F] = OTHER
ONE[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
ONE[0x30:0x3A] = NUMBER
ONE[0x27] = HARD
#: Classes of the characters that C2 and C3 begin, by the lead's last bit and the second byte.
TWO = np.full(512, HARD, np.uint8)
TWO[0xA1:0xC0] = OTHER
TWO[0xAD] = HARD
TWO[[0xAA, 0xB5, 0xBA]] = LETTER
TWO[[0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = NUMBER
TWO[256 + 0x80 : 256 + 0xC0] = LETTER
TWO[[256 + 0x97, 256 + 0xB7]] = OTHER
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: Bytes that the byte alphabet does not spell as the character of their number: it takes the next
#: free ones from U+0100, in order.
PRINTED = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
SPELLING = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in PRINTED)}


def pieces(data: np.ndarray, offsets: np.ndarray, cut: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of several texts with pieces in lower case, starts and ends of pieces, and which
    are whole HARD words (left as they are). Without ``cut`` all words are."""
    starts, ends, _ = word_bounds(data, offsets)
    n = len(data)
    after = np.zeros(n, np.uint8)
    after[:-1] = data[1:]
    kind = ONE[data]
    lead = (data & 0xFE) == 0xC2
    kind[lead] = TWO[(data[lead] & 1).astype(np.int64) * 256 + after[lead]]
    second = np.zeros(n, bool)
    second[1:] = lead[:-1]
    kind[1:][lead[:-1]] = kind[:-1][lead[:-1]]
    hard = ((kind == HARD) & ~SPACE_BYTES[data]) | ((data == 0x3C) & (after == 0x7C))
    sums = np.zeros(n + 1, np.int64)
    np.cumsum(hard, out=sums[1:])
    hard_word = sums[ends] > sums[starts] if cut else np.ones(len(starts), bool)
    steps = np.zeros(n + 1, np.int8)
    steps[starts[hard_word]] += 1
    steps[ends[hard_word]] -= 1
    in_hard = np.cumsum(steps[:n], dtype=np.int8) > 0
    begins = np.zeros(n, bool)
    begins[1:] = ~SPACE_BYTES[data[1:]] & ~in_hard[1:] & ((kind[1:] != kind[:-1]) | ((kind[1:] == NUMBER) & ~second[1:]))
    begins[starts] = True
    at = np.flatnonzero(begins)
    word = np.searchsorted(starts, at, "right") - 1
    until = np.append(at[1:], n)
    until = np.minimum(until, ends[word])
    low = LOWER[data]
    upper = np.zeros(n, bool)
    upper[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    low[upper] += 0x20
    return np.where(in_hard, data, low), at, until, hard_word[word]


class Encoder:
    """Ids of texts by the tokenizer of a file, with a table of pieces already seen."""

    def __init__(self, path: str, end: int = END):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_file(path), end
        self.model = self.tokenizer.model
        self.clear()
        self.cut = True
        self.cut = self._cuts_alike()
        self.clear()

    def clear(self) -> None:
        """Forgets all pieces but the end id, which has place 0."""
        self.places: dict[int, int] = {}
        self.flat = np.array([self.end], np.uint32)
        self.begin, self.count = np.zeros(1, np.int64), np.ones(1, np.int64)
        self.rows = 1

    def _cuts_alike(self) -> bool:
        """Whether pieces and model agree with the tokenizer on words that tell other cuts."""
        probes = ["don't", "WE'LL", "a1b22", "x--y", "\u00c9t\u00e9", "\u00b5m\u00b2", "(foo).", "na\u00efve\u00bf", "``a''"]
        whole = [[*self.tokenizer.encode(w, add_special_tokens=False).ids, self.end] for w in probes]
        return [self.encode([w])[0].tolist() for w in probes] == whole

    def _learn(self, keys: list[int], found: list[bytes], hard: list[bool]) -> np.ndarray:
        """Enters pieces, and their places."""
        ids, sizes = [], []
        model, tokenizer = self.model.tokenize, self.tokenizer.encode
        for piece, whole in zip(found, hard, strict=True):
            if whole:
                new = tokenizer(piece.decode(), add_special_tokens=False).ids
            else:
                new = [t.id for t in model(piece.decode() if piece.isascii() else piece.decode("latin-1").translate(SPELLING))]
            ids += new
            sizes.append(len(new))
        places = np.arange(self.rows, self.rows + len(keys))
        self.places.update(zip(keys, places.tolist(), strict=True))
        ends = len(self.flat) + np.cumsum(sizes, dtype=np.int64)
        self.begin = np.concatenate([self.begin, ends - np.array(sizes, np.int64)])
        self.count = np.concatenate([self.count, np.array(sizes, np.int64)])
        self.flat = np.concatenate([self.flat, np.array(ids, np.uint32)])
        self.rows += len(keys)
        return places

    def encode_views(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of several texts, each with the end id, and their numbers."""
        if self.rows > CACHE:
            self.clear()
        low, starts, ends, hard = pieces(data, offsets, self.cut)
        keys, first, which = np.unique(slices(SPREAD[low], starts, ends, BASE), return_index=True, return_inverse=True)
        get = self.places.get
        places = np.array([get(k, -1) for k in keys.tolist()], np.int64)
        text = low.tobytes()
        new = np.flatnonzero(places < 0)
        if len(new):
            f = first[new]
            found = [text[a:b] for a, b in zip(starts[f].tolist(), ends[f].tolist(), strict=True)]
            places[new] = self._learn(keys[new].tolist(), found, hard[f].tolist())
        closes = np.searchsorted(starts, offsets[1:])
        place = np.insert(places[which], closes, 0)
        count = self.count[place]
        up_to = np.cumsum(count)
        ids = self.flat[np.repeat(self.begin[place] - up_to + count, count) + np.arange(up_to[-1] if len(up_to) else 0)]
        return ids, np.diff(up_to[closes + np.arange(len(closes))], prepend=0)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text and the end id."""
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
        out = []
        for _, _, data, offsets in text_views(batch, "text", CHUNK):
            ids, sizes = self.encode_views(data, offsets)
            out += np.split(ids, np.cumsum(sizes)[:-1])
        return out


def encoder(path: str, end: int) -> Encoder:
    """The encoder that the tasks of a worker process share."""
    found = shared().get((path, end))
    if found is None:
        found = shared()[path, end] = Encoder(path, end)
    return found


#: Letters of a text by which rows of one doc_id are dealt to shards; more would go to the driver as
#: bounds of ranges.
RANGE_LETTERS = 64

COUNTS = schema(id=INT, n=LONG)


def raw_ids(row: pa.RecordBatch) -> np.ndarray:
    """The ids of one raw block, two or four bytes each. Blocks are taken one at a time, as a
    batch can hold a whole file of them."""
    data = row.column("data")[0].as_buffer()
    n = np.frombuffer(row.column("lengths")[0].as_buffer(), "<i4").sum(dtype=np.int64)
    return np.frombuffer(data, f"<u{max(data.size // max(n, 1), 1)}")


def count_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each id occurs in the raw blocks of a task."""
    counts = np.zeros(0, np.int64)
    for batch in batches:
        for k in range(batch.num_rows):
            n = np.bincount(raw_ids(batch.slice(k, 1)))
            if len(n) < len(counts):
                n, counts = counts, n
            n[: len(counts)] += counts
            counts = n
    ids = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(counts[ids], pa.int64())], names=COUNTS.names)


#: Bytes that a control byte's four ranks take, in all and each; places of each rank's bytes.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
SIZES = LENGTHS.sum(axis=1)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of ranks; the last control byte's spare ranks are not stored."""
    ranks = ranks.astype("<u4")
    code = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    spare = -len(ranks) % 4
    control = np.concatenate([code, np.zeros(spare, np.uint8)]).reshape(-1, 4)
    control = (control << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]]
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks of control and data bytes, by table lookup."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    ends = np.cumsum(lengths)
    data = np.frombuffer(data + b"\0\0\0", np.uint8)
    starts = ends - lengths
    out = np.zeros(n, np.uint32)
    for k in range(4):
        has = lengths > k
        if not has.any():
            break
        out[has] |= data[starts[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


BLOCKS = schema(shard=INT, block=INT, start=LONG, doc_ids=BINARY, valid=BINARY, lengths=BINARY, control=BINARY, data=BINARY)


def to_blocks(path: str, end: int):
    """Rows of one shard in order become its blocks, with raw ids in place of codes."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(path, end).encode_views
        shard = TaskContext.get().partitionId()
        block = start = held = 0
        docs, valid, sizes, parts = [], [], [], []

        def emit() -> pa.RecordBatch:
            columns = [np.concatenate(x) for x in (docs, valid, sizes, parts)]
            row = (shard, block, start, *(x.astype(k).tobytes() for x, k in zip(columns[:3], ("<i8", "u1", "<i4"), strict=True)), b"", columns[3].astype("<u2" if columns[3].max() < 1 << 16 else "<u4").tobytes())
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, KINDS, strict=True)], names=BLOCKS.names)

        for batch in batches:
            ids = batch.column("doc_id").fill_null(0).to_numpy()
            known = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            for row, stop, data, offsets in text_views(batch, "text", CHUNK):
                for x, new in zip((docs, valid, parts, sizes), (ids[row:stop], known[row:stop], *encode(data, offsets)), strict=True):
                    x.append(new)
                held += len(parts[-1])
                if held >= BLOCK:
                    yield emit()
                    block, start, held = block + 1, start + held, 0
                    docs, valid, sizes, parts = [], [], [], []
        if docs:
            yield emit()

    return scan


KINDS = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 5]


def to_codes(ranked: bytes):
    """Raw blocks become coded ones."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.frombuffer(ranked, "<u4")
        ranks = np.zeros(int(order.max()) + 1 if len(order) else 1, np.uint32)
        ranks[order] = np.arange(len(order), dtype=np.uint32)
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                codes = pack(ranks[raw_ids(row)])
                yield pa.RecordBatch.from_arrays([*row.columns[:6], *(pa.array([c], pa.binary()) for c in codes)], names=BLOCKS.names)

    return scan


DOCUMENTS = schema(doc_id=LONG, start=LONG, n_tokens=LONG, ids_crc32=LONG)


def decode(row: dict, order: np.ndarray) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, lengths and ids of a block."""
    lengths = np.frombuffer(row["lengths"], "<i4").astype(np.int64)
    ids = order[unpack(row["control"], row["data"], int(lengths.sum()))]
    return [d if v else None for d, v in zip(np.frombuffer(row["doc_ids"], "<i8").tolist(), row["valid"], strict=True)], lengths, ids


def to_documents(ranked: bytes, before: dict[int, int]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.frombuffer(ranked, "<u4")
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                docs, lengths, ids = decode(row, order)
                ends = np.cumsum(lengths)
                starts = ends - lengths
                crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                starts = starts + before[row["shard"]] + row["start"]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts), pa.array(lengths), pa.array(crcs, pa.int64())], names=DOCUMENTS.names)

    return scan


def write(docs: DataFrame, tokenizer: str, folder: str, end: int = END) -> None:
    """Writes the files of (doc_id, text) and the ranks' table under ``folder``. Texts are encoded
    once; the ids wait in a table until all are counted. A vocabulary bounds what is counted."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    # Rows of one doc_id, or of none, are many tasks' work: ranges go by the text's first letters too,
    # which agree with the order of whole texts.
    head = F.substring("text", 1, RANGE_LETTERS)
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(spark.sparkContext.defaultParallelism, int(size) // SHARD)
    sorted_ = docs.repartitionByRange(shards, "doc_id", head).sortWithinPartitions("doc_id", "text")
    raw = materialize(sorted_.mapInArrow(to_blocks(tokenizer, end), BLOCKS), "raw")
    release(spark)
    counted = raw.select("lengths", "data").mapInArrow(count_ids, COUNTS).groupBy("id").agg(F.sum("n").alias("n")).collect()
    order = np.array([r.id for r in sorted(counted, key=lambda r: (-r.n, r.id))], "<u4")
    raw.mapInArrow(to_codes(order.tobytes()), BLOCKS).write.option("compression", "uncompressed").parquet(f"{folder}/ids")
    spark.createDataFrame([(order.tobytes(),)], schema(ids=BINARY)).coalesce(1).write.parquet(f"{folder}/ranks")
    forget(raw)


def blocks(spark: SparkSession, folder: str) -> tuple[DataFrame, bytes, dict[int, int]]:
    """The blocks under a folder, ids by rank, and the ids before each shard. The driver gets one
    number a shard; shards are as many as files."""
    rows = spark.read.schema(BLOCKS).parquet(f"{folder}/ids")
    ranked = bytes(spark.read.parquet(f"{folder}/ranks").first()[0])
    sizes = rows.select("shard", "lengths").mapInArrow(block_sizes, schema(shard=INT, n=LONG)).groupBy("shard").agg(F.sum("n").alias("n")).collect()
    before, so_far = {}, 0
    for r in sorted(sizes, key=lambda r: r.shard):
        before[r.shard], so_far = so_far, so_far + r.n
    return rows, ranked, before


def block_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [int(np.frombuffer(x, "<i4").sum(dtype=np.int64)) for x in batch.column("lengths").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("shard"), pa.array(n, pa.int64())], names=["shard", "n"])


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the files under ``folder``."""
    rows, ranked, before = blocks(spark, folder)
    return rows.mapInArrow(to_documents(ranked, before), DOCUMENTS)


def round_trip(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """Writes the documents' ids to a new folder and returns what read() finds there."""
    folder = new_path(docs.sparkSession, "tokens")
    write(docs, tokenizer, folder, end)
    return read(docs.sparkSession, folder)


__all__ = ["round_trip", "read", "write", "pack", "unpack", "decode", "blocks"]
