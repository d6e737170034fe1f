"""Suffix and fingerprint deduplication against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from llm_words import WORDS

from marlstone.llm import common, logindex, rolling, suffixes


def removed_bytes(texts, depth):
    counts = Counter(t[i : i + depth] for t in texts for i in range(len(t) - depth + 1))
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - depth + 1):
            if counts[t[i : i + depth]] > 1:
                gone[i : i + depth] = b"\1" * depth
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        yield len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()


def shared_words(rows, width):
    """Words covered by windows of another document, and of a document with a smaller id."""
    docs = {}
    words = [(float("inf") if r[0] is None else r[0], WORDS.findall(r[1] or "")) for r in rows]
    for i, w in words:
        for k in range(len(w) - width + 1):
            docs.setdefault(tuple(w[k : k + width]), set()).add(i)
    for i, w in words:
        shared, later = [False] * len(w), [False] * len(w)
        for k in range(len(w) - width + 1):
            have = docs[tuple(w[k : k + width])]
            if len(have) > 1:
                shared[k : k + width] = [True] * width
            if min(have) < i:
                later[k : k + width] = [True] * width
        yield sum(shared), sum(later)


@pytest.mark.parametrize(("depth", "anchor", "words", "word_anchor"), [(400, 256, 50, 20), (40, 16, 10, 4), (12, 12, 3, 3)])
def test_suffixes(documents, fixture_rows, depth, anchor, words, word_anchor):
    texts = [(r[1] or "").encode() for r in fixture_rows]
    want = {r[0]: (*w, *x) for r, w, x in zip(fixture_rows, removed_bytes(texts, depth), shared_words(fixture_rows, words))}
    got = {r.doc_id: tuple(r)[1:] for r in suffixes.deduplicate(documents, depth, anchor, words, word_anchor).collect()}
    assert got == want


def test_shared_words_under_one_anchor(spark):
    """Near copies, repeats inside one document, equal windows in unequal covers."""
    r = np.random.default_rng(5)
    base = [f"w{x}" for x in r.integers(0, 6, 300)]
    rows = []
    for i in range(60):
        t = list(base)
        for p in r.integers(0, 300, 3):
            t[p] = "changed"
        rows.append((int(r.integers(0, 40)), " ".join(t[int(r.integers(0, 50)) :] + (t[:90] if i % 7 == 0 else []))))
    rows += [(None, rows[0][1]), (None, rows[1][1]), rows[5]]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted((str(i), s, x) for (i, _), (s, x) in zip(rows, shared_words(rows, 12)))
    got = sorted((str(r.doc_id), r.n_shared_words, r.n_later_words) for r in suffixes.deduplicate(d, 40, 16, 12, 4).collect())
    assert got == want


def test_suffixes_segments(documents, fixture_rows, monkeypatch):
    monkeypatch.setattr(suffixes, "SEGMENT", 700)
    texts = [(r[1] or "").encode() for r in fixture_rows]
    want = {r[0]: w for r, w in zip(fixture_rows, removed_bytes(texts, 40))}
    assert {r.doc_id: tuple(r)[1:5] for r in suffixes.deduplicate(documents, 40, 16).collect()} == want


def test_word_hashes_in_pieces(fixture_rows):
    for r in fixture_rows:
        t = (r[1] or "").encode()
        assert np.array_equal(common.word_hashes_of(t, 50), common.word_hashes_of(t))


def test_suffixes_repeated_rows(spark):
    text = "".join(chr(97 + i * i % 23) for i in range(900))
    d = spark.createDataFrame([(1, text), (1, text), (None, text[100:]), (None, None), (2, "short")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in suffixes.deduplicate(d).collect())
    assert got == [("1", 900, 900), ("1", 900, 900), ("2", 5, 0), ("None", 0, 0), ("None", 800, 800)]


def test_empty(empty):
    assert suffixes.deduplicate(empty).collect() == []
    assert logindex.deduplicate(empty).collect() == []


def test_rolling():
    values = np.random.default_rng(1).integers(0, 2**63, 300, dtype=np.uint64)
    values[100:150] = values[200:250]
    h = rolling.windows(values, 20, rolling.BASE)
    assert np.array_equal(h[100:131], h[200:231]) and len(np.unique(h)) == len(h) - 31
    assert len(rolling.windows(values[:5], 20, rolling.BASE)) == 0
    v = np.random.default_rng(2).integers(0, 1000, 77).astype(np.uint64)
    assert np.array_equal(rolling.sliding_least(v, 10), [v[i : i + 10].min() for i in range(68)])


def removed_words(rows, width):
    first = {}
    words = [(float("inf") if r[0] is None else r[0], WORDS.findall(r[1] or "")) for r in rows]
    for i, w in words:
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            first[key] = min(first.get(key, i), i)
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        yield len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()


@pytest.mark.parametrize("width", [13, 3])
def test_log_index(documents, fixture_rows, width):
    want = {r[0]: w for r, w in zip(fixture_rows, removed_words(fixture_rows, width))}
    got = {r.doc_id: tuple(r)[1:] for r in logindex.deduplicate(documents, width).collect()}
    assert got == want


def test_log_index_batches(documents, fixture_rows, monkeypatch):
    monkeypatch.setattr(logindex, "FLUSH", 500)
    want = {r[0]: w for r, w in zip(fixture_rows, removed_words(fixture_rows, 5))}
    for batches in (1, 6):
        assert {r.doc_id: tuple(r)[1:] for r in logindex.deduplicate(documents, 5, batches).collect()} == want


def test_log_index_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(5, text), (5, text), (None, text), (9, text + " more"), (None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in logindex.deduplicate(d).collect())
    assert got == [("5", 40, 0), ("5", 40, 0), ("9", 41, 40), ("None", 0, 0), ("None", 40, 40)]


def test_packing():
    r = np.random.default_rng(3)
    keys = np.sort(r.integers(0, 2**63, 1000, dtype=np.uint64))
    ids = r.integers(-50, 10**12, 1000)
    assert np.array_equal(logindex.unpack_sorted(logindex.pack_sorted(keys)), keys)
    assert np.array_equal(logindex.unpack_ids(logindex.pack_ids(ids)), ids)
    assert len(logindex.pack_sorted(keys)) < 8 * 1000


def test_runs_have_a_file_a_bucket(spark, monkeypatch):
    """Hits of many documents in every bucket of the index: files of a run grow with the buckets of
    the index, not with these times those of documents."""
    r = np.random.default_rng(9)
    shared = [" ".join(f"s{x}" for x in r.integers(0, 1000, 200)) for _ in range(4)]
    rows = [(i, shared[i % 4] + " " + " ".join(f"o{x}" for x in r.integers(0, 10**6, 40))) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(logindex, "FLUSH", 500)
    index = logindex.FingerprintIndex(spark, 16, 41)
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        index.ingest(docs.where("doc_id < 160"))
        assert 0 < len(spark.read.table(index.runs[0][0]).inputFiles()) <= index.buckets
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    index.ingest(docs.where("doc_id >= 160"))
    index.ingest(docs.where("false"))
    hits = index.hits()
    index.drop()
    got = sorted((int(d), int(s)) for x in hits.collect() for d, s, _ in zip(*logindex.unpack_hits(pd.DataFrame([x.asDict()]))))
    # Each window of a shared passage beyond its first document.
    assert sorted({d for d, _ in got}) == list(range(4, 240)) and all(s < d for d, s in got)
    assert len(got) >= 236 * 188 and hits.count() == len({d % 41 for d in range(4, 240)})
    out = logindex.remove_hits(docs, hits, 41).collect()
    assert {x.doc_id: x.n_removed for x in out} == {i: 200 * (i >= 4) for i in range(240)}
