"""The pipeline, stage by stage, against plain Python and SQL on a small folder of tables."""

import math
import random
import zlib

import duckdb
import numpy as np
import xxhash

import __spark_entry__ as entry
from marlstone.llm import logindex, queries, tokens, toxicity

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark):
    r = random.Random(11)
    items = [x.text for x in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").limit(6).collect()]
    texts = [x.text for x in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(70).collect()]
    for i in range(12):
        words = texts[i].split()
        for _ in range(max(1, len(words) // 100)):
            words[r.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += [texts[20], texts[20], "", None, "short text"]
    texts += [f"{texts[30 + i]} {item} {texts[40 + i]}" for i, item in enumerate(items)]
    return [(i, t, "en", r.choice(["s1", "s2", "s3", None]), len(t or "")) for i, t in enumerate(texts)]


def bits(words, width):
    shingles = [" ".join(words[i : i + width]) for i in range(max(len(words) - width + 1, 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_copies(rows):
    prints = {}
    for i, t in rows.items():
        words = (t or "").lower().split()
        prints[i] = (bits(words, 3), bits(words, 2)) if words else (0, 0)
    confirm = {}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    for a, b in prints.values():
        confirm[a] = min(confirm.get(a, b), b, key=signed)
    root = {a: a for a in confirm}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in confirm:
        for b in confirm:
            if (a ^ b).bit_count() <= 10 and (confirm[a] ^ confirm[b]).bit_count() <= 12:
                root[find(a)] = find(b)
    least = {}
    for i, (a, _) in prints.items():
        least[find(a)] = min(least.get(find(a), i), i)
    return {i: rows[i] for i in set(least.values())}


def shingles(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def uncontaminated(rows, items):
    parts = [s for s in map(shingles, items) if s]
    return {i: t for i, t in rows.items() if not any(len(s & shingles(t)) >= max(1, math.ceil(0.8 * len(s) - 1e-9)) for s in parts)}


def test_run_equals_brute_force(spark, tmp_path):
    import corpus_pipeline as p

    rows = corpus(spark)
    sf = f"file://{tmp_path}"
    docs = spark.createDataFrame(rows, KIND)
    docs.write.parquet(f"{sf}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{sf}/{t}.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    clean = {x.doc_id for x in toxicity.score(docs, labels).where("predicted = 0").collect()}
    kept = {i: t for i, t, *_ in rows if i in clean}
    unique = near_copies(kept)
    items = [x.text for x in labels.sparkSession.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = uncontaminated(unique, items)
    # Every kind of row goes somewhere.
    assert len(left) < len(unique) < len(kept)
    sources = {i: s for i, _, _, s, _ in rows}
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    con.executemany("insert into documents values (?, ?, 'en', ?, 0)", [(i, t, sources[i]) for i, t in left.items()])
    mixed = con.execute(entry.oracle_sql()["op10_mixing"]).df()
    times = {int(i): int(taken // size) for i, size, taken in zip(mixed["doc_id"], mixed["size"], mixed["taken"], strict=True) if size}
    got = p.run(spark, sf).collect()
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(queries.tokenizer())
    counts, want = {}, {}
    for x in got:
        counts[x.doc_id] = counts.get(x.doc_id, 0) + 1
    for i, t in left.items():
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want[i] = (len(ids), zlib.crc32(ids.tobytes()))
    assert {i: n for i, n in counts.items() if (left[i] or "").split()} == {i: n for i, n in times.items() if n}
    assert all((x.n_tokens, x.ids_crc32) == want[x.doc_id] for x in got)
    got = sorted(got, key=lambda x: x.start)
    assert [x.doc_id for x in got] == sorted(x.doc_id for x in got)
    assert [x.start for x in got] == [0, *np.cumsum([x.n_tokens for x in got])[:-1].tolist()]


def test_rows_of_one_id_are_in_order_of_text(spark):
    r = random.Random(3)
    texts = [r.choice(["same start " * 8, "", "other "]) + str(r.random()) for _ in range(200)]
    d = spark.createDataFrame([(None if i % 2 else 5, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(7)
    got = sorted(tokens.round_trip(d, queries.tokenizer()).collect(), key=lambda x: x.start)
    ordered = [t for none in (1, 0) for t in sorted(t for i, t in enumerate(texts) if i % 2 == none)]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(queries.tokenizer())
    crcs = [zlib.crc32(np.array([*model.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()) for t in ordered]
    assert [x.ids_crc32 for x in got] == crcs
    assert [x.start for x in got] == [0, *np.cumsum([x.n_tokens for x in got])[:-1].tolist()]


def test_windows_of_equal_hash_are_not_taken_for_each_other(spark, monkeypatch):
    """All bytes spread alike: words of one length, and so all windows here, have one hash."""
    monkeypatch.setattr(logindex, "SPREAD", np.full(256, 12345, np.uint64))
    r = random.Random(4)
    texts = [" ".join("".join(r.choice("abcdef") for _ in range(4)) for _ in range(40)) for _ in range(6)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9, texts[0])], "doc_id long, text string")
    got = {x.doc_id: x.n_removed for x in logindex.deduplicate(d).collect()}
    assert all(got[i] == 0 for i in range(6))
