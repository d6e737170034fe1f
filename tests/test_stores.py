"""Stores, clients, locks, tokens, streams: behaviour over several calls."""

import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.objects import ObjectClient, ObjectStore, to_bytes
from marlstone.operators import dense, sparse
from marlstone.plans import changelog
from marlstone.presign import PresignHandler
from marlstone.schema import OBJECT_LOG
from marlstone.sources.folder import Folder
from marlstone.sources.lock import FileLock, LockedError, break_lock
from marlstone.sources.log import ReadonlyError
from marlstone.streaming import ingest
from marlstone.vectors import VectorClient, VectorStore, reconciled


class Clock:
    def __init__(self):
        self.now = 1_000_000

    def __call__(self):
        return self.now


@pytest.fixture
def store(spark, tmp_path):
    s = ObjectStore(spark, f"file://{tmp_path}/objects", clock=Clock())
    yield s
    if s.lock.held:
        s.lock.release()


def test_put_get_stat(store):
    store.put("b", "dir/a.txt", "héllo")
    store.put("b", "dir/a.txt", b"hello world", content_disposition="inline")
    row = store.get("b", "dir/a.txt")
    assert bytes(row.data) == b"hello world" and row.content_type == "text/plain" and row.content_disposition == "inline"
    assert store.stat("b", "dir/a.txt")["size"] == 11 and store.stat("c", "dir/a.txt") is None
    assert store.get_range("b", "dir/a.txt", 6) == b"world" and store.get_range("b", "no", 0) is None
    with pytest.raises(ValueError):
        store.get_range("b", "dir/a.txt", -1)
    assert list(store.read_stream("b", "dir/a.txt", 4)) == [b"hell", b"o wo", b"rld"] and store.read_stream("b", "no") is None
    assert store.delete("b", "dir/a.txt") and not store.delete("b", "dir/a.txt") and not store.exists("b", "dir/a.txt")


def test_odd_keys_and_bytes(store):
    keys = ["", "a b", "emoji 🎉", "é/ü", "x=1&y=?", "k" * 10_000]
    store.put_frame(store.spark.createDataFrame([("b", k, bytearray(k.encode())) for k in keys] + [("b", "all", bytearray(range(256))), ("b", "none", bytearray())], "bucket string, key string, data binary"))
    assert bytes(store.get("b", "all").data) == bytes(range(256)) and bytes(store.get("b", "none").data) == b""
    for k in keys:
        assert bytes(store.get("b", k).data) == k.encode()


def test_lifetimes_and_copies(store):
    store.put("b", "soon", "x", expires=0.05)
    store.put("b", "late", "x", expires=3600)
    store.put("b", "gone", "x", expires=-1)
    store.put("b", "ever", "x", expires=0)
    assert [store.exists("b", k) for k in ("soon", "late", "gone", "ever")] == [True, True, False, True]
    store.clock.now += 100
    assert not store.exists("b", "soon") and not store.copy("b", "soon", "b", "y")
    store.put("b", "soon", "again")
    assert store.exists("b", "soon")
    assert store.copy("b", "late", "c", "late2") and store.get("c", "late2").expires_at_ms == store.get("b", "late").expires_at_ms
    assert store.get("c", "late2").etag == store.get("b", "late").etag
    assert sorted(r.key for r in store.objects("b").collect()) == ["ever", "late", "soon"]


def test_events_and_transactions(store):
    seen = []
    for e in ("put", "delete", "copy"):
        store.events.on(e, lambda b, k, e=e: seen.append((e, b, k)))
    store.put("b", "old", "1")
    store.delete("b", "nothing")
    store.transaction(lambda t: (t.delete("b", "old"), t.put("b", "new", "2")))
    store.copy("b", "new", "c", "n2")
    assert seen == [("put", "b", "old"), ("delete", "b", "old"), ("put", "b", "new"), ("copy", "c", "n2")]
    parts = list(store.table.state["parts"])

    def fails(t):
        t.put("b", "bad", "3")
        raise KeyError("stop")

    with pytest.raises(KeyError):
        store.transaction(fails)
    store.transaction(lambda t: None)
    assert store.table.state["parts"] == parts and not store.exists("b", "bad")
    with pytest.raises(RuntimeError):
        store.transaction(lambda t: store.transaction(lambda u: None))

    def angry(b, k):
        raise ValueError("no")

    store.events.listeners.clear()
    store.events.on("put", angry)
    store.events.on("put", lambda b, k: seen.append("never"))
    with pytest.raises(ValueError):
        store.put("b", "z", "1")
    assert seen[-1] != "never" and store.exists("b", "z")
    store.events.off("put", angry)


def test_uncommitted_records_do_not_count(spark):
    kind = "seq long, txn_id long, op string, key string"
    rows = [(1, None, "PUT", "a"), (2, 7, "TXN_BEGIN", None), (3, 7, "PUT", "b"), (4, 8, "TXN_BEGIN", None), (5, 8, "PUT", "c"), (6, 8, "DELETE", "a"), (7, 8, "TXN_COMMIT", None)]
    live = changelog.live(changelog.committed(spark.createDataFrame(rows, kind)), ["key"])
    assert [r.key for r in live.collect()] == ["c"]


def test_reopen_checkpoint_backup_readonly(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    a = ObjectStore(spark, path)
    a.put("b", "k", "1")
    a.put("b", "k", "2")
    with pytest.raises(LockedError):
        ObjectStore(spark, path)
    reader = ObjectStore(spark, path, readonly=True)
    for act in (lambda: reader.put("b", "x", "1"), lambda: reader.delete("b", "k"), lambda: reader.transaction(lambda t: None), reader.checkpoint):
        with pytest.raises(ReadonlyError):
            act()
    a.put("b", "later", "3")
    assert not reader.exists("b", "later") and bytes(reader.get("b", "k").data) == b"2"
    a.backup(f"file://{tmp_path}/copy")
    assert not a.compact_if_due() or True
    a.close()
    b = ObjectStore(spark, path)
    assert b.table.state["parts"] == [] and bytes(b.get("b", "k").data) == b"2" and b.exists("b", "later")
    b.close()
    c = ObjectStore(spark, f"file://{tmp_path}/copy", readonly=True)
    assert c.exists("b", "later")
    with pytest.raises(RuntimeError):
        ObjectStore(spark).backup(f"file://{tmp_path}/none")


def test_compaction_and_integrity(store, spark):
    store.put("b", "k", "x" * 100)
    store.put("b", "k", "y" * 60)
    assert store.compact_if_due() and not store.compact_if_due()
    store.put("b", "m", "1")
    store.put("b", "n", "2")
    assert store.check()["first_corrupt"] is None
    rows = store.log().withColumn("crc", F.when(F.col("key") == "m", 1).otherwise(F.col("crc")).cast("long"))
    store.table.checkpoint(rows.select(*OBJECT_LOG.names))
    found = store.check()
    assert found["n_total"] == 3 and found["n_valid"] == 1 and found["first_corrupt"] is not None
    assert store.repair() == 1 and not store.exists("b", "m") and store.exists("b", "n")


def test_bad_catalog_counts_as_empty(spark, tmp_path):
    for text in ("not json", json.dumps({"format": "other", "version": 1})):
        (tmp_path / "CURRENT").write_text(text)
        s = ObjectStore(spark, f"file://{tmp_path}", readonly=True)
        assert s.objects().isEmpty()


def test_locks(spark, tmp_path):
    folder = Folder(spark, f"file://{tmp_path}/l")
    one = FileLock(folder)
    one.acquire()
    with pytest.raises(LockedError):
        FileLock(folder).acquire()
    one.confirm()
    two = FileLock(folder, stale_after_ms=-1)
    two.acquire()
    two.confirm()
    with pytest.raises(LockedError):
        one.confirm()
    one.release()
    assert break_lock(folder) and not break_lock(folder)
    # A process of this host that has ended need not lapse; any other owner must.
    folder.create("LOCK", '{"owner": "x", "pid": 99999999, "host": "%s"}' % __import__("socket").gethostname())
    FileLock(folder).acquire()
    break_lock(folder)
    for holder in ('{"owner": "y", "pid": 1, "host": "elsewhere"}', "garbage"):
        folder.create("LOCK", holder)
        with pytest.raises(LockedError):
            FileLock(folder).acquire()
        FileLock(folder, stale_after_ms=-1).acquire()
        break_lock(folder)
    assert folder.names() == []


def test_lease_is_renewed(spark, tmp_path):
    folder = Folder(spark, f"file://{tmp_path}/l")
    one = FileLock(folder, stale_after_ms=2000)
    one.acquire()
    until = time.time() + 4
    while time.time() < until:
        with pytest.raises(LockedError):
            FileLock(folder, stale_after_ms=2000).acquire()
        time.sleep(0.5)
    one.confirm()
    one.release()
    assert folder.names() == []


def test_a_writer_that_lost_its_lock_commits_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    a = ObjectStore(spark, path)
    a.put("b", "k", "1")
    b = ObjectStore(spark, path, lock_stale_after_ms=-1)
    with pytest.raises(LockedError):
        a.put("b", "k", "2")
    with pytest.raises(LockedError):
        a.checkpoint()
    assert bytes(a.get("b", "k").data) == b"1" and a.table.state["snapshot"] is None
    b.put("b", "k", "3")
    assert bytes(ObjectStore(spark, path, readonly=True).get("b", "k").data) == b"3"
    b.close()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_snapshots_are_sorted_and_only_the_log_is_replayed(spark, tmp_path):
    s = ObjectStore(spark, f"file://{tmp_path}/s")
    s.put_frame(spark.range(500).selectExpr("'b' AS bucket", "concat('k', lpad(id * 7 % 500, 3, '0')) AS key", "CAST(CAST(id AS string) AS binary) AS data"))
    s.checkpoint()
    name = s.table.state["snapshot"]
    for part in (tmp_path / "s" / name).glob("*.parquet"):
        keys = [r.key for r in spark.read.parquet(str(part)).select("key").collect()]
        assert keys == sorted(keys)
    plan = plan_of(s.one("b", "k003"))
    assert "Exchange" not in plan and "EqualTo(key,k003)" in plan
    s.put("b", "k003", "new")
    s.delete("b", "k004")
    s.transaction(lambda t: (t.put("b", "k005", "in"), t.delete("b", "k006")))
    s.put("b", "more", "x")
    assert bytes(s.get("b", "k003").data) == b"new" and bytes(s.get("b", "k005").data) == b"in" and s.exists("b", "k007")
    assert not s.exists("b", "k004") and not s.exists("b", "k006") and s.objects("b").count() == 499
    s.checkpoint()
    assert not s.exists("b", "k004") and s.objects().count() == 499
    s.close()


def test_queries_over_checkpoints_move_no_vectors(spark, tmp_path):
    v = VectorStore(spark, f"file://{tmp_path}/v")
    v.create_index("i", 2)
    v.create_index("j", 2)
    v.put_frame("i", spark.range(50).selectExpr("CAST(id AS string) AS key", "array(CAST(id AS float), 1f) AS vector"))
    v.put_vectors("j", [{"key": "0", "vector": [9.0, 9.0]}])
    v.checkpoint()
    assert "Exchange" not in plan_of(v.vectors("i"))
    v.put_vectors("i", [{"key": "0", "vector": [5.0, 5.0]}])
    v.delete_vectors("i", ["1"])
    assert v.size("i") == 49 and v.get_vectors("i", ["0"])[0]["vector"] == [5.0, 5.0] and v.has_key("i", "2") and not v.has_key("i", "1")
    v.delete_index("i")
    v.create_index("i", 2)
    assert v.size("i") == 0 and v.size("j") == 1
    v.put_vectors("i", [{"key": "2", "vector": [1.0, 1.0]}])
    v.checkpoint()
    assert v.size("i") == 1 and v.size("j") == 1
    v.close()


def test_vector_log_folds_by_itself(spark, tmp_path, monkeypatch):
    import marlstone.vectors as module

    monkeypatch.setattr(module, "CHECKPOINT_PARTS", 3)
    v = VectorStore(spark, f"file://{tmp_path}/v")
    v.create_index("i", 1)
    for i in range(4):
        v.put_vectors("i", [{"key": str(i), "vector": [float(i)]}])
    assert len(v.table.state["parts"]) == 1 and v.size("i") == 4
    v.close()


def test_corruptions_have_files_and_reasons(store):
    store.put("b", "k", "one")
    store.put("b", "m", "two")
    assert store.corruptions().isEmpty()
    bad = store.log().withColumn("crc", F.when(F.col("key") == "m", 1).otherwise(F.col("crc")).cast("long"))
    store.table.checkpoint(bad.select(*OBJECT_LOG.names))
    (row,) = store.corruptions().collect()
    assert (row.bucket, row.key, row.reason) == ("b", "m", "checksum differs") and store.table.state["snapshot"] in row.file


def test_client_files_and_sinks(spark):
    c = ObjectClient(spark, region="x", acl="y", clock=Clock())
    assert c.write("a.json", '{"a": [1]}') == 10 and c.size("a.json") == 10 and c.exists("a.json")
    f = c.file("a.json")
    assert f.json() == {"a": [1]} and f.type == "application/json" and c.stat("a.json")["type"] == "application/json"
    s = f.slice(1, 4).slice(2, 5)
    assert s.bytes() == b'a":'[0:3] and s.size == 10
    assert c.file("no").size == 0 and c.file("no.png").type == "image/png" and c.file("no", type="t/t").type == "t/t"
    for call in (lambda: c.size("no"), lambda: c.file("no").text(), lambda: c.file("no").read_stream(), lambda: c.file("no").slice(0, 2).bytes()):
        with pytest.raises(FileNotFoundError):
            call()
    w = c.file("w").writer(type="a/b")
    assert w.write("ab") == 2 and w.write(b"c") == 1 and w.flush() == 0 and w.end() == 3
    assert c.stat("w")["type"] == "a/b" and w.end() == 0 and c.size("w") == 0
    assert c.file("st").write_stream([b"1", b"23"]) == 3 and c.copy("st", "st2") and c.file("st2").text() == "123"
    with pytest.raises(NotImplementedError):
        c.presign("w")
    c.delete("w")
    assert not c.exists("w")
    assert to_bytes(memoryview(b"ab")) == b"ab" and to_bytes(bytearray(b"x")) == b"x"
    c.close()


def keys(page):
    return [x["key"] for x in page.contents or []]


def test_listing(spark):
    c = ObjectClient(spark, clock=Clock())
    names = ["photos/2024/jan.jpg", "photos/2024/feb.jpg", "photos/2025/mar.jpg", "photos/top.jpg"]
    d = spark.createDataFrame([("default", k, bytearray(b"1")) for k in names + [f"key{i}" for i in range(5)] + ["dir1/a", "dir1/b", "dir2/c", "root"]], "bucket string, key string, data binary")
    c.store.put_frame(d)
    p = c.list(prefix="photos/", delimiter="/")
    assert p.common_prefixes == ["photos/2024/", "photos/2025/"] and keys(p) == ["photos/top.jpg"] and p.key_count == 1 and not p.is_truncated
    got, token, pages = [], None, 0
    while True:
        p = c.list(prefix="key", max_keys=2, continuation_token=token, start_after="zzz" if token else None)
        got += keys(p)
        pages += 1
        if not p.is_truncated:
            break
        token = p.next_continuation_token
    assert got == [f"key{i}" for i in range(5)] and pages == 3
    p = c.list(max_keys=0)
    assert p.contents is None and p.is_truncated
    p = c.list(prefix="nothing")
    assert p.contents is None and p.common_prefixes is None and not p.is_truncated
    p = c.list(prefix="dir", delimiter="/", max_keys=1)
    assert p.common_prefixes == ["dir1/"] and p.is_truncated and p.next_continuation_token == "dir1/b"
    assert c.list(prefix="dir", delimiter="/", continuation_token="dir1/b").common_prefixes == ["dir2/"]
    # Full after its last prefix, but a key under that prefix is left.
    p = c.list(prefix="photos/202", delimiter="/", max_keys=2)
    assert p.common_prefixes == ["photos/2024/", "photos/2025/"] and not p.is_truncated
    p = c.list(prefix="photos/2024", delimiter="/", max_keys=1)
    assert p.is_truncated
    assert c.list(prefix="photos/2024", delimiter="/", max_keys=1, token_of_contents=True).next_continuation_token is None
    assert keys(c.list(start_after="photos/2025/mar.jpg")) == ["photos/top.jpg", "root"]
    assert c.list(prefix="photos/", delimiter="2024/").common_prefixes == ["photos/2024/"]


def test_presigned_requests(spark):
    clock = Clock()
    c = ObjectClient(spark, clock=Clock())
    c.write("hello.txt", "hello world")
    h = PresignHandler(c, "http://x/y/", headers={"Access-Control-Allow-Origin": "*"}, most=3, clock=lambda: clock.now / 1000)
    url = h.presign("hello.txt", content_disposition="attachment")
    r = h.handle("GET", url)
    assert (r.status, r.body, r.headers["ETag"], r.headers["Content-Disposition"]) == (200, b"hello world", c.stat("hello.txt")["etag"], "attachment")
    for wanted, status, body, said in [("bytes=0-4", 206, b"hello", "bytes 0-4/11"), ("bytes=6-", 206, b"world", "bytes 6-10/11"), ("bytes=100-200", 416, None, "bytes */11"), ("bytes=0-999", 206, b"hello world", "bytes 0-10/11"), ("bytes=-2", 200, b"hello world", None)]:
        r = h.handle("GET", url, {"Range": wanted})
        assert r.status == status and r.headers.get("Content-Range") == said and (body is None or r.body == body)
    assert h.handle("GET", "http://x/y/").status == 401 and h.handle("GET", "http://x/y/none").status == 401
    assert h.handle("POST", url).status == 405 and h.handle("GET", h.presign("missing")).status == 404
    put = h.presign("up.bin", method="PUT")
    assert h.handle("PUT", put, {"Content-Type": "a/b"}, b"\0\1").status == 200 and c.stat("up.bin")["type"] == "a/b"
    assert h.handle("DELETE", h.presign("hello.txt", method="DELETE")).status == 405
    short = h.presign("hello.txt", expires_in=1)
    clock.now += 2000
    assert h.handle("GET", short).status == 401
    h.grants.clear()
    urls = [h.presign("hello.txt", expires_in=10 - i) for i in range(5)]
    assert len(h.grants) == 3 and urls[-1].rsplit("/", 1)[-1] not in h.grants


def results(rows):
    return [(r.key, round(r.score, 6)) for r in rows.collect()]


def test_dense_fixtures(spark):
    v = VectorStore(spark)
    v.create_index("e", 3, "euclidean")
    v.put_vectors("e", [{"key": "a", "vector": [0, 0, 0]}, {"key": "b", "vector": [10, 10, 10]}, {"key": "c", "vector": [1, 0.1, 0]}])
    assert [k for k, _ in results(v.query("e", 2, [1, 0, 0]))] == ["c", "a"]
    v.create_index("d", 3, "dotproduct")
    v.put_vectors("d", [{"key": "a", "vector": [1, 0, 0]}, {"key": "b", "vector": [0, 1, 0]}, {"key": "c", "vector": [0.5, 0.5, 0]}])
    assert results(v.query("d", 3, [1, 0, 0])) == [("a", -1), ("c", -0.5), ("b", 0)]
    v.create_index("f", 2, "euclidean")
    v.put_vectors("f", [{"key": k, "vector": [i, 0], "metadata": {"genre": g}} for i, (k, g) in enumerate([("a", "scifi"), ("b", "drama"), ("c", "scifi")])])
    for mode in ("pre", "post"):
        assert [k for k, _ in results(v.query("f", 5, [0, 0], condition={"genre": "scifi"}, filter_mode=mode))] == ["a", "c"]
    assert v.query("f", 2, [0, 0], ef_search=1, condition={"genre": "drama"}, filter_mode="post").count() == 1
    assert results(v.query("f", 0, [0, 0])) == []
    v.put_vectors("f", [{"key": "a", "vector": [10, 10]}])
    assert v.size("f") == 3 and results(v.query("f", 1, [10, 10])) == [("a", 0)]
    for call in (lambda: v.put_vectors("f", [{"key": "z", "vector": [1]}]), lambda: v.query("f", 1), lambda: v.query("f", 1, [1, 2, 3]), lambda: v.create_index("f", 2), lambda: v.put_vectors("f", [{"key": "z", "sparse": {"indices": [1], "values": [1.0]}}])):
        with pytest.raises(ValueError):
            call()
    with pytest.raises(KeyError):
        v.query("none", 1, [1])
    v.create_index("empty", 4)
    assert results(v.query("empty", 3, [1, 2])) == []
    v.close()


def test_knn_join_in_tiles(spark, monkeypatch):
    import numpy as np

    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.normal(size=6)]) for i in range(60)]
    d = spark.createDataFrame(rows, "key long, vector array<float>")
    q = d.where("key % 7 = 0").withColumnRenamed("key", "query_id")
    for metric in ("cosine", "euclidean", "dotproduct"):
        monkeypatch.setattr(dense, "VECTORS", 50_000)
        whole = sorted((x.query_id, x["rank"], x["key"]) for x in dense.knn_join(d, q, 5, metric).collect())
        monkeypatch.setattr(dense, "VECTORS", 7)
        monkeypatch.setattr(dense, "QUERIES", 2)
        assert sorted((x.query_id, x["rank"], x["key"]) for x in dense.knn_join(d, q, 5, metric).collect()) == whole
        one = [x["key"] for x in dense.top_k(d, rows[14][1], 5, metric).collect()]
        assert [k for i, _, k in whole if i == 14] == one


def test_knn_join_ranks_copies_by_key(spark, monkeypatch):
    r = np.random.default_rng(5)
    base = [[float(x) for x in r.normal(size=9)] for _ in range(3)]
    rows = [(i, base[i % 3]) for i in range(150)]
    d = spark.createDataFrame(rows, "key long, vector array<float>").repartition(3)
    q = d.where("key < 3").withColumnRenamed("key", "query_id")
    monkeypatch.setattr(dense, "VECTORS", 40)
    for metric in ("cosine", "euclidean", "dotproduct"):
        got = dense.knn_join(d, q, 5, metric).collect()
        for i in range(3):
            mine = [x["key"] for x in sorted((x for x in got if x.query_id == i), key=lambda x: x["rank"])]
            keys = [x % 3 for x in mine]
            assert len(set(keys)) == 1 and mine == [keys[0] + 3 * j for j in range(5)], metric


def test_hashing_recall(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").selectExpr("vec_id as key", "embedding as vector")
    asked = list(d.where("key = 7").first().vector)
    exact = {r["key"] for r in dense.top_k(d, asked, 10, "euclidean").collect()}
    near = {r["key"] for r in dense.approximate_top_k(d, asked, 10, 0.5, 8).collect()}
    assert len(exact & near) >= 9


def test_sparse_fixtures(spark):
    v = VectorStore(spark)
    v.create_index("s", 2, sparse=True)
    sv = lambda **x: {"indices": [int(k[1:]) for k in x], "values": list(x.values())}
    v.put_vectors("s", [{"key": "a", "sparse": sv(d0=1, d1=0.5, d2=0.3)}, {"key": "b", "sparse": sv(d0=0.2, d3=0.9)}, {"key": "c", "sparse": sv(d1=0.8, d2=0.7)}])
    assert results(v.query("s", 3, sparse_vector=sv(d0=1, d1=1))) == [("a", -1.5), ("c", -0.8), ("b", -0.2)]
    assert results(v.query("s", 3, sparse_vector=sv(d99=1))) == []
    v.put_vectors("s", [{"key": "a", "sparse": sv(d1=2)}])
    assert [k for k, _ in results(v.query("s", 3, sparse_vector=sv(d0=1)))] == ["b"]
    assert results(v.query("s", 1, sparse_vector={"indices": [1, 1], "values": [1, 1]})) == [("a", -4)]
    v.put_vectors("s", [{"key": "r", "sparse": {"indices": [7, 7], "values": [1, 5]}}])
    assert results(v.query("s", 1, sparse_vector=sv(d7=1))) == [("r", -5)]
    back = {r["key"]: r.sparse for r in sparse.gathered(sparse.postings(v.vectors("s"))).collect()}
    assert back["c"].indices == [1, 2]
    v.close()


def test_hybrid_fixtures(spark):
    v = VectorStore(spark)
    v.create_index("h", 3, "euclidean", sparse=True)
    put = lambda k, x, d, s: {"key": k, "vector": x, "sparse": {"indices": [d], "values": [s]}, "metadata": {"k": k}}
    v.put_vectors("h", [put("dense-winner", [1, 0, 0], 99, 0.1), put("sparse-winner", [10, 10, 10], 0, 1.0), put("hybrid-winner", [1.1, 0, 0], 0, 0.9)])
    got = results(v.query("h", 3, [1, 0, 0], {"indices": [0], "values": [1.0]}))
    assert got == [("sparse-winner", round(-(1 / 63 + 1 / 61), 6)), ("hybrid-winner", round(-2 / 62, 6)), ("dense-winner", round(-1 / 61, 6))]
    assert [k for k, _ in results(v.query("h", 3, [1, 0, 0], {"indices": [0], "values": [1.0]}, condition={"k": "hybrid-winner"}))] == ["hybrid-winner"]
    row = v.query("h", 1, [1, 0, 0], include_vectors=True, include_metadata=False).first()
    assert row.asDict().keys() == {"key", "score", "vector", "sparse"} and list(row.vector) == [1, 0, 0]
    v.close()


def test_vector_store_life(spark, tmp_path):
    path = f"file://{tmp_path}/v"
    v = VectorStore(spark, path)
    seen = []
    for e in ("create_index", "delete_index", "put_vectors", "delete_vectors"):
        v.events.on(e, lambda *x, e=e: seen.append((e, *x)))
    v.create_index("i", 2)
    v.put_vectors("i", [{"key": "old1", "vector": [1, 0]}, {"key": "old2", "vector": [0, 1]}])
    assert v.delete_index("i") and not v.delete_index("i")
    v.create_index("i", 2)
    v.put_vectors("i", [{"key": "new1", "vector": [1, 1], "metadata": {"a": 1}}, {"key": "new2", "metadata": {}}])
    assert v.list_vectors("i") == (["new1", "new2"], False, None)
    v.put_vectors("i", [{"key": "new1", "metadata": {"a": 2}}])
    got = v.get_vectors("i", ["new2", "none", "new1", "new2"])
    assert [x["key"] for x in got] == ["new2", "new1", "new2"] and got[1]["vector"] == [1, 1] and json.loads(got[1]["metadata"]) == {"a": 2}
    assert v.delete_vectors("i", ["new2", "zzz"]) == 1 and v.delete_vectors("i", ["zzz"]) == 0
    assert [s[0] for s in seen] == ["create_index", "put_vectors", "delete_index", "create_index", "put_vectors", "put_vectors", "delete_vectors"]
    v.put_frame("i", spark.createDataFrame([("f", [3.0, 4.0], '{"x": 1}')], "key string, vector array<float>, metadata string"))
    assert v.vectors("i").where("key = 'f'").first().norm == 5
    with pytest.raises(Exception, match="dimension"):
        v.put_frame("i", spark.createDataFrame([("g", [3.0])], "key string, vector array<float>"))
    v.close()
    w = VectorStore(spark, path, readonly=True)
    assert w.list_vectors("i")[0] == ["f", "new1"] and w.get_index("i").dimension == 2 and len(w.list_indexes()) == 1
    for call in (lambda: w.put_vectors("i", []), lambda: w.create_index("x", 1), lambda: w.delete_index("i"), lambda: w.delete_vectors("i", [])):
        with pytest.raises(ReadonlyError):
            call()
    assert w.list_vectors("i", max_keys=1) == (["f"], True, "f") and w.list_vectors("i", start_after="f", prefix="n")[0] == ["new1"]


def test_reconcile(spark):
    o, v = ObjectStore(spark), VectorClient(spark)
    o.put_frame(spark.createDataFrame([("default", k, bytearray(b"1")) for k in ("docs/a", "docs/b", "x")], "bucket string, key string, data binary"))
    v.create_index("i", 1)
    v.put_vectors("i", [{"key": k, "vector": [1]} for k in ("a", "b", "c")])
    mapper = lambda k: F.concat(F.lit("docs/"), k)
    lone, rest, n = reconciled(o, v.store, "i", mapper=mapper)
    assert ([r["key"] for r in lone.collect()], [r["key"] for r in rest.collect()], n) == (["c"], ["x"], 0)
    assert reconciled(o, v.store, "i", mapper=mapper, prefix="docs/", dry_run=False)[2] == 1
    assert v.list_vectors("i")[0] == ["a", "b"]
    assert reconciled(o, v.store, "i", mapper=mapper, prefix="docs/")[1].isEmpty()


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source, log, state = (f"file://{tmp_path}/{x}" for x in ("in", "log", "state"))
    kind = events.schema
    for part in (events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1")):
        part.write.mode("append").parquet(source)
        ingest.follow(spark, source, kind, log, state).awaitTermination()
    fold = lambda d: sorted((r.user_id, r.event_id) for r in changelog.last_writes(d, ["user_id"], "event_id").collect())
    assert ingest.log(spark, kind, log).count() == events.count()
    assert fold(ingest.log(spark, kind, log)) == fold(events)


def test_readers_outlive_checkpoints(spark, tmp_path):
    w = ObjectStore(spark, str(tmp_path / "s"))
    w.put("b", "k", b"one")
    reader, plan = ObjectStore(spark, str(tmp_path / "s"), readonly=True), w.objects()
    w.checkpoint()
    w.put("b", "k", b"two")
    w.checkpoint()
    assert bytes(reader.get("b", "k").data) == b"one" and plan.count() == 1
    assert bytes(w.get("b", "k").data) == b"two"
    w.checkpoint()
    w.close()
    assert sum(n.startswith("current-snapshot") for n in w.folder.names()) == 3


def test_batches_of_vectors_are_checked_like_single_puts(spark, tmp_path):
    v = VectorStore(spark, str(tmp_path / "v"))
    v.create_index("i", 2)
    seen = []
    v.events.on("put_vectors", lambda name, keys: seen.append((name, keys)))
    v.put_vectors("i", [{"key": "a", "vector": [1.0, 2.0], "metadata": {"x": 1}}])
    v.put_frame("i", spark.createDataFrame([("a", '{"x": 2}')], "key string, metadata string"))
    (row,) = v.get_vectors("i", ["a"])
    assert row["vector"] == [1.0, 2.0] and row["metadata"] == '{"x":2}'
    with pytest.raises(Exception, match="holds no sparse"):
        v.put_frame("i", spark.createDataFrame([("b", ([1], [1.0]))], "key string, sparse struct<indices:array<int>,values:array<double>>"))
    v.put_frame("i", spark.createDataFrame([("c", [float(x), 1.0]) for x in range(20)], "key string, vector array<float>").repartition(5))
    first = v.get_vectors("i", ["c"])[0]["vector"]
    v.checkpoint()
    assert v.get_vectors("i", ["c"])[0]["vector"] == first and v.size("i") == 2
    assert seen == [("i", ["a"]), ("i", None), ("i", None)]
    v.close()


def test_smallest_keeps_ties_in_order():
    r = np.random.default_rng(1)
    for _ in range(500):
        x = r.integers(0, 6, r.integers(1, 40)).astype(float)
        x[r.random(len(x)) < 0.1] = np.nan
        k = int(r.integers(1, 45))
        assert list(dense.smallest(x, k)) == list(np.argsort(x, kind="stable")[:k])


def test_knn_join_of_nothing(spark):
    d = spark.createDataFrame([(1, [1.0])], "key int, vector array<float>")
    got = dense.knn_join(d, d.withColumnRenamed("key", "query_id"), 0)
    assert got.columns == ["query_id", "rank", "key", "score"] and got.count() == 0
