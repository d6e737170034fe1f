"""Queries over all objects: against plain Python on whole tables."""

import hashlib

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def stored(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len({r.source for r in rows}) > 1 and max(r.doc_id for r in rows) > 100
    return rows


def test_get_reads_every_object(spark):
    want = sorted((r.doc_id, len(r.text.encode()), hashlib.md5(r.text.encode()).hexdigest(), r.text) for r in stored(spark))
    got = entry.queries()["object_get"](spark, SF)
    assert sorted((r.doc_id, r["size"], r.digest, r.text) for r in got.collect()) == want


def test_chunks_cover_every_object(spark):
    want = []
    for r in stored(spark):
        data = r.text.encode()
        parts = [data[i : i + 1000] for i in range(0, len(data), 1000)]
        want += [(r.doc_id, no, len(x), hashlib.md5(x.hex().upper().encode()).hexdigest()) for no, x in enumerate(parts)]
    got = entry.queries()["object_chunks"](spark, SF)
    assert sorted((r.doc_id, r.no, r["size"], r.digest) for r in got.collect()) == sorted(want)


def test_copy_takes_every_object(spark):
    want = sorted(("copies", f"copy/{r.lang}/{r.source}/{r.doc_id:08d}.txt", f'"{hashlib.md5(r.text.encode()).hexdigest()}"') for r in stored(spark))
    got = entry.queries()["object_copy"](spark, SF)
    assert sorted(map(tuple, got.collect())) == want
