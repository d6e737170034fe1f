"""The library's queries over the driver's tables, each with the SQL that its rows must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.functions import distance as D
from marlstone.functions import objects as O
from marlstone.functions.metadata import matches
from marlstone.objects import copies
from marlstone.operators import dense, hybrid, listing, reconcile, sparse
from marlstone.plans import changelog
from marlstone.vectors import get_by_keys, shaped

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: The query vector's id, results of a search, least magnitude of a sparse component.
ASKED, K, LEAST = 7, 10, 0.15


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = " ".join(sql.split())
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Vectors.


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, vector, metadata) of the embeddings; metadata is {"label": label}."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"), F.to_variant_object(F.struct("label")).alias("metadata"), "label")


def asked(vectors: DataFrame, key: int = ASKED) -> list[float]:
    return list(vectors.where(F.col("key") == key).select("vector").first()[0])


def rounded(found: DataFrame, *more: str, digits: int = 6) -> DataFrame:
    return found.select(F.col("key").alias("vec_id"), F.round("score", digits).alias("score"), *more)


NORM = "sqrt(list_inner_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]))"
DOT = "list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
COSINE = f"""CASE WHEN {NORM} = 0 OR {NORM.replace("e.", "q.")} = 0 THEN 1.0
    ELSE 1.0 - {DOT} / ({NORM} * {NORM.replace("e.", "q.")}) END"""
WITH_Q = f"q AS (SELECT embedding FROM embeddings WHERE vec_id = {ASKED})"
DIST = f"{WITH_Q}, dist AS (SELECT e.vec_id, e.label, {COSINE} AS score FROM embeddings e CROSS JOIN q)"


def nearest_sql(expression: str) -> str:
    return f"""WITH {WITH_Q}, d AS (SELECT e.vec_id, {expression} AS score FROM embeddings e CROSS JOIN q)
        SELECT vec_id, round(score, 6) AS score FROM (SELECT * FROM d ORDER BY score, vec_id LIMIT {K}) t"""


@query(nearest_sql(COSINE))
def dense_topk_cosine(spark, sf_dir):
    vectors = embeddings(spark, sf_dir)
    return rounded(dense.top_k(vectors, asked(vectors), K, "cosine"))


@query(nearest_sql("list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"))
def dense_topk_euclidean(spark, sf_dir):
    vectors = embeddings(spark, sf_dir)
    return rounded(dense.top_k(vectors, asked(vectors), K, "euclidean"))


@query(nearest_sql(f"-{DOT}"))
def dense_topk_dotproduct(spark, sf_dir):
    vectors = embeddings(spark, sf_dir)
    return rounded(dense.top_k(vectors, asked(vectors), K, "dotproduct"))


@query(f"""WITH {DIST} SELECT vec_id, round(score, 6) AS score, label FROM
    (SELECT * FROM dist WHERE label = 3 ORDER BY score, vec_id LIMIT {K}) t""")
def dense_topk_prefilter(spark, sf_dir):
    vectors = embeddings(spark, sf_dir)
    return rounded(dense.top_k(vectors, asked(vectors), K, condition={"label": 3}), "label")


@query(f"""WITH {DIST}, beam AS (SELECT * FROM dist ORDER BY score, vec_id LIMIT 64)
    SELECT vec_id, round(score, 6) AS score, label FROM
    (SELECT * FROM beam WHERE label = 3 ORDER BY score, vec_id LIMIT {K}) t""")
def dense_topk_postfilter_ef(spark, sf_dir):
    vectors = embeddings(spark, sf_dir)
    return rounded(dense.top_k(vectors, asked(vectors), K, condition={"label": 3}, filter_mode="post", ef=64), "label")


@query(f"""WITH d AS (SELECT q.vec_id AS query_id, e.vec_id, {COSINE} AS score FROM embeddings e CROSS JOIN embeddings q WHERE q.vec_id % 50 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), vec_id) AS rank FROM d)
    SELECT query_id, rank::INTEGER AS rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= {K}""")
def dense_knn_batch(spark, sf_dir):
    vectors = embeddings(spark, sf_dir).select("key", "vector")
    queries = vectors.where(F.col("key") % 50 == 0).withColumnRenamed("key", "query_id")
    return dense.knn_join(vectors, queries, K).select("query_id", "rank", F.col("key").alias("vec_id"), F.round("score", 6).alias("score"))


@query(f"SELECT vec_id, 1.0::DOUBLE AS score FROM embeddings ORDER BY vec_id LIMIT {K}")
def dense_zero_vector(spark, sf_dir):
    return rounded(dense.top_k(embeddings(spark, sf_dir), [0.0] * 64, K))


@query(f"SELECT vec_id, round({NORM}, 6) AS norm FROM embeddings e")
def vector_norms(spark, sf_dir):
    return embeddings(spark, sf_dir).select(F.col("key").alias("vec_id"), F.round(D.norm(F.col("vector")), 6).alias("norm"))


@query(f"""WITH {DIST} SELECT vec_id, round(score, 6) AS score, label AS metadata_label FROM
    (SELECT * FROM dist ORDER BY score, vec_id LIMIT {K}) t""")
def query_include_metadata(spark, sf_dir):
    vectors = embeddings(spark, sf_dir)
    found = dense.top_k(vectors, asked(vectors), K).select("key", "score")
    return rounded(shaped(found, vectors).withColumn("metadata_label", F.variant_get("metadata", "$.label", "int")), "metadata_label")


@query(f"""WITH {DIST}, t AS (SELECT * FROM dist ORDER BY score, vec_id LIMIT {K})
    SELECT t.vec_id, round(t.score, 6) AS score, len(e.embedding)::BIGINT AS dimension, round(e.embedding[1]::DOUBLE, 6) AS first, round(list_sum(e.embedding::DOUBLE[]), 6) AS total
    FROM t JOIN embeddings e USING (vec_id)""")
def query_include_vectors(spark, sf_dir):
    vectors = embeddings(spark, sf_dir)
    found = shaped(dense.top_k(vectors, asked(vectors), K).select("key", "score"), vectors, False, True)
    v = D.doubles(F.col("vector"))
    return rounded(found.withColumns({"dimension": F.size("vector").cast("long"), "first": F.round(v[0], 6), "total": F.round(D.total(v), 6)}), "dimension", "first", "total")


# Sparse and hybrid search.

POSTINGS = f"""post AS (SELECT vec_id, dim, v::DOUBLE AS v FROM
    (SELECT vec_id, unnest(range(0, 64)) AS dim, unnest(embedding) AS v FROM embeddings) t WHERE abs(v::DOUBLE) > {LEAST})"""


def sparse_sql(condition: str = "") -> str:
    return f"""{POSTINGS}, sp AS (SELECT p.vec_id, -sum(p.v * x.v) AS score FROM post p
        JOIN (SELECT dim, v FROM post WHERE vec_id = {ASKED}) x ON p.dim = x.dim {condition} GROUP BY p.vec_id)"""


KEEP_3 = "JOIN (SELECT vec_id AS kept FROM embeddings WHERE label = 3) f ON p.vec_id = f.kept"


def posted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vectors, their postings, and the query's dimensions."""
    vectors = embeddings(spark, sf_dir)
    rows = sparse.dense_postings(vectors, LEAST)
    return vectors, rows, rows.where(F.col("key") == ASKED).select("dim", F.col("value").alias("weight"))


@query(f"WITH {sparse_sql()} SELECT vec_id, round(score, 6) AS score FROM (SELECT * FROM sp ORDER BY score, vec_id LIMIT {K}) t")
def sparse_topk(spark, sf_dir):
    _, rows, asked_for = posted(spark, sf_dir)
    return rounded(sparse.top_k(rows, asked_for, K))


@query(f"WITH {sparse_sql(KEEP_3)} SELECT vec_id, round(score, 6) AS score FROM (SELECT * FROM sp ORDER BY score, vec_id LIMIT {K}) t")
def sparse_topk_filtered(spark, sf_dir):
    vectors, rows, asked_for = posted(spark, sf_dir)
    return rounded(sparse.top_k(rows, asked_for, K, vectors.where(matches(F.col("metadata"), {"label": 3}))))


@query(f"""WITH {POSTINGS} SELECT vec_id, count(*) AS n, string_agg(dim::VARCHAR, ',' ORDER BY dim) AS dims, round(sum(v), 6) AS total FROM post GROUP BY vec_id""")
def sparse_roundtrip(spark, sf_dir):
    vectors, rows, _ = posted(spark, sf_dir)
    back = sparse.gathered(sparse.postings(sparse.gathered(rows)))
    return back.select(
        F.col("key").alias("vec_id"),
        F.size("sparse.indices").cast("long").alias("n"),
        F.array_join(F.col("sparse.indices").cast("array<string>"), ",").alias("dims"),
        F.round(D.total(F.col("sparse.values")), 6).alias("total"),
    )


def hybrid_sql(fusion_k: int, dense_filter: str = "", sparse_filter: str = "") -> str:
    part = f"coalesce(CAST(1 AS DOUBLE) / ({fusion_k} + %s.rn), CAST(0 AS DOUBLE))"
    return f"""WITH {DIST}, {sparse_sql(sparse_filter)},
        dr AS (SELECT vec_id, rn FROM (SELECT vec_id, row_number() OVER (ORDER BY score, vec_id) AS rn FROM dist {dense_filter}) z WHERE rn <= {2 * K}),
        kk AS (SELECT CASE WHEN count(*) < {K} THEN {K} ELSE {2 * K} END AS k FROM dr),
        sr AS (SELECT vec_id, rn FROM (SELECT vec_id, row_number() OVER (ORDER BY score, vec_id) AS rn FROM sp) z CROSS JOIN kk WHERE rn <= kk.k),
        f AS (SELECT coalesce(dr.vec_id, sr.vec_id) AS vec_id, -({part % "dr"} + {part % "sr"}) AS score, dr.rn AS a, sr.rn AS b FROM dr FULL OUTER JOIN sr ON dr.vec_id = sr.vec_id)
        SELECT vec_id, round(score, 8) AS score FROM (SELECT * FROM f ORDER BY score, a NULLS LAST, b NULLS LAST LIMIT {K}) t"""


def fused(spark: SparkSession, sf_dir: str, fusion_k: float, condition: dict | None = None) -> DataFrame:
    vectors, rows, asked_for = posted(spark, sf_dir)
    keep = None if condition is None else vectors.where(matches(F.col("metadata"), condition))
    near = dense.top_k(vectors, asked(vectors), 2 * K, condition=condition)
    return rounded(hybrid.fuse(near.select("key", "score"), sparse.top_k(rows, asked_for, 2 * K, keep), K, fusion_k), digits=8)


@query(hybrid_sql(60))
def hybrid_rrf(spark, sf_dir):
    return fused(spark, sf_dir, 60)


@query(hybrid_sql(1))
def hybrid_rrf_fusion_k1(spark, sf_dir):
    return fused(spark, sf_dir, 1)


@query(hybrid_sql(60, "WHERE label = 3", KEEP_3))
def hybrid_rrf_filtered(spark, sf_dir):
    return fused(spark, sf_dir, 60, {"label": 3})


# Keyed vectors.


@query("""SELECT a.pos::INTEGER AS pos, e.vec_id, e.label FROM (VALUES (0, 5), (1, 3), (2, 5), (3, 99999999), (4, 0)) a(pos, vec_id) JOIN embeddings e USING (vec_id)""")
def vectors_get(spark, sf_dir):
    return get_by_keys(embeddings(spark, sf_dir), [5, 3, 5, 99999999, 0]).select("pos", F.col("key").alias("vec_id"), "label")


def vector_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding put once; every third put again with label + 100; every seventh deleted."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), "label")
    first = rows.select((F.col("key") * 10).alias("seq"), F.lit("PUT").alias("op"), "key", "label")
    again = rows.where(F.col("key") % 3 == 0).select((F.col("key") * 10 + 1).alias("seq"), F.lit("PUT").alias("op"), "key", (F.col("label") + 100).alias("label"))
    gone = rows.where(F.col("key") % 7 == 0).select((F.col("key") * 10 + 2).alias("seq"), F.lit("DELETE").alias("op"), "key", F.lit(None).cast("int").alias("label"))
    return first.union(again).union(gone)


@query("SELECT vec_id, (CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END)::INTEGER AS label FROM embeddings")
def vectors_upsert_lww(spark, sf_dir):
    log = vector_log(spark, sf_dir).where(F.col("op") == changelog.PUT)
    return changelog.live(log, ["key"]).select(F.col("key").alias("vec_id"), "label")


@query("SELECT vec_id FROM embeddings WHERE vec_id % 7 <> 0")
def vectors_delete(spark, sf_dir):
    return changelog.live(vector_log(spark, sf_dir), ["key"]).select(F.col("key").alias("vec_id"))


@query("""WITH k AS (SELECT 'v' || lpad(vec_id::VARCHAR, 6, '0') AS key FROM embeddings), m AS (SELECT key FROM k WHERE starts_with(key, 'v0000') AND key > 'v000010')
    SELECT key, (SELECT count(*) > 25 FROM m) AS is_truncated FROM (SELECT key FROM m ORDER BY key LIMIT 25) t""")
def vectors_list_page(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.format_string("v%06d", "vec_id").alias("key"))
    keys, more, _ = listing.key_page(rows, "v0000", "v000010", 25)
    return spark.createDataFrame([(k, more) for k in keys], "key string, is_truncated boolean")


@query("""SELECT label::VARCHAR AS index_name, count(*) AS n, min(vec_id) AS least FROM embeddings WHERE vec_id > CASE WHEN label % 2 = 0 THEN 200 ELSE -1 END GROUP BY label""")
def index_delete_fence(spark, sf_dir):
    log = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("index_name"), F.col("vec_id").alias("key"), F.col("vec_id").alias("seq"), F.lit("PUT").alias("op"))
    deletions = log.where(F.col("index_name").cast("int") % 2 == 0).select("index_name", F.lit(200).cast("long").alias("seq"))
    return changelog.live(changelog.fenced(log, deletions), ["index_name", "key"]).groupBy("index_name").agg(F.count("*").alias("n"), F.min("key").alias("least"))


# Metadata filters, over events: props is {"k": int}; every seventh event has no metadata.

NO_PROPS = "event_id % 7 <> 0"
NUMBER = "CAST(json_extract_string(props, '$.k') AS DOUBLE)"


def filtered(spark: SparkSession, sf_dir: str, condition: dict) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.try_parse_json("props")).alias("metadata"))
    return rows.where(matches(F.col("metadata"), condition)).select("event_id")


FILTERS = {
    "filter_bare": ({"k": 5}, f"{NUMBER} = 5"),
    "filter_eq": ({"k": {"$eq": 5}}, f"{NUMBER} = 5"),
    "filter_eq_other_type": ({"k": {"$eq": "5"}}, "false"),
    "filter_ne": ({"k": {"$ne": 5}}, f"{NUMBER} <> 5"),
    "filter_ne_missing": ({"absent": {"$ne": 1}}, "true"),
    "filter_gt": ({"k": {"$gt": 50}}, f"{NUMBER} > 50"),
    "filter_gte": ({"k": {"$gte": 50}}, f"{NUMBER} >= 50"),
    "filter_lt": ({"k": {"$lt": 10}}, f"{NUMBER} < 10"),
    "filter_lte": ({"k": {"$lte": 10}}, f"{NUMBER} <= 10"),
    "filter_in": ({"k": {"$in": [1, 2, 3, "4"]}}, f"{NUMBER} IN (1, 2, 3)"),
    "filter_nin_missing": ({"absent": {"$nin": [1]}, "k": {"$nin": [5, 6]}}, f"{NUMBER} NOT IN (5, 6)"),
    "filter_and_multi": ({"k": {"$gte": 10, "$lt": 20, "$ne": 15}, "absent": {"$ne": "x"}}, f"{NUMBER} >= 10 AND {NUMBER} < 20 AND {NUMBER} <> 15"),
    "filter_null_metadata": ({}, "true"),
    "filter_empty_object": ({"k": {}}, "false"),
}
for _name, (_condition, _sql) in FILTERS.items():
    QUERIES[_name] = lambda spark, sf_dir, condition=_condition: filtered(spark, sf_dir, condition)
    ORACLE[_name] = f"SELECT event_id FROM events WHERE {NO_PROPS} AND ({_sql})"


# Objects: a document is an object of its source's bucket.

KEY = "lang || '/' || source || '/' || lpad(doc_id::VARCHAR, 8, '0') || '.txt'"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    key = F.concat_ws("/", "lang", "source", F.concat(F.format_string("%08d", "doc_id"), F.lit(".txt")))
    return rows.select(F.col("source").alias("bucket"), key.alias("key"), F.encode("text", "UTF-8").alias("data"), "doc_id")


@query("SELECT doc_id, octet_length(encode(text)) AS size, md5(text) AS digest, text FROM documents")
def object_get(spark, sf_dir):
    return read_whole(documents(spark, sf_dir))


def read_whole(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", O.size(F.col("data")).alias("size"), F.md5("data").alias("digest"), F.decode("data", "UTF-8").alias("text"))


@query(f"""SELECT {KEY} AS key, octet_length(encode(text)) AS size, '"' || md5(text) || '"' AS etag, 'text/plain' AS type FROM documents""")
def object_stat(spark, sf_dir):
    return documents(spark, sf_dir).select("key", O.size(F.col("data")).alias("size"), O.etag(F.col("data")).alias("etag"), O.content_type(F.lit(None).cast("string"), F.col("key")).alias("type"))


@query("""SELECT doc_id, '"' || md5(text) || '"' AS etag FROM documents""")
def object_etag(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", O.etag(F.col("data")).alias("etag"))


EXTENSIONS = (".html", ".JSON", ".tar.gz", ".md", "", ".unknown", ".PNG", ".")
MIME_SQL = " ".join(f"WHEN '{e}' THEN '{t}'" for e, t in O.MIME_TYPES.items())


@query(f"""WITH n AS (SELECT doc_id, 'file' || doc_id::VARCHAR || ['{"', '".join(EXTENSIONS)}'][(doc_id % {len(EXTENSIONS)} + 1)::INTEGER] AS name FROM documents)
    SELECT doc_id, name, CASE lower(regexp_extract(name, '(\\.[^.]*)$', 1)) {MIME_SQL} ELSE '{O.DEFAULT_TYPE}' END AS type FROM n""")
def object_mime(spark, sf_dir):
    extensions = F.array(*map(F.lit, EXTENSIONS))
    name = F.concat(F.lit("file"), F.col("doc_id").cast("string"), F.get(extensions, (F.col("doc_id") % len(EXTENSIONS)).cast("int")))
    return table(spark, sf_dir, "documents").select("doc_id", name.alias("name")).withColumn("type", O.guess_type(F.col("name")))


@query("""SELECT a.id AS doc_id, count(d.doc_id) > 0 AS found FROM (VALUES (0), (5), (-1), (99999999), (17)) a(id) LEFT JOIN documents d ON d.doc_id = a.id GROUP BY a.id""")
def object_exists(spark, sf_dir):
    asked_for = spark.createDataFrame([(i,) for i in (0, 5, -1, 99999999, 17)], "doc_id long")
    there = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("there"))
    return asked_for.join(there, F.col("doc_id") == F.col("there"), "left").groupBy("doc_id").agg((F.count("there") > 0).alias("found"))


@query("""SELECT doc_id, lower(hex(encode(text)[11:LEAST(40, octet_length(encode(text)))])) AS part FROM documents""")
def object_range(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.lower(F.hex(O.byte_range(F.col("data"), 10, 40))).alias("part"))


HEADERS = ("bytes=0-4", "bytes=5-", "bytes=100000000-200000000", "bytes=0-99999999", "bytes=-5", "items=1-2")


@query(f"""WITH h AS (SELECT doc_id, octet_length(encode(text)) AS size, ['{"', '".join(HEADERS)}'][(doc_id % {len(HEADERS)} + 1)::INTEGER] AS header FROM documents),
    p AS (SELECT *, regexp_matches(header, '^bytes=[0-9]+-[0-9]*$') AS known, TRY_CAST(regexp_extract(header, '^bytes=([0-9]+)-([0-9]*)$', 1) AS BIGINT) AS a, TRY_CAST(regexp_extract(header, '^bytes=([0-9]+)-([0-9]*)$', 2) AS BIGINT) AS b FROM h),
    c AS (SELECT *, LEAST(coalesce(b, size - 1), size - 1) AS last FROM p)
    SELECT doc_id, header, CASE WHEN NOT known THEN 200 WHEN a > last OR a >= size THEN 416 ELSE 206 END AS status,
    (CASE WHEN NOT known THEN 0 WHEN a > last OR a >= size THEN NULL ELSE a END)::BIGINT AS start, (CASE WHEN NOT known THEN size WHEN a > last OR a >= size THEN NULL ELSE last + 1 END)::BIGINT AS stop FROM c""")
def object_range_header(spark, sf_dir):
    header = F.get(F.array(*map(F.lit, HEADERS)), (F.col("doc_id") % len(HEADERS)).cast("int"))
    rows = documents(spark, sf_dir).select("doc_id", header.alias("header"), O.size(F.col("data")).alias("size"))
    r = O.http_range(F.col("header"), F.col("size"))
    return rows.select("doc_id", "header", r["status"].alias("status"), r["start"].alias("start"), r["end"].alias("stop"))


@query("""WITH s AS (SELECT doc_id, encode(text) AS b, octet_length(encode(text)) AS size FROM documents),
    c AS (SELECT doc_id, b, size, unnest(range(0, ((size + 999) // 1000)::BIGINT)) AS no FROM s)
    SELECT doc_id, no::INTEGER AS no, LEAST(1000, size - no * 1000)::BIGINT AS size, md5(hex(b[(no * 1000 + 1)::BIGINT:LEAST((no + 1) * 1000, size)::BIGINT])) AS digest FROM c""")
def object_chunks(spark, sf_dir):
    return chunked(documents(spark, sf_dir))


def chunked(rows: DataFrame) -> DataFrame:
    rows = rows.select("doc_id", F.explode(O.chunks(F.col("data"), 1000)).alias("c"))
    return rows.select("doc_id", "c.no", F.octet_length("c.bytes").cast("long").alias("size"), F.md5(F.hex("c.bytes").cast("binary")).alias("digest"))


@query("""SELECT conv_id, count(*) AS n, octet_length(encode(string_agg(text, '' ORDER BY turn))) AS size, md5(string_agg(text, '' ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id""")
def object_concat_chunks(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.encode("text", "UTF-8").alias("data"))
    whole = rows.groupBy("conv_id").agg(F.count("*").alias("n"), O.concat_chunks(F.col("turn"), F.col("data")).alias("data"))
    return whole.select("conv_id", "n", O.size(F.col("data")).alias("size"), F.md5("data").alias("digest"))


@query(f"""SELECT 'copies' AS bucket, 'copy/' || {KEY} AS key, '"' || md5(text) || '"' AS etag FROM documents""")
def object_copy(spark, sf_dir):
    return copied(documents(spark, sf_dir))


def copied(rows: DataFrame) -> DataFrame:
    source = rows.withColumn("etag", O.etag(F.col("data")))
    return copies(source, "copies", F.concat(F.lit("copy/"), F.col("key")), 0).select("bucket", "key", "etag")


#: The moment at which lifetimes are judged: 100 s after each event, whatever the clock says.
@query(f"""WITH e AS (SELECT event_id, epoch_us(ts) // 1000 AS t, {NUMBER} AS k FROM events), d AS (SELECT *, CASE WHEN k <> 0 THEN (t + (k - 10) * 5 * 1000)::BIGINT END AS deadline FROM e WHERE k <> 10)
    SELECT event_id, deadline AS expires_at_ms FROM d WHERE deadline IS NULL OR t + 100000 <= deadline""")
def object_ttl_live(spark, sf_dir):
    millis = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")  # in any session's time zone
    rows = table(spark, sf_dir, "events").select("event_id", millis.alias("t"), F.get_json_object("props", "$.k").cast("double").alias("k")).where("k <> 10")
    seconds = F.when(F.col("k") != 0, (F.col("k") - 10) * 5)
    rows = rows.withColumn("expires_at_ms", O.expires_at(F.col("t"), seconds))
    return rows.where(O.live(F.col("expires_at_ms"), F.col("t") + 100000)).select("event_id", "expires_at_ms")


@query("SELECT source AS bucket, count(*) AS n, sum(octet_length(encode(text)))::BIGINT AS size FROM documents GROUP BY source")
def bucket_isolation(spark, sf_dir):
    return documents(spark, sf_dir).groupBy("bucket").agg(F.count("*").alias("n"), F.sum(O.size(F.col("data"))).alias("size"))


# Listings.


@query(f"SELECT key FROM (SELECT {KEY} AS key FROM documents) t WHERE starts_with(key, 'en/src1') ORDER BY key LIMIT 50")
def list_prefix(spark, sf_dir):
    return listing.eligible(documents(spark, sf_dir), "en/src1").select("key").orderBy("key").limit(50)


@query(f"SELECT key FROM (SELECT {KEY} AS key FROM documents) t WHERE starts_with(key, 'en/') AND key > 'en/src12/' ORDER BY key LIMIT 50")
def list_start_after(spark, sf_dir):
    return listing.eligible(documents(spark, sf_dir), "en/", "en/src12/").select("key").orderBy("key").limit(50)


@query(f"""WITH k AS (SELECT {KEY} AS key FROM documents UNION ALL SELECT 'en/' || doc_id::VARCHAR || '.txt' FROM documents WHERE doc_id < 5), r AS (SELECT key, substr(key, 4) AS rest FROM k WHERE starts_with(key, 'en/'))
    SELECT CASE WHEN instr(rest, '/') > 0 THEN 'en/' || substr(rest, 1, instr(rest, '/')) ELSE key END AS item, instr(rest, '/') > 0 AS is_prefix, count(*) AS n_keys, max(key) AS last_key FROM r GROUP BY 1, 2""")
def list_delimiter(spark, sf_dir):
    return listing.items(shelved(spark, sf_dir), "en/", "/")


def shelved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of documents, and a few without a further level."""
    rows = documents(spark, sf_dir)
    return rows.select("key").union(rows.where("doc_id < 5").select(F.concat(F.lit("en/"), F.col("doc_id").cast("string"), F.lit(".txt"))))


@query(f"""WITH k AS (SELECT {KEY} AS key FROM documents UNION ALL SELECT 'en/' || doc_id::VARCHAR || '.txt' FROM documents WHERE doc_id < 5), r AS (SELECT key, substr(key, 4) AS rest FROM k WHERE starts_with(key, 'en/')),
    i AS (SELECT CASE WHEN instr(rest, '/') > 0 THEN 'en/' || substr(rest, 1, instr(rest, '/')) ELSE key END AS item, count(*) AS n FROM r GROUP BY 1),
    o AS (SELECT item, n, row_number() OVER (ORDER BY item) AS ordinal FROM i)
    SELECT ordinal::INTEGER AS ordinal, item, (SELECT max(ordinal) > 8 OR max(CASE WHEN ordinal = 8 THEN n END) > 1 FROM o) AS is_truncated FROM o WHERE ordinal <= 8""")
def list_truncation(spark, sf_dir):
    return listing.page_rows(shelved(spark, sf_dir), "en/", "/", None, 8).select("ordinal", "item", "is_truncated")


# Change logs, over events: a key is (user_id, k); an event of type error deletes.

LOG = f"l AS (SELECT event_id AS seq, event_id // 100 AS txn, user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_type, value, ts, octet_length(encode(props)) AS size FROM events)"


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "error", changelog.DELETE).otherwise(changelog.PUT)
    return rows.select(
        F.col("event_id").alias("seq"),
        F.floor(F.col("event_id") / 100).cast("long").alias("txn_id"),
        op.alias("op"),
        "user_id",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        "value",
        "ts",
        F.octet_length("props").cast("long").alias("size"),
    )


KEYS = ["user_id", "k"]


def by_time() -> Column:
    return F.struct("ts", "seq")


LAST = "row_number() OVER (PARTITION BY user_id, k ORDER BY ts DESC, seq DESC) AS rn"


@query(f"WITH {LOG} SELECT user_id, k, seq, round(value, 6) AS value FROM (SELECT *, {LAST} FROM l) t WHERE rn = 1 AND event_type <> 'error'")
def log_lww(spark, sf_dir):
    return changelog.live(event_log(spark, sf_dir), KEYS, by_time()).select("user_id", "k", "seq", F.round("value", 6).alias("value"))


@query(f"WITH {LOG} SELECT user_id, k, seq FROM (SELECT *, {LAST} FROM l) t WHERE rn = 1 AND event_type = 'error'")
def log_delete(spark, sf_dir):
    return changelog.last_writes(event_log(spark, sf_dir), KEYS, by_time()).where(F.col("op") == changelog.DELETE).select("user_id", "k", "seq")


@query(f"WITH {LOG}, c AS (SELECT * FROM l WHERE txn % 3 <> 0) SELECT user_id, k, seq, round(value, 6) AS value FROM (SELECT *, {LAST} FROM c) t WHERE rn = 1 AND event_type <> 'error'")
def log_txn_committed(spark, sf_dir):
    log = event_log(spark, sf_dir)
    empty = [F.lit(None).cast(log.schema[c].dataType).alias(c) for c in log.columns if c not in ("seq", "txn_id", "op")]
    marks = log.where(F.col("txn_id") % 3 != 0).groupBy("txn_id").agg(F.max("seq").alias("seq"))
    marks = marks.select("seq", "txn_id", F.lit(changelog.TXN_COMMIT).alias("op"), *empty)
    return changelog.live(changelog.committed(log.unionByName(marks)), KEYS, by_time()).select("user_id", "k", "seq", F.round("value", 6).alias("value"))


@query(f"""WITH {LOG}, n AS (SELECT *, {LAST} FROM l), s AS (SELECT sum(CASE WHEN event_type <> 'error' THEN size ELSE 0 END)::BIGINT AS total_bytes, sum(CASE WHEN event_type <> 'error' AND rn = 1 THEN size ELSE 0 END)::BIGINT AS live_bytes FROM n)
    SELECT total_bytes, live_bytes, total_bytes - live_bytes AS dead_bytes, (total_bytes - live_bytes) > total_bytes * 0.5 AS compact FROM s""")
def log_compaction_stats(spark, sf_dir):
    return changelog.accounting(event_log(spark, sf_dir), KEYS, "size", by_time())


@query("""WITH c AS (SELECT doc_id AS seq, doc_id % 97 <> 96 AS good FROM documents), f AS (SELECT min(seq) AS first_corrupt FROM c WHERE NOT good)
    SELECT (SELECT count(*) FROM c) AS n_total, (SELECT count(*) FROM c WHERE (SELECT first_corrupt FROM f) IS NULL OR seq < (SELECT first_corrupt FROM f)) AS n_valid, first_corrupt FROM f""")
def integrity_scan(spark, sf_dir):
    rows = documents(spark, sf_dir).withColumn("stored", F.when(F.col("doc_id") % 97 == 96, F.md5(F.lit("flipped"))).otherwise(F.md5("data")))
    return changelog.integrity(rows, F.col("stored") == F.md5("data"), "doc_id")


# Reconciliation of labels (as vectors) with documents, and of documents with embeddings.


def numbered(spark: SparkSession, sf_dir: str, name: str, column: str) -> DataFrame:
    return table(spark, sf_dir, name).select(F.col(column).cast("string").alias("key"))


@query("SELECT DISTINCT doc_id::VARCHAR AS key FROM documents d WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def reconcile_orphan_vectors(spark, sf_dir):
    return reconcile.orphaned_vectors(numbered(spark, sf_dir, "documents", "doc_id"), numbered(spark, sf_dir, "embeddings", "vec_id"))


@query("SELECT DISTINCT doc_id::VARCHAR AS key FROM documents d WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def reconcile_orphan_objects(spark, sf_dir):
    return reconcile.orphaned_objects(numbered(spark, sf_dir, "labels", "doc_id"), numbered(spark, sf_dir, "documents", "doc_id"))


@query("""SELECT DISTINCT vec_id::VARCHAR AS key, 'vector' AS side FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')
    UNION ALL SELECT DISTINCT 'docs/' || doc_id::VARCHAR AS key, 'object' AS side FROM documents WHERE lang = 'en' AND doc_id NOT IN (SELECT vec_id FROM embeddings)""")
def reconcile_key_mapper(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    there = rows.select(F.concat(F.when(F.col("lang") == "en", "docs/").otherwise("other/"), F.col("doc_id").cast("string")).alias("key"))
    vectors = numbered(spark, sf_dir, "embeddings", "vec_id")
    mapper = lambda k: F.concat(F.lit("docs/"), k)
    lone = reconcile.orphaned_vectors(vectors, there, mapper, "docs/").withColumn("side", F.lit("vector"))
    return lone.union(reconcile.orphaned_objects(vectors, there, mapper, "docs/").withColumn("side", F.lit("object")))
