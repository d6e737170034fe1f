"""Vector store: named indexes of keyed dense and sparse vectors with JSON metadata."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.events import Events
from marlstone.functions.metadata import matches
from marlstone.objects import CHECKPOINT_PARTS, ObjectStore, now_ms
from marlstone.operators import dense, hybrid, reconcile, sparse
from marlstone.operators.listing import key_page
from marlstone.plans import changelog
from marlstone.schema import VECTOR_LOG
from marlstone.sources.folder import Folder, scratch
from marlstone.sources.lock import FileLock
from marlstone.sources.log import LogTable, ReadonlyError

CATALOG = "INDEXES"
KEYS = ("index_name", "key")


@dataclass
class IndexConfig:
    name: str
    dimension: int
    metric: str = "cosine"
    sparse: bool = False
    m: int = 16
    ef_construction: int = 200
    created_at: int = 0
    #: Records of the index with a smaller number belong to one deleted before.
    fence: int = 0


def shaped(results: DataFrame, vectors: DataFrame, include_metadata: bool = True, include_vectors: bool = False, with_sparse: bool = False) -> DataFrame:
    """Results (key, score, ...) with what the caller wants of their vectors; k rows, so that they
    are the broadcast side."""
    wanted = [c for c, on in (("metadata", include_metadata), ("vector", include_vectors), ("sparse", include_vectors and with_sparse)) if on]
    results = results.select(*[c for c in results.columns if c not in ("metadata", "vector", "sparse")])
    if not wanted:
        return results
    return vectors.select("key", *wanted).join(F.broadcast(results), "key", "right").select(*results.columns, *wanted)


def newest() -> Column:
    """The order of a key's records: by number, and in a batch, whose rows share one, by a hash."""
    return F.struct("seq", F.xxhash64("vector", "sparse", "metadata"))


class VectorStore:
    def __init__(self, spark: SparkSession, path: str | None = None, readonly: bool = False, lock_stale_after_ms: float | None = None, clock: Callable[[], int] = now_ms):
        self.spark, self.readonly, self.clock = spark, readonly, clock
        self.folder = Folder(spark, path or scratch(spark, "vectors"))
        self.lock = None if readonly else FileLock(self.folder, lock_stale_after_ms)
        if self.lock:
            self.lock.acquire()
        self.table = LogTable(spark, self.folder, VECTOR_LOG, confirm=self.lock and self.lock.confirm)
        self.indexes = {x["name"]: IndexConfig(**x) for x in json.loads(self.folder.read(CATALOG) or "[]")}
        self.events = Events()

    def _writable(self, operation: str) -> None:
        if self.readonly:
            raise ReadonlyError(operation)

    def _save(self) -> None:
        self.folder.write(CATALOG, json.dumps([vars(x) for x in self.indexes.values()]))

    def entry(self, name: str) -> IndexConfig:
        if name not in self.indexes:
            raise KeyError(f"no such index: {name}")
        return self.indexes[name]

    def create_index(self, name: str, dimension: int, metric: str = "cosine", sparse: bool = False, m: int = 16, ef_construction: int = 200) -> IndexConfig:
        self._writable("create_index")
        if name in self.indexes:
            raise ValueError(f"index already exists: {name}")
        self.indexes[name] = IndexConfig(name, dimension, metric, sparse, m, ef_construction, self.clock(), self.table.next_seq())
        self._save()
        self.events.emit("create_index", name)
        return self.indexes[name]

    def delete_index(self, name: str) -> bool:
        self._writable("delete_index")
        existed = self.indexes.pop(name, None) is not None
        if existed:
            self._save()
            self.events.emit("delete_index", name)
        return existed

    def get_index(self, name: str) -> IndexConfig | None:
        return self.indexes.get(name)

    def list_indexes(self) -> list[IndexConfig]:
        return list(self.indexes.values())

    def _live(self, name: str, fence: int) -> DataFrame:
        """The index's live records. Over a checkpoint without later writes no vector moves."""
        wanted = (F.col("index_name") == name) & (F.col("seq") > fence)
        snapshot, log = self.table.snapshot(), self.table.log()
        found = changelog.state(snapshot and snapshot.where(wanted), log and log.where(wanted), KEYS, newest())
        return self.table.rows() if found is None else found

    def vectors(self, name: str) -> DataFrame:
        """Live vectors (key, vector, norm, sparse, metadata as a variant)."""
        fence = self.entry(name).fence
        found = self._live(name, fence)
        return found.select("key", "vector", "norm", "sparse", F.parse_json("metadata").alias("metadata"))

    def put_vectors(self, name: str, inputs: Sequence[Mapping]) -> None:
        """Puts {key, vector?, sparse?: {indices, values}, metadata?} as one commit: all or none.
        A record replaces the one before, but a missing dense vector keeps the stored one."""
        self._writable("put_vectors")
        entry = self.entry(name)
        kept = {}
        missing = [x["key"] for x in inputs if x.get("vector") is None]
        if missing:
            kept = {r["key"]: list(r.vector) for r in self.vectors(name).where(F.col("key").isin(missing) & F.col("vector").isNotNull()).select("key", "vector").collect()}
        rows, first = [], self.table.next_seq(max(len(inputs), 1))
        for i, x in enumerate(inputs):
            vector = x.get("vector")
            if vector is not None:
                vector = [float(v) for v in np.asarray(vector, np.float32)]
                if len(vector) != entry.dimension:
                    raise ValueError(f"vector dimension {len(vector)} is not the index's {entry.dimension}")
                kept[x["key"]] = vector
            if x.get("sparse") is not None and not entry.sparse:
                raise ValueError(f"index {name} holds no sparse vectors")
            vector = kept.get(x["key"])
            norm = float(np.linalg.norm(np.asarray(vector, np.float64))) if vector is not None else None
            part = x.get("sparse") and ([int(d) for d in x["sparse"]["indices"]], [float(v) for v in x["sparse"]["values"]])
            metadata = None if x.get("metadata") is None else json.dumps(x["metadata"])
            rows.append((first + i, None, changelog.PUT, name, x["key"], vector, norm, part or None, metadata))
        if rows:
            self.table.append(rows)
            self.checkpoint_if_long()
        self.events.emit("put_vectors", name, [x["key"] for x in inputs])

    def put_frame(self, name: str, rows: DataFrame) -> None:
        """Puts a batch (key, vector?, sparse?, metadata as JSON text?) as one commit, with the checks
        of put_vectors. A batch has no order: of rows that repeat a key the one that newest() picks
        stays, in every read. The event names no keys, which can be any number."""
        self._writable("put_vectors")
        entry = self.entry(name)
        for c, kind in (("vector", "array<float>"), ("sparse", VECTOR_LOG["sparse"].dataType), ("metadata", "string")):
            rows = rows if c in rows.columns else rows.withColumn(c, F.lit(None).cast(kind))
        bad = F.col("vector").isNotNull() & (F.size("vector") != entry.dimension)
        checked = F.when(bad, F.raise_error(F.lit(f"a vector's dimension is not {entry.dimension}")).cast("array<float>")).otherwise(F.col("vector").cast("array<float>"))
        if not entry.sparse:
            refused = F.raise_error(F.lit(f"index {name} holds no sparse vectors")).cast(VECTOR_LOG["sparse"].dataType)
            rows = rows.withColumn("sparse", F.when(F.col("sparse").isNotNull(), refused))
        rows = rows.withColumn("vector", checked)
        # A row without a dense vector keeps the stored one; only such rows move.
        stored = self.vectors(name).select(F.col("key").alias("_key"), F.col("vector").alias("_stored"))
        lacking = rows.where(F.col("vector").isNull()).join(stored, F.col("key") == F.col("_key"), "left")
        lacking = lacking.withColumn("vector", F.col("_stored")).select(*rows.columns)
        rows = rows.where(F.col("vector").isNotNull()).unionByName(lacking)
        from marlstone.functions.distance import norm

        rows = rows.withColumns({"seq": F.lit(self.table.next_seq()).cast("long"), "txn_id": F.lit(None).cast("long"), "op": F.lit(changelog.PUT), "index_name": F.lit(name), "norm": norm(F.col("vector"))})
        self.table.append(rows.select(*VECTOR_LOG.names))
        self.checkpoint_if_long()
        self.events.emit("put_vectors", name, None)

    def get_vectors(self, name: str, keys: Sequence[str]) -> list[dict]:
        """Records in the order asked for; missing keys are left out, repeated ones repeated."""
        return [r.asDict(recursive=True) for r in get_by_keys(self.vectors(name), keys).withColumn("metadata", F.to_json("metadata")).collect()]

    def delete_vectors(self, name: str, keys: Sequence[str]) -> int:
        self._writable("delete_vectors")
        there = {r[0] for r in self.vectors(name).where(F.col("key").isin(list(keys))).select("key").collect()}
        if there:
            first = self.table.next_seq(len(there))
            self.table.append([(first + i, None, changelog.DELETE, name, k, None, None, None, None) for i, k in enumerate(sorted(there))])
            self.checkpoint_if_long()
            self.events.emit("delete_vectors", name, list(keys))
        return len(there)

    def list_vectors(self, name: str, prefix: str | None = None, start_after: str | None = None, max_keys: int | None = None) -> tuple[list[str], bool, str | None]:
        return key_page(self.vectors(name), prefix, start_after, max_keys)

    def has_key(self, name: str, key: str) -> bool:
        return not self.vectors(name).where(F.col("key") == key).isEmpty()

    def size(self, name: str) -> int:
        return self.vectors(name).count()

    def query(
        self,
        name: str,
        top_k: int,
        vector: Sequence[float] | None = None,
        sparse_vector: Mapping | None = None,
        ef_search: int = dense.EF,
        condition: Mapping | None = None,
        fusion_k: float = hybrid.FUSION_K,
        include_vectors: bool = False,
        include_metadata: bool = True,
        filter_mode: str = "pre",
    ) -> DataFrame:
        """The best vectors by distance, by sparse dot product, or by both rankings fused."""
        entry, rows = self.entry(name), self.vectors(name)
        if vector is None and sparse_vector is None:
            raise ValueError("a query needs a dense or a sparse vector")
        legs = {}
        fetch = 2 * top_k if vector is not None and sparse_vector is not None else top_k
        if vector is not None:
            if len(vector) != entry.dimension and not rows.where(F.col("vector").isNotNull()).isEmpty():
                raise ValueError(f"query dimension {len(vector)} is not the index's {entry.dimension}")
            fits = rows.where(F.size("vector") == len(vector))
            legs["dense"] = dense.top_k(fits, vector, fetch, entry.metric, condition, filter_mode, ef_search)
        if sparse_vector is not None:
            if not entry.sparse:
                raise ValueError(f"index {name} holds no sparse vectors")
            asked = sparse.query_frame(self.spark, sparse_vector["indices"], sparse_vector["values"])
            keep = None if condition is None else rows.where(matches(F.col("metadata"), condition))
            legs["sparse"] = sparse.top_k(sparse.postings(rows), asked, fetch, keep)
        if len(legs) == 2:
            found = hybrid.fuse(legs["dense"].select("key", "score"), legs["sparse"], top_k, fusion_k)
            order = [F.col("score"), F.col("dense_rank").asc_nulls_last(), F.col("sparse_rank").asc_nulls_last()]
        else:
            found = next(iter(legs.values())).select("key", "score")
            order = [F.col("score"), F.col("key")]
        return shaped(found, rows, include_metadata, include_vectors, entry.sparse).orderBy(*order)

    def checkpoint(self) -> None:
        """Folds the log to the live records of the indexes that exist."""
        self._writable("checkpoint")
        rows = None
        for x in self.indexes.values():
            one = self._live(x.name, x.fence)
            rows = one if rows is None else rows.union(one)
        if rows is None:
            rows = self.spark.createDataFrame([], VECTOR_LOG)
        self.table.checkpoint(rows.select(*VECTOR_LOG.names), KEYS)

    def checkpoint_if_long(self) -> None:
        if len(self.table.state["parts"]) >= CHECKPOINT_PARTS:
            self.checkpoint()

    def close(self) -> None:
        if self.lock:
            self.checkpoint()
            self.lock.release()


class VectorClient:
    """The store's calls under one name."""

    def __init__(self, spark: SparkSession, path: str | None = None, readonly: bool = False, **ignored):
        self.store = VectorStore(spark, path, readonly)
        for name in ("create_index", "delete_index", "get_index", "list_indexes", "put_vectors", "put_frame", "get_vectors", "delete_vectors", "list_vectors", "has_key", "query", "checkpoint", "close"):
            setattr(self, name, getattr(self.store, name))
        self.on, self.off = self.store.events.on, self.store.events.off


def get_by_keys(vectors: DataFrame, keys: Sequence) -> DataFrame:
    """Vectors in the order of keys: missing keys are left out, repeated ones repeated."""
    spark = vectors.sparkSession
    kind = vectors.schema["key"].dataType.simpleString()
    asked = spark.createDataFrame(list(enumerate(keys)), f"pos int, key {kind}")
    return vectors.join(F.broadcast(asked), "key").orderBy("pos").select("pos", *vectors.columns)


def reconciled(objects: ObjectStore, vectors: VectorStore, index: str, bucket: str = "default", prefix: str = "", mapper: reconcile.Mapper = reconcile.identity, dry_run: bool = True) -> tuple[DataFrame, DataFrame, int]:
    """Vectors without an object, objects without a vector, and how many of the former were
    removed (none in a dry run)."""
    rows, there = vectors.vectors(index), objects.objects(bucket)
    lone_vectors = reconcile.orphaned_vectors(rows, there, mapper, prefix)
    lone_objects = reconcile.orphaned_objects(rows, there, mapper, prefix)
    removed = 0
    if not dry_run:
        vectors._writable("reconcile")
        gone = lone_vectors.withColumns({"seq": F.lit(vectors.table.next_seq()).cast("long"), "op": F.lit(changelog.DELETE), "index_name": F.lit(index)})
        for f in VECTOR_LOG.fields:
            gone = gone if f.name in gone.columns else gone.withColumn(f.name, F.lit(None).cast(f.dataType))
        vectors.table.append(gone.select(*VECTOR_LOG.names))
        # Counted in the part just written, so that the anti join runs once.
        removed = vectors.table.last_part().count()
        vectors.checkpoint_if_long()
        if removed:
            vectors.events.emit("delete_vectors", index, None)
    return lone_vectors, lone_objects, removed
