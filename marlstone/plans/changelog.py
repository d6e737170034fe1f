"""Plans over append-only change logs: replay, transactions, fences, accounting, integrity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PUT, DELETE, TXN_BEGIN, TXN_COMMIT = "PUT", "DELETE", "TXN_BEGIN", "TXN_COMMIT"


def committed(log: DataFrame) -> DataFrame:
    """The records (seq, txn_id, op, ...) that count: those outside transactions, and those of
    transactions with a commit record. Begin and commit records go."""
    data = log.where(~F.col("op").isin(TXN_BEGIN, TXN_COMMIT))
    done = log.where(F.col("op") == TXN_COMMIT).select(F.col("txn_id").alias("_done")).distinct()
    inside = data.where(F.col("txn_id").isNotNull()).join(done, F.col("txn_id") == F.col("_done"), "left_semi")
    return data.where(F.col("txn_id").isNull()).unionByName(inside)


def last_writes(log: DataFrame, keys: Sequence[str], seq: Column | str = "seq") -> DataFrame:
    """The newest record of each key. An aggregation, so that a key written without end costs a
    row a task, not a partition."""
    order = F.col(seq) if isinstance(seq, str) else seq
    newest = log.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in log.columns if c not in keys]), order).alias("_r"))
    return newest.select(*keys, "_r.*").select(*log.columns)


def live(log: DataFrame, keys: Sequence[str], seq: Column | str = "seq", op: str = "op") -> DataFrame:
    """Replay: the newest record of each key unless it deletes."""
    return last_writes(log, keys, seq).where(F.col(op) == PUT)


def state(snapshot: DataFrame | None, log: DataFrame | None, keys: Sequence[str], seq: Column | str = "seq") -> DataFrame | None:
    """Live records of a snapshot (one live record a key) and the log written after it. Only the log
    is replayed; of the snapshot's rows none move but where the log is too large to be broadcast."""
    if log is None:
        return snapshot
    changes = last_writes(committed(log), keys, seq)
    put = changes.where(F.col("op") == PUT)
    if snapshot is None:
        return put
    # Names of their own: both sides can come from one file.
    changed = changes.select(*[F.col(k).alias(f"_{k}") for k in keys])
    return snapshot.join(changed, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left_anti").unionByName(put)


def fenced(log: DataFrame, deletions: DataFrame, index: str = "index_name") -> DataFrame:
    """Records of an index after its last deletion (index, seq): a deletion takes all before it."""
    last = deletions.groupBy(F.col(index).alias("_i")).agg(F.max("seq").alias("_fence"))
    joined = log.join(last, F.col(index) == F.col("_i"), "left")
    return joined.where(F.col("_fence").isNull() | (F.col("seq") > F.col("_fence"))).select(*[log[c] for c in log.columns])


def accounting(log: DataFrame, keys: Sequence[str], size: str = "size", seq: Column | str = "seq") -> DataFrame:
    """One row: total, live and dead bytes of a log's puts, and whether compaction is due (over
    half of them dead)."""
    order = F.col(seq) if isinstance(seq, str) else seq
    put = F.when(F.col("op") == PUT, F.col(size)).otherwise(F.lit(0))
    by_key = log.groupBy(*keys).agg(F.sum(put).alias("all"), F.max_by(put, order).alias("now"))
    total = F.coalesce(F.sum("all"), F.lit(0))
    alive = F.coalesce(F.sum("now"), F.lit(0))
    out = by_key.agg(total.alias("total_bytes"), alive.alias("live_bytes"), (total - alive).alias("dead_bytes"))
    return out.withColumn("compact", F.col("dead_bytes") > F.col("total_bytes") * 0.5)


def integrity(log: DataFrame, good: Column, seq: str = "seq") -> DataFrame:
    """One row: n_total, n_valid (records before the first bad one) and first_corrupt (its seq)."""
    out = log.agg(F.count("*").alias("n_total"), F.min(F.when(~good, F.col(seq))).alias("first_corrupt"))
    before = log.join(F.broadcast(out.select("first_corrupt")), how="cross").where(F.col("first_corrupt").isNull() | (F.col(seq) < F.col("first_corrupt"))).agg(F.count("*").alias("n_valid"))
    return out.join(F.broadcast(before), how="cross").select("n_total", "n_valid", "first_corrupt")


def repaired(log: DataFrame, good: Column) -> DataFrame:
    """The records that are whole; bad ones are skipped wherever they lie."""
    return log.where(F.coalesce(good, F.lit(False)))
