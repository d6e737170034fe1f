"""Versioned tables of a store: a snapshot, and log parts written since.

Snapshots are sorted by key over ranges of keys, so that Parquet's statistics skip files, row groups
and pages when keys or prefixes are asked for.

CURRENT names the snapshot and the parts that count; it is replaced at once, so that a crash leaves
the old state or the new. Each commit is one part (one Spark write); a checkpoint writes the live
rows as a new snapshot. A reader keeps the CURRENT it has read: what a checkpoint replaces is deleted
only by the checkpoint RETAINED further on, so that open readers and plans made before go on working.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from marlstone.sources.folder import Folder

FORMAT, VERSION = "marlstone-log", 1
#: Checkpoints that a replaced snapshot and its parts outlive.
RETAINED = 2


class ReadonlyError(RuntimeError):
    def __init__(self, operation: str):
        super().__init__(f"cannot {operation} on a read-only store")


class LogTable:
    def __init__(self, spark: SparkSession, folder: Folder, kind: T.StructType, name: str = "CURRENT", confirm: Callable[[], None] | None = None):
        """``confirm`` is called before each commit and raises if this writer may not commit."""
        self.spark, self.folder, self.kind, self.name, self.confirm = spark, folder, kind, name, confirm
        self.state = {"format": FORMAT, "version": VERSION, "snapshot": None, "parts": [], "seq": 0, "made": 0}
        text = folder.read(name)
        if text is not None:
            try:
                state = json.loads(text)
            except ValueError:
                state = {}
            # Another format or version counts as empty.
            if state.get("format") == FORMAT and state.get("version") == VERSION:
                self.state = state

    def _write(self, rows: DataFrame | Sequence, tag: str) -> str:
        self.state["made"] += 1
        name = f"{self.name.lower()}-{tag}-{self.state['made']:08d}"
        if not isinstance(rows, DataFrame):
            rows = self.spark.createDataFrame(list(rows), self.kind).coalesce(1)
        rows.write.mode("overwrite").parquet(f"{self.folder.path}/{name}")
        return name

    def _save(self) -> None:
        if self.confirm:
            self.confirm()
        self.folder.write(self.name, json.dumps(self.state))

    def rows(self) -> DataFrame:
        """Snapshot and parts together."""
        names = [n for n in (self.state["snapshot"], *self.state["parts"]) if n]
        if not names:
            return self.spark.createDataFrame([], self.kind)
        return self.spark.read.schema(self.kind).parquet(*[f"{self.folder.path}/{n}" for n in names])

    def snapshot(self) -> DataFrame | None:
        """The rows of the last checkpoint: one a key, all live then."""
        name = self.state["snapshot"]
        return self.spark.read.schema(self.kind).parquet(f"{self.folder.path}/{name}") if name else None

    def log(self) -> DataFrame | None:
        """The parts since the snapshot."""
        if not self.state["parts"]:
            return None
        return self.spark.read.schema(self.kind).parquet(*[f"{self.folder.path}/{n}" for n in self.state["parts"]])

    def last_part(self) -> DataFrame:
        """The part committed last."""
        return self.spark.read.schema(self.kind).parquet(f"{self.folder.path}/{self.state['parts'][-1]}")

    def next_seq(self, n: int = 1) -> int:
        """The first of n new numbers."""
        first = self.state["seq"] + 1
        self.state["seq"] += n
        return first

    def append(self, rows: DataFrame | Sequence) -> None:
        """Commits rows (all or none)."""
        before = dict(self.state, parts=list(self.state["parts"]))
        try:
            self.state["parts"] = [*self.state["parts"], self._write(rows, "part")]
            self._save()
        except BaseException:
            self.state = before
            raise

    def checkpoint(self, live: DataFrame, keys: Sequence[str] = ()) -> None:
        """Makes ``live`` the snapshot, sorted by ``keys``; what it replaces goes RETAINED checkpoints later."""
        if keys:
            live = live.repartitionByRange(*keys).sortWithinPartitions(*keys)
        before = dict(self.state)
        old = [n for n in (self.state["snapshot"], *self.state["parts"]) if n]
        name = self._write(live, "snapshot")
        replaced = [*self.state.get("replaced", []), old]
        gone, kept = replaced[:-RETAINED], replaced[-RETAINED:]
        self.state.update(snapshot=name, parts=[], replaced=kept)
        try:
            self._save()
        except BaseException:
            self.state = before
            raise
        for n in sum(gone, []):
            self.folder.delete(n)
