"""A durable replica: a log of changes in segments, full and incremental snapshots, recovery, clean-up, hooks.

Everything is in files below one folder, named by manifests. A manifest is written under a new number, by renaming
to a name that isn't taken; the greatest number counts. So a writer that dies between any two steps leaves the
store as it was before or after the step, and two writers can't both go on from one state. A change is in the
store once the manifest that names its batch is there; files that no manifest names are never read.

The state is a plan, not a copy: the snapshots' cells, overlaid by the merge of the log since. Recently written
records are the log (hot), the rest the snapshot (cold); reading merges them, point reads with the key pushed
down to both, reads by version with the version pushed down and without the snapshots that are older. The log's
size bounds the work of a read, and snapshots bound the log.
"""

from __future__ import annotations

import re
import time
import uuid
import warnings
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConflictError, CorruptStoreError, LimitError, NoParentError
from ..model import CELL_COLS, CELLS_DDL, CHANGE_COLS, CHANGES_DDL, TOMBSTONE_COLS, TOMBSTONES_DDL, Replica, empty
from ..operators import clock as clocks
from ..operators import merge as merging
from ..operators import mutate, query
from .files import Files
from .staging import staged, temporary


@dataclass(frozen=True)
class Config:
    """snapshot_changes and snapshot_seconds: after how much to write a snapshot by itself. full_every: incremental
    snapshots between full ones. format and sort_by are the layout of the files: any of Spark's columnar formats,
    and the column that snapshots are sorted by (record_id for point and range reads, local_db_version for reads
    by version); a store can be opened with another layout than it was written with, file by file."""

    snapshot_changes: int = 1000
    snapshot_seconds: float = 300.0
    incremental: bool = True
    full_every: int = 10
    skip_empty_incremental: bool = True
    auto_cleanup: int | None = None  # full snapshots to keep, if any are to go by themselves
    batch_limit: int = 10_000
    batch_overflow: str = "clear"  # or "newest_half"
    compression: str = "zstd"
    format: str = "parquet"
    sort_by: str = "record_id"
    most_tombstones: int | None = None  # in a snapshot; beyond, tombstones have to be compacted


MANIFEST = re.compile(r"manifest-(\d{12})\.json")
#: Manifests that are kept besides the latest.
OLD_MANIFESTS = 2
#: The log holds only changes that took effect, whatever rule they did by: the last to come is the state.
REPLAY = merging.Rule(order_key=lambda: [F.col("local_db_version"), F.col("col_version")])


def _numbers(files: Files) -> list[int]:
    return sorted(int(m[1]) for m in map(MANIFEST.fullmatch, files.list("")) if m)


class Store:
    def __init__(self, spark: SparkSession, root: str, manifest: dict, config: Config):
        self.spark, self.root, self.config, self.manifest = spark, root.rstrip("/"), config, manifest
        self.files = Files(spark, root)
        self.after_change: list[Callable[[DataFrame], None]] = []
        self.after_snapshot: list[Callable[[str, int], None]] = []
        self.after_seal: list[Callable[[str], None]] = []
        self._outbox: list[tuple[str, int]] = []
        self._since_snapshot, self._last_snapshot = 0, time.monotonic()

    # ---- opening and recovery

    @classmethod
    def open(cls, spark: SparkSession, root: str, node_id: int, config: Config | None = None) -> Store:
        """The store below root, or a new one. The node id of an existing store is the one given here."""
        files = Files(spark, root)
        if numbers := _numbers(files):
            name = f"manifest-{numbers[-1]:012d}.json"
            try:
                manifest = files.read_json(name)
            except ValueError as e:
                raise CorruptStoreError(f"{root}/{name} can't be read") from e
            manifest["node_id"] = node_id
        elif found := sorted({"wal", "snapshots"} & set(files.list(""))):
            raise CorruptStoreError(f"{root} has {', '.join(found)}, but no manifest")
        else:
            manifest = {"number": 0, "node_id": node_id, "clock": 0, "segment": 0, "batches": [], "snapshots": [], "sealed": [], "batch_id": -1}
        store = cls(spark, root, manifest, config or Config())
        for entry in [*manifest["snapshots"], *manifest["batches"]]:
            if not files.exists(entry["path"]):
                raise CorruptStoreError(f"{root}/{entry['path']} is missing")
        return store

    def check(self) -> None:
        """Counts the rows of all files that the manifest names; raises CorruptStoreError where they are others."""
        for b in self.manifest["batches"]:
            self._expect(b["path"], self._read([b]).count(), b["n"])
        for s in self.manifest["snapshots"]:
            for name, ddl in (("cells", CELLS_DDL), ("tombstones", TOMBSTONES_DDL)):
                self._expect(f"{s['path']}/{name}", self._part(s, name, ddl).count(), s[name])

    def _expect(self, path: str, n: int, wanted: int) -> None:
        if n != wanted:
            raise CorruptStoreError(f"{self.root}/{path} has {n} rows instead of {wanted}")

    @property
    def node_id(self) -> int:
        return self.manifest["node_id"]

    @property
    def clock(self) -> int:
        return self.manifest["clock"]

    def chain(self) -> list[dict]:
        """The latest full snapshot and the incremental ones that build on it, in order."""
        full = [s for s in self.manifest["snapshots"] if s["base"] is None]
        if not full:
            return []
        base = max(full, key=lambda s: s["version"])
        parts = sorted((s for s in self.manifest["snapshots"] if s["base"] == base["version"]), key=lambda s: s["version"])
        last = base["version"]
        for s in parts:
            if s["follows"] != last:
                warnings.warn(f"the snapshot before {s['path']} is missing; the log may not hold what was in it", stacklevel=2)
            last = s["version"]
        return [base, *parts]

    def _part(self, snapshot: dict, name: str, ddl: str) -> DataFrame:
        return self.spark.read.schema(ddl).format(snapshot.get("format", "parquet")).load(f"{self.root}/{snapshot['path']}/{name}")

    def cold(self, since: int | None = None) -> Replica:
        """The state of the snapshots alone; with since, only what has a later local version.

        All that a snapshot holds is as old as the snapshot, or older, so those up to since aren't read. What is
        older than since can't be brought back by anything newer, so the filter goes before all else.
        """
        cells, tombstones, clock = empty(self.spark, CELLS_DDL), empty(self.spark, TOMBSTONES_DDL), 0
        for s in self.chain():
            clock = s["version"]
            if since is not None and s["version"] <= since:
                continue
            new, gone = self._part(s, "cells", CELLS_DDL), self._part(s, "tombstones", TOMBSTONES_DDL)
            if s["base"] is None:
                cells, tombstones = new, gone
            else:
                # An incremental snapshot has whole records, with their field tombstones.
                replaced = new.select("record_id").unionAll(gone.select("record_id")).distinct()
                cells = cells.join(replaced, "record_id", "left_anti").unionByName(new)
                tombstones = tombstones.join(gone.select("record_id"), "record_id", "left_anti").unionByName(gone)
        if since is not None:
            later = F.col("local_db_version") > since
            cells, tombstones = cells.filter(later), tombstones.filter(later)
        return Replica(self.node_id, cells, tombstones, clock)

    def _read(self, batches: list[dict]) -> DataFrame:
        """The changes of batches, each in the format that it was written in."""
        parts = [self.spark.read.schema(CHANGES_DDL).format(f).load([f"{self.root}/{b['path']}" for b in batches if b.get("format", "parquet") == f]) for f in sorted({b.get("format", "parquet") for b in batches})]
        out = empty(self.spark, CHANGES_DDL) if not parts else parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def log(self) -> DataFrame:
        """The changes since the last snapshot."""
        return self._read([b for b in self.manifest["batches"] if not b["covered"]])

    def _state(self, cold: Replica, only: Column | None = None) -> Replica:
        log = self.log() if only is None else self.log().filter(only)
        return merging.merge(cold, merging.in_version_order(log), REPLAY, stamped=False).replica.with_(clock_source=self.clock)

    def replica(self) -> Replica:
        """The state now: a plan over the files. Local versions are those that the changes got when they came."""
        return self._state(self.cold())

    # ---- writing

    def apply_ops(self, ops: DataFrame) -> DataFrame:
        """Local inserts, updates and deletes; returns the changes to send."""
        with temporary(self.spark):
            after, changes = mutate.apply_ops(self.replica(), ops)
            return self._commit(changes, after.clock)

    def merge(self, changes: DataFrame, rule: merging.Rule = merging.LAST_WRITE, batch_id: int | None = None) -> DataFrame:
        """Changes from others; returns those that took effect. A batch_id that was merged before does nothing.

        The changes are written down once with the clock at each, as the merge reads them several times.
        """
        if batch_id is not None and batch_id <= self.manifest["batch_id"]:
            return empty(self.spark, CHANGES_DDL)
        with temporary(self.spark):
            log = staged(clocks.stamp(changes, self.clock), "stamped")
            last = log.agg(F.max("local_db_version")).first()[0]
            merged = merging.merge(self.replica(), log, rule)
            return self._commit(merged.accepted, self.clock if last is None else last, batch_id)

    def revert(self) -> DataFrame:
        """Stores have no parent, so there is nothing to go back to."""
        raise NoParentError(f"{self.root} is a store, which has no parent to go back to")

    def _commit(self, changes: DataFrame, clock: int, batch_id: int | None = None) -> DataFrame:
        path = f"wal/segment={self.manifest['segment']:06d}/batch={uuid.uuid4().hex}"
        changes.select(*CHANGE_COLS).write.format(self.config.format).option("compression", self.config.compression).save(f"{self.root}/{path}")
        batch = {"path": path, "segment": self.manifest["segment"], "format": self.config.format, "covered": False}
        written = self._read([batch])
        n = batch["n"] = written.count()
        self.manifest["batches"].append(batch)
        self.manifest["clock"] = max(self.clock, clock)
        if batch_id is not None:
            self.manifest["batch_id"] = batch_id
        self._publish()
        self._outbox.append((path, n))
        self._limit_outbox()
        for hook in self.after_change:
            hook(written)
        self._since_snapshot += n
        if self._since_snapshot >= self.config.snapshot_changes or time.monotonic() - self._last_snapshot >= self.config.snapshot_seconds:
            self.snapshot()
        return written

    def _publish(self) -> None:
        number = self.manifest["number"] + 1
        try:
            self.files.write_json(f"manifest-{number:012d}.json", self.manifest | {"number": number})
        except FileExistsError as e:
            raise ConflictError(f"{self.root} has been written to by another since it was opened") from e
        self.manifest["number"] = number
        for old in _numbers(self.files)[: -1 - OLD_MANIFESTS]:
            self.files.delete(f"manifest-{old:012d}.json")

    # ---- the outbox

    def _limit_outbox(self) -> None:
        if sum(n for _, n in self._outbox) <= self.config.batch_limit:
            return
        if self.config.batch_overflow == "clear":
            self._outbox.clear()
            return
        while len(self._outbox) > 1 and sum(n for _, n in self._outbox) > self.config.batch_limit // 2:
            self._outbox.pop(0)

    def peek_batch(self) -> DataFrame:
        """Changes that haven't been taken yet, for sending."""
        waiting = {p for p, _ in self._outbox}
        return self._read([b for b in self.manifest["batches"] if b["path"] in waiting])

    def take_batch(self) -> DataFrame:
        batch = self.peek_batch()
        self._outbox.clear()
        return batch

    # ---- snapshots

    def snapshot(self, full: bool | None = None) -> str | None:
        """Writes what the log holds into a snapshot and starts a new segment. None: nothing had changed."""
        chain = self.chain()
        if full is None:
            full = not self.config.incremental or not chain or len(chain) > self.config.full_every
        version, since = self.clock, chain[-1]["version"] if chain else -1
        self._since_snapshot, self._last_snapshot = 0, time.monotonic()
        with temporary(self.spark):
            if full or not chain:
                full, state = True, self.replica()
            else:
                # Only records of the log have changed.
                ids = staged(self.log().select("record_id").distinct(), "changed")
                if self.config.skip_empty_incremental and ids.isEmpty():
                    return None
                cold = self.cold()
                state = self._state(cold.with_(cells=cold.cells.join(ids, "record_id", "left_semi"), tombstones=cold.tombstones.join(ids, "record_id", "left_semi")))
                state = state.with_(tombstones=state.tombstones.filter(F.col("local_db_version") > since))
            entry = self._write(state, version, None if full else chain[0]["version"], None if full else since)
        for b in self.manifest["batches"]:
            b["covered"] = True
        self.manifest["snapshots"].append(entry)
        sealed = self._rotate()
        self._publish()
        for hook in self.after_snapshot:
            hook(f"{self.root}/{entry['path']}", version)
        for hook in self.after_seal:
            for segment in sealed:
                hook(f"{self.root}/{segment}")
        if self.config.auto_cleanup is not None:
            self.cleanup_snapshots(self.config.auto_cleanup)
        return f"{self.root}/{entry['path']}"

    def _write(self, state: Replica, version: int, base: int | None, follows: int | None) -> dict:
        """A snapshot's files; returns its entry for the manifest, which doesn't have it yet."""
        path, by, counts = f"snapshots/{'full' if base is None else 'incr'}-{version:012d}-{uuid.uuid4().hex[:8]}", self.config.sort_by, {}
        for name, frame, cols, ddl in (("cells", state.cells, CELL_COLS, CELLS_DDL), ("tombstones", state.tombstones, TOMBSTONE_COLS, TOMBSTONES_DDL)):
            # Written down first: dealing out by range reads its input twice.
            frame = staged(frame.select(*cols), name)
            counts[name] = frame.count()
            if name == "tombstones" and self.config.most_tombstones is not None and counts[name] > self.config.most_tombstones:
                raise LimitError(f"{counts[name]} tombstones: compact them, or allow more than {self.config.most_tombstones}")
            frame.repartitionByRange(by).sortWithinPartitions(by).write.format(self.config.format).option("compression", self.config.compression).save(f"{self.root}/{path}/{name}")
        return {"path": path, "version": version, "base": base, "follows": follows, "uploaded": False, "format": self.config.format, **counts}

    def _rotate(self) -> list[str]:
        """Closes the segment if anything was written to it. Returns the segments that no more is written to."""
        if any(b["segment"] == self.manifest["segment"] for b in self.manifest["batches"]):
            self.manifest["sealed"].append({"segment": self.manifest["segment"], "uploaded": False})
            self.manifest["segment"] += 1
        return [f"wal/segment={s['segment']:06d}" for s in self.manifest["sealed"]]

    def mark_uploaded(self, path: str) -> None:
        """Says that a snapshot or a sealed segment is safe elsewhere."""
        for s in self.manifest["snapshots"]:
            s["uploaded"] |= path.endswith(s["path"])
        for s in self.manifest["sealed"]:
            s["uploaded"] |= path.endswith(f"segment={s['segment']:06d}")
        self._publish()

    def cleanup_snapshots(self, keep: int, require_uploaded: bool = False) -> int:
        """Deletes all but the latest `keep` (1 at least) full snapshots, and the incremental ones whose base goes or
        that a later full one has superseded."""
        full = sorted((s for s in self.manifest["snapshots"] if s["base"] is None), key=lambda s: -s["version"])
        kept = {s["version"] for s in full[: max(1, keep)]}
        stays = lambda s: s["version"] in kept if s["base"] is None else s["base"] in kept and s["version"] >= max(kept)
        gone = [s for s in self.manifest["snapshots"] if not stays(s) and (s["uploaded"] or not require_uploaded)]
        return self._drop("snapshots", gone)

    def cleanup_segments(self, keep: int = 0, require_uploaded: bool = False) -> int:
        """Deletes sealed segments that snapshots cover, but for the latest `keep`; never the one in use."""
        old = sorted(self.manifest["sealed"], key=lambda s: -s["segment"])[keep:]
        open_ = {b["segment"] for b in self.manifest["batches"] if not b["covered"]}
        gone = [s for s in old if s["segment"] not in open_ and (s["uploaded"] or not require_uploaded)]
        numbers = {s["segment"] for s in gone}
        self.manifest["sealed"] = [s for s in self.manifest["sealed"] if s["segment"] not in numbers]
        batches = [b for b in self.manifest["batches"] if b["segment"] in numbers]
        self._outbox = [x for x in self._outbox if x[0] not in {b["path"] for b in batches}]
        self.manifest["batches"] = [b for b in self.manifest["batches"] if b["segment"] not in numbers]
        self._publish()
        for n in numbers:
            self.files.delete(f"wal/segment={n:06d}")
        return len(numbers)

    def _drop(self, kind: str, gone: list[dict]) -> int:
        paths = {s["path"] for s in gone}
        self.manifest[kind] = [s for s in self.manifest[kind] if s["path"] not in paths]
        self._publish()  # first out of the manifest, then from the disk
        for path in paths:
            self.files.delete(path)
        return len(paths)

    def compact_tombstones(self, min_acknowledged: int) -> int:
        """Drops old tombstones for good: a full snapshot without them, and the log before it goes."""
        state, removed = merging.compact_tombstones(self.replica(), min_acknowledged)
        n = removed.first().removed
        with temporary(self.spark):
            entry = self._write(state, self.clock, None, None)
        for b in self.manifest["batches"]:
            b["covered"] = True
        # Snapshots of the same version hold the old tombstones.
        old = [s for s in self.manifest["snapshots"] if s["version"] >= self.clock or s["base"] is not None]
        self.manifest["snapshots"].append(entry)
        self._rotate()
        self._drop("snapshots", old)
        self.cleanup_segments()
        return n

    # ---- reading

    def get_record(self, record_id: str) -> DataFrame:
        """One record's cells, the key pushed down to the snapshot's sorted files and the log."""
        here = F.col("record_id") == record_id
        cold = self.cold()
        narrowed = cold.with_(cells=cold.cells.filter(here), tombstones=cold.tombstones.filter(here))
        return query.get_record(self._state(narrowed, here), record_id)

    def contains(self, record_id: str) -> bool:
        return not self.get_record(record_id).isEmpty()

    def is_tombstoned(self, record_id: str) -> bool:
        return not self.replica().tombstones.filter(F.col("record_id") == record_id).isEmpty()

    def changes_since(self, since: int, excluding: tuple[int, ...] = ()) -> DataFrame:
        """What has a local version above `since`, which the scans of the snapshots and of the log are filtered by."""
        state = self._state(self.cold(since), F.col("local_db_version") > since)
        return query.changes_since(state, since, excluding)

    def counts(self) -> DataFrame:
        """(hot, cold, total): records in the log, in the snapshots, and in the state."""
        ids = lambda df: df.select("record_id").distinct()
        counted = lambda df, name: ids(df).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("tier"), "n")
        rows = counted(self.log(), "hot").unionAll(counted(self.cold().cells, "cold")).unionAll(counted(query.live_cells(self.replica()), "total"))
        return rows.groupBy().pivot("tier", ["hot", "cold", "total"]).agg(F.first("n"))
