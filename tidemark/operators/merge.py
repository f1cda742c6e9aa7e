"""Conflict-resolving merge, compaction of change logs, and tombstone clean-up."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..model import CELL_COLS, CHANGE_COLS, DEL_RECORD, DELETE_VERSION, PUT, TOMBSTONE_COLS, Replica, version
from ..sources.staging import staged
from . import clock
from .query import changes_since


@dataclass(frozen=True)
class Rule:
    """How two writes of a cell are weighed.

    order_key lists columns of a write; the greatest wins, ties stay with the earlier write. It needs no more
    than the last-write-wins rule does. predicate(local, remote) gets two dicts and says whether the remote
    write replaces the local one; writes are folded in order of arrival, one cell at a time, in Python. Whether
    replicas converge under a predicate is up to its author.
    """

    order_key: Callable[[], list[Column]] | None = None
    predicate: Callable[[dict, dict], bool] | None = None

    def key(self) -> Column:
        return F.struct(*[c.alias(f"k{i}") for i, c in enumerate(self.order_key())]) if self.order_key else version()


#: A write wins if (col_version, db_version, node_id) is greater.
LAST_WRITE = Rule()


def with_context(make: Callable[..., list[Column]], **context) -> Rule:
    """A rule whose order key also depends on context values, given as literals."""
    return Rule(order_key=lambda: make(**{k: F.lit(v) for k, v in context.items()}))


def dead_records(replica: Replica, ignore_parent: bool = False) -> DataFrame:
    """Ids of deleted records, the parents' too."""
    own = replica.tombstones.select("record_id")
    if ignore_parent or not replica.parent:
        return own
    return own.unionAll(dead_records(replica.parent)).distinct()


def parent_cells(replica: Replica) -> DataFrame | None:
    """The cells that reads of this replica fall through to, by whole records: those of the nearest ancestor."""
    parent = replica.parent
    if not parent:
        return None
    above = parent_cells(parent)
    if above is None:
        return parent.cells
    return parent.cells.unionByName(above.join(parent.cells.select("record_id").distinct(), "record_id", "left_anti"))


def _incumbents(replica: Replica, incoming: DataFrame, ignore_parent: bool) -> tuple[DataFrame, DataFrame | None]:
    """Own cells, and the parents' cells of incoming records that this replica has not got itself."""
    above = None if ignore_parent else parent_cells(replica)
    if above is None:
        return replica.cells, None
    asked = incoming.select("record_id").distinct().join(replica.cells.select("record_id").distinct(), "record_id", "left_anti")
    return replica.cells, above.join(asked, "record_id", "left_semi")


@dataclass(frozen=True)
class Merged:
    """What a merge comes to; each frame is lazy and shares its inputs with the others."""

    replica: Replica
    accepted: DataFrame


def merge(replica: Replica, changes: DataFrame, rule: Rule = LAST_WRITE, ignore_parent: bool = False, stamped: bool = True, parts: int | None = None) -> Merged:
    """Applies changes in order of seq.

    The first delete of a record that isn't deleted yet removes it for good, whatever the versions; changes to
    deleted records are ignored. Of the writes of a cell the rule's greatest stays, ties with the earlier one.
    accepted are the changes that took effect when they arrived, with the clock at that time. stamped=False
    leaves local_db_version as it came and the clock at the greatest db_version: it saves the pass that
    computes the clock, for callers who want the state only; seq may then be of any type that has an order.
    Changes that clock.stamp() has already been applied to (they have a column `range`) aren't stamped again.

    Costs a shuffle by record for deletes (a broadcast, if they are few) and one by cell. Each task keeps only
    its best write of a cell before that shuffle, so a hot cell or record doesn't pile up.
    """
    if rule.predicate:
        return _fold(replica, changes, rule, ignore_parent, parts)
    c0 = replica.clock if stamped else 0
    if stamped:
        log = changes if "range" in changes.columns else clock.stamp(changes, c0, parts=parts)
        time: int | DataFrame = log.agg(F.coalesce(F.max("local_db_version"), F.lit(c0)))
    else:
        log = changes.withColumn("range", F.lit(0))
        time = changes.agg(F.max("db_version"))
    alive = log.join(dead_records(replica, ignore_parent), "record_id", "left_anti")
    deletes = _first_deletes(alive)
    tombstones = replica.tombstones.unionByName(deletes.select(*TOMBSTONE_COLS))
    # What came before a record's first delete was accepted in its time; no cell of the record stays.
    cut = alive.filter(F.col("op") != DEL_RECORD).join(deletes.select("record_id", F.col("seq").alias("gone")), "record_id", "left")
    writes = cut.filter(F.col("gone").isNull() | (F.col("seq") < F.col("gone"))).withColumn("present", F.col("op") == PUT).withColumn("value", F.when(F.col("op") == PUT, F.col("value")))
    own, above = _incumbents(replica, writes, ignore_parent)
    held = own if above is None else own.unionByName(above)
    before = held.select(*CELL_COLS, F.lit(None).cast(changes.schema["seq"].dataType).alias("seq"))
    lasting = before.join(deletes.select("record_id"), "record_id", "left_anti").unionByName(writes.filter("gone is null").select(*CELL_COLS, "seq"))
    cells = _winners(lasting, rule)
    if above is not None:
        # A parent's record is copied when the first write to it is accepted.
        touched = cells.filter("seq is not null").select("record_id").unionAll(own.select("record_id")).distinct()
        cells = cells.join(touched, "record_id", "left_semi")
    accepted = _accepted(before, writes, rule, replica.cells.sparkSession).unionByName(deletes.select(*CHANGE_COLS))
    return Merged(replica.with_(cells=cells.select(*CELL_COLS), tombstones=tombstones, clock_source=time), accepted)


def _first_deletes(alive: DataFrame) -> DataFrame:
    first = alive.filter(F.col("op") == DEL_RECORD).groupBy("record_id").agg(F.min(F.struct("seq", "col_version", "db_version", "node_id", "local_db_version", "flags")).alias("d"))
    return first.select("record_id", "d.*", F.lit(DEL_RECORD).alias("op"), F.lit(None).cast("string").alias("col_name"), F.lit(None).cast("string").alias("value"))


def _winners(rows: DataFrame, rule: Rule) -> DataFrame:
    """The write of each cell that stays; incumbents have a null seq."""
    best = Window.partitionBy("record_id", "col_name").orderBy(rule.key().desc(), F.col("seq").asc_nulls_first())
    return rows.withColumn("__n", F.row_number().over(best)).filter("__n = 1").drop("__n")


def _accepted(before: DataFrame, writes: DataFrame, rule: Rule, spark) -> DataFrame:
    """The writes greater than all that came before them in their cell: strict prefix maxima in order of seq.

    Each cell's writes are looked at range by range, and the ranges' greatest writes are carried forward, so a
    hot cell spreads over the ranges' tasks.
    """
    cell = ["record_id", "col_name"]
    keyed = writes.withColumn("__key", rule.key())
    best = keyed.groupBy(*cell, "range").agg(F.max("__key").alias("__top"))
    best = best.unionByName(before.select(*cell, F.lit(-1).alias("range"), rule.key().alias("__top")))
    earlier = Window.partitionBy(*cell).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = best.withColumn("__carry", F.max("__top").over(earlier)).filter("range >= 0").drop("__top")
    within = Window.partitionBy(*cell, "range").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("__before", F.max("__key").over(within)).join(carried, [*cell, "range"])
    wins = (F.col("__before").isNull() | (F.col("__key") > F.col("__before"))) & (F.col("__carry").isNull() | (F.col("__key") > F.col("__carry")))
    return placed.filter(wins).select(*CHANGE_COLS)


def _fold(replica: Replica, changes: DataFrame, rule: Rule, ignore_parent: bool, parts: int | None) -> Merged:
    """Merge under a predicate: sorted by cell and arrival, a cell's writes stream through one comparison each."""
    c0 = replica.clock
    log = changes if "range" in changes.columns else clock.stamp(changes, c0, parts=parts)
    alive = log.join(dead_records(replica, ignore_parent), "record_id", "left_anti")
    deletes = _first_deletes(alive)
    cut = alive.filter(F.col("op") != DEL_RECORD).join(deletes.select("record_id", F.col("seq").alias("gone")), "record_id", "left")
    writes = cut.filter(F.col("gone").isNull() | (F.col("seq") < F.col("gone")))
    own, above = _incumbents(replica, writes, ignore_parent)
    held = own if above is None else own.unionByName(above)
    before = held.withColumn("seq", F.lit(None).cast("long")).withColumn("op", F.when(F.col("present"), PUT).otherwise("del_field")).withColumn("flags", F.lit(0)).withColumn("gone", F.lit(None).cast("long"))
    cols = [*CHANGE_COLS, "gone"]
    ordered = before.select(*cols).unionByName(writes.select(*cols)).repartition("record_id", "col_name").sortWithinPartitions("record_id", "col_name", F.col("seq").asc_nulls_first())
    decide = rule.predicate

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, local = None, None
        for frame in frames:
            took, left = [], []
            for row in frame.astype(object).where(frame.notna(), None).to_dict("records"):
                if (row["record_id"], row["col_name"]) != cell:
                    if local:
                        left.append(local)
                    cell, local = (row["record_id"], row["col_name"]), None
                won = local is None or decide(local, row)
                if won:
                    local = row
                if won and row["seq"] is not None:
                    took.append(row | {"kind": "accepted"})
            yield pd.DataFrame([*(r | {"kind": "state"} for r in left), *took], columns=[*cols, "kind"])
        if local:
            yield pd.DataFrame([local | {"kind": "state"}], columns=[*cols, "kind"])

    out = ordered.mapInPandas(run, StructType([*ordered.schema.fields, StructField("kind", StringType())]))
    cells = out.filter("kind = 'state' and gone is null").withColumn("present", F.col("op") == PUT).withColumn("value", F.when(F.col("op") == PUT, F.col("value")))
    cells = cells.join(deletes.select("record_id"), "record_id", "left_anti")
    if above is not None:
        touched = cells.filter("seq is not null").select("record_id").unionAll(own.select("record_id")).distinct()
        cells = cells.join(touched, "record_id", "left_semi")
    accepted = out.filter("kind = 'accepted'").select(*CHANGE_COLS).unionByName(deletes.select(*CHANGE_COLS))
    time = log.agg(F.coalesce(F.max("local_db_version"), F.lit(c0)))
    return Merged(replica.with_(cells=cells.select(*CELL_COLS), tombstones=replica.tombstones.unionByName(deletes.select(*TOMBSTONE_COLS)), clock_source=time), accepted)


def compress(changes: DataFrame, comparator: Callable[[], list[Column]] | None = None) -> DataFrame:
    """The newest change of each cell; of a deleted record only the newest delete, whatever the versions.

    comparator gives the sort columns that put the newest first; by default the versions, descending.
    """
    newest = comparator() if comparator else [F.col(c).desc() for c in ("col_version", "db_version", "node_id")]
    order = [*newest, F.col("seq").asc_nulls_last()]
    deletes = changes.filter(F.col("op") == DEL_RECORD)
    last = deletes.withColumn("__n", F.row_number().over(Window.partitionBy("record_id").orderBy(*order))).filter("__n = 1").drop("__n")
    others = changes.filter(F.col("op") != DEL_RECORD)
    first = others.withColumn("__n", F.row_number().over(Window.partitionBy("record_id", "col_name").orderBy(*order))).filter("__n = 1").drop("__n")
    # Deleted records go after the cells are reduced: fewer rows meet.
    return first.join(last.select("record_id"), "record_id", "left_anti").unionByName(last)


def in_order(changes: DataFrame) -> DataFrame:
    """By record and column, newest first; a record's delete comes before its cells."""
    return changes.orderBy("record_id", F.col("col_name").asc_nulls_first(), F.col("col_version").desc(), F.col("db_version").desc(), F.col("node_id").desc(), "seq")


def sync(source: Replica, target: Replica, last: int, **options) -> tuple[Merged, int]:
    """Applies to target what source has since `last`; returns the merge and the next watermark.

    The filter is on local versions and the watermark on the changes' own: what was sent may be sent again,
    which changes nothing, and nothing is left out. Without changes the watermark stays. What is sent is written
    down in the shared folder.
    """
    delta = staged(numbered(staged(changes_since(source, last), "delta")), "numbered")
    seen = delta.agg(F.max("db_version")).first()[0]
    return merge(target, delta, **options), max(last, seen if seen is not None else last)


#: What tells the changes of a state apart.
KEYS = ["record_id", "col_name", "op"]


def numbered(delta: DataFrame, parts: int | None = None) -> DataFrame:
    """A delta from a replica's state, which has no order of arrival, with a seq by local version."""
    return clock.numbered(delta.drop("seq"), KEYS, parts=parts).select(*CHANGE_COLS)


def in_version_order(delta: DataFrame) -> DataFrame:
    """A delta with a seq of another type, by local version: for merges that don't stamp."""
    return delta.withColumn("seq", clock.in_version_order(KEYS))


def compact_tombstones(replica: Replica, min_acknowledged: int) -> tuple[Replica, DataFrame]:
    """Without the tombstones older than what every replica has seen; and one row, how many there were."""
    old = F.col("db_version") < min_acknowledged
    removed = replica.tombstones.agg(F.count(F.when(old, 1)).alias("removed"))
    return replica.with_(tombstones=replica.tombstones.filter(~old)), removed


__all__ = ["DELETE_VERSION", "LAST_WRITE", "Merged", "Rule", "compact_tombstones", "compress", "in_order", "in_version_order", "merge", "numbered", "sync", "with_context"]
