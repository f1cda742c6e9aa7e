"""Reads: incremental extraction, predicates, projections, key ranges, and what changed when."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import CHANGE_COLS, DEL_FIELD, DEL_RECORD, DELETE_VERSION, PUT, TOMBSTONE_COLS, Replica


def _own_changes(replica: Replica, since: int, excluding: Iterable[int]) -> DataFrame:
    excluding = list(excluding)
    new = F.col("local_db_version") > since
    if excluding:
        new &= ~F.col("node_id").isin(excluding)
    nothing = lambda kind: F.lit(None).cast(kind)
    op = F.when(F.col("present"), F.lit(PUT)).otherwise(F.lit(DEL_FIELD))
    value = F.when(F.col("present"), F.col("value"))
    cells = replica.cells.filter(new).select(
        nothing("long").alias("seq"), "record_id", op.alias("op"), "col_name", value.alias("value"), "col_version", "db_version", "node_id", "local_db_version", F.lit(0).alias("flags")
    )
    gone = replica.tombstones.filter(new).select(
        nothing("long").alias("seq"), "record_id", F.lit(DEL_RECORD).alias("op"), nothing("string").alias("col_name"), nothing("string").alias("value"),
        F.lit(DELETE_VERSION).alias("col_version"), "db_version", "node_id", "local_db_version", F.lit(0).alias("flags"),
    )
    return cells.unionByName(gone).select(*CHANGE_COLS)


def changes_since(replica: Replica, since: int, excluding: Iterable[int] = ()) -> DataFrame:
    """Cells and tombstones whose local version is above `since`, but for those that excluded nodes wrote.

    A child's changes are compressed together with its parents'. The filters are pushed down to the state's
    files.
    """
    own = _own_changes(replica, since, excluding)
    if not replica.parent:
        return own
    from .merge import compress

    return compress(changes_since(replica.parent, since, excluding).unionByName(own))


def changed_records(replica: Replica, since: int) -> tuple[DataFrame, DataFrame]:
    """All cells of records of which any changed since, and the tombstones that came since."""
    ids = replica.cells.filter(F.col("local_db_version") > since).select("record_id").distinct()
    return replica.cells.join(ids, "record_id", "left_semi"), replica.tombstones.filter(F.col("local_db_version") > since)


def live_cells(replica: Replica) -> DataFrame:
    """Cells of records that aren't deleted, by this replica or its parents."""
    from .merge import dead_records

    return replica.cells.join(dead_records(replica), "record_id", "left_anti")


def records(replica: Replica) -> DataFrame:
    """(record_id, fields, lowest_local, highest_local): own live records, fields as a map.

    A record whose fields are all deleted has an empty map. lowest_local is advisory: no read filters on it.
    """
    field = F.when(F.col("present"), F.struct("col_name", "value"))
    return live_cells(replica).groupBy("record_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(field))).alias("fields"), F.min("local_db_version").alias("lowest_local"), F.max("local_db_version").alias("highest_local")
    )


def query(replica: Replica, predicate: Column) -> DataFrame:
    """Own live records that fulfil a predicate over record_id and fields."""
    return records(replica).filter(predicate)


def project(replica: Replica, predicate: Column, *columns: Column) -> DataFrame:
    return query(replica, predicate).select(*columns)


def key_range(replica: Replica, low: str | None = None, high: str | None = None, low_inclusive: bool = True, high_inclusive: bool = False) -> DataFrame:
    """Own live records with ids between low and high, sorted; None leaves a side open."""
    inside = F.lit(True)
    key = F.col("record_id")
    if low is not None:
        inside &= key >= low if low_inclusive else key > low
    if high is not None:
        inside &= key <= high if high_inclusive else key < high
    narrowed = replica.with_(cells=replica.cells.filter(inside))
    return records(narrowed).orderBy("record_id")


def get_record(replica: Replica, record_id: str, ignore_parent: bool = False, raw: bool = False) -> DataFrame:
    """The cells of one record; without a local one, the nearest ancestor's.

    raw=True also shows an ancestor's copy of a record that a child has deleted.
    """
    from .merge import dead_records, parent_cells

    own = replica.cells.filter(F.col("record_id") == record_id)
    above = None if ignore_parent else parent_cells(replica)
    if above is not None:
        own = own.unionByName(above.filter(F.col("record_id") == record_id).join(own.select("record_id").distinct(), "record_id", "left_anti"))
    if raw:
        return own
    return own.join(dead_records(replica, ignore_parent).filter(F.col("record_id") == record_id), "record_id", "left_anti")


def tombstone(replica: Replica, record_id: str) -> DataFrame:
    """The tombstone of a record: the nearest one, own before the parents'."""
    found, level, above = None, 0, replica
    while above is not None:
        own = above.tombstones.filter(F.col("record_id") == record_id).select(*TOMBSTONE_COLS, F.lit(level).alias("level"))
        found = own if found is None else found.unionByName(own)
        above, level = above.parent, level + 1
    return found.orderBy("level").limit(1).drop("level")


def are_tombstoned(replica: Replica, ids: DataFrame) -> DataFrame:
    """ids(record_id) with the boolean `tombstoned`."""
    from .merge import dead_records

    dead = dead_records(replica).select("record_id", F.lit(True).alias("tombstoned"))
    return ids.join(dead, "record_id", "left").withColumn("tombstoned", F.coalesce("tombstoned", F.lit(False)))


def tombstone_count(replica: Replica) -> DataFrame:
    return replica.tombstones.agg(F.count(F.lit(1)).alias("tombstones"))


def modified_since(replica: Replica, since: int) -> DataFrame:
    """Ids of live records of which some cell changed since."""
    return live_cells(replica).filter(F.col("local_db_version") > since).select("record_id").distinct()


def recently_modified(replica: Replica, limit: int = 10) -> DataFrame:
    """(record_id, local_db_version): the live records that changed last, newest first, ties by id."""
    last = live_cells(replica).groupBy("record_id").agg(F.max("local_db_version").alias("local_db_version"))
    return last.orderBy(F.col("local_db_version").desc(), "record_id").limit(limit)


def differing(a: Replica, b: Replica) -> DataFrame:
    """Fields (never versions) that only one of two replicas has, or has so often. Empty: they have converged."""
    fields = lambda r: live_cells(r).filter("present").select("record_id", "col_name", "value")
    x, y = fields(a), fields(b)
    return x.exceptAll(y).withColumn("side", F.lit("left")).unionByName(y.exceptAll(x).withColumn("side", F.lit("right")))


def converged(a: Replica, b: Replica) -> DataFrame:
    """One row: whether two replicas hold the same fields."""
    return differing(a, b).agg((F.count(F.lit(1)) == 0).alias("converged"))


def show(replica: Replica, n: int = 20) -> None:
    """Prints the state, for debugging."""
    replica.cells.orderBy("record_id", "col_name").show(n, truncate=False)
    replica.tombstones.orderBy("record_id").show(n, truncate=False)
