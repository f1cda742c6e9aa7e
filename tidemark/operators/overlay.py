"""Parent and child replicas: the combined view, differences, and taking changes back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import NoParentError
from ..model import CHANGE_COLS, DEL_FIELD, DEL_RECORD, PUT, Replica
from ..sources.staging import staged
from .merge import compress
from .query import changes_since, live_cells


def combined(child: Replica) -> DataFrame:
    """The cells that a child shows: its parents' records without those that it deleted, or has itself."""
    own = live_cells(child)
    if not child.parent:
        return own
    above = combined(child.parent).join(child.tombstones.select("record_id"), "record_id", "left_anti")
    return above.join(child.cells.select("record_id").distinct(), "record_id", "left_anti").unionByName(own)


def invert(changes: DataFrame, reference: Replica, node_id: int, clock: int) -> DataFrame:
    """The changes that bring what `changes` touched back to the reference.

    A record delete becomes puts of all the reference's fields. Any other change becomes a put of the
    reference's value with its versions; a field delete (col_version 0) where it has the record without the
    field; and a record delete where it hasn't got the record.
    """
    cells = combined(reference) if reference.parent else live_cells(reference)
    fields = cells.filter("present").select("record_id", "col_name", F.col("value").alias("rv"), F.col("col_version").alias("rc"), F.col("db_version").alias("rd"), F.col("local_db_version").alias("rl"))
    ids = cells.select("record_id").distinct().withColumn("known", F.lit(True))
    deletes, others = changes.filter(F.col("op") == DEL_RECORD), changes.filter(F.col("op") != DEL_RECORD)
    restored = deletes.select("seq", "record_id", "flags").join(fields, "record_id")
    puts = lambda df: df.select("seq", "record_id", F.lit(PUT).alias("op"), "col_name", F.col("rv").alias("value"), F.col("rc").alias("col_version"), F.col("rd").alias("db_version"), F.lit(node_id).cast("long").alias("node_id"), F.col("rl").alias("local_db_version"), "flags")
    met = others.select("seq", "record_id", "col_name", "flags").join(fields, ["record_id", "col_name"], "left").join(ids, "record_id", "left")
    back, gone = met.filter("rc is not null"), met.filter("rc is null")
    known = F.coalesce("known", F.lit(False))
    undone = gone.select(
        "seq", "record_id", F.when(known, DEL_FIELD).otherwise(DEL_RECORD).alias("op"), F.when(known, F.col("col_name")).alias("col_name"), F.lit(None).cast("string").alias("value"),
        F.lit(0).cast("long").alias("col_version"), F.lit(clock).cast("long").alias("db_version"), F.lit(node_id).cast("long").alias("node_id"), F.lit(0).cast("long").alias("local_db_version"), "flags",
    )
    return puts(restored).unionByName(puts(back)).unionByName(undone).select(*CHANGE_COLS)


def written(replica: Replica) -> Replica:
    """The same replica, its frames (not its parents') written down: worth it where more than one is read again."""
    return replica.with_(cells=staged(replica.cells, "cells"), tombstones=staged(replica.tombstones, "tombstones"))


def diff(a: Replica, b: Replica) -> DataFrame:
    """Changes that turn a into b, from the changes that either has made since the lesser of their clocks.

    Both states are read several times, so they are written down first.
    """
    common = min(a.clock, b.clock)
    a, b = written(a), written(b)
    back = invert(changes_since(a, common), b, a.node_id, a.clock)
    return compress(back.unionByName(changes_since(b, common)))


def revert(child: Replica) -> DataFrame:
    """Changes that undo what a child has done since it was made; not compressed."""
    if not child.parent:
        raise NoParentError("a replica without a parent has nothing to go back to")
    own = changes_since(child.with_(parent=None), child.base_version)
    return invert(own, child.parent, child.node_id, child.clock)
