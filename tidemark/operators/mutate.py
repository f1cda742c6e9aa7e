"""Local writes: batches of operations become changes, and the state that they lead to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import CELL_COLS, CHANGE_COLS, DEL_FIELD, DEL_RECORD, DELETE_VERSION, PUT, TOMBSTONE_COLS, Replica
from ..sources.staging import staged
from . import clock
from .merge import dead_records, parent_cells

#: Columns of an operation. Puts of one `call` are one insert or update: they share a version.
OPS_DDL = "seq long, call long, op string, record_id string, col_name string, value string, flags int"


def explode_fields(inserts: DataFrame) -> DataFrame:
    """Operations from rows (seq, record_id, fields map, flags): one call for each row.

    seq of the operations is the row's times 2 ** 20 plus the field's place; a row has fewer fields than that.
    """
    fields = inserts.select("*", F.posexplode(F.array_sort(F.map_entries("fields"))).alias("at", "field"))
    return fields.select(
        (F.col("seq") * (1 << 20) + F.col("at")).alias("seq"), F.col("seq").alias("call"), F.lit(PUT).alias("op"), "record_id", F.col("field.key").alias("col_name"), F.col("field.value").alias("value"), "flags"
    )


def apply_ops(replica: Replica, ops: DataFrame, parts: int | None = None) -> tuple[Replica, DataFrame]:
    """Applies operations in order of seq; returns the new state and the changes to send to others.

    Puts tick the clock even where the record is deleted and they change nothing. Deleting a record twice, or a
    field that isn't there, does nothing and takes no tick; deleting an unknown record leaves a tombstone.

    The operations, with all that is found out about them, are written down once (in the shared folder): the
    state, the changes and the clock are read from there.
    """
    dead = dead_records(replica).select("record_id", F.lit(True).alias("dead"))
    known = ops.join(dead, "record_id", "left").withColumn("dead", F.coalesce("dead", F.lit(False)))
    first = known.filter((F.col("op") == DEL_RECORD) & ~F.col("dead")).groupBy("record_id").agg(F.min("seq").alias("dseq"))
    known = known.join(first, "record_id", "left").withColumn("alive", ~F.col("dead") & (F.col("dseq").isNull() | (F.col("seq") <= F.col("dseq"))))

    above = parent_cells(replica)
    own = replica.cells
    if above is not None:
        written = ops.filter(F.col("op") == PUT).select("record_id").distinct().join(own.select("record_id").distinct(), "record_id", "left_anti")
        # The first write copies a parent's record; field deletes before it find nothing here.
        own = own.unionByName(above.join(written, "record_id", "left_semi").join(dead, "record_id", "left_anti"))
    stored = own.select("record_id", "col_name", F.col("present").alias("was"), F.col("col_version").alias("stored"))
    if above is not None:
        local = replica.cells.select("record_id", "col_name", F.lit(True).alias("mine"))
        stored = stored.join(local, ["record_id", "col_name"], "left")
    met = known.join(stored, ["record_id", "col_name"], "left")
    cell = Window.partitionBy("record_id", "col_name").orderBy("seq")
    # Fate of the cell just before: by the batch, or else by the state.
    fields = met.filter(F.col("op") != DEL_RECORD)
    before = F.coalesce(F.lag(F.when(F.col("alive"), F.col("op"))).over(cell) == PUT, F.col("was") if above is None else F.col("was") & F.col("mine"), F.lit(False))
    fields = fields.withColumn("emitted", F.col("alive") & ((F.col("op") == PUT) | before))
    deletes = met.filter(F.col("op") == DEL_RECORD).withColumn("emitted", F.col("alive") & (F.col("seq") == F.col("dseq")))
    both = fields.unionByName(deletes)
    opens = F.row_number().over(Window.partitionBy("call").orderBy("seq")) == 1
    puts = both.filter(F.col("op") == PUT).withColumn("ticks", opens)
    others = both.filter(F.col("op") != PUT).withColumn("ticks", F.col("emitted"))
    timed = clock.running_sum(puts.unionByName(others), F.col("ticks").cast("int"), "count", parts=parts)
    timed = timed.withColumn("db_version", F.lit(replica.clock) + F.col("count"))
    count = F.sum(F.col("emitted").cast("int")).over(cell.rowsBetween(Window.unboundedPreceding, 0))
    versioned = timed.withColumn("col_version", F.when(F.col("op") == DEL_RECORD, F.lit(DELETE_VERSION)).otherwise(F.coalesce("stored", F.lit(0)) + count).cast("long"))
    versioned = staged(versioned.drop("range"), "operations")
    changes = versioned.filter("emitted").select(
        "seq", "record_id", "op", "col_name", F.when(F.col("op") == PUT, F.col("value")).alias("value"), "col_version", "db_version", F.lit(replica.node_id).cast("long").alias("node_id"), F.col("db_version").alias("local_db_version"), "flags"
    )
    gone = changes.filter(F.col("op") == DEL_RECORD).select(*TOMBSTONE_COLS)
    last = changes.filter(F.col("op") != DEL_RECORD).withColumn("__n", F.row_number().over(Window.partitionBy("record_id", "col_name").orderBy(F.desc("seq")))).filter("__n = 1")
    written_cells = last.withColumn("present", F.col("op") == PUT).select(*CELL_COLS)
    kept = own.join(written_cells.select("record_id", "col_name"), ["record_id", "col_name"], "left_anti")
    cells = kept.select(*CELL_COLS).unionByName(written_cells).join(gone.select("record_id"), "record_id", "left_anti")
    time = versioned.agg(F.coalesce(F.max("db_version"), F.lit(replica.clock)))
    return replica.with_(cells=cells, tombstones=replica.tombstones.unionByName(gone), clock_source=time), changes.select(*CHANGE_COLS)


def from_changes(node_id: int, changes: DataFrame) -> Replica:
    """The state that a log, read in order of seq, leads to, without comparing versions: the last write of a cell stays.

    A field delete moves a cell's version on but doesn't take its value. A deleted record stays deleted, under
    the version of its last delete. Local versions are kept; the clock is the greatest version seen.
    """
    deletes = changes.filter(F.col("op") == DEL_RECORD).groupBy("record_id").agg(F.max(F.struct("seq", "db_version", "node_id", "local_db_version")).alias("d"))
    tombstones = deletes.select("record_id", "d.db_version", "d.node_id", "d.local_db_version")
    writes = changes.filter(F.col("op") != DEL_RECORD)
    put = F.when(F.col("op") == PUT, F.struct("seq", "value"))
    last = writes.groupBy("record_id", "col_name").agg(F.max(F.struct("seq", "col_version", "db_version", "node_id", "local_db_version")).alias("v"), F.max(put).alias("p"))
    cells = last.select("record_id", "col_name", F.col("p.value").alias("value"), F.col("p").isNotNull().alias("present"), "v.col_version", "v.db_version", "v.node_id", "v.local_db_version")
    time = changes.agg(F.max(F.greatest("db_version", "local_db_version")))
    return Replica(node_id, cells.join(tombstones.select("record_id"), "record_id", "left_anti").select(*CELL_COLS), tombstones, time)


def reset(replica: Replica, changes: DataFrame) -> Replica:
    """A replica of the same writer and parent whose state is that of the log alone."""
    return from_changes(replica.node_id, changes).with_(parent=replica.parent, base_version=replica.base_version)


__all__ = ["DEL_FIELD", "OPS_DDL", "apply_ops", "explode_fields", "from_changes", "reset"]
