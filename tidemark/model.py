"""The data model: change logs, cells and tombstones as DataFrames, and a replica that holds them.

A change is put, del_field or del_record; `op` keeps an absent field apart from a null value. `seq` gives the
order of arrival, which a DataFrame lacks.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CHANGES_DDL = "seq long, record_id string, op string, col_name string, value string, col_version long, db_version long, node_id long, local_db_version long, flags int"
CELLS_DDL = "record_id string, col_name string, value string, present boolean, col_version long, db_version long, node_id long, local_db_version long"
TOMBSTONES_DDL = "record_id string, db_version long, node_id long, local_db_version long"
CHANGE_COLS = [c.split()[0] for c in CHANGES_DDL.split(", ")]
CELL_COLS = [c.split()[0] for c in CELLS_DDL.split(", ")]
TOMBSTONE_COLS = [c.split()[0] for c in TOMBSTONES_DDL.split(", ")]
PUT, DEL_FIELD, DEL_RECORD = "put", "del_field", "del_record"
#: col_version of a record delete: above any other.
DELETE_VERSION = 9223372036854775807
VERSION = ["col_version", "db_version", "node_id"]


def empty(spark: SparkSession, ddl: str) -> DataFrame:
    """A frame without rows that the optimiser knows to be empty: joins with it go from the plan."""
    fields = StructType.fromDDL(ddl).fields
    return spark.range(1).filter(F.lit(False)).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])


def version(prefix: str = "") -> Column:
    """What decides between two writes of a cell, in one comparable column."""
    return F.struct(*[F.col(prefix + c) for c in VERSION])


@dataclass(frozen=True)
class Replica:
    """The state of one writer: its cells (field tombstones are cells with present = false), the tombstones of
    deleted records, and its logical clock. A child replica reads through to its parent."""

    node_id: int
    cells: DataFrame
    tombstones: DataFrame
    clock_source: int | DataFrame = 0  # or a frame of one row and column, looked at when the clock is asked for
    parent: Replica | None = None
    base_version: int = 0

    @cached_property
    def clock(self) -> int:
        if isinstance(self.clock_source, int):
            return self.clock_source
        return int(self.clock_source.first()[0] or 0)

    def with_(self, **changed) -> Replica:
        return replace(self, **changed)


def new(spark: SparkSession, node_id: int, parent: Replica | None = None) -> Replica:
    """An empty replica; a child starts at its parent's clock."""
    clock = parent.clock if parent else 0
    return Replica(node_id, empty(spark, CELLS_DDL), empty(spark, TOMBSTONES_DDL), clock, parent, clock)


def replica(node_id: int, cells: DataFrame, tombstones: DataFrame, clock: int | DataFrame | None = None) -> Replica:
    """A replica of given state; without a clock, the clock is the state's latest version."""
    if clock is None:
        latest = F.max(F.greatest("db_version", "local_db_version")).alias("v")
        clock = cells.agg(latest).unionAll(tombstones.agg(latest)).agg(F.max("v"))
    return Replica(node_id, cells, tombstones, clock)
