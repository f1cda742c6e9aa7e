"""A replica's state and logs as files: JSON, Parquet, and Parquet of another schema version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import CELLS_DDL, CHANGES_DDL, TOMBSTONES_DDL, Replica, replica


def to_json(state: Replica) -> DataFrame:
    """One JSON text for each cell and tombstone, and one for the replica itself; a parent isn't written."""
    kind = lambda df, name: df.select(F.to_json(F.struct(F.lit(name).alias("kind"), *df.columns), {"ignoreNullFields": "false"}).alias("json"))
    spark = state.cells.sparkSession
    meta = spark.createDataFrame([(state.node_id, state.clock, state.base_version)], "node_id long, clock long, base_version long")
    return kind(state.cells, "cell").unionAll(kind(state.tombstones, "tombstone")).unionAll(kind(meta, "replica"))


def from_json(texts: DataFrame) -> Replica:
    """The replica that to_json() wrote."""
    kind = F.get_json_object("json", "$.kind")
    read = lambda name, ddl: texts.filter(kind == name).select(F.from_json("json", ddl).alias("r")).select("r.*")
    meta = read("replica", "node_id long, clock long, base_version long").first()
    if meta is None:
        raise ValueError("there is no replica in these texts")
    return Replica(meta.node_id, read("cell", CELLS_DDL), read("tombstone", TOMBSTONES_DDL), meta.clock, None, meta.base_version)


def write(state: Replica, path: str, compression: str = "zstd") -> None:
    """Cells and tombstones as Parquet, sorted by record, so that point and range reads skip row groups."""
    for name, frame in (("cells", state.cells), ("tombstones", state.tombstones)):
        frame.repartitionByRange("record_id").sortWithinPartitions("record_id").write.option("compression", compression).parquet(f"{path}/{name}")


def read(spark: SparkSession, path: str, node_id: int, clock: int | None = None) -> Replica:
    """What write() wrote, by this or another version: missing columns are null, additional ones are dropped."""
    return replica(node_id, spark.read.schema(CELLS_DDL).parquet(f"{path}/cells"), spark.read.schema(TOMBSTONES_DDL).parquet(f"{path}/tombstones"), clock)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHANGES_DDL).parquet(path)
