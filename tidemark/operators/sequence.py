"""Lists whose elements are ordered by what they were inserted between.

An element is (replica_id, sequence) with the ids of its neighbours when it was inserted. Order is a fixed sort
key: left origin (none first), right origin (none first), own id. A frame may hold many lists (list_id).
Indices count visible elements from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ELEMENTS_DDL = (
    "list_id string, replica_id long, sequence long, value string, deleted boolean, ol_seq long, ol_rep long, or_seq long, or_rep long, "
    "version long, db_version long, node_id long, local_db_version long"
)
COLS = [c.split()[0] for c in ELEMENTS_DDL.split(", ")]
ID = ["list_id", "replica_id", "sequence"]


def order() -> list[Column]:
    nulls_first = [F.col(c).asc_nulls_first() for c in ("ol_seq", "ol_rep", "or_seq", "or_rep")]
    return [*nulls_first, F.col("sequence"), F.col("replica_id")]


def visible(elements: DataFrame) -> DataFrame:
    """Elements that aren't deleted, with their index."""
    at = F.row_number().over(Window.partitionBy("list_id").orderBy(*order())) - 1
    return elements.filter(~F.col("deleted")).withColumn("index", at.cast("long"))


def values(elements: DataFrame) -> DataFrame:
    """(list_id, values): the visible values in order."""
    key = F.struct(*[F.col(c) for c in ("ol_seq", "ol_rep", "or_seq", "or_rep", "sequence", "replica_id")], "value")
    return elements.filter(~F.col("deleted")).groupBy("list_id").agg(F.transform(F.array_sort(F.collect_list(key)), lambda e: e["value"]).alias("values"))


def insert(elements: DataFrame, inserts: DataFrame, replica_id: int, db_version: int = 1) -> DataFrame:
    """Inserts (list_id, index, value), all as of the current lists; an index past the end means the end.

    New sequences go on from the replica's greatest in each list, in order of index.
    """
    seen = visible(elements)
    size = seen.groupBy("list_id").agg(F.count(F.lit(1)).alias("size"))
    last = elements.filter(F.col("replica_id") == replica_id).groupBy("list_id").agg(F.max("sequence").alias("last"))
    rows = inserts.join(size, "list_id", "left").join(last, "list_id", "left")
    rows = rows.withColumn("index", F.least(F.greatest("index", F.lit(0)), F.coalesce("size", F.lit(0))).cast("long"))
    nth = F.row_number().over(Window.partitionBy("list_id").orderBy("index", "value"))
    rows = rows.withColumn("sequence", (F.coalesce("last", F.lit(0)) + nth).cast("long"))
    left = seen.select("list_id", (F.col("index") + 1).alias("index"), F.col("sequence").alias("ol_seq"), F.col("replica_id").alias("ol_rep"))
    right = seen.select("list_id", "index", F.col("sequence").alias("or_seq"), F.col("replica_id").alias("or_rep"))
    made = rows.join(left, ["list_id", "index"], "left").join(right, ["list_id", "index"], "left")
    node = F.lit(replica_id).cast("long")
    version = F.lit(db_version).cast("long")
    return made.select("list_id", node.alias("replica_id"), "sequence", "value", F.lit(False).alias("deleted"), "ol_seq", "ol_rep", "or_seq", "or_rep", F.lit(1).cast("long").alias("version"), version.alias("db_version"), node.alias("node_id"), version.alias("local_db_version"))


def delete(elements: DataFrame, deletes: DataFrame, replica_id: int, db_version: int = 1) -> DataFrame:
    """The elements at (list_id, index), as deleted: their next version. Indices that aren't there do nothing."""
    hit = visible(elements).join(deletes.select("list_id", "index").distinct(), ["list_id", "index"], "left_semi")
    version, node = F.lit(db_version).cast("long"), F.lit(replica_id).cast("long")
    return hit.withColumns({"value": F.lit(None).cast("string"), "deleted": F.lit(True), "version": F.col("version") + 1, "db_version": version, "node_id": node, "local_db_version": version}).select(*COLS)


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Elements of both, each id once. A deletion stays; origins are the same wherever an element is known."""
    both = a.select(*COLS).unionByName(b.select(*COLS))
    top = F.max(F.struct("version", "db_version", "node_id", "local_db_version"))
    origins = [F.first(c, ignorenulls=True).alias(c) for c in ("ol_seq", "ol_rep", "or_seq", "or_rep")]
    # max over non-null values: a value is written once.
    met = both.groupBy(*ID).agg(F.max("value").alias("value"), F.max("deleted").alias("deleted"), *origins, top.alias("v"))
    return met.select(*ID, F.when(~F.col("deleted"), F.col("value")).alias("value"), "deleted", "ol_seq", "ol_rep", "or_seq", "or_rep", "v.*").select(*COLS)


def delta(a: DataFrame, b: DataFrame) -> DataFrame:
    """Elements of a that b doesn't know; deletions of elements that b knows are not among them."""
    return a.join(b.select(*ID), ID, "left_anti").select(*COLS)


def apply_delta(elements: DataFrame, new: DataFrame, tombstones: DataFrame | None = None) -> DataFrame:
    """Adds unknown elements and deletes those whose ids are in tombstones(list_id, replica_id, sequence)."""
    met = merge(elements, new)
    if tombstones is None:
        return met
    gone = tombstones.select(*ID).distinct().withColumn("gone", F.lit(True))
    marked = met.join(gone, ID, "left").withColumn("deleted", F.col("deleted") | F.coalesce("gone", F.lit(False)))
    return marked.withColumn("value", F.when(~F.col("deleted"), F.col("value"))).select(*COLS)


def collect_garbage(elements: DataFrame) -> DataFrame:
    """Without the deleted elements. A replica that still has them would bring them back."""
    return elements.filter(~F.col("deleted"))


def changes_since(elements: DataFrame, since: int) -> DataFrame:
    return elements.filter(F.col("local_db_version") > since)


def sync(a: DataFrame, b: DataFrame, last: int) -> tuple[DataFrame, DataFrame, int]:
    """Both lists with each other's changes since `last`, and the next watermark."""
    top = a.agg(F.max("local_db_version")).unionAll(b.agg(F.max("local_db_version"))).agg(F.max("max(local_db_version)")).first()[0]
    return merge(a, changes_since(b, last)), merge(b, changes_since(a, last)), max(last, top or 0)
