"""Change logs, texts and lists derived from plain tables: what the queries, benches and tests run over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import CHANGE_COLS, DEL_FIELD, DEL_RECORD, PUT, Replica
from ..operators.mutate import from_changes

#: The log's seq: events of node 1 arrive before those of node 2, and so on.
NODE_STEP = 1 << 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three writers' logs, one after the other: events put a user's value of their type, some errors delete."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    error = F.col("event_type") == "error"
    op = F.when(~error, F.lit(PUT)).when(F.col("event_id") % 97 == 0, F.lit(DEL_RECORD)).when(F.col("event_id") % 7 == 0, F.lit(DEL_FIELD))
    rows = e.select(
        "event_id", (F.col("event_id") % 3 + 1).alias("node_id"), F.col("user_id").cast("string").alias("record_id"), op.alias("op"),
        F.when(op == PUT, F.col("event_type")).when(op == DEL_FIELD, F.lit("view")).alias("col_name"),
        F.when(op == PUT, F.round(F.col("value") * 100).cast("long").cast("string")).alias("value"),
    ).filter("op is not null")
    count = F.row_number().over(Window.partitionBy("node_id", "record_id", "col_name").orderBy("event_id"))
    db = F.floor(F.col("event_id") / 3) + 1
    return rows.withColumn("col_version", count.cast("long")).select(
        (F.col("node_id") * NODE_STEP + F.col("event_id")).alias("seq"), "record_id", "op", "col_name", "value", "col_version", db.alias("db_version"), "node_id", db.alias("local_db_version"), F.lit(0).alias("flags")
    ).select(*CHANGE_COLS)


def event_replica(spark: SparkSession, sf_dir: str, node_id: int) -> Replica:
    """The state of one of the writers."""
    return from_changes(node_id, events_log(spark, sf_dir).filter(F.col("node_id") == node_id))


def _puts(rows: DataFrame, key, cells: list[tuple[str, object]], version, db, node) -> DataFrame:
    fields = F.array(*[F.struct(F.lit(n).alias("col_name"), v.cast("string").alias("value")) for n, v in cells])
    made = rows.select(key.alias("record_id"), version.cast("long").alias("col_version"), db.cast("long").alias("db_version"), node.cast("long").alias("node_id"), F.posexplode(fields).alias("at", "field"))
    return made.select(
        (F.col("db_version") * 8 + F.col("at")).alias("seq"), "record_id", F.lit(PUT).alias("op"), "field.col_name", "field.value", "col_version", "db_version", "node_id", F.col("db_version").alias("local_db_version"), F.lit(0).alias("flags")
    ).select(*CHANGE_COLS)


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's status, priority and customer, written once."""
    o = table(spark, sf_dir, "orders")
    cells = [("status", F.col("o_orderstatus")), ("priority", F.col("o_orderpriority")), ("custkey", F.col("o_custkey"))]
    return _puts(o, F.col("o_orderkey").cast("string"), cells, F.lit(1), F.col("o_orderkey") + 1, F.lit(1))


def orders_replica(spark: SparkSession, sf_dir: str) -> Replica:
    return from_changes(1, orders_log(spark, sf_dir))


def lineitem_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items that share an order and number, as conflicting writes by their suppliers; the dearest wins."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount")
    scaled = lambda c: F.round(F.col(c) * 100).cast("long")
    cells = [("qty", scaled("l_quantity")), ("price", scaled("l_extendedprice")), ("discount", scaled("l_discount"))]
    return _puts(li, F.concat_ws("-", "l_orderkey", "l_linenumber"), cells, scaled("l_extendedprice") * 128 + scaled("l_discount"), F.col("l_partkey") + 1, F.col("l_suppkey"))


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, i, content): the documents' lines."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "content"))


def line_edits(spark: SparkSession, sf_dir: str, apart: bool = False) -> DataFrame:
    """Writers 2 and 3 edit every 5th line of every document at once; writer 2 deletes every 11th.

    Both add a word at the end; if apart, writer 2 adds it in front.
    """
    rows = doc_lines(spark, sf_dir).select("doc_id", "i", "content", F.concat_ws("_", F.lit(1), F.lit(1), "i").alias("line_id"))
    kind = F.when(F.col("i") % 11 == 10, F.lit("Delete")).when(F.col("i") % 5 == 4, F.lit("Edit"))
    base = rows.withColumn("type", kind).filter("type is not null")
    nodes = base.select("*", F.explode(F.array(F.lit(2), F.lit(3))).alias("node_id")).filter("type = 'Edit' or node_id = 2")
    word = F.concat(F.lit("edit"), F.col("node_id").cast("string"))
    return nodes.select(
        (F.col("doc_id").cast("long") * 1_000_000 + F.col("i") * 4 + F.col("node_id")).alias("seq"), "doc_id", "type", "line_id", F.lit(None).cast("array<bigint>").alias("position"),
        F.when(F.col("type") == "Edit", F.when(F.lit(apart) & (F.col("node_id") == 2), F.concat(word, F.lit(" "), "content")).otherwise(F.concat("content", F.lit(" "), word))).alias("content"),
        F.when(F.col("type") == "Edit", 2).otherwise(1).cast("long").alias("line_version"), F.lit(2).cast("long").alias("db_version"), F.col("node_id").cast("long").alias("node_id"), F.lit(2).cast("long").alias("local_db_version"),
        F.when(F.col("type") == "Edit", F.col("content")).alias("base_content"),
    )


def conversation_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as lists: each turn was inserted after the one before it, by its role's replica."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("list_id"), "turn", "role", "text")
    replica = F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 2).otherwise(3).cast("long")
    before = Window.partitionBy("list_id").orderBy("turn")
    gone = F.col("turn") % 4 == 3
    rows = c.withColumn("replica_id", replica).withColumn("sequence", (F.col("turn") + 1).cast("long"))
    version = F.when(gone, 2).otherwise(1).cast("long")
    return rows.select(
        "list_id", "replica_id", "sequence", F.when(~gone, F.col("text")).alias("value"), gone.alias("deleted"), F.lag("sequence").over(before).alias("ol_seq"), F.lag("replica_id").over(before).alias("ol_rep"),
        F.lit(None).cast("long").alias("or_seq"), F.lit(None).cast("long").alias("or_rep"), version.alias("version"), F.col("sequence").alias("db_version"), F.col("replica_id").alias("node_id"), F.col("sequence").alias("local_db_version"),
    )
