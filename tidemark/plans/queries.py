"""One query for each operator, over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import positions, words
from ..model import CELL_COLS, CHANGE_COLS, PUT, TOMBSTONE_COLS, Replica, new
from ..operators import digest, merge, mutate, overlay, query, sequence, text
from ..sources import codec
from ..sources.staging import new_path as scratch
from ..sources.store import Config, Store
from ..streaming.apply import apply_stream, read_changes
from . import workload as w

STATE = ["record_id", "col_name", "value", "present", "col_version", "db_version", "node_id"]
NO_SNAPSHOTS = Config(snapshot_changes=1 << 62, snapshot_seconds=float("inf"), incremental=True)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


def _split(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first two writers' part of the log, and the third's."""
    return log.filter("node_id < 3"), log.filter("node_id = 3")


def _merged(spark: SparkSession, sf_dir: str, stamped: bool = False) -> merge.Merged:
    return merge.merge(new(spark, 9), w.events_log(spark, sf_dir), stamped=stamped)


# ---- merge -------------------------------------------------------------------------------------------------


@register
def merge_lww_state(spark, sf_dir):
    return _merged(spark, sf_dir).replica.cells.select(*STATE)


@register
def merge_lineitem_state(spark, sf_dir):
    return merge.merge(new(spark, 9), w.lineitem_log(spark, sf_dir), stamped=False).replica.cells.select(*STATE)


@register
def merge_into_state(spark, sf_dir):
    first, second = _split(w.events_log(spark, sf_dir))
    state = merge.merge(new(spark, 9), first, stamped=False).replica
    return merge.merge(state, second, stamped=False).replica.cells.select(*STATE)


@register
def merge_stamped_state(spark, sf_dir):
    return _merged(spark, sf_dir, True).replica.cells.select("record_id", "col_name", "local_db_version")


@register
def merge_tombstones(spark, sf_dir):
    return _merged(spark, sf_dir, True).replica.tombstones


@register
def merge_accepted(spark, sf_dir):
    return _merged(spark, sf_dir, True).accepted.select("seq", "record_id", "op", "col_name", "value", "db_version", "node_id", "local_db_version")


@register
def merge_clock(spark, sf_dir):
    return spark.createDataFrame([(_merged(spark, sf_dir, True).replica.clock,)], "clock long")


LARGEST = merge.Rule(order_key=lambda: [F.coalesce(F.col("value").cast("long"), F.lit(-1))])


@register
def merge_custom_rule_key(spark, sf_dir):
    log = w.events_log(spark, sf_dir)
    return merge.merge(new(spark, 9), log, LARGEST, stamped=False).replica.cells.select(*STATE)


@register
def merge_context_rule(spark, sf_dir):
    rule = merge.with_context(lambda trusted: [F.col("node_id") == trusted, F.col("col_version"), F.col("db_version"), F.col("node_id")], trusted=2)
    return merge.merge(new(spark, 9), w.events_log(spark, sf_dir), rule, stamped=False).replica.cells.select(*STATE)


@register
def merge_custom_rule_fold(spark, sf_dir):
    weigh = lambda r: -1 if r["value"] is None else int(r["value"])
    rule = merge.Rule(predicate=lambda local, remote: weigh(remote) > weigh(local))
    return merge.merge(new(spark, 9), w.events_log(spark, sf_dir), rule).replica.cells.select(*STATE)


@register
def compress_changes(spark, sf_dir):
    return merge.compress(w.events_log(spark, sf_dir).filter("op <> 'del_record'")).select(*CHANGE_COLS)


@register
def compress_with_deletes(spark, sf_dir):
    return merge.compress(w.events_log(spark, sf_dir)).select(*CHANGE_COLS)


@register
def compress_custom_order(spark, sf_dir):
    return merge.compress(w.events_log(spark, sf_dir), lambda: [F.col("db_version").desc(), F.col("node_id").desc()]).select(*CHANGE_COLS)


@register
def sync_watermark(spark, sf_dir):
    merged, last = merge.sync(w.event_replica(spark, sf_dir, 1), w.event_replica(spark, sf_dir, 2), 500)
    return merged.replica.cells.select(*STATE).withColumn("last", F.lit(last).cast("long"))


@register
def compact_tombstones(spark, sf_dir):
    state, removed = merge.compact_tombstones(w.event_replica(spark, sf_dir, 1), 1500)
    return state.tombstones.select(*TOMBSTONE_COLS, F.lit(removed.first().removed).alias("removed"))


@register
def convergence_check(spark, sf_dir):
    a = _merged(spark, sf_dir).replica
    log = w.events_log(spark, sf_dir)
    other_way = log.withColumn("seq", F.lit(1 << 45) - F.col("seq"))
    b = merge.merge(new(spark, 8), other_way, stamped=False).replica
    behind = merge.merge(new(spark, 8), log.filter("node_id < 3"), stamped=False).replica
    return query.converged(a, b).select(F.lit("all").alias("replica"), "converged").unionAll(query.converged(a, behind).select(F.lit("behind"), "converged"))


@register
def differing_fields(spark, sf_dir):
    behind = merge.merge(new(spark, 8), w.events_log(spark, sf_dir).filter("node_id < 3"), stamped=False).replica
    return query.differing(_merged(spark, sf_dir).replica, behind)


@register
def reset_state(spark, sf_dir):
    log = w.events_log(spark, sf_dir).filter("node_id = 2")
    return mutate.reset(w.event_replica(spark, sf_dir, 1), log).cells.select(*CELL_COLS)


@register
def tombstone_of_record(spark, sf_dir):
    """The tombstone of the first deleted record by id."""
    state = w.event_replica(spark, sf_dir, 1)
    first = state.tombstones.agg(F.min("record_id")).first()[0]
    return query.tombstone(state, first or "").select(*TOMBSTONE_COLS)


@register
def insert_containers(spark, sf_dir):
    """Customers, each inserted by one call from a map of its fields."""
    c = w.table(spark, sf_dir, "customer")
    fields = F.map_from_arrays(F.array(F.lit("segment"), F.lit("nation"), F.lit("balance")), F.array("c_mktsegment", F.col("c_nationkey").cast("string"), F.round(F.col("c_acctbal") * 100).cast("long").cast("string")))
    rows = c.select(F.col("c_custkey").alias("seq"), F.col("c_custkey").cast("string").alias("record_id"), fields.alias("fields"), F.lit(0).alias("flags"))
    return mutate.apply_ops(new(spark, 4), mutate.explode_fields(rows))[0].cells.select(*CELL_COLS)


# ---- local writes ------------------------------------------------------------------------------------------


def _ops(spark, sf_dir) -> DataFrame:
    """The third writer's events as local operations, two puts to a call now and then."""
    log = w.events_log(spark, sf_dir).filter("node_id = 3")
    return log.select("seq", F.floor(F.col("seq") / 12).alias("call"), "op", "record_id", "col_name", "value", "flags")


def _written(spark, sf_dir, only: str | None = None) -> tuple[Replica, DataFrame]:
    ops = _ops(spark, sf_dir)
    if only:
        ops = ops.filter(F.col("op").isin(PUT, only))
    return mutate.apply_ops(w.event_replica(spark, sf_dir, 1), ops)


OUT = ["seq", "record_id", "op", "col_name", "value", "col_version", "db_version", "node_id"]


@register
def local_insert_changes(spark, sf_dir):
    return _written(spark, sf_dir, PUT)[1].select(*OUT)


@register
def local_delete_record(spark, sf_dir):
    return _written(spark, sf_dir, "del_record")[1].filter("op = 'del_record'").select("seq", "record_id", "db_version", "node_id")


@register
def local_delete_field(spark, sf_dir):
    return _written(spark, sf_dir, "del_field")[1].filter("op = 'del_field'").select(*OUT)


@register
def local_all_changes(spark, sf_dir):
    return _written(spark, sf_dir)[1].select(*OUT)


@register
def local_state(spark, sf_dir):
    return _written(spark, sf_dir)[0].cells.select(*STATE)


@register
def from_changes_state(spark, sf_dir):
    return w.event_replica(spark, sf_dir, 2).cells.select(*CELL_COLS)


# ---- reads -------------------------------------------------------------------------------------------------


@register
def changes_since(spark, sf_dir):
    return query.changes_since(w.event_replica(spark, sf_dir, 1), 1000).drop("seq", "flags")


@register
def changes_since_excluding(spark, sf_dir):
    return query.changes_since(_merged(spark, sf_dir).replica, 1000, excluding=[2]).drop("seq", "flags")


@register
def changed_records_since(spark, sf_dir):
    return query.changed_records(w.event_replica(spark, sf_dir, 1), 3000)[0].select(*CELL_COLS)


@register
def query_records(spark, sf_dir):
    found = query.query(w.orders_replica(spark, sf_dir), F.col("fields")["status"] == "F")
    return found.select("record_id", "highest_local")


@register
def query_with_projection(spark, sf_dir):
    urgent = F.col("fields")["priority"].startswith("1")
    return query.project(w.orders_replica(spark, sf_dir), urgent, "record_id", F.col("fields")["custkey"].alias("custkey"), F.col("fields")["status"].alias("status"))


@register
def range_keys(spark, sf_dir):
    return query.key_range(w.orders_replica(spark, sf_dir), "10", "20").select("record_id", "lowest_local", "highest_local")


@register
def get_record(spark, sf_dir):
    return query.get_record(_merged(spark, sf_dir).replica, "7").select(*STATE)


@register
def is_tombstoned(spark, sf_dir):
    ids = w.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("record_id")).distinct()
    return query.are_tombstoned(_merged(spark, sf_dir).replica, ids)


@register
def tombstone_count(spark, sf_dir):
    return query.tombstone_count(_merged(spark, sf_dir).replica)


@register
def records_modified_since(spark, sf_dir):
    return query.modified_since(w.event_replica(spark, sf_dir, 1), 3000)


@register
def recently_modified_topk(spark, sf_dir):
    return query.recently_modified(w.event_replica(spark, sf_dir, 1), 10)


# ---- parent and child --------------------------------------------------------------------------------------


def _child(spark, sf_dir) -> Replica:
    """Writer 2's log merged into a child of writer 1's state."""
    parent = w.event_replica(spark, sf_dir, 1)
    child = Replica(2, new(spark, 2).cells, new(spark, 2).tombstones, 0, parent, 0)
    return merge.merge(child, w.events_log(spark, sf_dir).filter("node_id = 2"), stamped=False).replica


@register
def overlay_child_state(spark, sf_dir):
    return _child(spark, sf_dir).cells.select(*STATE)


@register
def overlay_combined(spark, sf_dir):
    return overlay.combined(_child(spark, sf_dir)).select(*STATE)


@register
def overlay_changes_since(spark, sf_dir):
    return query.changes_since(_child(spark, sf_dir), 2000).drop("seq", "flags")


@register
def diff_replicas(spark, sf_dir):
    a, b = w.event_replica(spark, sf_dir, 1), w.event_replica(spark, sf_dir, 2)
    return overlay.diff(a.with_(clock_source=2000), b).drop("seq", "flags", "local_db_version")


@register
def revert_child(spark, sf_dir):
    return overlay.revert(_child(spark, sf_dir).with_(clock_source=4000)).drop("seq", "flags", "local_db_version")


@register
def invert_changes(spark, sf_dir):
    log = w.events_log(spark, sf_dir).filter("node_id = 3")
    return overlay.invert(log, w.event_replica(spark, sf_dir, 1), 3, 5000).drop("flags", "local_db_version")


# ---- texts -------------------------------------------------------------------------------------------------


def _text(spark, sf_dir) -> text.Text:
    d = w.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return text.load(d, 1)


@register
def text_lines_in_order(spark, sf_dir):
    return text.ordered(_text(spark, sf_dir)).select("doc_id", "line_id", positions.dotted(F.col("position")).alias("position"), "content")


@register
def text_to_text(spark, sf_dir):
    return text.to_text(text.merge(_text(spark, sf_dir), w.line_edits(spark, sf_dir)))


LINE_OUT = ["doc_id", "line_id", "content", "line_version", "db_version", "node_id"]


@register
def text_merge_lww(spark, sf_dir):
    return text.merge(_text(spark, sf_dir), w.line_edits(spark, sf_dir)).lines.select(*LINE_OUT)


@register
def text_merge_bww(spark, sf_dir):
    state = text.merge(_text(spark, sf_dir), w.line_edits(spark, sf_dir), text.BOTH_WRITES)
    return text.all_versions(state).select("doc_id", "line_id", F.col("at").cast("long").alias("at"), "db_version", "node_id", "content")


@register
def text_merge_auto(spark, sf_dir):
    state = text.merge(_text(spark, sf_dir), w.line_edits(spark, sf_dir, apart=True), text.AUTO_MERGE)
    return state.lines.select(*LINE_OUT, F.coalesce(F.size("conflicts"), F.lit(0)).alias("conflicts"))


@register
def text_tombstones(spark, sf_dir):
    return text.merge(_text(spark, sf_dir), w.line_edits(spark, sf_dir)).tombstones.select(*text.TOMB_COLS)


@register
def text_changes_since(spark, sf_dir):
    state = text.merge(_text(spark, sf_dir), w.line_edits(spark, sf_dir))
    return text.changes_since(state, 1).select("doc_id", "line_id", "type", positions.dotted(F.col("position")).alias("position"), "content", "line_version", "db_version", "node_id")


@register
def text_word_diff(spark, sf_dir):
    edited = w.line_edits(spark, sf_dir).filter("type = 'Edit'").select("doc_id", "line_id", "node_id", F.col("content").alias("new"))
    met = edited.join(_text(spark, sf_dir).lines.select("doc_id", "line_id", "content"), ["doc_id", "line_id"])
    return met.select("doc_id", "line_id", "node_id", F.explode(words.edits(F.col("content"), F.col("new"))).alias("e")).select("doc_id", "line_id", "node_id", "e.start", "e.end", F.array_join("e.words", " ").alias("words"))


@register
def text_split_words(spark, sf_dir):
    return _text(spark, sf_dir).lines.select("doc_id", "line_id", F.size(words.word_array(F.col("content"))).cast("long").alias("n_words"))


@register
def text_positions_between(spark, sf_dir):
    """A line put after every line."""
    state = _text(spark, sf_dir)
    inserts = state.lines.select((F.col("doc_id").cast("long") * 1_000_000 + F.element_at("position", 1)).alias("seq"), "doc_id", F.lit("after").alias("where"), F.col("line_id").alias("anchor"), F.lit("new").alias("content"))
    made, changes = text.insert_lines(state, inserts)
    return changes.select("doc_id", positions.dotted(F.col("position")).alias("position"), "content")


@register
def text_edit_lines(spark, sf_dir):
    edits = w.line_edits(spark, sf_dir).filter("type = 'Edit' and node_id = 2").select("seq", "doc_id", "line_id", "content")
    return text.edit_lines(_text(spark, sf_dir).with_(node_id=2), edits)[0].lines.select("doc_id", "line_id", "content", "line_version", "base_content")


@register
def text_delete_lines(spark, sf_dir):
    deletes = w.line_edits(spark, sf_dir).filter("type = 'Delete'").select("seq", "doc_id", "line_id")
    state = text.delete_lines(_text(spark, sf_dir), deletes)[0]
    left = state.lines.select("doc_id", "line_id", "content", F.lit(None).cast("long").alias("deleted_at"))
    return left.unionByName(state.tombstones.select("doc_id", "line_id", F.lit(None).cast("string").alias("content"), F.col("db_version").alias("deleted_at")))


@register
def text_sync(spark, sf_dir):
    """A replica that has only loaded the texts gets another's edits and deletions."""
    edited = text.merge(_text(spark, sf_dir), w.line_edits(spark, sf_dir))
    return text.sync(edited, _text(spark, sf_dir), 1)[0].lines.select(*LINE_OUT)


@register
def text_collision_order(spark, sf_dir):
    """Writers 2 and 3 put a line into the same gap, after every document's first line: line ids decide."""
    state = _text(spark, sf_dir)
    docs = state.lines.select("doc_id").distinct()
    both = None
    for node in (2, 3):
        inserts = docs.select(F.col("doc_id").cast("long").alias("seq"), "doc_id", F.lit("after").alias("where"), F.lit("1_1_0").alias("anchor"), F.lit(f"by {node}").alias("content"))
        made = text.insert_lines(state.with_(node_id=node), inserts)[1]
        both = made if both is None else both.unionByName(made)
    state = text.merge(state, both.withColumn("seq", F.col("seq") * 4 + F.col("node_id")))
    new_ones = state.lines.filter("node_id > 1")
    return new_ones.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "line_id", "content"))), lambda x: x["content"]), ",").alias("order"), F.countDistinct("position").alias("positions"))


# ---- lists -------------------------------------------------------------------------------------------------


def _halves(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Two replicas of the lists: without replica 2's elements, and without the deletions."""
    full = w.conversation_list(spark, sf_dir)
    texts = w.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("list_id"), (F.col("turn") + 1).cast("long").alias("sequence"), "text")
    alive = full.join(texts, ["list_id", "sequence"]).withColumns({"value": F.col("text"), "deleted": F.lit(False), "version": F.lit(1).cast("long")})
    return full.filter("replica_id <> 2 or deleted"), alive.select(*sequence.COLS)


@register
def list_values(spark, sf_dir):
    return sequence.values(w.conversation_list(spark, sf_dir)).select("list_id", F.array_join("values", "|").alias("joined"), F.size("values").cast("long").alias("n"))


@register
def list_merge(spark, sf_dir):
    a, b = _halves(spark, sf_dir)
    return sequence.merge(a, b).select("list_id", "replica_id", "sequence", "value", "deleted", "version")


@register
def list_delta(spark, sf_dir):
    a, b = _halves(spark, sf_dir)
    return sequence.delta(b, a).select("list_id", "replica_id", "sequence", "value")


@register
def list_apply_delta(spark, sf_dir):
    a, b = _halves(spark, sf_dir)
    gone = a.filter("deleted").select(*sequence.ID)
    return sequence.apply_delta(b, sequence.delta(a, b), gone).select("list_id", "replica_id", "sequence", "value", "deleted")


@register
def list_gc(spark, sf_dir):
    return sequence.collect_garbage(w.conversation_list(spark, sf_dir)).select("list_id", "replica_id", "sequence", "value")


@register
def list_insert(spark, sf_dir):
    full = w.conversation_list(spark, sf_dir)
    inserts = full.select("list_id").distinct().select("list_id", F.lit(1).alias("index"), F.lit("inserted").alias("value"))
    return sequence.insert(full, inserts, 7).select("list_id", "replica_id", "sequence", "value", "ol_seq", "ol_rep", "or_seq", "or_rep")


@register
def list_delete(spark, sf_dir):
    full = w.conversation_list(spark, sf_dir)
    deletes = full.select("list_id", F.lit(0).alias("index")).distinct()
    return sequence.delete(full, deletes, 7, 99).select("list_id", "replica_id", "sequence", "version", "db_version")


@register
def list_changes_since(spark, sf_dir):
    return sequence.changes_since(w.conversation_list(spark, sf_dir), 2).select("list_id", "replica_id", "sequence", "deleted")


@register
def list_sync(spark, sf_dir):
    a, b = _halves(spark, sf_dir)
    return sequence.sync(a, b, 0)[0].select("list_id", "replica_id", "sequence", "value", "deleted")


# ---- storage and streams -----------------------------------------------------------------------------------


def _stored(spark, sf_dir, snapshots: bool) -> Store:
    """The events in a store: two writers', then a snapshot, then the third's; and another snapshot, if asked."""
    first, second = _split(w.events_log(spark, sf_dir))
    root = scratch(spark, "store")
    store = Store.open(spark, root, 9, NO_SNAPSHOTS)
    store.merge(first)
    if snapshots:
        store.snapshot()
    store.merge(second)
    if snapshots:
        store.snapshot()
    return Store.open(spark, root, 9, NO_SNAPSHOTS)


@register
def snapshot_recover_state(spark, sf_dir):
    return _stored(spark, sf_dir, True).replica().cells.select(*CELL_COLS)


@register
def incremental_snapshot_delta(spark, sf_dir):
    store = _stored(spark, sf_dir, True)
    return spark.read.parquet(f"{store.root}/{store.chain()[-1]['path']}/cells").select("record_id", "col_name").distinct()


@register
def wal_replay_state(spark, sf_dir):
    return _stored(spark, sf_dir, False).replica().cells.select(*CELL_COLS)


@register
def tiered_read(spark, sf_dir):
    first, second = _split(w.events_log(spark, sf_dir))
    store = Store.open(spark, scratch(spark, "store"), 9, NO_SNAPSHOTS)
    store.merge(first)
    store.snapshot()
    store.merge(second)
    return store.get_record("7").select(*STATE)


@register
def store_changes_since(spark, sf_dir):
    """By versions of the store's own clock: what the second half of all changes has left."""
    store = _stored(spark, sf_dir, True)
    return store.changes_since(store.clock // 2).drop("seq", "flags")


@register
def store_outbox(spark, sf_dir):
    """What is to be sent on after two merges."""
    store = Store.open(spark, scratch(spark, "store"), 9, Config(snapshot_changes=1 << 62, snapshot_seconds=float("inf"), batch_limit=1 << 62))
    for part in _split(w.events_log(spark, sf_dir)):
        store.merge(part)
    return store.take_batch().select("seq", "record_id", "op", "col_name", "value", "db_version", "node_id", "local_db_version")


@register
def store_segments(spark, sf_dir):
    """Changes of each segment of the log, as hooks see them, and whether the segment is closed."""
    store = Store.open(spark, scratch(spark, "store"), 9, Config(snapshot_changes=1, snapshot_seconds=float("inf")))
    seen: list = []
    store.after_change.append(lambda c: seen.append(c.count()))
    for part in _split(w.events_log(spark, sf_dir)):
        store.merge(part)
    closed = {s["segment"] for s in store.manifest["sealed"]}
    return spark.createDataFrame([(k, n, k in closed) for k, n in enumerate(seen)], "segment long, n long, closed boolean")


@register
def store_automatic_snapshots(spark, sf_dir):
    """Snapshots that come by themselves, full and incremental in turn, with the cells that each holds."""
    store = Store.open(spark, scratch(spark, "store"), 9, Config(snapshot_changes=1, snapshot_seconds=float("inf"), full_every=1))
    log = w.events_log(spark, sf_dir)
    for node in (1, 2, 3):
        store.merge(log.filter(F.col("node_id") == node))
    return spark.createDataFrame([(k, s["base"] is None, s["cells"]) for k, s in enumerate(store.manifest["snapshots"])], "place long, whole boolean, cells long")


@register
def store_counts(spark, sf_dir):
    first, second = _split(w.events_log(spark, sf_dir))
    store = Store.open(spark, scratch(spark, "store"), 9, NO_SNAPSHOTS)
    store.merge(first)
    store.snapshot()
    store.merge(second)
    return store.counts()


@register
def store_cleaned_state(spark, sf_dir):
    """The state after old snapshots and segments are gone, opened again."""
    store = _stored(spark, sf_dir, True)
    store.snapshot(full=True)
    store.cleanup_snapshots(1)
    store.cleanup_segments()
    return Store.open(spark, store.root, 9, NO_SNAPSHOTS).replica().cells.select(*CELL_COLS)


@register
def store_compacted_tombstones(spark, sf_dir):
    """Tombstones that are left after those before version 1,500 have been dropped for good."""
    store = _stored(spark, sf_dir, True)
    store.compact_tombstones(1500)
    return Store.open(spark, store.root, 9, NO_SNAPSHOTS).replica().tombstones.select(*TOMBSTONE_COLS)


@register
def store_read_by_key(spark, sf_dir):
    """Whether records are there, deleted or unknown, by point reads."""
    store = _stored(spark, sf_dir, True)
    return spark.createDataFrame([(k, store.contains(k), store.is_tombstoned(k)) for k in ("7", "11", "none")], "record_id string, there boolean, deleted boolean")


@register
def older_schema(spark, sf_dir):
    """A state written without local versions and with a column more."""
    path = scratch(spark, "codec")
    state = _merged(spark, sf_dir).replica
    state.cells.drop("local_db_version").withColumn("extra", F.lit(1)).write.parquet(f"{path}/cells")
    state.tombstones.write.parquet(f"{path}/tombstones")
    return codec.read(spark, path, 9).cells.select(*CELL_COLS)


@register
def digest_leaves(spark, sf_dir):
    return digest.leaves(_merged(spark, sf_dir).replica)


@register
def digest_proof(spark, sf_dir):
    """Whether a record's proof leads to the root, and whether it does with another leaf."""
    state = overlay.written(_merged(spark, sf_dir).replica)
    first = query.live_cells(state).agg(F.min("record_id")).first()[0]
    root, proof = digest.root(state).first().root, digest.prove(state, first)
    return spark.createDataFrame([(first, root, digest.verify(root, proof), digest.verify(root, proof | {"leaf": "0" * 64}))], "record_id string, root string, holds boolean, forged boolean")


@register
def json_round_trip(spark, sf_dir):
    return codec.from_json(codec.to_json(_merged(spark, sf_dir).replica)).cells.select(*STATE)


@register
def parquet_round_trip(spark, sf_dir):
    path = scratch(spark, "codec")
    codec.write(_merged(spark, sf_dir).replica, path)
    return codec.read(spark, path, 9).cells.select(*STATE)


@register
def stream_merge_state(spark, sf_dir):
    root = scratch(spark, "stream")
    for k, part in enumerate(_split(w.events_log(spark, sf_dir))):
        part.write.mode("append").parquet(f"{root}/in/{k}")
    store = Store.open(spark, f"{root}/store", 9, NO_SNAPSHOTS)
    stream = apply_stream(read_changes(spark, f"{root}/in/*", 1), store, f"{root}/checkpoint")
    stream.awaitTermination()
    return store.replica().cells.select(*STATE)


@register
def state_digest(spark, sf_dir):
    return digest.root(_merged(spark, sf_dir).replica)
