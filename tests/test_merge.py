import random

import pytest
from helpers import Model, cells_of, changes, del_field, del_record, put, random_changes, random_ops, rows_of, tombs_of
from pyspark.sql import functions as F

from tidemark.model import new
from tidemark.operators import clock, merge, mutate, overlay, query


@pytest.mark.parametrize("seed", range(2))
def test_merge_is_the_sequential_fold(spark, seed):
    rng = random.Random(seed)
    model, state = Model(), new(spark, 9)
    for k in range(2):
        rows = random_changes(rng, 60, 1 + 100 * k)
        accepted = model.merge(rows)
        shuffled = rows[:]
        rng.shuffle(shuffled)
        merged = merge.merge(state, changes(spark, shuffled), parts=3)
        assert rows_of(merged.accepted) == sorted(accepted, key=repr)
        state = merged.replica
        state = state.with_(cells=spark.createDataFrame(state.cells.collect(), state.cells.schema), tombstones=spark.createDataFrame(state.tombstones.collect(), state.tombstones.schema), clock_source=state.clock)
        assert cells_of(state) == model.cells
        assert tombs_of(state) == model.tombs
        assert state.clock == model.clock


@pytest.mark.parametrize("seed", range(2))
def test_local_batches_are_the_sequential_fold(spark, seed):
    rng = random.Random(100 + seed)
    model = Model(4)
    start = random_changes(rng, 25)
    model.merge(start)
    state = merge.merge(new(spark, 4), changes(spark, start)).replica
    ops = random_ops(rng, 60)
    expected = model.apply(ops)
    after, out = mutate.apply_ops(state, spark.createDataFrame(ops, mutate.OPS_DDL), parts=3)
    assert rows_of(out) == sorted(expected, key=repr)
    assert cells_of(after) == model.cells
    assert tombs_of(after) == model.tombs
    assert after.clock == model.clock


def test_clock_vector(spark):
    log = changes(spark, [put(i, f"r{i}", "c", "v", db=1) for i in range(1, 6)])
    got = [r.local_db_version for r in clock.stamp(log, 1, parts=3).orderBy("seq").collect()]
    assert got == [2, 3, 4, 5, 6]


def test_empty_batch_leaves_everything(spark):
    state = merge.merge(new(spark, 1), changes(spark, [put(1, "a", "c", "v")])).replica
    again = merge.merge(state, changes(spark, []))
    assert cells_of(again.replica) == cells_of(state) and again.replica.clock == state.clock and again.accepted.isEmpty()


def test_tie_goes_to_the_higher_node_in_either_order(spark):
    a, b = put(1, "x", "tag", "one", node=1), put(2, "x", "tag", "two", node=2)
    for rows in ([a, b], [(9, *a[1:]), b]):
        assert cells_of(merge.merge(new(spark, 3), changes(spark, rows)).replica)["x", "tag"][0] == "two"


def test_delete_beats_newer_updates_and_blocks_reinsertion(spark):
    rows = [put(1, "x", "a", "1"), del_record(2, "x"), put(3, "x", "a", "2", cv=9, db=9), del_record(4, "x", db=50)]
    merged = merge.merge(new(spark, 3), changes(spark, rows))
    assert cells_of(merged.replica) == {}
    assert tombs_of(merged.replica)["x"][0] == 1  # the first delete to come
    assert [r.seq for r in merged.accepted.orderBy("seq").collect()] == [1, 2]


def test_merging_again_accepts_nothing_but_moves_the_clock(spark):
    log = changes(spark, [put(1, "x", "a", "1"), put(2, "x", "b", "1")])
    one = merge.merge(new(spark, 3), log).replica
    two = merge.merge(one, log)
    assert two.accepted.isEmpty() and two.replica.clock == one.clock + 2


def test_null_value_is_not_an_absent_field(spark):
    rows = [put(1, "x", "a", None), put(2, "x", "b", "1"), del_field(3, "x", "b")]
    got = cells_of(merge.merge(new(spark, 3), changes(spark, rows)).replica)
    assert got["x", "a"][:2] == (None, True) and got["x", "b"][:2] == (None, False)


def test_large_versions(spark):
    big = 9223372036854775807 - 100
    rows = [put(1, "x", "a", "old", db=big - 1), put(2, "x", "a", "new", db=big)]
    assert cells_of(merge.merge(new(spark, 3), changes(spark, rows)).replica)["x", "a"][0] == "new"


def test_compress(spark):
    rows = [put(1, "r", "c1", "v1"), put(2, "r", "c1", "v2", cv=2), put(3, "r", "c2", "v"), del_field(4, "r", "c2"), put(5, "r", "c3", "v")]
    got = {(r.col_name, r.op): r.col_version for r in merge.compress(changes(spark, rows)).collect()}
    assert got == {("c1", "put"): 2, ("c2", "del_field"): 2, ("c3", "put"): 1}
    rows += [del_record(6, "r", cv=1), del_record(7, "r", cv=3)]
    got = merge.compress(changes(spark, rows)).collect()
    assert [(r.op, r.col_version) for r in got] == [("del_record", 3)]
    assert [r.op for r in merge.in_order(changes(spark, rows)).collect()][:2] == ["del_record", "del_record"]


def test_compaction_of_tombstones_is_strict(spark):
    rows = [del_record(k, f"r{k}", db=k) for k in (4, 5, 6)]
    state = mutate.from_changes(1, changes(spark, rows))
    state, removed = merge.compact_tombstones(state, 5)
    assert removed.first().removed == 1 and set(tombs_of(state)) == {"r5", "r6"}
    state, removed = merge.compact_tombstones(state, 10)
    assert removed.first().removed == 2 and tombs_of(state) == {}


def test_rules(spark):
    rows = [put(1, "x", "a", "5", cv=1), put(2, "x", "a", "9", cv=1, node=0), put(3, "x", "a", "7", cv=8)]
    log = changes(spark, rows)
    largest = merge.Rule(order_key=lambda: [F.col("value").cast("long")])
    assert cells_of(merge.merge(new(spark, 1), log, largest).replica)["x", "a"][0] == "9"
    folded = merge.merge(new(spark, 1), log, merge.Rule(predicate=lambda a, b: int(b["value"]) > int(a["value"])))
    assert cells_of(folded.replica)["x", "a"][0] == "9"
    assert [r.seq for r in folded.accepted.orderBy("seq").collect()] == [1, 2]
    trusting = merge.with_context(lambda node: [F.col("node_id") == node], node=0)
    assert cells_of(merge.merge(new(spark, 1), log, trusting).replica)["x", "a"][0] == "9"


def test_sync_converges_and_keeps_the_watermark_without_news(spark):
    a = mutate.from_changes(1, changes(spark, [put(1, "x", "a", "1", db=3), del_record(2, "y", db=4)]))
    b = mutate.from_changes(2, changes(spark, [put(1, "x", "a", "2", db=3, node=2), put(2, "y", "b", "1", db=1, node=2)]))
    to_b, last = merge.sync(a, b, 0)
    assert last == 4
    to_a, _ = merge.sync(to_b.replica, a, 0)
    assert query.converged(to_a.replica, to_b.replica).first().converged
    _, again = merge.sync(a, to_b.replica, last)
    assert again == last


def test_from_changes_reads_the_log_in_order(spark):
    rows = [put(1, "x", "a", "new", cv=9), put(2, "x", "a", "old", cv=1), del_field(3, "x", "a", cv=0), del_record(4, "y", db=2), del_record(5, "y", db=7), put(6, "y", "a", "1", db=8)]
    state = mutate.from_changes(1, changes(spark, rows))
    assert cells_of(state) == {("x", "a"): ("old", True, 0, 2, 1, 2)}
    assert tombs_of(state) == {"y": (7, 1, 7)} and state.clock == 8
    assert cells_of(mutate.reset(state, changes(spark, []))) == {}


def test_overlay(spark):
    parent = mutate.from_changes(1, changes(spark, [put(1, "p", "a", "1"), put(2, "p", "b", "2", db=2), put(3, "q", "a", "3", db=3)]))
    child = new(spark, 2, parent)
    assert child.clock == child.base_version == 3
    ops = [(1, 1, "put", "p", "c", "9", 0), (2, 2, "del_record", "q", None, None, 0), (3, 3, "put", "q", "a", "no", 0)]
    child, out = mutate.apply_ops(child, spark.createDataFrame(ops, mutate.OPS_DDL))
    assert [(r.op, r.db_version) for r in out.orderBy("seq").collect()] == [("put", 4), ("del_record", 5)] and child.clock == 6
    seen = {(r.record_id, r.col_name): r.value for r in overlay.combined(child).collect()}
    assert seen == {("p", "a"): "1", ("p", "b"): "2", ("p", "c"): "9"}
    assert query.get_record(child, "q").isEmpty() and not query.get_record(child, "q", raw=True).isEmpty()
    assert query.tombstone(child, "q").first().db_version == 5 and query.tombstone(child, "p").isEmpty()
    undo = {(r.record_id, r.op, r.col_name): r.value for r in overlay.revert(child).collect()}
    assert undo == {("p", "del_field", "c"): None, ("q", "put", "a"): "3"}
    with pytest.raises(ValueError):
        overlay.revert(parent)


def test_merge_into_a_child_copies_the_record_it_writes_to(spark):
    parent = mutate.from_changes(1, changes(spark, [put(1, "p", "a", "1", cv=5), put(2, "p", "b", "2", cv=5), put(3, "q", "a", "3", cv=5)]))
    child = new(spark, 2, parent)
    rows = [put(1, "p", "a", "stale", cv=1, node=3), put(2, "p", "b", "new", cv=6, node=3), put(3, "q", "a", "stale", cv=1, node=3)]
    merged = merge.merge(child, changes(spark, rows))
    assert {k: v[0] for k, v in cells_of(merged.replica).items()} == {("p", "a"): "1", ("p", "b"): "new"}
    assert [r.seq for r in merged.accepted.collect()] == [2]


def test_diff_of_a_changed_copy(spark):
    base = [put(1, "r", "a", "1", db=1), put(2, "r", "b", "1", db=2)]
    parent = mutate.from_changes(1, changes(spark, base))
    more = [*base, put(3, "r", "c", "1", db=3, node=2), put(4, "r", "d", "1", db=4, node=2), put(5, "r", "a", "2", cv=2, db=5, node=2)]
    child = mutate.from_changes(2, changes(spark, more))
    got = {(r.op, r.col_name): r.value for r in overlay.diff(child, parent).collect()}
    assert got == {("del_field", "c"): None, ("del_field", "d"): None, ("put", "a"): "1"}


def test_reads(spark):
    rows = [put(1, "k1", "tag", "important", db=1), put(2, "k2", "tag", "other", db=2), put(3, "k3", "tag", "important", db=3), put(4, "k1", "n", "1", db=4), del_record(5, "k3", db=5), del_field(6, "k2", "tag", db=6)]
    state = mutate.from_changes(1, changes(spark, rows))
    assert [r.record_id for r in query.query(state, F.col("fields")["tag"] == "important").collect()] == ["k1"]
    assert [r.record_id for r in query.key_range(state, "k1", "k2").collect()] == ["k1"]
    assert [r.record_id for r in query.key_range(state, "k1", "k2", high_inclusive=True).collect()] == ["k1", "k2"]
    assert [r.record_id for r in query.key_range(state, "k1", low_inclusive=False).collect()] == ["k2"]
    assert query.tombstone_count(state).first().tombstones == 1
    assert [tuple(r) for r in query.recently_modified(state, 1).collect()] == [("k2", 6)]
    assert [r.record_id for r in query.modified_since(state, 4).collect()] == ["k2"]
    whole, gone = query.changed_records(state, 3)
    assert {(r.record_id, r.col_name) for r in whole.collect()} == {("k1", "tag"), ("k1", "n"), ("k2", "tag")} and gone.count() == 1
    since = {(r.record_id, r.op) for r in query.changes_since(state, 3).collect()}
    assert since == {("k1", "put"), ("k3", "del_record"), ("k2", "put")}  # a field delete read from a log leaves the value
    assert query.changes_since(state, 0, excluding=[1]).isEmpty()


def test_explode_fields(spark):
    rows = spark.createDataFrame([(1, "r", {"b": "2", "a": "1"}, 0)], "seq long, record_id string, fields map<string,string>, flags int")
    _, out = mutate.apply_ops(new(spark, 1), mutate.explode_fields(rows))
    assert [(r.col_name, r.db_version, r.col_version) for r in out.orderBy("seq").collect()] == [("a", 1, 1), ("b", 1, 1)]


def test_hot_cells_are_reduced_before_the_shuffle(spark):
    log = changes(spark, [put(1, "x", "a", "1")])
    plan = merge.merge(new(spark, 1), log, stamped=False).replica.cells._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan


TOP = (1 << 63) - 101


def test_versions_near_the_greatest(spark):
    a = mutate.from_changes(1, changes(spark, [put(1, "x", "f", "initial", db=TOP), put(2, "y", "f", "other", db=5)]))
    a, out = mutate.apply_ops(a, spark.createDataFrame([(1, 1, "put", "x", "g", "value", 0)], mutate.OPS_DDL))
    assert out.first().db_version == TOP + 1
    merged, last = merge.sync(a, new(spark, 2), 0)
    assert last == TOP + 1 and {k: v[0] for k, v in cells_of(merged.replica).items()} == {("x", "f"): "initial", ("x", "g"): "value", ("y", "f"): "other"}
    assert merged.replica.clock > TOP + 1


@pytest.mark.parametrize("versions", [[7] * 300, list(range(300)), [TOP - k % 3 for k in range(300)], []])
def test_a_delta_is_numbered_in_version_order(spark, versions):
    rows = [put(k, f"r{k}", "c", "v", db=v) for k, v in enumerate(versions)]
    got = merge.numbered(changes(spark, rows).withColumn("seq", F.lit(None).cast("long")), parts=3).orderBy("seq").collect()
    assert [r.seq for r in got] == list(range(1, len(rows) + 1))
    assert [r.local_db_version for r in got] == sorted(versions)
    again = merge.numbered(changes(spark, rows[::-1]).repartition(5), parts=2).orderBy("seq").collect()
    assert [r.record_id for r in again] == [r.record_id for r in got]


def test_rules_meet_deletes(spark):
    rows = [put(1, "x", "a", "5", cv=1), del_field(2, "x", "a", cv=9), put(3, "x", "a", "7", cv=1), put(4, "y", "a", "9"), del_record(5, "y"), put(6, "y", "a", "99")]
    weigh = lambda r: -1 if r["value"] is None else int(r["value"])
    for rule in (merge.Rule(order_key=lambda: [F.coalesce(F.col("value").cast("long"), F.lit(-1))]), merge.Rule(predicate=lambda local, remote: weigh(remote) > weigh(local))):
        merged = merge.merge(new(spark, 1), changes(spark, rows), rule)
        assert {k: v[0] for k, v in cells_of(merged.replica).items()} == {("x", "a"): "7"} and set(tombs_of(merged.replica)) == {"y"}
        assert [r.seq for r in merged.accepted.orderBy("seq").collect()] == [1, 3, 4, 5]


def test_clock_can_be_set():
    assert clock.set_time(4, 9) == 9 and clock.update(4, 9) == 10 and clock.tick(4) == 5
    with pytest.raises(ValueError):
        clock.set_time(9, 4)


def _scans(frame) -> int:
    """Scans of files in the plan that ran, but for those of results that were used again."""
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("FileScan")


def test_written_states_are_read_a_few_times(spark):
    state = mutate.from_changes(1, changes(spark, random_changes(random.Random(1), 50)))
    other = mutate.from_changes(2, changes(spark, random_changes(random.Random(2), 60)))
    after, out = mutate.apply_ops(state, spark.createDataFrame(random_ops(random.Random(3), 40), mutate.OPS_DDL))
    assert _scans(out) <= 1 and _scans(after.cells) <= 4
    assert _scans(overlay.diff(state, other)) <= 8
