import warnings

import pytest
from helpers import cells_of, changes, del_record, put, rows_of, tombs_of
from pyspark.sql import functions as F

from tidemark.errors import ConflictError, CorruptStoreError, LimitError, NoParentError
from tidemark.model import CHANGES_DDL, new
from tidemark.operators import digest, merge, mutate
from tidemark.sources import codec
from tidemark.sources.store import Config, Store
from tidemark.streaming.apply import apply_stream, read_changes

MANUAL = Config(snapshot_changes=1 << 60, snapshot_seconds=float("inf"))


def _ops(spark, *rows):
    return spark.createDataFrame([(k, k, *r, 0) for k, r in enumerate(rows, 1)], mutate.OPS_DDL)


def test_store_life(spark, tmp_path):
    seen = {"ops": 0, "snapshots": [], "sealed": []}
    store = Store.open(spark, str(tmp_path / "s"), 1, MANUAL)
    store.after_change.append(lambda c: seen.update(ops=seen["ops"] + c.count()))
    store.after_snapshot.append(lambda path, version: seen["snapshots"].append(version))
    store.after_seal.append(lambda path: seen["sealed"].append(path))
    store.apply_ops(_ops(spark, ("put", "a", "x", "1"), ("put", "b", "x", "2"), ("del_record", "b", None, None)))
    store.apply_ops(_ops(spark, ("put", "a", "x", "3"), ("put", "a", "y", "4"), ("del_field", "a", "y", None)))
    before = cells_of(store.replica()), tombs_of(store.replica()), store.clock
    assert before[0]["a", "x"][:3] == ("3", True, 2) and before[0]["a", "y"][:2] == (None, False) and set(before[1]) == {"b"}

    def same(s):
        return (cells_of(s.replica()), tombs_of(s.replica()), s.clock) == before

    assert same(Store.open(spark, store.root, 1, MANUAL))  # from the log alone
    store.snapshot()
    assert same(Store.open(spark, store.root, 1, MANUAL))
    assert store.snapshot() is None  # nothing new
    store.apply_ops(_ops(spark, ("put", "c", "x", "5")))
    store.snapshot()
    store.merge(changes(spark, [put(1, "a", "x", "far", cv=9, db=50, node=7), put(2, "b", "x", "zombie", cv=9, db=51, node=7)]))
    state = cells_of(Store.open(spark, store.root, 1, MANUAL).replica())
    assert state["a", "x"][0] == "far" and ("b", "x") not in state and store.clock == 52
    assert [s["base"] is None for s in store.chain()] == [True, False]
    assert seen["ops"] == 8 and len(seen["snapshots"]) == 2 and seen["sealed"]
    assert cells_of(Store.open(spark, store.root, 1, MANUAL).replica()) == state
    assert store.get_record("a").filter("col_name = 'x'").first().value == "far"
    assert store.contains("a") and not store.contains("b") and store.is_tombstoned("b")
    hot, cold, total = store.counts().first()
    assert (hot, cold, total) == (1, 2, 2)
    assert {r.record_id for r in store.changes_since(before[2]).collect()} == {"a", "c"}
    # clean-up
    store.mark_uploaded(store.chain()[0]["path"])
    assert store.cleanup_segments(0) == 2 and cells_of(store.replica()) == state
    store.snapshot(full=True)
    assert store.cleanup_snapshots(1) == 2 and cells_of(store.replica()) == state
    assert store.compact_tombstones(1 << 40) == 1 and tombs_of(Store.open(spark, store.root, 1, MANUAL).replica()) == {}
    assert cells_of(Store.open(spark, store.root, 5, MANUAL).replica()) == state and Store.open(spark, store.root, 5, MANUAL).node_id == 5
    store.apply_ops(_ops(spark, ("put", "d", "x", "1")))
    assert ("d", "x") in cells_of(Store.open(spark, store.root, 1, MANUAL).replica())


def test_replay_keeps_what_a_custom_rule_decided(spark, tmp_path):
    store = Store.open(spark, str(tmp_path / "s"), 1, MANUAL)
    largest = merge.Rule(order_key=lambda: [F.col("value").cast("long")])
    store.merge(changes(spark, [put(1, "a", "x", "5", cv=9), put(2, "a", "x", "7", cv=1)]), largest)
    assert cells_of(Store.open(spark, store.root, 1).replica())["a", "x"][0] == "7"


def test_automatic_snapshots_and_outbox(spark, tmp_path):
    store = Store.open(spark, str(tmp_path / "s"), 1, Config(snapshot_changes=2, snapshot_seconds=float("inf"), batch_limit=3, batch_overflow="newest_half"))
    store.apply_ops(_ops(spark, ("put", "a", "x", "1")))
    assert not store.chain()
    store.apply_ops(_ops(spark, ("put", "a", "x", "2")))
    assert len(store.chain()) == 1
    assert store.peek_batch().count() == 2 and store.take_batch().count() == 2 and store.take_batch().isEmpty()
    for k in range(4):
        store.apply_ops(_ops(spark, ("put", "a", "x", f"n{k}")))
    assert [r.value for r in store.take_batch().collect()] == ["n3"]


def test_damage(spark, tmp_path):
    store = Store.open(spark, str(tmp_path / "s"), 1, MANUAL)
    for k in range(3):
        store.apply_ops(_ops(spark, ("put", f"r{k}", "x", "1")))
        store.snapshot()
    middle = store.chain()[1]
    store.manifest["snapshots"].remove(middle)
    store._publish()
    with warnings.catch_warnings(record=True) as found:
        warnings.simplefilter("always")
        Store.open(spark, store.root, 1).replica()
    assert any("missing" in str(w.message) for w in found)
    store.files.delete(store.chain()[0]["path"])
    with pytest.raises(CorruptStoreError):
        Store.open(spark, store.root, 1)


def test_incremental_snapshots_are_small(spark, tmp_path):
    store = Store.open(spark, str(tmp_path / "s"), 1, MANUAL)
    store.merge(changes(spark, [put(k, f"r{k // 5}", f"c{k % 5}", f"value {k * 7919}", db=k + 1) for k in range(10000)]))
    store.snapshot()
    store.apply_ops(_ops(spark, *[("put", f"r{k}", "c0", "new") for k in range(5)]))
    store.snapshot()
    full, part = store.chain()
    assert store.files.size(part["path"]) < store.files.size(full["path"]) / 5


def test_codecs(spark, tmp_path):
    state = merge.merge(new(spark, 3), changes(spark, [put(1, "a", "x", None), put(2, "a", "y", '"q"'), del_record(3, "b")])).replica
    back = codec.from_json(codec.to_json(state))
    assert cells_of(back) == cells_of(state) and tombs_of(back) == tombs_of(state) and back.clock == state.clock and back.node_id == 3
    codec.write(state, str(tmp_path / "p"))
    assert cells_of(codec.read(spark, str(tmp_path / "p"), 3)) == cells_of(state)
    old = state.cells.drop("local_db_version").withColumn("extra", F.lit(1))
    old.write.mode("overwrite").parquet(str(tmp_path / "p/cells"))
    assert codec.read(spark, str(tmp_path / "p"), 3).cells.filter("local_db_version is null").count() == 2


def test_stream_is_applied_once(spark, tmp_path):
    for k, rows in enumerate([[put(1, "a", "x", "1", cv=2)], [put(2, "a", "x", "late", cv=1), put(3, "b", "x", "2")]]):
        spark.createDataFrame(rows, CHANGES_DDL).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    store = Store.open(spark, str(tmp_path / "s"), 1, MANUAL)
    for _ in range(2):  # the second run finds nothing new
        apply_stream(read_changes(spark, str(tmp_path / "in/*"), 1), store, str(tmp_path / "cp")).awaitTermination()
    assert {k: v[0] for k, v in cells_of(store.replica()).items()} == {("a", "x"): "1", ("b", "x"): "2"}
    clock = store.clock
    store.merge(changes(spark, [put(9, "z", "x", "again")]), batch_id=0)
    assert store.clock == clock and not store.contains("z")


def test_digest_and_proof(spark):
    rows = [put(k, f"r{k}", "x", str(k)) for k in range(40)]
    a = merge.merge(new(spark, 1), changes(spark, rows)).replica
    b = merge.merge(new(spark, 2), changes(spark, [(100 - r[0], *r[1:]) for r in rows])).replica
    assert digest.depth_for(a) == 2 and digest.root(a).first() == digest.root(a, 2).first()
    root = digest.root(a, 2).first().root
    assert root == digest.root(b, 2).first().root
    proof = digest.prove(a, "r7", 2)
    assert digest.verify(root, proof) and not digest.verify(root, proof | {"leaf": "0" * 64}) and digest.prove(a, "nope", 2) is None
    c = merge.merge(a, changes(spark, [put(1, "r7", "x", "changed", cv=9)])).replica
    assert digest.root(c, 2).first().root != root
    assert digest.with_root(changes(spark, rows[:1]), a, 2).first().root == root


def test_the_digest_gets_deeper_with_the_records(spark, monkeypatch):
    monkeypatch.setattr(digest, "LEAVES", 2)
    a = merge.merge(new(spark, 1), changes(spark, [put(k, f"r{k}", "x", str(k)) for k in range(1500)])).replica
    assert digest.depth_for(a) == 3
    root, proof = digest.root(a).first().root, digest.prove(a, "r7")
    assert digest.verify(root, proof) and len(proof["nodes"]) == 3 and len(proof["leaves"]) < 10
    assert digest.levels(a)[0].count() > 256


class Dies(Exception):
    pass


@pytest.mark.parametrize("step", range(6))
def test_a_writer_that_dies_loses_nothing(spark, tmp_path, monkeypatch, step):
    """Dies before the step-th thing that it does to the files of the manifest."""
    store = Store.open(spark, str(tmp_path / "s"), 1, MANUAL)
    for k in range(4):
        store.apply_ops(_ops(spark, ("put", "a", f"x{k}", "1")))
    before = cells_of(store.replica())
    left, files = [step], store.files

    class Fragile:
        def __getattr__(self, name):
            real = getattr(files.fs, name)
            if name not in ("create", "rename", "delete", "exists"):
                return real

            def call(*args):
                if "manifest" in str(args[0]):
                    if not left[0]:
                        raise Dies
                    left[0] -= 1
                return real(*args)

            return call

    store.files = type(files)(spark, store.root)
    store.files.fs = Fragile()
    try:
        store.apply_ops(_ops(spark, ("put", "a", "x", "new")))
        died = False
    except Dies:
        died = True
    again = Store.open(spark, store.root, 1, MANUAL)
    after = cells_of(again.replica())
    assert after == before or set(after) - set(before) == {("a", "x")} and {k: after[k] for k in before} == before
    assert died or ("a", "x") in after
    again.apply_ops(_ops(spark, ("put", "b", "x", "2")))
    assert ("b", "x") in cells_of(Store.open(spark, store.root, 1, MANUAL).replica())


def test_manifests_are_never_replaced(spark, tmp_path):
    one = Store.open(spark, str(tmp_path / "s"), 1, MANUAL)
    two = Store.open(spark, str(tmp_path / "s"), 1, MANUAL)
    one.apply_ops(_ops(spark, ("put", "a", "x", "1")))
    with pytest.raises(ConflictError):
        two.apply_ops(_ops(spark, ("put", "a", "x", "2")))
    for _ in range(4):
        one.mark_uploaded("nothing")
    assert len([n for n in one.files.list("") if n.startswith("manifest")]) == 3
    for name in [n for n in one.files.list("") if n.startswith("manifest")]:
        one.files.delete(name)
    with pytest.raises(CorruptStoreError, match="no manifest"):
        Store.open(spark, one.root, 1)


def test_reads_by_version_reach_the_scans(spark, tmp_path):
    store = Store.open(spark, str(tmp_path / "s"), 1, MANUAL)
    marks = []
    for k in range(3):
        store.apply_ops(_ops(spark, ("put", "a", f"c{k}", "1"), ("put", f"r{k}", "x", "1"), ("put", f"d{k}", "x", "1"), ("del_record", f"d{k}", None, None)))
        marks.append(store.clock)
        if k < 2:
            store.snapshot()
    for since in (0, *marks):
        got = store.changes_since(since)
        want = merge.compress(_since(store, since))
        assert rows_of(got.drop("seq")) == rows_of(want.drop("seq"))
        plan = got._jdf.queryExecution().executedPlan().toString()
        scans = [line for line in plan.splitlines() if "FileScan" in line and "local_db_version" in line]
        assert all("GreaterThan(local_db_version" in line for line in scans), plan
        assert "snapshots/full" not in plan or since < marks[0]
    assert store.changes_since(marks[2]).isEmpty()


def _since(store, since):
    from tidemark.operators import query

    return query.changes_since(store.replica(), since)


def test_versions_near_the_greatest_are_stored(spark, tmp_path):
    top = (1 << 63) - 101
    store = Store.open(spark, str(tmp_path / "s"), 1, MANUAL)
    store.merge(changes(spark, [put(1, "x", "f", "initial", db=top), put(2, "y", "f", "2", db=3)]))
    store.apply_ops(_ops(spark, ("put", "x", "g", "value")))
    for _ in range(2):
        again = Store.open(spark, store.root, 1, MANUAL)
        assert {k: v[0] for k, v in cells_of(again.replica()).items()} == {("x", "f"): "initial", ("x", "g"): "value", ("y", "f"): "2"}
        assert again.clock > top and again.changes_since(top).count() >= 1
        store.snapshot()


def test_checks_limits_layouts_and_errors(spark, tmp_path):
    orc = Config(snapshot_changes=1 << 60, snapshot_seconds=float("inf"), format="orc", sort_by="local_db_version")
    store = Store.open(spark, str(tmp_path / "s"), 1, orc)
    store.apply_ops(_ops(spark, ("put", "a", "x", "1"), ("put", "b", "x", "2"), ("del_record", "b", None, None)))
    store.snapshot()
    again = Store.open(spark, store.root, 1, MANUAL)  # goes on in Parquet
    again.apply_ops(_ops(spark, ("put", "c", "x", "3"), ("del_record", "d", None, None)))
    again.check()
    assert set(cells_of(again.replica())) == {("a", "x"), ("c", "x")} and set(tombs_of(again.replica())) == {"b", "d"}
    again.config = Config(most_tombstones=1)
    with pytest.raises(LimitError):
        again.snapshot(full=True)
    again.config = MANUAL
    again.snapshot()
    again.check()
    again.manifest["snapshots"][0]["cells"] += 1
    with pytest.raises(CorruptStoreError, match="instead of"):
        again.check()
    with pytest.raises(NoParentError):
        again.revert()


def test_superseded_incremental_snapshots_go(spark, tmp_path):
    store = Store.open(spark, str(tmp_path / "s"), 1, MANUAL)
    for full in (True, False, True, False):
        store.apply_ops(_ops(spark, ("put", "a", "x", str(full)), ("put", "b", "y", "1")))
        store.snapshot(full=full)
    assert store.cleanup_snapshots(2) == 1  # the first incremental one; both full ones are kept
    assert [s["base"] is None for s in store.manifest["snapshots"]] == [True, True, False]
    assert cells_of(Store.open(spark, store.root, 1, MANUAL).replica())["a", "x"][0] == "False"
