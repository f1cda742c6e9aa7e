import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.functions import positions, words
from tidemark.operators import sequence, text


def test_position_vectors():
    assert positions.after([10000]) == [20000]
    assert positions.before([10000]) == [9990]
    assert positions.between([1000], [3000]) == [2000]
    assert positions.between([1000], [1001]) == [1000, 10000]
    assert positions.between([1000], [1000, 5000]) == [1000, 2500]
    assert positions.between([1000, 5], [1001]) == [1000, 10005]
    with pytest.raises(ValueError):
        positions.between([2], [1])


def test_there_is_always_room():
    p = [10000]
    for _ in range(3000):  # prepending never runs out, and never leaves its place
        q = positions.before(p)
        assert q < p
        p = q
    low, high = [5], [6]
    for _ in range(200):
        mid = positions.between(low, high)
        assert low < mid < high
        high = mid


@settings(max_examples=200, deadline=None)
@given(st.lists(st.booleans(), max_size=40), st.integers(1, 9))
def test_between_is_between(turns, n):
    low, high = [10000], [10001]
    for left in turns:
        mid = positions.between(low, high)
        assert low < mid < high
        low, high = (low, mid) if left else (mid, high)
    many = positions.spread(low, high, n)
    assert many == sorted(many) and len(set(map(tuple, many))) == n and low < many[0] and many[-1] < high


def test_word_merge():
    base = "the quick brown fox jumps"
    assert words.merge_words(base, "the slow brown fox jumps", "the quick brown fox leaps") == "the slow brown fox leaps"
    assert words.merge_words(base, "the slow brown fox", "the fast brown fox") is None
    edits = words.diff_words(base.split(), "the brown red fox jumps".split())
    assert words.apply_edits(base.split(), edits) == "the brown red fox jumps".split()


def _loaded(spark, content="one\ntwo\nthree"):
    return text.load(spark.createDataFrame([("d", content)], "doc_id string, text string"), 1)


def _changes(spark, rows):
    """Changes; a base content may come last."""
    return spark.createDataFrame([r if len(r) == 11 else (*r, None) for r in rows], text.CHANGES_DDL)


def _text(state):
    return {r.doc_id: r.text for r in text.to_text(state).collect()}["d"]


def test_edit_insert_delete(spark):
    state = _loaded(spark)
    ins = spark.createDataFrame([(1, "d", "after", "1_1_0", "A"), (2, "d", "after", "1_1_0", "B"), (3, "d", "end", None, "E"), (4, "d", "end", None, "F"), (5, "d", "start", None, "S"), (6, "d", "before", "1_1_2", "C"), (7, "d", "after", "gone", "G")], "seq long, doc_id string, where string, anchor string, content string")
    state, out = text.insert_lines(state, ins)
    assert _text(state) == "S\none\nB\nA\ntwo\nC\nthree\nE\nF\nG" and out.count() == 7 and state.clock == 8
    edits = spark.createDataFrame([(1, "d", "1_1_0", "ONE"), (2, "d", "1_1_0", "One!"), (3, "d", "nope", "x")], "seq long, doc_id string, line_id string, content string")
    state, out = text.edit_lines(state, edits)
    assert [r.line_version for r in out.orderBy("seq").collect()] == [2, 3]
    assert text.line(state, "d", "1_1_0").first().base_content == "one"
    deletes = spark.createDataFrame([(1, "d", "1_1_1"), (2, "d", "1_1_1"), (3, "d", "nope")], "seq long, doc_id string, line_id string")
    state, out = text.delete_lines(state, deletes)
    assert out.count() == 1 and text.line_counts(state).first().lines == 9


def test_merge_rules(spark):
    state = _loaded(spark, "Original")
    rows = [(k, "d", "Edit", "1_1_0", None, f"by {k}", 2, 2, k, 2) for k in (2, 3, 4, 5)]
    orders = [rows, [(10 - r[0], *r[1:]) for r in rows]]
    for some in orders:
        assert _text(text.merge(state, _changes(spark, some))) == "by 5"
        both = text.merge(state, _changes(spark, some), text.BOTH_WRITES)
        again = text.merge(both, _changes(spark, some), text.BOTH_WRITES)
        for s in (both, again):
            assert [r.content for r in text.all_versions(s).orderBy("at").collect()] == ["by 5", "by 2", "by 3", "by 4"]


def _lines(state):
    """What must be the same on all replicas."""
    keep = ["line_id", "content", "line_version", "db_version", "node_id", "conflicts", "merged_from"]
    return sorted(repr([r[c] for c in keep]) for r in state.lines.collect())


def test_auto_merge_converges(spark):
    """Three writers edit at once, one of them only reads; every replica ends with the same, in every order."""
    state = _loaded(spark, "one two three four\nplain")
    edits = {2: "ONE two three four", 3: "one two three FOUR", 4: "one TWO three four"}
    one = "seq long, doc_id string, line_id string, content string"
    made = {n: text.edit_lines(state.with_(node_id=n), spark.createDataFrame([(n, "d", "1_1_0", c)], one)) for n, c in edits.items()}
    changes = {n: spark.createDataFrame(m[1].collect(), text.CHANGES_DDL) for n, m in made.items()}
    ends = []
    for start, order in ((state, (2, 3, 4)), (made[2][0], (3, 4)), (made[4][0], (2, 3))):
        for n in order:
            start = text.merge(start, changes[n], text.AUTO_MERGE)
            start = start.with_(lines=spark.createDataFrame(start.lines.collect(), text.LINES_DDL))
        ends.append(start)
    assert {_text(e) for e in ends} == {"ONE TWO three FOUR\nplain"}
    assert len({str(_lines(e)) for e in ends}) == 1
    # What a replica has merged goes on as the writes that it holds.
    two = text.merge(made[2][0], changes[3], text.AUTO_MERGE)
    sent = [(k, *r[1:]) for k, r in enumerate(text.changes_since(two, 1).collect())] + [tuple(r) for r in changes[4].collect()]
    assert len(sent) == 3 and _text(text.merge(state, _changes(spark, sent), text.AUTO_MERGE)) == "ONE TWO three FOUR\nplain"
    # An edit of the merged line is the next version, of the merged content.
    _, later = text.edit_lines(ends[0].with_(node_id=5), spark.createDataFrame([(1, "d", "1_1_0", "all new")], one))
    assert later.first().base_content == "ONE TWO three FOUR" and later.first().line_version == 3


def test_overlapping_edits_are_all_kept_everywhere(spark):
    state = _loaded(spark, "one two")
    rows = [(k, "d", "Edit", "1_1_0", None, f"one {k}", 2, 2, k, 2, "one two") for k in (2, 3)] + [(9, "d", "Edit", "1_1_0", None, "zero one two", 2, 2, 9, 2, "one two")]
    ends = [text.merge(text.merge(state, _changes(spark, rows[:k]), text.AUTO_MERGE), _changes(spark, rows[::-1]), text.AUTO_MERGE) for k in (1, 2)]
    ends.append(text.merge(state, _changes(spark, rows), text.AUTO_MERGE))
    assert len({str(_lines(e)) for e in ends}) == 1
    assert [r.content for r in text.all_versions(ends[0]).orderBy("at").collect()] == ["zero one two", "one 2", "one 3"]
    unknown = [(k, "d", "Edit", "1_1_0", None, f"{k} one two", 2, 2, k, 2) for k in (2, 3)]
    assert len(text.merge(state, _changes(spark, unknown), text.AUTO_MERGE).lines.first().conflicts) == 1


def test_tombstone_reads_and_rebalancing(spark):
    state = _loaded(spark)
    state, _ = text.delete_lines(state, spark.createDataFrame([(1, "d", "1_1_1")], "seq long, doc_id string, line_id string"))
    assert text.tombstone(state, "d", "1_1_1").count() == 1 and text.tombstone(state, "d", "1_1_0").isEmpty()
    ids = spark.createDataFrame([("d", "1_1_0"), ("d", "1_1_1"), ("e", "1_1_1")], "doc_id string, line_id string")
    assert {(r.doc_id, r.line_id): r.tombstoned for r in text.are_tombstoned(state, ids).collect()} == {("d", "1_1_0"): False, ("d", "1_1_1"): True, ("e", "1_1_1"): False}
    ins = "seq long, doc_id string, where string, anchor string, content string"
    for k in range(2):
        state, _ = text.insert_lines(state, spark.createDataFrame([(k, "d", "after", "1_1_0", f"n{k}")], ins))
        state = state.with_(lines=spark.createDataFrame(state.lines.collect(), text.LINES_DDL))
    even = text.rebalanced(state)
    assert _text(even) == _text(state) and {tuple(r.position) for r in even.lines.collect()} == {(10000 * (k + 1),) for k in range(4)}
    text.show(even)


def test_text_versions_near_the_greatest(spark):
    top = (1 << 63) - 101
    state = _loaded(spark)
    far = text.merge(state, _changes(spark, [(1, "d", "Edit", "1_1_0", None, "far", 2, top, 2, top), (2, "d", "Insert", "n", [15000], "new", 1, top, 2, top)]))
    there, mark = text.sync(far, state, 0)
    assert _text(there) == _text(far) == "far\nnew\ntwo\nthree" and mark == top
    assert there.clock > top


def test_delete_beats_edit_and_deletes_keep_the_greatest(spark):
    state = _loaded(spark)
    rows = [(1, "d", "Delete", "1_1_0", None, None, 1, 2, 2, 2), (2, "d", "Edit", "1_1_0", None, "x", 9, 9, 3, 9), (3, "d", "Delete", "1_1_0", None, None, 1, 5, 3, 5), (4, "d", "Insert", "new", None, "no place", 1, 1, 2, 1), (5, "d", "Insert", "n2", [15000], "in", 1, 1, 2, 1), (6, "d", "Insert", "n2", [1], "in2", 2, 1, 2, 1)]
    after = text.merge(state, _changes(spark, rows))
    assert _text(after) == "in2\ntwo\nthree"
    assert after.tombstones.first().db_version == 5
    since = {(r.type, r.line_id) for r in text.changes_since(after, 1).collect()}
    assert since == {("Delete", "1_1_0")}


def test_sync_converges(spark):
    a = _loaded(spark)
    b, last = text.sync(a, text.new(spark, 2), 0)
    assert _text(a) == _text(b) and last == a.clock


def test_lines_at_one_place_have_one_order(spark):
    a = [(1, "d", "Insert", "x", [500], "X", 1, 1, 2, 1), (2, "d", "Insert", "y", [500], "Y", 1, 1, 3, 1)]
    b = [(2, *a[0][1:]), (1, *a[1][1:])]
    assert _text(text.merge(text.new(spark, 1), _changes(spark, a))) == _text(text.merge(text.new(spark, 1), _changes(spark, b))) == "X\nY"


def _elements(spark, rows):
    return spark.createDataFrame(rows, sequence.ELEMENTS_DDL)


def _values(elements):
    return [r.value for r in elements.filter("not deleted").orderBy(*sequence.order()).collect()]


def test_lists(spark):
    e = lambda rep, s, v, ol=(None, None), orr=(None, None), deleted=False: ("l", rep, s, v, deleted, *ol, *orr, 1, s, rep, s)
    a = _elements(spark, [e(1, 1, "Hello"), e(1, 2, "World", (1, 1))])
    b = _elements(spark, [e(2, 1, "Goodbye"), e(2, 2, "Cruel", (1, 2))])
    ab, ba = sequence.merge(a, b), sequence.merge(b, a)
    assert _values(ab) == _values(ba) == ["Hello", "Goodbye", "World", "Cruel"]
    assert _values(sequence.merge(ab, ab)) == _values(ab)
    gone = sequence.delete(ab, spark.createDataFrame([("l", 0), ("l", 99)], "list_id string, index long"), 1, 9)
    after = sequence.merge(ab, gone)
    assert _values(after) == ["Goodbye", "World", "Cruel"] and _values(sequence.merge(gone, ab)) == _values(after)
    assert sequence.collect_garbage(after).count() == 3
    assert sequence.delta(ab, a).count() == 2
    assert _values(sequence.apply_delta(a, sequence.delta(ab, a), gone)) == _values(after)
    new = sequence.insert(after, spark.createDataFrame([("l", 99, "!")], "list_id string, index int, value string"), 1, 10)
    row = new.first()
    assert (row.sequence, row.ol_seq, row.ol_rep, row.or_seq) == (3, 2, 2, None)
    assert {r["values"][0] for r in sequence.values(after).collect()} == {"Goodbye"}
    x, y, last = sequence.sync(a, b, 0)
    assert _values(x) == _values(y) and last == 2


@pytest.mark.parametrize("seed", range(2))
def test_list_merge_commutes(spark, seed):
    rng = random.Random(seed)
    rows = [("l", rng.randrange(1, 4), s, f"v{s}", False, rng.choice([None, 1, 2]), None, None, None, 1, s, 1, s) for s in range(1, 12)]
    a, b = _elements(spark, rng.sample(rows, 8)), _elements(spark, rng.sample(rows, 8))
    assert _values(sequence.merge(a, b)) == _values(sequence.merge(b, a))
