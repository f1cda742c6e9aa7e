"""Texts as lines in order of fractional positions, written to by many replicas.

A frame of lines may hold many documents (doc_id). Order within a document is (position, line_id): lines that
two writers put at one position come in the same order everywhere.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import positions, words
from ..model import empty
from ..sources.staging import staged
from . import clock

#: Writes, each with the content that it changed, if that is known.
CONFLICTS = "array<struct<db_version:bigint,node_id:bigint,content:string,base:string>>"
LINES_DDL = f"doc_id string, line_id string, position array<bigint>, content string, line_version long, db_version long, node_id long, local_db_version long, conflicts {CONFLICTS}, merged_from {CONFLICTS}, base_content string"
TOMBS_DDL = "doc_id string, line_id string, line_version long, db_version long, node_id long, local_db_version long"
CHANGES_DDL = "seq long, doc_id string, type string, line_id string, position array<bigint>, content string, line_version long, db_version long, node_id long, local_db_version long, base_content string"
PLAIN_COLS = ["doc_id", "line_id", "position", "content", "line_version", "db_version", "node_id", "local_db_version"]
LINE_COLS = [*PLAIN_COLS, "conflicts", "merged_from", "base_content"]
TOMB_COLS = ["doc_id", "line_id", "line_version", "db_version", "node_id", "local_db_version"]
CHANGE_COLS = ["seq", "doc_id", "type", "line_id", "position", "content", "line_version", "db_version", "node_id", "local_db_version", "base_content"]
INSERT, EDIT, DELETE = "Insert", "Edit", "Delete"
LINE = ["doc_id", "line_id"]
VERSION = ["line_version", "db_version", "node_id"]


@dataclass(frozen=True)
class Text:
    node_id: int
    lines: DataFrame
    tombstones: DataFrame
    clock: int = 0

    def with_(self, **changed) -> Text:
        return replace(self, **changed)


def new(spark: SparkSession, node_id: int) -> Text:
    return Text(node_id, empty(spark, LINES_DDL), empty(spark, TOMBS_DDL))


def _unwritten(*, base: Column | None = None) -> list[Column]:
    """The last of LINE_COLS for a line that one write made."""
    none = F.lit(None)
    return [none.cast(CONFLICTS).alias("conflicts"), none.cast(CONFLICTS).alias("merged_from"), (none.cast("string") if base is None else base).alias("base_content")]


def load(documents: DataFrame, node_id: int, separator: str = "\n") -> Text:
    """Lines of documents(doc_id, text), at even positions, as one writer's first version."""
    split = documents.select("doc_id", F.posexplode(F.split("text", separator)).alias("i", "content"))
    lines = split.select(
        "doc_id", F.concat_ws("_", F.lit(1), F.lit(node_id), F.col("i")).alias("line_id"), positions.bulk(F.col("i")).alias("position"), "content",
        *[F.lit(v).cast("long").alias(c) for c, v in (("line_version", 1), ("db_version", 1), ("node_id", node_id), ("local_db_version", 1))],
        *_unwritten(),
    )
    return Text(node_id, lines, empty(documents.sparkSession, TOMBS_DDL), 1)


def ordered(text: Text) -> DataFrame:
    """All lines in document order."""
    return text.lines.orderBy("doc_id", "position", "line_id")


def to_text(text: Text, separator: str = "\n") -> DataFrame:
    """(doc_id, text) of every document."""
    rows = F.array_sort(F.collect_list(F.struct("position", "line_id", "content")))
    return text.lines.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda r: r["content"]), separator).alias("text"))


def line(text: Text, doc_id: str, line_id: str) -> DataFrame:
    return text.lines.filter((F.col("doc_id") == doc_id) & (F.col("line_id") == line_id))


def tombstone(text: Text, doc_id: str, line_id: str) -> DataFrame:
    """The tombstone of a line; no row if it isn't deleted."""
    return text.tombstones.filter((F.col("doc_id") == doc_id) & (F.col("line_id") == line_id))


def are_tombstoned(text: Text, ids: DataFrame) -> DataFrame:
    """ids(doc_id, line_id) with the boolean `tombstoned`."""
    gone = text.tombstones.select(*LINE).distinct().withColumn("tombstoned", F.lit(True))
    return ids.join(gone, LINE, "left").withColumn("tombstoned", F.coalesce("tombstoned", F.lit(False)))


def show(text: Text, n: int = 20) -> None:
    """Prints lines and tombstones, for debugging."""
    ordered(text).withColumn("position", positions.dotted(F.col("position"))).show(n, truncate=False)
    text.tombstones.orderBy(*LINE).show(n, truncate=False)


def rebalanced(text: Text) -> Text:
    """The same lines in the same order, at even positions of one element.

    Positions only get longer by themselves. Replicas have to do this with the same lines, when all have seen all
    changes, as they do with old tombstones.
    """
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("position", "line_id")) - 1
    return text.with_(lines=text.lines.withColumn("position", positions.bulk(nth)))


def line_counts(text: Text) -> DataFrame:
    return text.lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"))


def all_versions(text: Text) -> DataFrame:
    """Every content that a line holds: its own (at 0), and its conflicts in order."""
    own = F.array(F.struct("db_version", "node_id", "content", F.col("base_content").alias("base")))
    every = F.concat(own, F.coalesce("conflicts", F.array().cast(CONFLICTS)))
    return text.lines.select(*LINE, F.posexplode(every).alias("at", "v")).select(*LINE, "at", "v.db_version", "v.node_id", "v.content")


# ---- local edits -------------------------------------------------------------------------------------------


def insert_lines(text: Text, inserts: DataFrame, parts: int | None = None) -> tuple[Text, DataFrame]:
    """Inserts (seq, doc_id, where, anchor, content); where is start, end, after or before.

    An anchor that isn't there, or null, means the end for `after` and the start for `before`. Lines that go
    into one gap share it out evenly: `end` and `before` in order of seq, `start` and `after` in reverse, as
    if each had been put directly at its anchor in turn.
    """
    rows = text.lines.select("doc_id", "line_id", "position")
    order = Window.partitionBy("doc_id").orderBy("position", "line_id")
    gaps = rows.select("doc_id", F.col("line_id").alias("anchor"), "position", F.lag("position").over(order).alias("low"), F.lead("position").over(order).alias("high"))
    ends = rows.groupBy("doc_id").agg(F.min("position").alias("first"), F.max("position").alias("last"))
    met = inserts.join(gaps, ["doc_id", "anchor"], "left").join(ends, "doc_id", "left")
    found = F.col("position").isNotNull()
    after_it, before_it = found & (F.col("where") == "after"), found & (F.col("where") == "before")
    at_end = (F.col("where") == "end") | (F.col("where") == "after") & ~found
    low = F.when(after_it, F.col("position")).when(before_it, F.col("low")).when(at_end, F.col("last"))
    high = F.when(after_it, F.col("high")).when(before_it, F.col("position")).when(~at_end, F.col("first"))
    placed = met.withColumn("low", low).withColumn("high", high).withColumn("up", at_end | before_it)
    gap = ["doc_id", "low", "high"]
    # Within a gap: those that push others on come first, the latest of them in front.
    nth = F.row_number().over(Window.partitionBy(*gap).orderBy("up", F.when(F.col("up"), F.col("seq")).otherwise(-F.col("seq")))) - 1
    counted = placed.withColumn("nth", nth).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*gap)))
    counted = counted.withColumn("position", positions.in_gap(F.col("low"), F.col("high"), F.col("n"), F.col("nth")))
    timed = clock.running_sum(counted, F.lit(1), "tick", parts=parts).withColumn("db_version", F.lit(text.clock) + F.col("tick"))
    changes = timed.select(
        "seq", "doc_id", F.lit(INSERT).alias("type"), F.concat_ws("_", "db_version", F.lit(text.node_id), "seq").alias("line_id"), "position", "content",
        F.lit(1).cast("long").alias("line_version"), "db_version", F.lit(text.node_id).cast("long").alias("node_id"), F.col("db_version").alias("local_db_version"), F.lit(None).cast("string").alias("base_content"),
    )
    lines = text.lines.unionByName(changes.select(*PLAIN_COLS, *_unwritten()))
    return text.with_(lines=lines, clock=text.clock + inserts.count()), changes


def edit_lines(text: Text, edits: DataFrame, parts: int | None = None) -> tuple[Text, DataFrame]:
    """Edits (seq, doc_id, line_id, content). Unknown and deleted lines are left alone, without a tick.

    A change says what content it changed: that of the line before this writer's own edits of it.
    """
    untouched = (F.col("node_id") == text.node_id) & F.col("conflicts").isNull() & F.col("merged_from").isNull()
    base = F.coalesce(F.when(untouched, F.col("base_content")), "content").alias("base_content")
    met = edits.join(text.lines.select(*LINE, "position", F.col("line_version").alias("was"), base), LINE)
    timed = clock.running_sum(met, F.lit(1), "tick", parts=parts).withColumn("db_version", F.lit(text.clock) + F.col("tick"))
    own = Window.partitionBy(*LINE).orderBy("seq")
    changes = timed.withColumn("line_version", F.col("was") + F.row_number().over(own)).select(
        "seq", "doc_id", F.lit(EDIT).alias("type"), "line_id", "position", "content", F.col("line_version").cast("long").alias("line_version"), "db_version",
        F.lit(text.node_id).cast("long").alias("node_id"), F.col("db_version").alias("local_db_version"), "base_content",
    )
    last = changes.withColumn("__n", F.row_number().over(Window.partitionBy(*LINE).orderBy(F.desc("seq")))).filter("__n = 1")
    edited = last.select(*PLAIN_COLS, *_unwritten(base=F.col("base_content")))
    lines = text.lines.join(edited.select(*LINE), LINE, "left_anti").unionByName(edited)
    return text.with_(lines=lines, clock=text.clock + met.count()), changes.select(*CHANGE_COLS)


def delete_lines(text: Text, deletes: DataFrame, parts: int | None = None) -> tuple[Text, DataFrame]:
    """Deletes (seq, doc_id, line_id). Unknown lines can't be deleted; a line is deleted once."""
    first = deletes.groupBy(*LINE).agg(F.min("seq").alias("seq")).join(text.lines.select(*LINE, "position"), LINE)
    timed = clock.running_sum(first, F.lit(1), "tick", parts=parts).withColumn("db_version", F.lit(text.clock) + F.col("tick"))
    changes = timed.select(
        "seq", "doc_id", F.lit(DELETE).alias("type"), "line_id", "position", F.lit(None).cast("string").alias("content"), F.lit(1).cast("long").alias("line_version"), "db_version",
        F.lit(text.node_id).cast("long").alias("node_id"), F.col("db_version").alias("local_db_version"), F.lit(None).cast("string").alias("base_content"),
    )
    lines = text.lines.join(changes.select(*LINE), LINE, "left_anti")
    return text.with_(lines=lines, tombstones=text.tombstones.unionByName(changes.select(*TOMB_COLS)), clock=text.clock + first.count()), changes


# ---- exchange ----------------------------------------------------------------------------------------------


def _writes() -> Column:
    """All writes that a line holds: what its content was merged from, or else its content, and its conflicts."""
    own = F.array(F.struct("db_version", "node_id", "content", F.col("base_content").alias("base")))
    return F.concat(F.coalesce("merged_from", own), F.coalesce("conflicts", F.array().cast(CONFLICTS)))


def changes_since(text: Text, since: int) -> DataFrame:
    """Live lines as inserts (edits can't be told apart), one for each write that a line holds; tombstones as
    deletes without a position."""
    new = F.col("local_db_version") > since
    none = F.lit(None)
    held = text.lines.filter(new).select("doc_id", "line_id", "position", "line_version", "local_db_version", F.explode(_writes()).alias("w"))
    live = held.select("*", "w.*", F.col("w.base").alias("base_content"), F.lit(INSERT).alias("type"), none.cast("long").alias("seq"))
    gone = text.tombstones.filter(new).select(
        "*", F.lit(DELETE).alias("type"), none.cast("long").alias("seq"), none.cast("array<bigint>").alias("position"), none.cast("string").alias("content"), none.cast("string").alias("base_content")
    )
    return live.select(*CHANGE_COLS).unionByName(gone.select(*CHANGE_COLS))


def numbered(delta: DataFrame) -> DataFrame:
    """A delta from a state, with a seq by local version."""
    return clock.numbered(delta.drop("seq"), [*LINE, "type", "node_id"]).select(*delta.columns)


def _latest(rows: DataFrame) -> DataFrame:
    """The greatest version of each line; the state's own row before arriving ones, then the first to arrive."""
    best = Window.partitionBy(*LINE).orderBy(*[F.col(c).desc() for c in VERSION], F.col("seq").asc_nulls_first())
    return rows.withColumn("__n", F.row_number().over(best)).filter("__n = 1").drop("__n")


RULED = [*LINE, "content", *VERSION, "local_db_version", "conflicts", "merged_from", "base_content", "seq"]


def _last_write(rows: DataFrame) -> DataFrame:
    return _latest(rows).select(*RULED)


def _concurrent(rows: DataFrame) -> DataFrame:
    """For each line its latest row and `writes`: all writes of its greatest line version, one for each writer (the
    latest), in order of (db_version, node_id). It depends on nothing but the writes that rows hold."""
    every = rows.select(*LINE, "line_version", F.explode(_writes()).alias("w"))
    top = rows.groupBy(*LINE).agg(F.max("line_version").alias("line_version"))
    mine = every.join(top, [*LINE, "line_version"]).groupBy(*LINE, F.col("w.node_id").alias("n")).agg(F.max("w").alias("w"))
    sets = mine.groupBy(*LINE).agg(F.array_sort(F.collect_list("w")).cast(CONFLICTS).alias("writes"))
    return _latest(rows).drop("conflicts", "merged_from", "content", "base_content").join(sets, LINE)


def _both_writes(rows: DataFrame) -> DataFrame:
    """Writes of one line version by different writers are concurrent: the latest is the content, the others, in
    order of (db_version, node_id), are its conflicts. Merging the same writes again changes nothing."""
    last, others = F.element_at("writes", -1), F.slice("writes", 1, F.size("writes") - 1)
    held = {"content": last["content"], "base_content": last["base"], "conflicts": F.when(F.size("writes") > 1, others), "merged_from": F.lit(None).cast(CONFLICTS)}
    return _concurrent(rows).withColumns(held).select(*RULED)


def _auto_merge(rows: DataFrame) -> DataFrame:
    """Experimental. Concurrent edits of one base are merged word by word where no two of them overlap; where they
    do, or their bases differ or aren't known, they are kept as by BOTH_WRITES.

    The content is worked out from all the writes, which the line keeps in merged_from, so replicas that have got
    the same writes, in whatever order, hold the same.
    """
    met = _concurrent(rows)
    bases = F.array_distinct(F.transform("writes", lambda w: w["base"]))
    may = (F.size("writes") > 1) & (F.size(bases) == 1) & bases[0].isNotNull()
    met = met.withColumn("merged", words.merged(bases[0], F.when(may, F.transform("writes", lambda w: w["content"]))))
    last, others, done = F.element_at("writes", -1), F.slice("writes", 1, F.size("writes") - 1), F.col("merged").isNotNull()
    held = {
        "content": F.coalesce("merged", last["content"]), "base_content": last["base"], "merged_from": F.when(done, F.col("writes")),
        "conflicts": F.when(~done & (F.size("writes") > 1), others),
    }
    return met.withColumns(held).select(*RULED)


#: Rules for writes to lines that are known: a function from all writes of lines to one row for each line.
LAST_WRITE, BOTH_WRITES, AUTO_MERGE = _last_write, _both_writes, _auto_merge


def merge(text: Text, changes: DataFrame, rule: Callable[[DataFrame], DataFrame] = LAST_WRITE, stamped: bool = False, parts: int | None = None) -> Text:
    """Applies changes in order of seq.

    A deleted line stays deleted; of its deletes the greatest version is kept. A new line needs a position and
    a content; it never moves from the position that arrived first. stamped sets local versions to the clock
    on arrival, else they stay as they come.
    """
    log = clock.stamp(changes, text.clock, parts=parts).drop("range") if stamped else changes
    top = log.agg(F.max("local_db_version" if stamped else "db_version")).first()[0]
    gone = log.filter(F.col("type") == DELETE).select(*TOMB_COLS).unionByName(text.tombstones)
    gone = gone.groupBy(*LINE).agg(F.max(F.struct(*VERSION, "local_db_version")).alias("v")).select(*LINE, "v.*")
    base = F.col("base_content") if "base_content" in log.columns else F.lit(None).cast("string")
    arrived = log.filter((F.col("type") != DELETE) & F.col("content").isNotNull()).select(*PLAIN_COLS, "seq", *_unwritten(base=base))
    cols = [*LINE_COLS, "seq"]
    own = text.lines.withColumn("seq", F.lit(None).cast("long"))
    rows = own.select(*cols).unionByName(arrived.select(*cols)).join(gone.select(*LINE), LINE, "left_anti")
    place = rows.filter("position is not null").groupBy(*LINE).agg(F.min(F.struct(F.coalesce("seq", F.lit(-1)).alias("s"), "position"))["position"].alias("position"))
    lines = rule(rows).join(place, LINE).select(*LINE_COLS)
    return text.with_(lines=lines, tombstones=gone.select(*TOMB_COLS), clock=max(text.clock, top or 0) if not stamped else (top or text.clock))


def sync(source: Text, target: Text, last: int = 0, rule: Callable[[DataFrame], DataFrame] = LAST_WRITE) -> tuple[Text, int]:
    """Applies source's changes since `last` to target by a rule; the watermark becomes source's clock."""
    delta = staged(numbered(staged(changes_since(source, last), "delta")), "numbered")
    return merge(target, delta, rule, stamped=True), source.clock
