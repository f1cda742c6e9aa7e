"""Mixing sources to target weights by weighted fair queueing, in DataFrame and SQL operations only.

Each source is a queue of its documents in an order shuffled by a seeded digest, run through up to three
times. A document's virtual finish time is the cumulative size of its queue up to its end, divided by the
source's target: the mix is all queues' entries in ascending finish time, up to where the budget ends.

The targets add up to the budget, and until a queue has reached its target it is served at a rate in proportion
to it, so the whole budget has been served at virtual time 1: that is where the mix is cut off. The entry of
each source that is being served then is taken if at least half of it has been, so every source ends as near
to its target as whole documents allow, however large they are.

Nothing sorts a whole source in one task: the order within a source is cut into ranges of the digest, the
ranges' sums are accumulated, and windows run within ranges only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import maybe_broadcast, staged, unused

#: Times that a document may be taken; rows that a range of the order holds on average, but at most so many
#: ranges in all, as a source's sums of ranges pass through one task. At 100 TB (some 5e10 rows) a range then has
#: some 400,000 thin rows (about 40 MB), sorted, and spilled if need be, by one task.
REPEATS, RANGE_ROWS, MOST_RANGES = 3, 500, 1 << 17
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def words(text) -> F.Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """sizes(key, source_size): adds target (double). Keys in ascending order weigh 1, 2, 3, 1, ...

    The budget is the sum of all sizes. Targets are min(repeats * source_size, level * weight) for the one
    level at which they add up to the budget, which is where resharing the excess by weight comes to rest.
    """
    one = Window.orderBy("key")
    weighed = sizes.withColumn("weight", ((F.row_number().over(one) - 1) % 3 + 1).cast("double")).withColumn("cap", repeats * F.col("source_size"))
    # By ascending cap / weight: the first i sources are capped, the others share what is left.
    order = Window.orderBy(F.col("cap") / F.col("weight"), "key")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    rows = weighed.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    found = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), "key", "level"))).over(Window.partitionBy())["level"]
    return rows.select("key", "source_size", F.least(F.col("cap").cast("double"), found * F.col("weight")).alias("target"))


def _keys(id_col: str, source_col: str, seed: str) -> tuple[F.Column, F.Column]:
    """A source's key, in code point order with null last, and the digest that shuffles its documents."""
    key = F.coalesce(F.concat(F.lit("0"), F.col(source_col)), F.lit("1"))
    return key, F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))


def _served(end: F.Column, size: F.Column, k: int) -> F.Column:
    """Whether the k-th taking of an entry is at least half served at virtual time 1."""
    return 2 * (F.lit(k) * F.col("source_size") + end) - size <= 2 * F.col("target")


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, repeats: int = REPEATS) -> DataFrame:
    """For every row: id, key (of its source), digest, size, source_size, target, times (how often the mix takes
    it) and finish, the virtual finish time of its first taking, null if it is never taken.

    A null source is the last of the sources. Texts without words, null ones too, have size 0 and are taken 0
    times; if there are no words at all, nothing is taken. Repeated rows are separate entries; entries that
    agree in everything that orders them are alike, so reruns agree. Rows that share an id share a place in the
    shuffled order, and so a task. Other columns are not looked at. An empty table gives an empty result.
    """
    key, digest = _keys(id_col, source_col, seed)
    thin = staged(docs.select(F.col(id_col).alias("id"), key.alias("key"), words(F.col(text_col)).alias("size"), digest.alias("digest")), "sizes")
    ranges = min(MOST_RANGES, max(1, thin.count() // RANGE_ROWS))
    placed = thin.withColumn("cut", F.floor(F.conv(F.substring("digest", 1, 8), 16, 10).cast("double") * ranges / 2**32))
    sums = staged(placed.groupBy("key", "cut").agg(F.sum("size").alias("sum")), "sums")
    goals = staged(targets(sums.groupBy("key").agg(F.sum("sum").alias("source_size")), repeats), "targets")
    # One row for each of a source's ranges: what its queue has before it.
    earlier = Window.partitionBy("key").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("key", "cut", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("base")).join(maybe_broadcast(goals, 100), "key")
    within = Window.partitionBy("key", "cut").orderBy("digest", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    ends = placed.withColumn("end", F.sum("size").over(within)).join(maybe_broadcast(staged(bases, "bases"), 120), ["key", "cut"])
    end = F.col("base") + F.col("end")
    times = sum((_served(end, F.col("size"), k).cast("int") for k in range(repeats)), F.lit(0))
    times = F.when((F.col("size") > 0) & F.col("target").isNotNull(), times).otherwise(0).cast("int")
    finish = F.when(times > 0, F.try_divide(end, F.col("target")))
    return ends.select("id", "key", "digest", "size", "source_size", "target", times.alias("times"), finish.alias("finish"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, repeats: int = REPEATS, ordered: bool = False) -> DataFrame:
    """docs, all columns, each row as often as the mix takes it.

    What a source's queue gives in each round ends at one place in its shuffled order, so a row needs only its
    source's places to know how often it is taken: texts don't move. With ordered=True they do: the rows come
    range-sorted by virtual finish time, as far as their source's first round tells it, so that every stretch of
    the result has the sources in proportion. Rows that repeat an id, source and size share the most of their
    times. An empty table gives an empty result.
    """
    key, digest = _keys(id_col, source_col, seed)
    place = F.struct("digest", "id", "size")
    ends = [F.max(F.when(F.col("times") > k, place)).alias(f"end{k}") for k in range(repeats)]
    planned = plan(docs, id_col, text_col, source_col, seed, repeats)
    rows = staged(planned.groupBy("key").agg(F.struct(*ends, F.max(F.try_divide("source_size", "target")).alias("round")).alias("queue")), "queue-ends")
    at, of, source, queue, turn = (unused(docs, f"mix_{n}") for n in ("at", "of", "source", "queue", "turn"))
    mine = F.struct(digest.alias("digest"), F.col(id_col).alias("id"), words(F.col(text_col)).alias("size"))
    rows = rows.select(F.col("key").alias(source), F.col("queue").alias(queue))
    met = docs.withColumns({at: mine, of: key}).join(maybe_broadcast(rows, 400), F.col(of) == F.col(source))
    times = sum((F.coalesce(F.col(at) <= F.col(f"{queue}.end{k}"), F.lit(False)).cast("int") for k in range(repeats)), F.lit(0))
    times = F.when(F.col(f"{at}.size") > 0, times).otherwise(0)
    taken = met.withColumn(turn, F.explode(F.filter(F.sequence(F.lit(0), times), lambda k: k > 0)))
    if ordered:
        # Digests are even over a source, so a digest's share of their range is near its share of the queue.
        share = F.conv(F.substring(f"{at}.digest", 1, 8), 16, 10).cast("double") / 2**32
        taken = taken.orderBy((F.col(turn) - 1 + share) * F.col(f"{queue}.round"), f"{at}.digest")
    return taken.select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"), "finish")


OP4_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce('0' || source, '1') AS key,
         coalesce(len(regexp_extract_all(text, '[^ 	-
]+')), 0)::BIGINT AS size, md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS digest
  FROM documents),
w AS (
  SELECT key, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY key) - 1) % 3 + 1)::DOUBLE AS weight
  FROM t GROUP BY key),
c AS (SELECT *, 3 * source_size AS cap, 3 * source_size / weight AS ratio FROM w),
l AS (
  SELECT *, ((SELECT sum(source_size) FROM w) - coalesce(sum(cap) OVER (ORDER BY ratio, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY ratio, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM c),
g AS (
  SELECT key, source_size, least(cap::DOUBLE, (SELECT level FROM l WHERE level * weight <= cap ORDER BY ratio, key LIMIT 1) * weight) AS target FROM l),
e AS (
  SELECT t.*, source_size, target, sum(size) OVER (PARTITION BY t.key ORDER BY digest, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS ended
  FROM t JOIN g USING (key)),
n AS (
  SELECT *, CASE WHEN size > 0 THEN (2 * ended - size <= 2 * target)::INT + (2 * (source_size + ended) - size <= 2 * target)::INT + (2 * (2 * source_size + ended) - size <= 2 * target)::INT ELSE 0 END AS times
  FROM e)
SELECT doc_id, size, source_size, target, (times * size)::BIGINT AS taken, CASE WHEN times > 0 THEN ended::DOUBLE / target END AS finish FROM n
"""
