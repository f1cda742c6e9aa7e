"""The logical clock over an ordered batch, without sorting the batch in one task.

The clock moves to max(clock, db_version) + 1 for every change, taken or not. For the i-th of a batch that is
i + max(c0, max over j <= i of (db_j - j + 1)): a running maximum. The batch is cut into ranges of seq;
windows run within ranges, and one row for each range carries the count and the maximum on to the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranges(changes: DataFrame, order: str = "seq", parts: int | None = None) -> Column:
    """A column that numbers ranges of `order` holding about equally many rows; costs one pass over that column."""
    parts = parts or int(changes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted({min(int(b), (1 << 63) - 1) for b in changes.approxQuantile(order, [k / parts for k in range(1, parts)], 1 / (2 * parts))}) if parts > 1 else []
    if not bounds:
        return F.lit(0)
    return _search(F.col(order), bounds, 0)


def _search(value: Column, bounds: list[int], base: int) -> Column:
    """How many bounds are at most value, by nested comparisons."""
    if not bounds:
        return F.lit(base)
    mid = len(bounds) // 2
    return F.when(value < bounds[mid], _search(value, bounds[:mid], base)).otherwise(_search(value, bounds[mid + 1 :], base + mid + 1))


def stamp(changes: DataFrame, c0: int, order: str = "seq", parts: int | None = None) -> DataFrame:
    """changes with local_db_version set to the clock at each, and the column `range`.

    `order` must be unique and not null.
    """
    cut = changes.withColumn("range", ranges(changes, order, parts))
    upto = Window.partitionBy("range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ahead = F.col("db_version") - F.col("__at") + 1
    within = cut.withColumn("__at", F.row_number().over(Window.partitionBy("range").orderBy(order)).cast("long"))
    # The same windows again give each range's totals: counts and maxima, which combine before the shuffle.
    within = within.withColumn("__ahead", F.max(ahead).over(upto))
    totals = within.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.max("__ahead").alias("m"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    placed = totals.withColumn("off", F.coalesce(F.sum("n").over(before), F.lit(0)))
    carried = placed.select(F.col("range").alias("__range"), "off", F.coalesce(F.max(F.col("m") - F.col("off")).over(before), F.lit(c0)).alias("carry"))
    met = within.join(carried, F.col("range") == F.col("__range"))
    local = F.col("off") + F.col("__at") + F.greatest(F.lit(c0), F.col("carry"), F.col("__ahead") - F.col("off"))
    return met.withColumn("local_db_version", local.cast("long")).drop("__at", "__ahead", "__range", "off", "carry")


def tick(clock: int) -> int:
    return clock + 1


def update(clock: int, seen: int) -> int:
    return max(clock, seen) + 1


def set_time(clock: int, time: int) -> int:
    """The clock moved to a time given from outside, which must not lie before it."""
    if time < clock:
        raise ValueError(f"the clock is at {clock} and can't go back to {time}")
    return time


def running_sum(rows: DataFrame, value: Column, name: str, order: str | list[str] = "seq", parts: int | None = None) -> DataFrame:
    """rows with the column `name`: the sum of value up to and with each row, in order. Works as stamp() does.

    The ranges are of the first column of the order; the whole order must be unique.
    """
    order = [order] if isinstance(order, str) else order
    cut = rows.withColumn("__range", ranges(rows, order[0], parts)).withColumn("__v", value.cast("long"))
    upto = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(F.col("__range").alias("__r")).agg(F.sum("__v").alias("__t")).select("__r", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__base"))
    met = cut.withColumn("__in", F.sum("__v").over(upto)).join(totals, F.col("__range") == F.col("__r"))
    return met.withColumn(name, (F.col("__base") + F.col("__in")).cast("long")).drop("__range", "__v", "__in", "__r", "__base")


def in_version_order(keys: list[str], version: str = "local_db_version") -> Column:
    """What puts rows without an order of arrival in one: the version, then a digest of their keys, then the keys.

    One local version belongs to one call or batch, so the digest only settles what came at once, alike everywhere.
    """
    return F.struct(F.col(version).alias("v"), F.xxhash64(*keys).alias("h"), *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])


def numbered(rows: DataFrame, keys: list[str], version: str = "local_db_version", name: str = "seq", parts: int | None = None) -> DataFrame:
    """rows with the column `name`: 1, 2, ... in version order, whatever the versions' size.

    Rows of a version are cut into parts by their digests, so that a version which all rows share is not sorted in
    one task. What is kept for each part is added up as in running_sum().
    """
    digest = F.xxhash64(*keys)
    cut = rows.withColumn("__h", digest).withColumn("__p", F.shiftright("__h", 54))
    sizes = cut.groupBy(F.col(version).alias("__v0"), F.col("__p").alias("__p0")).agg(F.count(F.lit(1)).alias("__n"))
    bases = running_sum(sizes, F.col("__n"), "__upto", ["__v0", "__p0"], parts).select("__v0", "__p0", (F.col("__upto") - F.col("__n")).alias("__base"))
    nth = F.row_number().over(Window.partitionBy(version, "__p").orderBy("__h", *keys))
    met = cut.withColumn("__nth", nth).join(bases, (F.col(version) == F.col("__v0")) & (F.col("__p") == F.col("__p0")))
    return met.withColumn(name, (F.col("__base") + F.col("__nth")).cast("long")).drop("__h", "__p", "__v0", "__p0", "__base", "__nth")
