"""Sharding by a two-pass external shuffle, in DataFrame and SQL operations only.

Pass one scatters the rows by a seeded hash into buckets of a size that fits in memory. Pass two applies a
Fisher-Yates shuffle to each bucket and writes it. The shuffled buckets, one after the other, are dealt to the
shards in turn, so the shards' row counts differ by one at most and slots have no gaps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import maybe_broadcast, new_path, staged, unused

SHARDS, SEED = 40, 11
#: Bytes of text that a bucket holds on average, and bytes that count for a row besides its text.
BUCKET_BYTES, ROW_BYTES = 4 << 20, 16
#: At most so many buckets, so that their offsets (24 MB) can always be broadcast. At 100 TB a bucket then has
#: 100 MB on average; a task holds one bucket at a time, two or three times over: some 300 MB.
MOST_BUCKETS = 1 << 20
#: Parts that copies of one row are dealt into to be counted.
SALTS = 1 << 12
#: Rows of a file of a written shard.
FILE_ROWS = 1 << 18


def _numbered(docs: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    """docs with the long `name`: 0, 1, ... among rows that agree in id and text, however many; else 0.

    Rows alike share a hash, and few hashes come twice. Only rows with such a hash are dealt out at random, and
    that is written down, so that a hash with a third of all rows is counted in many small parts.
    """
    mark, salt = unused(docs, "shard_mark"), unused(docs, "shard_salt")
    marked = docs.withColumn(mark, F.xxhash64(id_col, text_col))
    again = staged(marked.groupBy(F.col(mark).alias("again")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("again"), "again")
    if again.isEmpty():
        return docs.withColumn(name, F.lit(0).cast("long"))
    again = maybe_broadcast(again, 16)
    once = marked.join(again, F.col(mark) == F.col("again"), "left_anti").withColumn(name, F.lit(0).cast("long"))
    rows = staged(marked.join(again, F.col(mark) == F.col("again"), "left_semi").withColumn(salt, F.floor(F.rand() * SALTS)), "alike")
    part, at = unused(docs, "shard_part"), unused(docs, "shard_at")
    sums = rows.groupBy(F.col(mark).alias(part), F.col(salt).alias(at)).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(part).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    before = unused(docs, "shard_before")
    bases = sums.select(part, at, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before))
    nth = F.row_number().over(Window.partitionBy(mark, salt).orderBy(salt)) - 1
    met = rows.join(bases, (F.col(mark) == F.col(part)) & (F.col(salt) == F.col(at))).withColumn(name, (F.col(before) + nth).cast("long"))
    return once.drop(mark).unionByName(met.select(*docs.columns, name))


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """docs, all columns, with shard (0 to shards - 1) and slot (0, 1, ... within the shard), as written.

    Null and empty texts count 16 bytes; a row longer than a bucket stays whole. Rows that repeat an id and a
    text are numbered and scattered like any other. docs must have no columns named shard or slot. An empty
    table gives an empty result. What is returned has been written to the shared folder, so it is the same
    whenever it is read.
    """
    if clash := {"shard", "slot"} & {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has the columns {sorted(clash)}, which the result adds")
    total = docs.agg(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + ROW_BYTES)).first()[0] or 0
    buckets = min(MOST_BUCKETS, max(1, -(-total // bucket_bytes)))
    ordinal = unused(docs, "shard_ordinal")
    mixed = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col), F.col(ordinal))
    bucket = F.pmod(mixed, F.lit(buckets))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    width = max(1, min(buckets, -(-total // (4 * bucket_bytes))))
    scattered = _numbered(docs, id_col, text_col, ordinal).select(bucket.alias("bucket"), F.shiftright(mixed, 16).alias("order"), F.col(id_col).alias("id"), row.alias("row"))
    scattered = scattered.repartition(width, "bucket").sortWithinPartitions("bucket", "order", "id")
    # Spark's shuffle() is a seeded Fisher-Yates shuffle.
    shuffled = scattered.groupBy("bucket").agg(F.collect_list("row").alias("rows")).select("bucket", F.shuffle("rows", F.lit(seed)).alias("rows"))
    dealt = staged(shuffled.select("bucket", F.posexplode("rows").alias("at", "row")), "buckets")
    counts = staged(dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "counts")
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = staged(counts.select("bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")), "bases")
    place = F.col("base") + F.col("at")
    met = dealt.join(maybe_broadcast(bases, 24, 24 * MOST_BUCKETS), "bucket")
    return met.select("row.*", (place % shards).cast("int").alias("shard"), F.floor(place / F.lit(shards)).alias("slot"))


def write_shards(docs: DataFrame, path: str | None = None, file_rows: int = FILE_ROWS, **options) -> str:
    """Shards of docs as Parquet below path, one folder for each shard, its files by ranges of slots; returns the path."""
    path = path or new_path(docs.sparkSession, "shards")
    rows = shard(docs, **options)
    files = max(1, -(-rows.count() // file_rows))
    rows.repartition(files, "shard", F.floor(F.col("slot") / file_rows)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return path


def op6_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    text = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    return rows.select(
        "doc_id",
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
