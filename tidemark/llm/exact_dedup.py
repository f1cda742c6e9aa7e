"""Exact deduplication by two-pass Bloom filtering.

Pass one hashes every row's normalised text into a filter whose cells count to two. A text that occurs
twice has two in each of its cells, so pass two can tell rows that are certainly single: they go straight
through through. Only the rest shuffle, and are compared by SHA-256.

A filter has a bounded size. Where the rows need more cells than that, they are looked at in several rounds, each
with a filter of its own for the rows whose digests fall into one range: equal texts have equal digests, so they
meet in one round. Rounds read pages of sorted files, and nothing moves for them.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, staged

#: Cells per row, hashes per row, and the most cells of a filter: 32 MB of bits to send, twice that while a task
#: counts. So a round has at most 17 million rows; 5e10 rows, some 100 TB, take 3,000 rounds.
CELLS_PER_ROW, HASHES, MOST_CELLS = 16, 4, 1 << 28
#: Values of the part of a digest that assigns it to a round.
HEADS = 1 << 31
#: Cells of one segment: filters are merged segment by segment.
SEGMENT = 1 << 16

WHITE = r"[\x20\x09-\x0D]+"


def normalised(text) -> F.Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def _cells(digest: pa.Array, cells: int) -> np.ndarray:
    """HASHES cell numbers for each 32-byte digest."""
    if not len(digest):
        return np.zeros((0, HASHES), np.int64)
    words = np.frombuffer(b"".join(digest.to_pylist()), "<u8").reshape(-1, 4)
    return (words & np.uint64(cells - 1)).astype(np.int64)[:, :HASHES]


def _is_set(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _set(bits: np.ndarray, at: np.ndarray) -> None:
    """Sets the bits at ascending places."""
    if len(at):
        byte = at >> 3
        heads = np.flatnonzero(np.diff(byte, prepend=-1))
        bits[byte[heads]] |= np.bitwise_or.reduceat((1 << (at & 7)).astype(np.uint8), heads)


def repeat_filter(digests: DataFrame, cells: int) -> np.ndarray:
    """Bitmap of the cells that two or more rows hit, over all rows. digests has a column `digest`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = twice = None
        for batch in batches:
            if once is None and batch.num_rows:
                once, twice = np.zeros(cells // 8, np.uint8), np.zeros(cells // 8, np.uint8)
            for column in _cells(batch.column("digest"), cells).T:
                found, n = np.unique(column, return_counts=True)
                _set(twice, found[(n > 1) | _is_set(once, found)])
                _set(once, found)
        for s in range(0, 0 if once is None else cells // 8, SEGMENT // 8):
            a = once[s : s + SEGMENT // 8]
            if a.any():
                yield pa.RecordBatch.from_pydict({"segment": [8 * s // SEGMENT], "once": [a.tobytes()], "twice": [twice[s : s + SEGMENT // 8].tobytes()]})

    def merge(key: tuple[pa.Scalar, ...], groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = twice = None
        for batch in groups:
            for a, b in zip(batch.column("once").to_pylist(), batch.column("twice").to_pylist(), strict=True):
                a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
                once, twice = (a, b) if once is None else (once | a, twice | b | (once & a))
        yield pa.RecordBatch.from_pydict({"segment": [key[0].as_py()], "twice": [twice.tobytes()]})

    parts = digests.mapInArrow(count, "segment long, once binary, twice binary")
    merged = parts.groupBy("segment").applyInArrow(merge, "segment long, twice binary")
    bits = np.zeros(cells // 8, np.uint8)
    for row in merged.toLocalIterator():  # cells / 8 bytes in all, at most 32 MB
        part = np.frombuffer(row.twice, np.uint8)
        bits[row.segment * SEGMENT // 8 :][: len(part)] = part
    return bits


def _mark(rows: DataFrame, cells: int, path: str) -> None:
    """Writes rows(id, digest) with `again`: whether its text may come more than once among them."""
    sent = rows.sparkSession.sparkContext.broadcast(repeat_filter(rows.select("digest"), cells))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for batch in batches:
            hit = _is_set(bits, _cells(batch.column("digest"), cells)).all(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("digest"), pa.array(hit)], names=["id", "digest", "again"])

    rows.select("id", "digest").mapInArrow(mark, rows.select("id", "digest").schema.add("again", "boolean")).write.parquet(path)
    sent.destroy()


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: its id, the id that its text keeps, the size of its group, whether it stays, the digest.

    Null and empty texts are equal to each other. A text that is only white space is one space, and differs
    from the empty text. Of rows that repeat one id with one text, each is marked kept. A null id is kept only
    if no row of the group has one. Any other columns of docs, whatever their names, are not looked at.
    An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest"))
    # Bits of the digest that give no cells: equal shares of their values are the rounds.
    rows = rows.withColumn("head", F.conv(F.substring(F.hex("digest"), -8, 8), 16, 10).cast("long").bitwiseAND(F.lit(HEADS - 1)))
    rows = staged(rows.sortWithinPartitions("head"), "digests")
    n = rows.count()
    rounds = max(1, -(-CELLS_PER_ROW * n // MOST_CELLS))
    cells = SEGMENT
    while cells < min(MOST_CELLS, CELLS_PER_ROW * n):
        cells *= 2
    path, head = new_path(docs.sparkSession, "marked"), F.col("head")
    for k in range(rounds):
        _mark(rows.filter((head >= k * HEADS // rounds) & (head < (k + 1) * HEADS // rounds)), cells, f"{path}/{k}")
    marked = docs.sparkSession.read.schema(rows.select("id", "digest").schema.add("again", "boolean")).parquet(*[f"{path}/{k}" for k in range(rounds)])
    again, single = marked.filter("again"), marked.filter("not again")
    groups = again.groupBy("digest").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    met = again.join(groups, "digest").select("id", "digest", "keep_id", "group_size")
    alone = single.select("id", "digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    return alone.unionAll(met).select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP9_SQL = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
"""
