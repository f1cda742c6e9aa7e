"""What the operators of this subpackage share: staged tables, checked broadcasts, Arrow slices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import delete, new_path, staged, temporary

#: A side of a join is broadcast only when its measured size is at most this many bytes.
BROADCAST_BYTES = 8 << 20
#: Text bytes that a Python worker looks at together.
SLICE_BYTES = 4 << 20
#: Rows that Spark sends to a Python worker at a time.
BATCH_ROWS = 1000
#: A table of less than this for each core is dealt out anew, as a scan has too few splits of it.
CORE_BYTES = 4 << 20

__all__ = ["coded_words", "delete", "maybe_broadcast", "new_path", "ragged", "shuffled", "slices", "small_batches", "split_words", "spread", "staged", "temporary", "unused"]


def maybe_broadcast(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its counted rows fit in limit; else df for a shuffled join."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else shuffled(df)


def shuffled(df: DataFrame) -> DataFrame:
    """df for a join that shuffles both sides.

    Spark takes a written table's compressed size for its own and doesn't count what explode() adds, so it may
    broadcast millions of rows, all of which the driver would hold.
    """
    return df.hint("merge")


def small_batches(spark: SparkSession) -> None:
    """Lets Spark send BATCH_ROWS rows at a time to Python workers, unless the session has a setting of its own.

    Spark's own 10,000 rows of text are held several times over, by the JVM and by the worker. slices() puts
    together as much as an operator wants to look at. Spark looks at the setting when a plan runs, which may be
    after the operator has returned, so it stays for the session.
    """
    if "spark.sql.execution.arrow.maxRecordsPerBatch" not in spark.conf.getAll:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df for work in Python; a table too small for a split a core is dealt out by keys, so that all cores work."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores, *keys) if size < cores * CORE_BYTES else df


def unused(docs: DataFrame, name: str) -> str:
    """name, or name with more underscores, so that docs has no such column."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of a column; one longer row stays whole."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        n = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(n)
        at = 0
        while at < len(n):
            base = int(ends[at - 1]) if at else 0
            end = int(np.searchsorted(ends, base + most - size, side="left")) + 1
            end = min(end, len(n))
            held.append(batch.slice(at, end - at))
            size += int(ends[end - 1]) - base
            at = end
            if size >= most:
                yield _together(held)
                held, size = [], 0
                pa.default_memory_pool().release_unused()
    if held:
        yield _together(held)


def _together(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.concat_batches(held)


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices of the ranges [start, start + len), one after the other."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lens), lens) + np.arange(total, dtype=np.int64)


def split_words(text: pa.Array) -> tuple[np.ndarray, np.ndarray, list]:
    """Words between ASCII white space: (row boundaries, index of each word, distinct words)."""
    bounds, index, distinct = coded_words(text)
    return bounds, index, distinct.to_pylist()


def coded_words(text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """As split_words, with the distinct words in an Arrow array."""
    words = pc.ascii_split_whitespace(pc.fill_null(text, "").cast(pa.large_string()))
    flat = words.flatten()
    coded = pc.dictionary_encode(flat)
    at = words.offsets.to_numpy().astype(np.int64)
    return at - at[0], coded.indices.to_numpy(), coded.dictionary
