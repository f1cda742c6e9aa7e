"""A stream of changes, applied to a store micro-batch by micro-batch.

Conflicts are resolved by version, so late changes are never dropped and no watermark on time is needed. A
batch that is delivered again after a failure is recognised by its number and does nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..model import CHANGES_DDL
from ..operators.merge import LAST_WRITE, Rule
from ..sources.store import Store


def read_changes(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Change files that arrive in a folder, as a stream."""
    return spark.readStream.schema(CHANGES_DDL).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def apply_stream(changes: DataFrame, store: Store, checkpoint: str, rule: Rule = LAST_WRITE, seconds: float | None = None) -> StreamingQuery:
    """Merges every micro-batch into the store. Without `seconds`, stops when what there is has been read."""

    def each(batch: DataFrame, batch_id: int) -> None:
        store.merge(batch, rule, batch_id)

    writer = changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)
    return writer.start()
