"""Tables that are written down between steps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from .files import Files

_own_dir: list[str] = []
_folder: ContextVar[str | None] = ContextVar("folder", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own on a local master."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="tidemark-"))
    return _own_dir[0]


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder below the one of temporary(), or else below the shared folder."""
    return f"{_folder.get() or shared_dir(spark) + '/tidemark'}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df, written to the shared folder and read again: lineage ends here and lost executors cost nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    Files(spark, path).delete("")


@contextmanager
def temporary(spark: SparkSession) -> Iterator[str]:
    """Tables that are staged inside go to one folder, which is deleted at the end.

    What operators return reads such tables, so it has to be written elsewhere before that.
    """
    path = f"{_folder.get() or shared_dir(spark) + '/tidemark'}/run-{uuid.uuid4().hex}"
    token = _folder.set(path)
    try:
        yield path
    finally:
        _folder.reset(token)
        delete(spark, path)
