"""Intermediate tables in the folder that all executors share.

A table written there replaces the lineage before it: an executor that is lost takes no finished work with it.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; in local mode without that setting, a new temporary folder, which is then set."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="scratch-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


_LIVE: list[Scratch] = []


class Scratch:
    """The tables of one query. They go when the driver ends, or before by ``drop``, ``clear`` or at the end of ``released``."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._count = 0
        _LIVE.append(self)
        atexit.register(self.clear)

    def put(self, df: DataFrame) -> DataFrame:
        """Write ``df`` once and return a reader of what was written."""
        self._count += 1
        path = f"{self.root}/{self._count}"
        df.write.parquet(path)
        read = self.spark.read.schema(df.schema).parquet(path)
        read._scratch_path = path
        return read

    def drop(self, read: DataFrame | None) -> None:
        """Delete a table that ``put`` returned and that no later step reads."""
        path = getattr(read, "_scratch_path", "")
        if path.startswith(f"{self.root}/"):
            self._delete(path)

    def clear(self) -> None:
        """Delete all tables of this query."""
        if self in _LIVE:
            _LIVE.remove(self)
            atexit.unregister(self.clear)
            if self._count:
                self._delete(self.root)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        if jvm is None or self.spark.sparkContext._jsc is None:
            return
        try:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception as e:  # the session is gone; the folder's owner removes the rest
            if "NoSuchFile" not in str(e):
                return


@contextmanager
def released() -> Iterator[None]:
    """What queries called within put there is deleted at the end; their results must be written by then."""
    before = len(_LIVE)
    yield
    for scratch in _LIVE[before:]:
        scratch.clear()
