"""Intermediate tables in the folder that all executors share: an executor that is lost takes no finished work with it."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Workspace:
    """Tables of one run below ``spark.checkpoint.dir``; in local mode without that setting, below a new temporary folder. They go by ``delete``, or when the driver ends."""

    def __init__(self, spark: SparkSession):
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="workspace-")
        self.spark = spark
        self.root = f"{folder.rstrip('/')}/ratio-{uuid.uuid4().hex}"
        self._made = 0

    def write(self, df: DataFrame) -> DataFrame:
        """``df`` as it was written, without its lineage."""
        if not self._made:
            atexit.register(self.delete)
        self._made += 1
        path = f"{self.root}/{self._made}"
        df.write.parquet(path)
        read = self.spark.read.schema(df.schema).parquet(path)
        read._workspace_path = path
        return read

    def drop(self, read: DataFrame) -> None:
        """Delete one table that ``write`` returned and that no later step reads."""
        if path := getattr(read, "_workspace_path", ""):
            self._remove(path)

    def delete(self) -> None:
        if self._made:
            atexit.unregister(self.delete)
            self._made = 0
            self._remove(self.root)

    def _remove(self, place: str) -> None:
        jvm = self.spark.sparkContext._jvm
        if jvm is None or self.spark.sparkContext._jsc is None:
            return  # the session has ended; the folder's owner removes the rest
        path = jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
