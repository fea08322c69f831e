"""Numbers for rows whose doc_id does not tell them apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def told_apart(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, bool]:
    """``docs(doc_id, text)`` with ``id``, different for each row and in the order of doc_id (null first), then of the text's sha256; and whether it is doc_id itself.

    Only ids and hashes are sampled for the order, never texts, and equal ids are dealt over tasks by their hashes.
    """
    if docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1 or doc_id is null").isEmpty():
        return docs.withColumn("id", F.col("doc_id")), True
    return scratch.put(docs.orderBy("doc_id", F.sha2(F.col("text").cast("binary"), 256)).withColumn("id", F.monotonically_increasing_id())), False
