"""Shards by jump consistent hashing (Lamping and Veach, 2014): no table of places, and a new shard takes only its own share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import numbered
from .scratch import Scratch
from .textscan import U, mix


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key."""
    key = keys.astype(U)
    shard = np.zeros(len(key), dtype=np.int64)
    b = np.full(len(key), -1, dtype=np.int64)
    j = np.zeros(len(key), dtype=np.int64)
    live = np.arange(len(key))
    while len(live):
        b[live] = j[live]
        key[live] = key[live] * U(2862933555777941757) + U(1)
        j[live] = ((b[live] + 1) * (float(1 << 31) / ((key[live] >> U(33)) + U(1)).astype(np.float64))).astype(np.int64)
        live = live[j[live] < shards]
    shard[:] = b
    return shard


def shard_of(key, shards: int):
    """A column with the shard of each value of a long column; null counts as 0. The key's bits are mixed first, as ids may be dense."""

    @F.pandas_udf("int")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(jump(mix(part.fillna(0).to_numpy(np.int64).view(U)), shards).astype(np.int32))

    return of(key)


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """One row for each row of ``docs(doc_id, text, ...)``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``key``: doc_id and the number of shards alone decide, whatever else the table holds, so copies under other ids
    and hot sources spread like all rows. grown_shard is the place with one shard more: the same, or the new one. size is the
    text's UTF-8 bytes plus 1 (null: 1); slot numbers a shard's rows without gaps, repeated rows one by one. A null doc_id
    counts as key 0. Texts of any length are only measured and summed where they are read; further columns are not read. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "shards")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.withColumn("shard", shard_of(F.col("doc_id"), shards)).withColumn("grown_shard", shard_of(F.col("doc_id"), shards + 1))
    rows = numbered(scratch.put(rows), ["shard"], ["doc_id", "text_crc32", "size"], "slot")
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
