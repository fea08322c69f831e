"""Gapless numbers within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with a number from 0 within each group, without gaps.

    A group is dealt over as many parts as there are shuffle partitions by a hash of ``order``; the parts' sizes, summed in
    turn, tell where each part begins, so that no task sorts a whole group. ``rows`` is read twice.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("_part", F.expr(f"pmod(xxhash64({', '.join(order)}), {parts})").cast("int"))
    keys = ", ".join([*group, "_part"])
    sizes = rows.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_c"))
    begins = sizes.withColumn("_begin", F.expr(f"coalesce(sum(_c) over (partition by {', '.join(group)} order by _part rows between unbounded preceding and 1 preceding), 0)")).drop("_c")
    at = F.expr(f"row_number() over (partition by {keys} order by {', '.join(order)}) - 1")
    return rows.withColumn("_at", at).join(begins, [*group, "_part"]).withColumn(name, (F.col("_at") + F.col("_begin")).cast("long")).drop("_at", "_begin", "_part")
