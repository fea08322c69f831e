"""Running sums and weighted quantiles over tables of any size, without a task that sees all rows.

Rows are dealt by ranges of the order; each range's totals, one row a range, tell what comes before it. The dealt rows are
written once, so that every later use sees the same ranges.
"""

from __future__ import annotations

import bisect

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.workspace import Workspace


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, Column], work: Workspace | None = None) -> DataFrame:
    """``df`` with running sums (the row itself included) in ``order``, named by the keys of ``sums``. Rows of equal order follow each other in no stated order."""
    work = work or Workspace(df.sparkSession)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = df.withColumns({f"_v_{k}": v.cast("double") for k, v in sums.items()})
    dealt = work.write(named.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    totals = dealt.groupBy("_range").agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums])
    # one row for each range: at most as many as there are shuffle partitions
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_range", *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0.0)).alias(f"_o_{k}") for k in sums])
    here = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.join(F.broadcast(offsets), "_range").withColumns({k: F.col(f"_o_{k}") + F.sum(f"_v_{k}").over(here) for k in sums})
    return out.drop("_range", *[f"_{a}_{k}" for k in sums for a in "vo"])


def ranked(df: DataFrame, column: str, name: str, work: Workspace | None = None) -> DataFrame:
    """``df`` with the place of its value among the different values of ``column``, from 1; null has none. The values are numbered by ranges and joined back."""
    values = df.select(F.col(column).alias("_value")).where("_value is not null").distinct()
    places = running_sums(values, [F.col("_value")], {"_place": F.lit(1.0)}, work).select("_value", F.col("_place").cast("int").alias(name))
    return df.join(places, df[column] == places["_value"], "left").drop("_value")


#: Tables of at most so many different values are summed on the driver, of which they take some megabytes; larger ones by ranges, with the same result.
DRIVER_VALUES = 200_000


def all_weighted_quantiles(df: DataFrame, values: list[str], weight: str, shares: list[float], work: Workspace | None = None) -> dict[str, list[float]]:
    """For each column its lower weighted quantiles: for each share p the least value whose running weight is at least p times the total; then its greatest value.

    Null values and rows without weight are left out; a column without values gets an empty list. All columns are counted in one pass.
    """
    if work is None:
        work = Workspace(df.sparkSession)
        try:
            return all_weighted_quantiles(df, values, weight, shares, work)
        finally:
            work.delete()
    pairs = ", ".join(f"'{i}', cast(`{v}` as double)" for i, v in enumerate(values))
    long = df.select(F.col(weight).cast("double").alias("w"), F.expr(f"stack({len(values)}, {pairs}) as (k, v)")).where("v is not null and w > 0")
    levels = work.write(long.groupBy("k", "v").agg(F.sum("w").alias("w")))
    out = {}
    if levels.count() <= DRIVER_VALUES:
        found = levels.toArrow().to_pandas().sort_values("v")
        for i, name in enumerate(values):
            part = found[found.k == str(i)]
            v, cum = part.v.to_numpy(), part.w.to_numpy().cumsum()
            at = np.searchsorted(cum, np.array(shares) * (cum[-1] if len(cum) else 0.0) * (1 - 1e-12))
            out[name] = [*v[np.minimum(at, len(v) - 1)].tolist(), float(v[-1])] if len(v) else []
        return out
    for i, name in enumerate(values):
        part = levels.where(F.col("k") == str(i))
        total, top = part.agg(F.sum("w"), F.max("v")).first()
        if total is None:
            out[name] = []
            continue
        bounds = [p * total * (1 - 1e-12) for p in shares]
        summed = running_sums(part, [F.col("v")], {"cum": F.col("w")}, work)
        # the rows on which a bound is first reached, and by rounding perhaps one more for each share
        rows = sorted((r["cum"], r["v"]) for r in summed.where(F.exists(F.array(*map(F.lit, bounds)), lambda b: (b <= F.col("cum")) & (b >= (F.col("cum") - F.col("w")) * (1 - 1e-9)))).select("cum", "v").collect())
        cums = [c for c, _ in rows]
        out[name] = [*(rows[min(bisect.bisect_left(cums, b), len(rows) - 1)][1] for b in bounds), top]
    return out


def weighted_quantiles(df: DataFrame, value: str, weight: str, shares: list[float], work: Workspace | None = None) -> list[float]:
    """The quantiles of one column, without its greatest value."""
    return all_weighted_quantiles(df, [value], weight, shares, work)[value][:-1]


def first_at_least(value: Column, bounds: list[float]) -> Column:
    """The 1-based place of the first bound that is at least ``value``, the number of bounds plus 1 if none is: a halving tree of comparisons."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo + 1)
        middle = (lo + hi) // 2
        return F.when(value <= F.lit(float(bounds[middle])), tree(lo, middle)).otherwise(tree(middle + 1, hi))

    if len(bounds) <= 32:
        return tree(0, len(bounds))
    # a long tree would pass the JVM's limit for a method: halve down to a short part of the bounds, and count the smaller ones there
    part = max(16, -(-len(bounds) // 32))
    firsts = list(range(0, len(bounds), part))
    pieces = F.array(*[F.array(*[F.lit(float(b)) for b in bounds[a : a + part]]) for a in firsts])

    def which(lo: int, hi: int) -> Column:
        if hi - lo == 1:
            return F.lit(lo + 1)
        middle = (lo + hi) // 2
        return F.when(value <= F.lit(float(bounds[firsts[middle] - 1])), which(lo, middle)).otherwise(which(middle, hi))

    at = which(0, len(firsts))
    return F.size(F.filter(F.element_at(pieces, at), lambda b: b < value)) + (at - 1) * F.lit(part) + F.lit(1)
