"""Claims reserving: triangles, chain ladder, and models for each development year."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.running import first_at_least, running_sums, weighted_quantiles
from ..settings import ModelSettings
from ..sources.workspace import Workspace
from .prepare import encode
from .tree import fit_tree, with_leaf


def triangle(payments: DataFrame, origin: str = "origin", dev: str = "dev", amount: str = "amount", by: tuple[str, ...] = ()) -> DataFrame:
    """by, origin, dev, paid, cum: payments of each origin and development year, cumulated; years without payments are filled in up to the latest calendar year."""
    paid = payments.groupBy(*by, origin, dev).agg(F.sum(amount).alias("paid")).select(*by, F.col(origin).alias("origin"), F.col(dev).alias("dev"), "paid")
    last = paid.agg(F.max(F.col("origin") + F.col("dev")).alias("last"))
    origins = paid.select(*by, "origin").distinct().crossJoin(F.broadcast(last))  # one row on the right side
    cells = origins.select(*by, "origin", F.explode(F.sequence(F.lit(0), (F.col("last") - F.col("origin")).cast("int"))).alias("dev"))
    full = cells.join(paid, [*by, "origin", "dev"], "left").fillna(0.0, ["paid"])
    return full.withColumn("cum", F.sum("paid").over(Window.partitionBy(*by, "origin").orderBy("dev").rowsBetween(Window.unboundedPreceding, 0)))


def wide_triangle(rows: DataFrame, origin: str, columns: list[str]) -> DataFrame:
    """origin, dev, cum: sums of cumulative columns by origin year, as a long table."""
    sums = rows.groupBy(F.col(origin).alias("origin")).agg(*[F.sum(c).alias(c) for c in columns])
    return sums.select("origin", F.posexplode(F.array(*columns)).alias("dev", "cum"))


def factors(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, dev, factor, to_ultimate: of each step from dev to dev + 1, over the origins that have both; cells(by, origin, dev, cum) are a triangle's known part."""
    ahead = cells.withColumn("_next", F.lead("cum").over(Window.partitionBy(*by, "origin").orderBy("dev"))).where("_next is not null")
    steps = ahead.groupBy(*by, "dev").agg(F.coalesce(F.try_divide(F.sum("_next"), F.sum("cum")), F.lit(1.0)).alias("factor"))
    rest = Window.partitionBy(*by).orderBy(F.desc("dev")).rowsBetween(Window.unboundedPreceding, 0)  # a row for each development year
    return steps.withColumn("to_ultimate", F.aggregate(F.collect_list("factor").over(rest), F.lit(1.0), lambda a, x: a * x))


def chain_ladder(cells: DataFrame, by: tuple[str, ...] = (), tail: float = 1.0) -> DataFrame:
    """by, origin, dev, paid, factor, ultimate, reserve for each origin year."""
    latest = cells.groupBy(*by, "origin").agg(F.max_by("cum", "dev").alias("paid"), F.max("dev").alias("dev"))
    steps = factors(cells, by).select(*by, "dev", "to_ultimate")
    out = latest.join(steps, [*by, "dev"], "left").withColumn("factor", F.coalesce("to_ultimate", F.lit(1.0)) * tail)
    return out.select(*by, "origin", "dev", "paid", "factor", (F.col("paid") * F.col("factor")).alias("ultimate"), (F.col("paid") * F.col("factor") - F.col("paid")).alias("reserve"))


def totals(rows: DataFrame, key: str) -> DataFrame:
    """``chain_ladder`` rows with a total (null key): sums, and the factor they imply."""
    return rows.rollup(key).agg(F.sum("paid").alias("paid"), F.sum("ultimate").alias("ultimate"), F.sum("reserve").alias("reserve")).withColumn("factor", F.try_divide("ultimate", "paid"))


def paid_to_date(rows: DataFrame, year: str, columns: list[str], last: int) -> DataFrame:
    """``rows`` with paid: the cumulative column of the last known development year."""
    place = F.least(F.lit(last) - F.col(year) + 1, F.lit(len(columns))).cast("int")
    return rows.withColumn("paid", F.when(place >= 1, F.element_at(F.array(*columns), F.greatest(place, F.lit(1)))).otherwise(F.lit(0.0)))


def row_ultimates(rows: DataFrame, paid: str, ratios: str, start: str) -> DataFrame:
    """``rows`` with ultimate: paid over the product of an array's ratios (known over next) from a 1-based place on."""
    rest = F.expr(f"slice(`{ratios}`, `{start}`, greatest(size(`{ratios}`) - `{start}` + 1, 0))")
    return rows.withColumn("ultimate", F.aggregate(rest, F.col(paid).cast("double"), lambda a, x: F.try_divide(a, x)))


def reported(rows: DataFrame, year: str, delay: str, last: int) -> DataFrame:
    return rows.where(F.col(year) + F.col(delay) <= last)


def monotone(columns: list[str]):  # noqa: ANN201
    """Whether a row's columns never fall."""
    values = F.array(*columns)
    return F.array_sort(values) == values


def compare(truth: DataFrame, estimate: DataFrame, chain: DataFrame, by: str) -> DataFrame:
    """by, truth, estimate, chain and their relative errors, joined on the key."""
    out = truth.join(estimate, by, "full").join(chain, by, "full")
    return out.withColumn("estimate_error", F.try_divide(F.col("estimate") - F.col("truth"), "truth")).withColumn("chain_error", F.try_divide(F.col("chain") - F.col("truth"), "truth"))


def concentration(rows: DataFrame, amount: str, points: list[float], work: Workspace | None = None) -> DataFrame:
    """share, amount_share: what the largest claims, so large a share of all, have of the total amount; equal amounts stand together."""
    levels = rows.groupBy(F.col(amount).cast("double").alias("a")).agg(F.count(F.lit(1)).cast("double").alias("k"))
    placed = running_sums(levels, [F.col("a").desc()], {"ck": F.col("k"), "ca": F.col("a") * F.col("k")}, work)
    n, total = placed.agg(F.max("ck"), F.sum(F.col("a") * F.col("k"))).first()
    parts = [F.max(F.when((F.col("ck") - F.col("k") < p * n) & (F.col("ck") >= p * n), F.col("ca") - (F.col("ck") - p * n) * F.col("a"))).alias(f"p{i}") for i, p in enumerate(points)]
    row = placed.agg(*parts).first()
    return rows.sparkSession.createDataFrame([(float(p), float(row[i] or 0.0) / total) for i, p in enumerate(points)], "share double, amount_share double")


def quantile_groups(rows: DataFrame, value: str, groups: int, name: str = "group") -> DataFrame:
    """``rows`` with a group from 1 by the value's quantiles; equal values are never parted."""
    bounds = weighted_quantiles(rows.withColumn("_one", F.lit(1.0)), value, "_one", [i / groups for i in range(1, groups)])
    return rows.withColumn(name, first_at_least(F.col(value), bounds))


def corrected_errors(rows: DataFrame, truth: str, estimate: str, total: float, shares: list[float]) -> DataFrame:
    """share, error: lower quantiles of estimate less truth, with estimates scaled to a total; no task holds all errors."""
    scale = total / rows.agg(F.sum(estimate)).first()[0]
    errors = rows.select((F.col(estimate) * scale - F.col(truth)).alias("e"), F.lit(1.0).alias("w"))
    found = weighted_quantiles(errors, "e", "w", shares)
    return rows.sparkSession.createDataFrame(list(zip(map(float, shares), found, strict=True)), "share double, error double")


def development_trees(claims: DataFrame, year: str, columns: list[str], numeric: list[str], categorical: list[str], last: int, settings: ModelSettings) -> list:
    """A tree for each development year: the known payments of the year before over those of the year, on claims that have both."""
    trees = []
    for k in range(1, len(columns)):
        before, after = F.col(columns[k - 1]).cast("double"), F.col(columns[k]).cast("double")
        rows = claims.where((F.col(year) <= last - k) & (after > 0)).select(
            F.hex(F.xxhash64(*claims.columns)).alias("key"), before.alias("numerator"), after.alias("denominator"), F.lit(1.0).alias("weight"),
            F.lit(True).alias("is_train"), *[F.col(c).cast("double").alias(c) for c in numeric], *[F.col(c).cast("string").alias(c) for c in categorical])
        trees.append(fit_tree(encode(rows, numeric, categorical, settings.max_splitting_points), settings))
    return trees


def tree_ultimates(claims: DataFrame, trees: list, year: str, columns: list[str], last: int) -> DataFrame:
    """``claims`` with paid, ratios (one for each development year) and ultimate."""
    paid = paid_to_date(claims, year, columns, last)
    names = [f"_ratio{i}" for i in range(len(trees))]
    for name, tree in zip(names, trees, strict=True):
        paid = with_leaf(paid, tree, {name: lambda n: float(n.ratio)})
    paid = paid.withColumn("ratios", F.array(*names)).drop(*names)
    return row_ultimates(paid.withColumn("_start", (F.lit(last) - F.col(year) + 1).cast("int")), "paid", "ratios", "_start").drop("_start")


def with_offset(rows: DataFrame, model: str, fitted: str, name: str = "combined") -> DataFrame:
    """The estimate of a model of residuals times the estimate it started from."""
    return rows.withColumn(name, F.col(model) * F.col(fitted))
