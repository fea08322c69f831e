"""Error and ranking measures over scored rows. Where an order over all rows is needed, running sums by ranges do it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.workspace import Workspace
from .running import running_sums


def poisson_error(truth: Column, estimate: Column) -> Column:
    """2 (e - t - t ln(e / t)), and 2 e for t = 0; null where an estimate is not positive but the truth is."""
    some = F.when(estimate > 0, 2.0 * (estimate - truth - truth * F.ln(F.try_divide(estimate, truth))))
    return F.when(truth == 0, 2.0 * estimate).otherwise(some)


def error_stats(rows: DataFrame, truth: str, estimate: str, weight: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """mse, mae, mrse, mrae (relative to the estimate), srae and correlation, weighted if asked."""
    t, e = F.col(truth), F.col(estimate)
    w = F.col(weight) if weight else F.lit(1.0)
    miss, rel = t - e, F.try_divide(t - e, e)
    mean = lambda x: F.try_divide(F.sum(w * x), F.sum(w))
    cov = mean(t * e) - mean(t) * mean(e)
    spread = F.sqrt((mean(t * t) - mean(t) * mean(t)) * (mean(e * e) - mean(e) * mean(e)))
    return rows.groupBy(*by).agg(mean(miss * miss).alias("mse"), mean(F.abs(miss)).alias("mae"), mean(rel * rel).alias("mrse"), mean(F.abs(rel)).alias("mrae"), F.sum(F.abs(rel)).alias("srae"), F.try_divide(cov, spread).alias("correlation"))


def squares(rows: DataFrame, numerator: str, denominator: str, estimate: str, by: tuple[str, ...] = (), more: tuple[Column, ...] = ()) -> DataFrame:
    """rss, tss and r2 of numerators, and the same of the rows' ratios; ``estimate`` is a numerator; ``more`` are named aggregates. One pass over sums of squares."""
    n, d, e = F.col(numerator), F.col(denominator), F.col(estimate)
    r, f = F.try_divide(n, d), F.try_divide(e, d)
    sums = rows.groupBy(*by).agg(F.sum((n - e) * (n - e)).alias("rss"), (F.sum(n * n) - F.sum(n) * F.avg(n)).alias("tss"), F.sum((r - f) * (r - f)).alias("rss_ratio"), (F.sum(r * r) - F.sum(r) * F.avg(r)).alias("tss_ratio"), *more)
    return sums.select(*[c for c in sums.columns if c not in ("rss", "tss", "rss_ratio", "tss_ratio")], "rss", "tss", (1.0 - F.try_divide("rss", "tss")).alias("r2"), "rss_ratio", "tss_ratio", (1.0 - F.try_divide("rss_ratio", "tss_ratio")).alias("r2_ratio"))


def gini(rows: DataFrame, value: str, work: Workspace | None = None) -> DataFrame:
    """One row: 2 sum(i x_(i)) / (n sum(x)) - 1 with x rising. Equal values share a place's sum, so they are counted first."""
    levels = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("k"))
    placed = running_sums(levels, [F.col("x")], {"upto": F.col("k")}, work)
    # places upto - k + 1 .. upto sum to k (2 upto - k + 1) / 2
    sums = placed.agg(F.sum(F.col("x") * F.col("k") * (2 * F.col("upto") - F.col("k") + 1)).alias("a"), F.sum(F.col("x") * F.col("k")).alias("s"), F.sum("k").cast("double").alias("n"))
    return sums.select((F.try_divide("a", F.col("n") * F.col("s")) - 1.0).alias("gini"))


def _lorenz(rows: DataFrame, order: str, truth: str, work: Workspace | None) -> tuple[float, float, float]:
    """Sum over rows, by falling order, of cumulative share of truth less share of rows; rows of equal order stand as one block, each with the block's mean."""
    levels = rows.groupBy(F.col(order).cast("double").alias("o")).agg(F.sum(truth).cast("double").alias("t"), F.count(F.lit(1)).cast("double").alias("k"))
    placed = running_sums(levels, [F.col("o").desc()], {"ct": F.col("t"), "ck": F.col("k")}, work)
    # within a block of k rows the cumulative truth rises evenly: its sum is k (ct - t) + t (k + 1) / 2
    row = placed.agg(F.sum(F.col("k") * (F.col("ct") - F.col("t")) + F.col("t") * (F.col("k") + 1) / 2), F.sum("t"), F.sum("k")).first()
    return float(row[0] or 0.0), float(row[1] or 0.0), float(row[2] or 0.0)


def normalized_gini(rows: DataFrame, truth: str, estimate: str, work: Workspace | None = None) -> DataFrame:
    """One row: gini of truth ordered by falling estimate, of the perfect order, and their ratio."""
    def value(order: str) -> float:
        a, t, n = _lorenz(rows, order, truth, work)
        return a / t - (n + 1) / 2 if t else 0.0

    got, best = value(estimate), value(truth)
    return rows.sparkSession.createDataFrame([(got, best, got / best if best else None)], "gini double, perfect double, normalized double")


def error_histogram(rows: DataFrame, truth: str, estimate: str, step: float = 0.001, top: float = 1.0) -> DataFrame:
    """bin, upto, n, cumulative: rows by absolute error relative to the estimate; the last bin holds all above ``top``."""
    bins = round(top / step)
    rel = F.abs(F.try_divide(F.col(truth) - F.col(estimate), F.col(estimate)))
    place = F.coalesce(F.least(F.floor(rel / step), F.lit(bins)), F.lit(bins)).cast("int")
    counts = rows.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # at most bins + 1 rows
    return counts.select("bin", (F.when(F.col("bin") < bins, (F.col("bin") + 1) * step)).alias("upto"), "n", F.sum("n").over(upto).alias("cumulative"))


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    return rows.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def accuracy(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    return rows.agg(F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("accuracy"), F.avg((F.col(truth) != F.col(predicted)).cast("double")).alias("error"))


def quadratic_kappa(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: 1 - observed over expected squared distances of whole-number classes, from moments alone."""
    t, p = F.col(truth).cast("double"), F.col(predicted).cast("double")
    seen = F.avg((t - p) * (t - p))
    chance = F.avg(t * t) + F.avg(p * p) - 2 * F.avg(t) * F.avg(p)
    return rows.agg((1.0 - F.try_divide(seen, chance)).alias("kappa"))


def roc(rows: DataFrame, truth: str, score: str, work: Workspace | None = None) -> DataFrame:
    """score, tp, fp, tpr, fpr at each different score, from the highest down; truth is 0 or 1."""
    levels = rows.groupBy(F.col(score).cast("double").alias("score")).agg(F.sum(truth).cast("double").alias("p"), F.sum(1 - F.col(truth)).cast("double").alias("n"))
    placed = running_sums(levels, [F.col("score").desc()], {"tp": F.col("p"), "fp": F.col("n")}, work)
    totals = levels.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    return placed.crossJoin(F.broadcast(totals)).select("score", "p", "n", "tp", "fp", F.try_divide("tp", "all_p").alias("tpr"), F.try_divide("fp", "all_n").alias("fpr"))  # one row on the right side


def auc(rows: DataFrame, truth: str, score: str, work: Workspace | None = None) -> DataFrame:
    """One row: the area under the ROC curve by trapezoids, ties as half."""
    curve = roc(rows, truth, score, work)
    return curve.agg(F.try_divide(F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2)), F.sum("p") * F.sum("n")).alias("auc"))


def hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """The upper convex hull of ROC points (fpr, tpr), of a curve already thinned to scores."""
    out: list[tuple[float, float]] = []
    for p in sorted({(0.0, 0.0), (1.0, 1.0), *points}):
        while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) >= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
            out.pop()
        out.append(p)
    return out
