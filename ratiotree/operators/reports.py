"""Aggregations of scored rows: bands, segments, single features, two-way tables, and the measures drawn from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import error_histogram, gini, normalized_gini, poisson_error, squares
from ..functions.running import first_at_least
from ..sources.workspace import Workspace

#: Measures of a run, and whether the greatest or the least is best.
MEASURES = {
    "correlation": max, "lift_trn": max, "lift_val": max, "reversals_trn": min, "reversals_val": min, "std_trn": max, "std_val": max, "std_ratio": max,
    "rel_diff": min, "rel_diff_fitted": min, "min_relativity_trn": min, "max_relativity_trn": max, "min_observed_trn": min, "max_observed_trn": max,
    "min_relativity_val": min, "max_relativity_val": max, "min_observed_val": min, "max_observed_val": max, "normalized_gini_trn": max, "normalized_gini_val": max,
    "gini_trn": max, "gini_val": max, "r2_ratio_trn": max, "r2_ratio_val": max, "r2_trn": max, "r2_val": max, "rss_ratio_trn": min, "rss_ratio_val": min,
    "rss_trn": min, "rss_val": min, "poisson_error_trn": min, "poisson_error_val": min}


def band(score: Column, starts: list[int]) -> Column:
    """The 1-based band of a score; each band begins at its start."""
    return first_at_least(score, [float(s) - 0.5 for s in starts[1:]])


def band_label(starts: list[int], scores: int) -> list[str]:
    ends = [*(s - 1 for s in starts[1:]), scores]
    return [f"{a}-{b}" for a, b in zip(starts, ends, strict=True)]


def grouped_stats(rows: DataFrame, group: str, estimate: str) -> DataFrame:
    """``group`` (null for the total), is_train, weight, numerator, denominator, observed, estimated, fitted, relativity.

    ``estimate`` is a ratio. Rows are summed by part and group, those sums rolled up; relativity is the observed ratio over that of all rows of the same part.
    """
    by = rows.groupBy("is_train", group).agg(F.sum("weight").alias("weight"), F.sum("numerator").alias("numerator"), F.sum("denominator").alias("denominator"), F.sum(F.col(estimate) * F.col("denominator")).alias("estimated"))
    sums = by.rollup("is_train", group).agg(F.grouping(group).alias("_total"), *[F.sum(c).alias(c) for c in ("weight", "numerator", "denominator", "estimated")])
    sums = sums.where("is_train is not null").withColumn("observed", F.try_divide("numerator", "denominator"))
    whole = Window.partitionBy("is_train")
    total = F.max(F.when(F.col("_total") == 1, F.col("observed"))).over(whole)
    return sums.select(F.when(F.col("_total") == 0, F.col(group)).alias(group), "is_train", "weight", "numerator", "denominator", "observed", "estimated", F.try_divide("estimated", "denominator").alias("fitted"), F.try_divide("observed", total).alias("relativity"))


def band_metrics(stats: DataFrame, group: str) -> DataFrame:
    """One row from ``grouped_stats``: correlation of the two parts' relativities; for each part lift (last relativity over first), reversals and
    std (the weighted variance of the observed ratios around the total), least and greatest relativity and observed ratio; the mean difference of relativities (rel_diff), and of validation
    relativities from training fitted ratios (rel_diff_fitted), both weighted by the estimates of training rows.
    """
    rows = stats.where(F.col(group).isNotNull())
    total = stats.where(F.col(group).isNull())
    value = lambda c, trn: F.max(F.when(F.col("is_train") == trn, F.col(c)))
    names = ("relativity", "observed", "fitted", "estimated", "weight")
    wide = rows.groupBy(group).agg(*[value(c, t).alias(f"{c}_{s}") for c in names for t, s in ((True, "trn"), (False, "val"))])
    whole = total.agg(value("observed", True).alias("_trn"), value("observed", False).alias("_val"))
    order = Window.orderBy(group)  # a row for each band, leaf or score
    wide = wide.crossJoin(F.broadcast(whole)).withColumns({f"_falls_{s}": (F.col(f"relativity_{s}") < F.lag(f"relativity_{s}").over(order)).cast("int") for s in ("trn", "val")})
    out = [F.corr("relativity_trn", "relativity_val").alias("correlation")]
    for s in ("trn", "val"):
        end = F.when(F.col(f"relativity_{s}").isNotNull(), F.struct(group, f"relativity_{s}"))
        miss = F.col(f"observed_{s}") - F.col(f"_{s}")
        out += [
            F.try_divide(F.max(end)[f"relativity_{s}"], F.min(end)[f"relativity_{s}"]).alias(f"lift_{s}"),
            F.coalesce(F.sum(f"_falls_{s}"), F.lit(0)).alias(f"reversals_{s}"),
            F.try_divide(F.sum(F.col(f"weight_{s}") * miss * miss), F.sum(f"weight_{s}")).alias(f"std_{s}"),
            *[f(f"{c}_{s}").alias(f"{n}_{c}_{s}") for n, f in (("min", F.min), ("max", F.max)) for c in ("relativity", "observed")]]
    mean = lambda x: F.try_divide(F.sum(x * F.col("estimated_trn")), F.sum("estimated_trn"))
    out += [mean(F.abs(F.col("relativity_trn") - F.col("relativity_val"))).alias("rel_diff"), mean(F.abs(F.col("relativity_val") - F.col("fitted_trn"))).alias("rel_diff_fitted")]
    return wide.agg(*out).withColumn("std_ratio", F.try_divide("std_val", "std_trn"))


def error_row(rows: DataFrame) -> dict:
    """Mean Poisson errors of rows with numerator, denominator, estimate and is_train."""
    error = poisson_error(F.col("numerator"), F.col("estimate") * F.col("denominator"))
    row = rows.agg(F.avg(F.when(F.col("is_train"), error)).alias("poisson_error_trn"), F.avg(F.when(~F.col("is_train"), error)).alias("poisson_error_val")).first()
    return row.asDict()


def measures_row(rows: DataFrame, group: str, ginis: bool = True) -> dict:
    """All measures of rows with numerator, denominator, weight, estimate (a ratio), is_train and a group: those of ``band_metrics``, Poisson errors, and
    for each part residual squares and R2 of numerators and of ratios, and the ginis; ``ginis`` False leaves those out, as they need an order over all rows.
    """
    out = band_metrics(grouped_stats(rows, group, "estimate"), group).first().asDict()
    guess = rows.withColumn("_guess", F.col("estimate") * F.col("denominator"))
    error = F.avg(poisson_error(F.col("numerator"), F.col("_guess"))).alias("poisson_error")
    found = {r["is_train"]: r for r in squares(guess, "numerator", "denominator", "_guess", ("is_train",), (error,)).collect()}  # both parts in one pass
    for s, trn in (("trn", True), ("val", False)):
        part = guess.where(F.col("is_train") == trn)
        out |= {f"{name}_{s}": found[trn][name] if trn in found else None for name in ("poisson_error", "r2_ratio", "r2", "rss_ratio", "rss")}
        if ginis:
            work = Workspace(rows.sparkSession)
            out[f"normalized_gini_{s}"] = normalized_gini(part, "numerator", "estimate", work).first()["normalized"]
            out[f"gini_{s}"] = gini(part, "_guess", work).first()["gini"]
            work.delete()
    return out


def numerator_errors(rows: DataFrame, truth: str, estimates: list[str], step: float = 0.001) -> DataFrame:
    """estimate, upto, n, share, cumulative: for each of several estimated numerators the rows by absolute error relative to the estimate, in steps up to 100 % and one bin above."""
    parts = [error_histogram(rows, truth, e, step).withColumn("estimate", F.lit(e)) for e in estimates]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    total = Window.partitionBy("estimate")  # at most 1 / step + 1 rows each
    return out.select("estimate", "bin", "upto", "n", F.try_divide("n", F.sum("n").over(total)).alias("share"), "cumulative")


def univariate(rows: DataFrame, features: list[str], estimate: str, score: str | None = None) -> DataFrame:
    """feature, level, weight, numerator, denominator, observed, fitted, difference, score: every level of every feature in one aggregate."""
    pairs = ", ".join(f"'{f}', cast(`{f}` as string)" for f in features)
    keep = ["weight", "numerator", "denominator", (F.col(estimate) * F.col("denominator")).alias("_est"), (F.col(score) if score else F.lit(None).cast("double")).alias("_score")]
    long = rows.select(*keep, F.expr(f"stack({len(features)}, {pairs}) as (feature, level)"))
    sums = long.groupBy("feature", "level").agg(F.sum("weight").alias("weight"), F.sum("numerator").alias("numerator"), F.sum("denominator").alias("denominator"), F.sum("_est").alias("_est"), F.round(F.avg("_score")).alias("score"))
    out = sums.withColumn("observed", F.try_divide("numerator", "denominator")).withColumn("fitted", F.try_divide("_est", "denominator"))
    return out.select("feature", "level", "weight", "numerator", "denominator", "observed", "fitted", (F.col("fitted") - F.col("observed")).alias("difference"), "score")


def random_group(key: Column, groups: int, seed: int) -> Column:
    return (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(groups)) + 1).cast("string")


def two_way(rows: DataFrame, by: list[Column], names: list[str], group: str, estimate: str) -> DataFrame:
    """variable, level, group, is_train, weight, numerator, denominator, observed, fitted."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("variable"), c.cast("string").alias("level")) for n, c in zip(names, by, strict=True)])).alias("p")
    long = rows.select("weight", "numerator", "denominator", "is_train", group, (F.col(estimate) * F.col("denominator")).alias("_est"), pairs).select("*", "p.*")
    sums = long.groupBy("variable", "level", group, "is_train").agg(F.sum("weight").alias("weight"), F.sum("numerator").alias("numerator"), F.sum("denominator").alias("denominator"), F.sum("_est").alias("_est"))
    return sums.select("variable", "level", group, "is_train", "weight", "numerator", "denominator", F.try_divide("numerator", "denominator").alias("observed"), F.try_divide("_est", "denominator").alias("fitted"))


def partial_dependence(df: DataFrame, feature: str, levels: list, predict, output: str = "fitted") -> DataFrame:  # noqa: ANN001
    """level, mean: the mean prediction if all rows had the level. Each row is scored once for each level, in one pass; only sums are shuffled."""
    kind = df.schema[feature].dataType
    wide = df.withColumn("_level", F.explode(F.array(*[F.lit(x).cast(kind) for x in levels]))).withColumn(feature, F.col("_level"))
    return predict(wide).groupBy(F.col("_level").alias("level")).agg(F.avg(output).alias("mean"))


def best(measures: DataFrame, name: str) -> DataFrame:
    """The row of the best iteration or model by a named measure; ties go to the first."""
    if name not in MEASURES:
        raise ValueError(f"no such measure: {name}")
    order = F.desc_nulls_last(name) if MEASURES[name] is max else F.asc_nulls_last(name)
    return measures.orderBy(order, measures.columns[0]).limit(1)


def stats_of_stats(measures: DataFrame, names: list[str]) -> DataFrame:
    """measure, mean, median, least, most, std, total over models or folds."""
    pairs = ", ".join(f"'{n}', cast(`{n}` as double)" for n in names)
    long = measures.select(F.expr(f"stack({len(names)}, {pairs}) as (measure, value)"))
    return long.groupBy("measure").agg(F.avg("value").alias("mean"), F.expr("percentile(value, 0.5)").alias("median"), F.min("value").alias("least"), F.max("value").alias("most"), F.stddev_samp("value").alias("std"), F.sum("value").alias("total"))


def iteration_errors(long: DataFrame, truth: str) -> DataFrame:
    """is_train, iteration, abs_error, error: sums of differences between estimates and truth for each iteration."""
    miss = F.col("estimate") - F.col(truth)
    return long.groupBy("is_train", "iteration").agg(F.sum(F.abs(miss)).alias("abs_error"), F.sum(miss).alias("error"))
