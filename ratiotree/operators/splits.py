"""The search for the best split of nodes, from their level sums.

``candidates`` is the search as a query, for one table of level sums of any origin. ``best_split`` is the same on arrays, for the
tree builder, which has collected the sums of its open nodes: at most the levels of all features for each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.criteria import CRITERIA, SUMS, ArrayMath, ColumnMath, Side


#: All subsets of more levels are not tried, but refused.
MOST_SUBSET_LEVELS = 16
#: Values that agree in so many digits are ties, so that the order of sums does not decide.
DIGITS = 10


def settled(value: float) -> float:
    return float(f"{value:.{DIGITS - 1}e}")


@dataclass
class Split:
    feature: str
    numeric: bool
    left: list[int]  # codes, in the order of the search
    value: float
    left_weight: float
    right_weight: float


def _sides(df: DataFrame, sums: list[str]) -> tuple[Side, Side, Side]:
    left = Side(**{s: F.col(f"l_{s}") for s in sums})
    total = Side(**{s: F.col(f"t_{s}") for s in sums})
    return left, Side(**{s: F.col(f"t_{s}") - F.col(f"l_{s}") for s in sums}), total


def _valued(df: DataFrame, criterion: str, sums: list[str], least: float) -> DataFrame:
    """``df`` with l_ and t_ sums, reduced to splits whose sides both weigh more than ``least`` (a share of the node's weight if negative)."""
    bound = F.lit(float(least)) if least >= 0 else F.col("t_w") * -least
    fit = df.where((F.col("l_w") > bound) & (F.col("t_w") - bound > F.col("l_w")))
    return fit.withColumn("value", CRITERIA[criterion].value(*_sides(fit, sums), ColumnMath)).where("value is not null and not isnan(value)")


def candidates(levels: DataFrame, criterion: str, least: float = -0.1, by_mean: bool = False) -> DataFrame:
    """node, feature, level, place, wl, wr, value: each split that puts the levels up to ``level`` to the left, in level order or in the order of their ratios."""
    sums = [s for s in SUMS if s in ("c", "n", "d", "w") or s in CRITERIA[criterion].sums]
    group = Window.partitionBy("node", "feature")
    order = [F.try_divide("n", "d").asc_nulls_last(), F.col("level")] if by_mean else [F.col("level")]
    run = group.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = levels.withColumns({f"l_{s}": F.sum(s).over(run) for s in sums} | {f"t_{s}": F.sum(s).over(group) for s in sums} | {"place": F.row_number().over(group.orderBy(*order))})
    return _valued(placed, criterion, sums, least).select("node", "feature", "level", "place", F.col("l_w").alias("wl"), (F.col("t_w") - F.col("l_w")).alias("wr"), "value")


def subset_candidates(levels: DataFrame, criterion: str, least: float = -0.1) -> DataFrame:
    """node, feature, mask, wl, wr, value: each bipartition of a feature's levels; bit i of ``mask`` is set if the level of place i (from 0) is left, the last never is.

    Their number doubles with each level, so a feature of more than MOST_SUBSET_LEVELS stops the query; ``candidates`` with ``by_mean`` is for those.
    """
    sums = [s for s in SUMS if s in ("c", "n", "d", "w") or s in CRITERIA[criterion].sums]
    group = Window.partitionBy("node", "feature")
    placed = levels.withColumn("place", F.row_number().over(group.orderBy("level")) - 1).withColumn("k", F.count(F.lit(1)).over(group))
    placed = placed.where("k >= 2").withColumns({f"t_{s}": F.sum(s).over(group) for s in sums})
    refused = F.raise_error(F.concat(F.lit(f"more than {MOST_SUBSET_LEVELS} levels, too many to try all subsets: "), F.col("feature").cast("string"))).cast("int")
    top = F.when(F.col("k") > MOST_SUBSET_LEVELS, refused).otherwise(F.expr("cast(pow(2, k - 1) as int) - 1"))
    masks = placed.withColumn("mask", F.explode(F.sequence(F.lit(1), top)))
    left = masks.groupBy("node", "feature", "mask").agg(*[F.sum(F.expr(f"if((shiftright(mask, place) & 1) = 1, {s}, 0D)")).alias(f"l_{s}") for s in sums], *[F.first(f"t_{s}").alias(f"t_{s}") for s in sums])
    return _valued(left, criterion, sums, least).select("node", "feature", "mask", F.col("l_w").alias("wl"), (F.col("t_w") - F.col("l_w")).alias("wr"), "value")


def best_of(found: DataFrame, order: list[str], by: tuple[str, ...] = ("node",)) -> DataFrame:
    """The candidate of the greatest value of each group; ties go to the first in ``order``."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("value"), *order))
    return found.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def gray_masks(k: int) -> list[int]:
    """All proper bipartitions of k levels, the last one always right; neighbours differ in one level."""
    return [i ^ (i >> 1) for i in range(1, 1 << (k - 1))]


def feature_splits(sums: dict[str, np.ndarray], codes: np.ndarray, numeric: bool, criterion: str, least: float, sort_above: int, pool: int) -> list[tuple[float, list[int], float]]:
    """(value, left codes, left weight) of all feasible splits of one feature in one node. Levels without rows are not among ``codes``."""
    k = len(codes)
    if k < 2:
        return []
    if numeric or pool > sort_above:
        if numeric:
            order = np.argsort(codes, kind="stable")
        else:
            ratio = ArrayMath.div(sums["n"], sums["d"])
            order = np.lexsort((codes, np.where(np.isnan(ratio), np.inf, ratio)))
        left = {s: np.cumsum(v[order])[:-1] for s, v in sums.items()}
        sets = [order[: i + 1] for i in range(k - 1)]
    else:
        masks = np.array(gray_masks(k))
        member = (masks[:, None] >> np.arange(k)) & 1
        left = {s: member @ v for s, v in sums.items()}
        sets = [np.flatnonzero(m) for m in member]
    total = {s: v.sum() for s, v in sums.items()}
    with np.errstate(all="ignore"):
        value = CRITERIA[criterion].value(Side(**left), Side(**{s: total[s] - left[s] for s in left}), Side(**{s: np.asarray(v) for s, v in total.items()}), ArrayMath)
        fit = (left["w"] > least) & (total["w"] - least > left["w"]) & np.isfinite(value)
    return [(settled(float(value[i])), [int(codes[j]) for j in sets[i]], float(left["w"][i])) for i in np.flatnonzero(fit)]


def all_splits(node: dict[str, tuple[np.ndarray, dict[str, np.ndarray]]], numeric: set[str], pools: dict[str, int], criterion: str, least: float, sort_above: int) -> list[Split]:
    """Every feasible split of every feature of a node, the best first; ties in the order of features and search."""
    found = []
    for feature, (codes, sums) in node.items():
        weight = float(sums["w"].sum())
        found += [Split(feature, feature in numeric, left, value, wl, weight - wl) for value, left, wl in feature_splits(sums, codes, feature in numeric, criterion, least, sort_above, pools[feature])]
    return sorted(found, key=lambda s: -s.value)


def best_split(node: dict[str, tuple[np.ndarray, dict[str, np.ndarray]]], numeric: set[str], pools: dict[str, int], criterion: str, least: float, sort_above: int, top: float = 0.0, rng: np.random.Generator | None = None) -> Split | None:
    """The best split over features: greatest value, ties to the earlier feature and the earlier split. With ``top``, one of the best so large share, by ``rng``."""
    found: list[tuple[float, int, int, str, list[int], float, float]] = []
    for place, (feature, (codes, sums)) in enumerate(node.items()):
        splits = feature_splits(sums, codes, feature in numeric, criterion, least, sort_above, pools[feature])
        if not splits:
            continue
        weight = float(sums["w"].sum())
        if not top:
            i = int(np.argmax([v for v, _, _ in splits]))
            splits = [splits[i]]
        found += [(-v, place, i, feature, left, wl, weight - wl) for i, (v, left, wl) in enumerate(splits)]
    if not found:
        return None
    found.sort(key=lambda x: x[:3])
    at = min(len(found), max(1, int(np.ceil(rng.random() * top * len(found))))) - 1 if top and rng is not None else 0
    value, _, _, feature, left, wl, wr = found[at]
    is_numeric = feature in numeric
    if not is_numeric and wl > wr:  # the lighter side is left, so that levels not seen here go with the heavier one
        left = [int(c) for c in node[feature][0] if int(c) not in set(left)]
        wl, wr = wr, wl
    return Split(feature, is_numeric, left, -value, wl, wr)
