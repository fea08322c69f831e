"""Scores: rows ranked by relativity into weighted quantiles, with observed and smoothed ratios for each."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.running import first_at_least, weighted_quantiles
from ..sources.workspace import Workspace


@dataclass
class ScoreTable:
    """A row for each different relativity range: ``bounds`` (half-way from its greatest relativity to the next one's least; the last has none), estimates, and
    its score. Scores run to the number asked for; a range that holds many quantiles has the first of their numbers.
    """

    bounds: list[float]
    numbers: list[int]
    observed: list[float]
    modelled: list[float]
    smoothed: list[float]
    weights: list[float] = field(default_factory=list)  # of the training rows of each range
    scores: int = 0  # the number asked for

    def filled(self) -> list[dict]:
        """A row for each score up to the number asked for: a range that holds the weight of several scores is repeated, with weight 0, until the next one's number."""
        out = []
        for i, first in enumerate(self.numbers):
            last = self.numbers[i + 1] - 1 if i + 1 < len(self.numbers) else self.scores
            for number in range(first if i else 1, last + 1):
                upto = self.bounds[i] if i < len(self.bounds) else None
                out.append({"score": number, "upto": upto, "weight": self.weights[i] if number == last else 0.0, "observed": self.observed[i], "modelled": self.modelled[i], "smoothed": self.smoothed[i]})
        return out

    def place(self, relativity: Column) -> Column:
        return F.least(first_at_least(relativity, self.bounds), F.lit(len(self.observed)))

    def look_up(self, place: Column, values: list) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), place)


def quantile_list(rows: DataFrame, relativity: str, weight: str, scores: int, work: Workspace | None = None) -> list[float]:
    """The weighted quantiles of the relativities at 1/scores, 2/scores, ... 1."""
    return weighted_quantiles(rows, relativity, weight, [i / scores for i in range(1, scores + 1)], work)


def local_line(y: np.ndarray, span: int) -> np.ndarray:
    """A moving regression line: at each place, of the values at most ``span`` away, weighted 1 - (distance / span)^2."""
    n = len(y)
    out = np.empty(n)
    x = np.arange(n, dtype=float)
    for i in range(n):
        lo, hi = max(0, i - span), min(n, i + span + 1)
        w = 1 - ((x[lo:hi] - i) / (span + 1)) ** 2
        mx, my = np.average(x[lo:hi], weights=w), np.average(y[lo:hi], weights=w)
        sxx = (w * (x[lo:hi] - mx) ** 2).sum()
        out[i] = my + ((w * (x[lo:hi] - mx) * (y[lo:hi] - my)).sum() / sxx * (i - mx) if sxx else 0.0)
    return out


def smooth(values: np.ndarray, passes: int = 30) -> np.ndarray:
    """A rising curve through the values: smoothed once, again while more than max(10, n / 100) steps fall, then never falling."""
    span = max(1, min(50, int(np.ceil(0.05 * len(values)))))
    out = local_line(values, span)
    for _ in range(passes - 1):
        if (np.diff(out) < 0).sum() <= max(10, len(out) / 100):
            break
        out = local_line(out, span)
    return np.maximum.accumulate(out)


def score_table(rows: DataFrame, scores: int, from_ratios: bool = True, work: Workspace | None = None) -> ScoreTable:
    """From training rows with relativity, numerator, denominator, weight and estimate (a ratio)."""
    quantiles = quantile_list(rows, "relativity", "weight", scores, work)
    cuts = sorted(set(quantiles))
    place = F.least(first_at_least(F.col("relativity"), cuts), F.lit(len(cuts)))
    sums = rows.groupBy(place.alias("score")).agg(F.sum("numerator").alias("n"), F.sum("denominator").alias("d"), F.sum("weight").alias("w"), F.sum(F.col("estimate") * F.col("denominator")).alias("e"), F.max("relativity").alias("hi"), F.min("relativity").alias("lo"))
    found = sums.orderBy("score").collect()  # at most ``scores`` rows
    bounds = [(a["hi"] + b["lo"]) / 2 for a, b in zip(found, found[1:], strict=False)]
    observed = np.array([r["n"] / r["d"] if r["d"] else 0.0 for r in found])
    modelled = np.array([r["e"] / r["d"] if r["d"] else 0.0 for r in found])
    if from_ratios:
        ratio = np.divide(observed, modelled, out=np.ones_like(observed), where=modelled != 0)
        smoothed = np.maximum.accumulate(local_line(ratio, max(1, min(50, int(np.ceil(0.05 * len(ratio)))))) * modelled) if len(ratio) > 1 else observed
    else:
        smoothed = smooth(observed) if len(observed) > 1 else observed
    numbers = [quantiles.index(cuts[r["score"] - 1]) + 1 for r in found]
    return ScoreTable([float(b) for b in bounds], numbers, observed.tolist(), modelled.tolist(), [float(x) for x in smoothed], [float(r["w"]) for r in found], scores)
