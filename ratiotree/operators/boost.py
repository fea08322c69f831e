"""Multiplicative boosting and bagging of trees."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import error_stats
from ..settings import ModelSettings
from ..sources.workspace import Workspace
from .histogram import at_hand, cells, scaled
from .prepare import Prepared, code
from .sampling import sampled, samples
from .scores import ScoreTable, score_table
from .tree import Tree, check_features, fit_tree, grow, leaves_of, with_leaf


@dataclass
class Boosted:
    trees: list[Tree]
    rates: list[float]
    mean: float
    scores: ScoreTable
    history: list[dict]  # metrics after each iteration, where asked for

    def to_json(self) -> str:
        return json.dumps({"mean": self.mean, "rates": self.rates, "scores": vars(self.scores), "trees": [json.loads(t.to_json()) for t in self.trees], "history": self.history})

    @staticmethod
    def from_json(text: str) -> Boosted:
        data = json.loads(text)
        return Boosted([Tree.from_json(json.dumps(t)) for t in data["trees"]], data["rates"], data["mean"], ScoreTable(**data["scores"]), data["history"])


def fit_boosted(data: Prepared, settings: ModelSettings, track: bool = False) -> Boosted:
    """Trees on numerator over estimated numerator, one after the other.

    An estimate follows from the codes, so it stands with the sums of equal codes where those are few, and with the rows else. It is written to the shared
    folder every ``checkpoint_every`` trees, so that neither plan nor loss of an executor grows with the number of trees.
    """
    work = Workspace(data.rows.sparkSession)
    rng = np.random.default_rng(settings.seed)
    train = data.rows.where("is_train")
    base = cells(train, data.features, settings.criterion)
    top = base.rows.agg(F.sum("n"), F.sum("d")).first()
    mean = float(top[0] / top[1])
    rows, tracked = base.rows.withColumn("estimate", F.lit(mean)), data.rows.withColumn("estimate", F.lit(mean))
    near = at_hand(base, data.features) if settings.sample_rows == 1 else None
    estimate = np.full(len(near.sums["c"]), mean) if near else None
    trees: list[Tree] = []
    history: list[dict] = []
    for i, rate in enumerate(settings.rates()):
        if settings.sample_rows < 1:
            inside = train.where(sampled(train, settings.sample_rows, int(rng.integers(1 << 31))))
            part = cells(inside, data.features, settings.criterion)
            known = part.rows.withColumn("estimate", F.lit(mean))
            for t, r in zip(trees, settings.rates(), strict=False):
                known = multiplied(known, t, r, by_code=True)
            tree = grow(data, settings, scaled(replace(part, rows=known), F.col("estimate")), rng)
            part.free()
        elif near:
            tree = grow(data, settings, near.scaled(estimate), rng)
        else:
            tree = grow(data, settings, scaled(replace(base, rows=rows), F.col("estimate")), rng)
        if min(leaf.ratio for leaf in tree.leaves) < 0:
            raise ValueError(f"iteration {i + 1}: a leaf has a negative relativity")
        trees.append(tree)
        if near:
            estimate = estimate * np.array([(n.ratio - 1.0) * rate + 1.0 for n in tree.leaves])[leaves_of(tree, near.codes) - 1]
        else:
            rows = multiplied(rows, tree, rate, by_code=True)
            if (i + 1) % settings.checkpoint_every == 0:
                rows = work.write(rows)
        if track:
            from .reports import error_row

            tracked = multiplied(tracked, tree, rate, by_code=True)
            if (i + 1) % settings.checkpoint_every == 0:
                tracked = work.write(tracked)
            history.append({"iteration": i + 1, **error_row(tracked)})
    if near:
        rows = data.rows.sparkSession.createDataFrame(pa.table({"estimate": estimate, **{s: near.sums[s] for s in "ndw"}}))
    ready = rows.select(F.col("n").alias("numerator"), F.col("d").alias("denominator"), F.col("w").alias("weight"), "estimate", (F.col("estimate") / F.lit(mean)).alias("relativity"))
    table = score_table(work.write(ready), settings.n_scores, settings.smooth_estimates, work)
    work.delete()
    base.free()
    return Boosted(trees, settings.rates(), mean, table, history)


def multiplied(df: DataFrame, tree: Tree, rate: float, name: str = "estimate", by_code: bool = False) -> DataFrame:
    """``df`` with a column times a tree's moderated ratio."""
    return with_leaf(df, tree, {"_factor": lambda n: (n.ratio - 1.0) * rate + 1.0}, by_code).withColumn(name, F.col(name) * F.col("_factor")).drop("_factor")


def predict_boosted(df: DataFrame, model: Boosted) -> DataFrame:
    """``df`` with raw, relativity, score, unsmoothed and smoothed, by the features' values."""
    for tree in model.trees:
        check_features(df, tree)
    out = df.withColumn("raw", F.lit(model.mean))
    for tree, rate in zip(model.trees, model.rates, strict=True):
        out = multiplied(out, tree, rate, "raw")
    table = model.scores
    out = out.withColumn("relativity", F.col("raw") / F.lit(model.mean)).withColumn("_place", table.place(F.col("relativity")))
    columns = (("score", table.numbers), ("unsmoothed", table.observed), ("smoothed", table.smoothed))
    return out.withColumns({name: table.look_up(F.col("_place"), values) for name, values in columns}).drop("_place")


def iteration_matrix(df: DataFrame, model: Boosted, key: str = "key", tables: list[ScoreTable] | None = None) -> DataFrame:
    """key, iteration, leaf, estimate, estimate_from_score: what each tree made of each row, as a long table.

    ``tables`` has a score table for each iteration (``score_tables``); the last column is the smoothed ratio of the row's score by then, null without tables.
    """
    out, parts = df.withColumn("_e0", F.lit(model.mean)), []
    for i, (tree, rate) in enumerate(zip(model.trees, model.rates, strict=True), 1):
        out = with_leaf(out, tree, {f"_l{i}": lambda n: n.leaf, "_factor": lambda n, rate=rate: (n.ratio - 1.0) * rate + 1.0})
        out = out.withColumn(f"_e{i}", F.col(f"_e{i - 1}") * F.col("_factor")).drop("_factor")
        scored = F.lit(None).cast("double")
        if tables:
            scored = tables[i - 1].look_up(tables[i - 1].place(F.col(f"_e{i}") / F.lit(model.mean)), tables[i - 1].smoothed)
        parts.append(F.struct(F.lit(i).alias("iteration"), F.col(f"_l{i}").alias("leaf"), F.col(f"_e{i}").alias("estimate"), scored.alias("estimate_from_score")))
    return out.select(key, F.explode(F.array(*parts)).alias("p")).select(key, "p.*")


def score_tables(data: Prepared, model: Boosted, scores: int, from_ratios: bool = True) -> list[ScoreTable]:
    """The score table after each iteration, from the training rows."""
    work = Workspace(data.rows.sparkSession)
    rows, out = data.rows.where("is_train").withColumn("estimate", F.lit(model.mean)), []
    for tree, rate in zip(model.trees, model.rates, strict=True):
        rows = work.write(multiplied(rows, tree, rate, by_code=True))
        out.append(score_table(rows.withColumn("relativity", F.col("estimate") / F.lit(model.mean)), scores, from_ratios, work))
    work.delete()
    return out


def iteration_measures(data: Prepared, model: Boosted, starts: list[int], scores: int, ginis: bool = True) -> DataFrame:
    """iteration and all measures of a run after each iteration, over the bands of its scores that begin at ``starts``; iteration 0 is the mean alone, in one band."""
    from .reports import MEASURES, band, measures_row

    work = Workspace(data.rows.sparkSession)
    rows, found = data.rows.withColumn("estimate", F.lit(model.mean)), []
    found.append({"iteration": 0, **measures_row(rows.withColumn("_band", F.lit(1)), "_band", ginis)})
    for i, (tree, rate, table) in enumerate(zip(model.trees, model.rates, score_tables(data, model, scores), strict=True), 1):
        rows = work.write(multiplied(rows, tree, rate, by_code=True))
        score = table.look_up(table.place(F.col("estimate") / F.lit(model.mean)), table.numbers)
        found.append({"iteration": i, **measures_row(rows.withColumn("_band", band(score, starts)), "_band", ginis)})
    work.delete()
    names = [n for n in MEASURES if ginis or "gini" not in n]
    table = [(r["iteration"], *[None if r.get(n) is None else float(r[n]) for n in names]) for r in found]
    return data.rows.sparkSession.createDataFrame(table, ", ".join(["iteration int", *[f"{n} double" for n in names]]))


def levels_used(model: Boosted, data: Prepared) -> DataFrame:
    """feature, code, number, text, used: whether any split of the model takes the level to its left side, or, for numbers, ends there."""
    found = {(n.feature, c) for t in model.trees for n in t.nodes.values() if n.feature for c in n.codes}
    spark = data.rows.sparkSession
    table = spark.createDataFrame(sorted(found), "feature string, code int").withColumn("used", F.lit(True))  # at most the levels of all features
    return data.levels.join(F.broadcast(table), ["feature", "code"], "left").fillna(False, ["used"])


@dataclass
class Bagged:
    trees: list[Tree]
    weights: list[float]


#: What a bagged tree's weight is one over, on the rows it has not seen; ``uniform`` weighs all alike.
ERRORS = ("mse", "mae", "mrse", "mrae", "uniform")


def fit_bagged(data: Prepared, settings: ModelSettings, error: str = "mse") -> Bagged:
    """Trees on samples of exact size of the training rows; a tree weighs one over its ``error`` (of ratios, weighted by ``weight``) on the rows it has not seen."""
    if error not in ERRORS:
        raise ValueError(f"error must be one of {', '.join(ERRORS)}")
    rng = np.random.default_rng(settings.seed)
    share = settings.sample_rows if settings.sample_rows < 1 else 0.632
    plain = settings.update(sample_rows=1.0)
    train = data.rows.where("is_train")
    work = Workspace(data.rows.sparkSession)
    known: list[Column] = []
    if not settings.random_top and settings.sample_features >= 1:  # growing a tree draws nothing, so all samples are known, and written once
        flags = samples(train, share, [int(rng.integers(1 << 31)) for _ in range(settings.iterations)])
        codes = [F.col(f"`{code(f)}`") for f in data.features]
        train = work.write(train.select("numerator", "denominator", "weight", *codes, *[f.alias(f"_inside{i}") for i, f in enumerate(flags)]))
        known = [F.col(f"_inside{i}") for i in range(settings.iterations)]
    trees, errors = [], []
    for i in range(settings.iterations):
        inside = known[i] if known else sampled(train, share, int(rng.integers(1 << 31)))
        tree = fit_tree(data, plain, train.where(inside), rng)
        if error != "uniform":
            unseen = with_leaf(train.where(~inside), tree, {"fitted": lambda n: float(n.ratio)}, by_code=True).withColumn("ratio", F.try_divide("numerator", "denominator"))
            errors.append(error_stats(unseen, "ratio", "fitted", "weight").first()[error])
        trees.append(tree)
    work.delete()
    return Bagged(trees, inverse_weights(errors) if error != "uniform" else [1 / len(trees)] * len(trees))


def inverse_weights(errors: list[float | None]) -> list[float]:
    """One over each error, scaled to 1; an error of 0 or none counts as the least one, and all alike if none is left."""
    weights = [1 / e if e else None for e in errors]
    top = max((w for w in weights if w is not None), default=1.0)
    weights = [top if w is None else w for w in weights]
    return [w / sum(weights) for w in weights]


def predict_bagged(df: DataFrame, model: Bagged) -> DataFrame:
    out = df.withColumn("fitted", F.lit(0.0))
    for tree, weight in zip(model.trees, model.weights, strict=True):
        out = with_leaf(out, tree, {"_part": lambda n, weight=weight: float(n.ratio) * weight}).withColumn("fitted", F.col("fitted") + F.col("_part")).drop("_part")
    return out
