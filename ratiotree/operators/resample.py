"""Folds, cross-validation, grid search, and the run that they repeat."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.running import ranked
from ..settings import ModelSettings
from ..sources.workspace import Workspace
from .boost import fit_bagged, fit_boosted, predict_bagged, predict_boosted
from .prepare import Prepared
from .reports import band, measures_row, stats_of_stats
from .sampling import fold, samples
from .tree import fit_tree, predict_tree


@dataclass
class CrossValidation:
    """``folds`` below 0: disjoint training sets of one fold each; ``share`` above 0: so large random training sets instead of folds."""

    folds: int = 5
    share: float = 0.0
    use_all: bool = True


def training_flags(rows: DataFrame, options: CrossValidation, seed: int) -> list[Column]:
    """For each fold, the column that says whether a row trains; folds and samples have exact sizes, by a hash of the key alone."""
    if options.share > 0:
        return samples(rows, options.share, [seed + i for i in range(abs(options.folds))])
    place = fold(rows, abs(options.folds), seed)
    return [place == i if options.folds < 0 else place != i for i in range(abs(options.folds))]


@dataclass
class Run:
    model: object
    scored: DataFrame
    measures: dict


def run_model(data: Prepared, settings: ModelSettings, ginis: bool = True) -> Run:
    """Fit, score all rows, and measure."""
    settings.validate()
    if settings.model_type == "boosted_tree":
        model = fit_boosted(data, settings)
        scored = predict_boosted(data.rows, model)
        estimate = {"rawRelativities": "raw", "unsmoothedPerScore": "unsmoothed", "smoothedPerScore": "smoothed"}[settings.fit_for_stats]
        scored = scored.withColumn("estimate", F.col(estimate)).withColumn("group", band(F.col("score"), settings.score_bands))
    elif settings.model_type == "bagged_tree":
        model = fit_bagged(data, settings)
        scored = predict_bagged(data.rows, model).withColumn("estimate", F.round("fitted", 12))
        scored = ranked(scored, "estimate", "group")
    else:
        model = fit_tree(data, settings)
        scored = predict_tree(data.rows, model).withColumn("estimate", F.col("fitted")).withColumn("group", F.col("leaf"))
    return Run(model, scored, measures_row(scored, "group", ginis))


def _attempts(jobs: list, threads: int) -> list[dict]:
    """The jobs' measures, several at a time; a job that fails gives an error and no measures."""

    def one(job) -> dict:  # noqa: ANN001
        try:
            return job() | {"error": None}
        except Exception as e:  # a model that can't be fitted must not end the search
            return {"error": str(e)[:200]}

    with ThreadPoolExecutor(threads) as pool:
        return list(pool.map(one, jobs))


def _table(spark, results: list[dict], first: str) -> DataFrame:  # noqa: ANN001
    names = sorted({k for r in results for k in r} - {"error", first})
    rows = [(i, *[None if r.get(k) is None else float(r[k]) for k in names], r["error"]) for i, r in enumerate(results, 1)]
    return spark.createDataFrame(rows, ", ".join([f"{first} int", *[f"{k} double" for k in names], "error string"]))


def cross_validate(data: Prepared, settings: ModelSettings, options: CrossValidation, threads: int = 2, ginis: bool = True) -> tuple[DataFrame, DataFrame]:
    """(measures of each fold, statistics over folds). The prepared rows are written once with their folds' flags, as each fold reads them several times; their keys only where models draw samples."""
    base = data if options.use_all else data.where("is_train")
    work = Workspace(data.rows.sparkSession)
    flags = {f"_train{i}": f for i, f in enumerate(training_flags(base.rows, options, settings.seed))}
    keyed = settings.model_type == "bagged_tree" or settings.sample_rows < 1
    base = replace(base, rows=work.write(base.rows.withColumns(flags).drop(*[] if keyed else ["key"])))
    total = base.rows.count()

    def job(flag: Column, i: int):  # noqa: ANN202
        def run() -> dict:
            part = Prepared(base.rows.withColumn("is_train", flag), data.levels, data.numeric, data.categorical)
            own = settings
            if settings.min_weight > 0:  # an absolute weight follows the size of the training set
                own = settings.update(min_weight=settings.min_weight * part.rows.where("is_train").count() / max(1, total))
            return run_model(part, replace(own, seed=settings.seed + i), ginis).measures

        return run

    found = _attempts([job(F.col(name), i) for i, name in enumerate(flags)], threads)
    work.delete()
    table = _table(data.rows.sparkSession, found, "fold")
    names = [c for c in table.columns if c not in ("fold", "error")]
    return table, stats_of_stats(table, names)


def search(data: Prepared, options: list[ModelSettings], threads: int = 2, ginis: bool = True) -> DataFrame:
    """model, the measures of each of many settings. The prepared rows are written once, as each model reads them several times."""
    work = Workspace(data.rows.sparkSession)
    base = replace(data, rows=work.write(data.rows))
    found = _attempts([lambda s=s: run_model(base, s, ginis).measures for s in options], threads)
    work.delete()
    return _table(data.rows.sparkSession, found, "model")
