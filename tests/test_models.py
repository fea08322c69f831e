import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratiotree.operators import boost, histogram, reports, sampling, tree
from ratiotree.operators.prepare import prepare
from ratiotree.operators.resample import CrossValidation, cross_validate, run_model, search, training_flags
from ratiotree.operators.scores import local_line, smooth
from ratiotree.plans import export
from ratiotree.settings import ModelSettings, grid
from ratiotree.streaming.scoring import score_stream

CRITERIA = ["difference", "poissondeviance", "gammadeviance", "sse", "mse", "msepointwise"]


@pytest.fixture(scope="module")
def data(spark):
    r = random.Random(3)
    rows = []
    for i in range(1500):
        area, age, power = r.choice("abcdefghij"), r.uniform(18, 80), r.randint(1, 6)
        rate = 0.1 + 0.2 * (age < 30) + 0.15 * (area in "aei") + 0.02 * power
        exposure = r.uniform(0.2, 1)
        rows.append((i, float(np.random.default_rng(i).poisson(rate * exposure * 3)), exposure, area, age, power, "it's" if i % 3 else 'a\\"b', int(i % 10 < 7)))
    df = spark.createDataFrame(rows, "id long, n double, d double, area string, age double, power int, odd string, trn int")
    out = prepare(df, "n", "d", "d", "id", "trn", points=40)
    out.rows = out.rows.cache()
    return out


@pytest.mark.parametrize("criterion", CRITERIA)
def test_tree_partitions_the_rows(data, criterion):
    model = tree.fit_tree(data, ModelSettings(criterion=criterion, min_weight=-0.08))
    top = model.nodes[1]
    assert len(model.leaves) > 2 and [n.leaf for n in model.leaves] == list(range(1, len(model.leaves) + 1))
    assert sum(n.weight for n in model.leaves) == pytest.approx(top.weight) and sum(n.count for n in model.leaves) == top.count
    assert min(n.weight for n in model.leaves) > 0.08 * top.weight
    assert [n.ratio for n in model.leaves] == sorted(n.ratio for n in model.leaves)
    scored = tree.apply_tree(data.rows, model)
    by = {r.leaf: r for r in scored.where("is_train").groupBy("leaf").agg(F.sum("numerator").alias("n"), F.sum("denominator").alias("d"), F.count(F.lit(1)).alias("c")).collect()}
    for leaf in model.leaves:
        assert by[leaf.leaf].c == leaf.count and by[leaf.leaf].n / by[leaf.leaf].d == pytest.approx(leaf.ratio)
    by_code = scored.withColumn("code_leaf", tree.walk(model, lambda n: n.leaf, by_code=True))
    assert by_code.where("leaf <> code_leaf").count() == 0
    assert sum(model.importance().values()) == pytest.approx(1) and tree.Tree.from_json(model.to_json()) == model


def test_partitions_do_not_matter(data):
    settings = ModelSettings(criterion="sse", min_weight=-0.1)
    shapes = []
    for n in (1, 4, 13):
        part = type(data)(data.rows.repartition(n), data.levels, data.numeric, data.categorical)
        shapes.append([(i, n.feature, n.codes) for i, n in sorted(tree.fit_tree(part, settings).nodes.items())])
    assert shapes[0] == shapes[1] == shapes[2]


@pytest.mark.parametrize("criterion", ["gammadeviance", "mse"])
def test_paths_of_growth_agree(data, monkeypatch, criterion):
    """Cells on the driver, cells on executors, rows, and the search where the sums are: one tree."""
    settings = ModelSettings(criterion=criterion, min_weight=-0.06, random_top=0.3, random_only_at_root=False)
    boosting = settings.update(model_type="boosted_tree", criterion="difference" if criterion.startswith("mse") else criterion, iterations=2, random_top=0.0, n_scores=10, score_bands=[1])
    few = type(data)(data.rows, data.levels, ["power"], ["area", "odd"])
    shape = lambda t: [(i, n.feature, n.codes, n.count) for i, n in sorted(t.nodes.items())]
    steps = lambda m: [shape(t) for t in m.trees]
    want, boosted = shape(tree.fit_tree(few, settings)), steps(boost.fit_boosted(few, boosting))
    monkeypatch.setattr(histogram, "LOCAL_CELLS", 0)
    assert shape(tree.fit_tree(few, settings)) == want and steps(boost.fit_boosted(few, boosting)) == boosted
    monkeypatch.setattr(histogram, "WORTH", 1e9)
    assert shape(tree.fit_tree(few, settings)) == want and steps(boost.fit_boosted(few, boosting)) == boosted
    monkeypatch.setattr(tree, "DRIVER_LEVELS", 0)
    assert shape(tree.fit_tree(few, settings)) == want


def test_refused_rows(data):
    wrong = {"poisson": "numerator - 1", "gamma": "-numerator - 1"}
    for criterion, numerator in wrong.items():
        with pytest.raises(ValueError, match="negative numerator"):
            tree.fit_tree(type(data)(data.rows.withColumn("numerator", F.expr(numerator)), data.levels, data.numeric, data.categorical), ModelSettings(criterion=criterion))
    for criterion in ("sse", "mse"):
        with pytest.raises(ValueError, match="denominator 0"):
            tree.fit_tree(type(data)(data.rows.withColumn("denominator", F.expr("if(key = '1', 0D, denominator)")), data.levels, data.numeric, data.categorical), ModelSettings(criterion=criterion))


def test_inverse_weights():
    assert boost.inverse_weights([1.0, 2.0]) == pytest.approx([2 / 3, 1 / 3])
    assert boost.inverse_weights([0.5, 0.0, None]) == pytest.approx([1 / 3] * 3) and boost.inverse_weights([0.0, None]) == [0.5, 0.5]


def test_first_split_equals_brute_force(data):
    model = tree.fit_tree(data, ModelSettings(min_weight=-0.1, max_depth=1))
    rows = data.rows.where("is_train").toPandas()
    least, best = 0.1 * rows.weight.sum(), 0.0
    for f in data.numeric:
        for c in range(int(rows[f"{f}#"].max())):
            side = rows[f"{f}#"] <= c
            if least < rows.weight[side].sum() < rows.weight.sum() - least:
                best = max(best, abs(rows.numerator[side].sum() / rows.denominator[side].sum() - rows.numerator[~side].sum() / rows.denominator[~side].sum()))
    for f in data.categorical:
        by = rows.groupby(f"{f}#")[["numerator", "denominator", "weight"]].sum()
        order = (by.numerator / by.denominator).sort_values().index
        for k in range(1, len(order)):
            a, b = by.loc[order[:k]].sum(), by.loc[order[k:]].sum()
            if least < a.weight < rows.weight.sum() - least:
                best = max(best, abs(a.numerator / a.denominator - b.numerator / b.denominator))
    assert model.nodes[1].value == pytest.approx(best)


def test_no_split_and_odd_levels(spark, data):
    alone = tree.fit_tree(data, ModelSettings(min_weight=-0.9))
    assert len(alone.nodes) == 1 and tree.apply_tree(data.rows, alone).select("fitted").distinct().count() == 1
    model = tree.fit_tree(data, ModelSettings(criterion="sse", min_weight=-0.05))
    new = data.rows.limit(5).withColumn("area", F.lit("never seen"))
    assert tree.predict_tree(new, model).where("leaf is not null").count() == 5
    with pytest.raises(ValueError):
        tree.predict_tree(data.rows.drop(*model.levels_used()), model)


def test_deep_trees_use_node_steps(data, monkeypatch):
    model = tree.fit_tree(data, ModelSettings(criterion="sse", min_weight=-0.03))
    nested = {r.key: (r.leaf, r.fitted) for r in tree.apply_tree(data.rows, model).collect()}
    monkeypatch.setattr(tree, "NESTED_LEAVES", 1)
    assert nested == {r.key: (r.leaf, r.fitted) for r in tree.apply_tree(data.rows, model).collect()}


def test_random_choice_and_samples(data):
    base = ModelSettings(criterion="sse", min_weight=-0.1, random_top=0.5, sample_rows=0.6, sample_features=0.5)
    a, b = tree.fit_tree(data, base), tree.fit_tree(data, base)
    assert a == b and len(a.levels_used()) <= 2
    assert tree.fit_tree(data, base.update(random_only_at_root=False)).nodes[1].weight < data.rows.where("is_train").agg(F.sum("weight")).first()[0]


@pytest.fixture(scope="module")
def boosted(data):
    return boost.fit_boosted(data, ModelSettings(model_type="boosted_tree", criterion="poisson", iterations=4, learning_rate=0.3, n_scores=30, score_bands=[1, 10, 20], checkpoint_every=2), track=True)


def test_boosting_improves_on_training_rows(data, boosted):
    errors = [h["poisson_error_trn"] for h in boosted.history]
    assert errors == sorted(errors, reverse=True) and len(boosted.trees) == 4
    scored = boost.predict_boosted(data.rows, boosted)
    again = reports.error_row(scored.withColumn("estimate", F.col("raw")))
    assert again["poisson_error_trn"] == pytest.approx(errors[-1])
    table = boosted.scores
    assert table.bounds == sorted(table.bounds) and table.smoothed == sorted(table.smoothed) and len(table.observed) == len(table.bounds) + 1
    got = scored.where("is_train").groupBy("score").agg((F.sum("numerator") / F.sum("denominator")).alias("o"), F.max("unsmoothed").alias("u")).collect()
    assert all(r.o == pytest.approx(r.u) for r in got)
    assert boost.Boosted.from_json(boosted.to_json()).to_json() == boosted.to_json()
    tables = boost.score_tables(data, boosted, 30)
    long = boost.iteration_matrix(data.rows, boosted, tables=tables)
    last = long.where("iteration = 4").join(scored.select("key", "raw", "smoothed"), "key")
    assert long.count() == 4 * 1500 and last.where("abs(estimate - raw) > 1e-9 or abs(estimate_from_score - smoothed) > 1e-9").count() == 0
    filled = table.filled()
    assert len(filled) == 30 and sum(r["weight"] > 0 for r in filled) == len(table.observed) and [r["smoothed"] for r in filled] == sorted(r["smoothed"] for r in filled)
    assert sum(r["weight"] for r in filled) == pytest.approx(data.rows.where("is_train").agg(F.sum("weight")).first()[0])
    used = boost.levels_used(boosted, data)
    assert used.where("used").select("feature").distinct().count() == len({f for t in boosted.trees for f in t.levels_used()})


def test_one_step_of_boosting(data):
    model = boost.fit_boosted(data, ModelSettings(model_type="boosted_tree", iterations=1, learning_rate=0.1, max_depth=1, n_scores=10, score_bands=[1]))
    leaf = model.trees[0].leaves[0]
    least = boost.predict_boosted(data.rows, model).agg(F.min("raw")).first()[0]
    assert least == pytest.approx(model.mean * ((leaf.ratio - 1) * 0.1 + 1))


def test_bagging(data):
    model = boost.fit_bagged(data, ModelSettings(model_type="bagged_tree", iterations=3, min_weight=-0.1))
    low, high = boost.predict_bagged(data.rows, model).agg(F.min("fitted"), F.max("fitted")).first()
    assert sum(model.weights) == pytest.approx(1) and low < high


def test_smoothing():
    y = np.array([1.0, 2, 3, 4, 5, 6])
    assert np.allclose(local_line(y, 2), y)
    noisy = np.linspace(1, 2, 200) + np.random.default_rng(1).normal(0, 0.2, 200)
    out = smooth(noisy)
    assert (np.diff(out) >= 0).all() and abs(out.mean() - 1.5) < 0.1


def test_exported_sql_equals_the_model(data, boosted):
    model = tree.fit_tree(data, ModelSettings(criterion="sse", min_weight=-0.04))
    assert tree.apply_tree(data.rows, model).where(F.expr(export.tree_sql(model)) != F.col("fitted")).count() == 0
    miss = boost.predict_boosted(data.rows, boosted).where(F.abs(F.expr(export.boosted_sql(boosted)) - F.col("raw")) > 1e-12)
    assert miss.count() == 0


def test_other_exports(data, boosted):
    model = tree.fit_tree(data, ModelSettings(criterion="sse", min_weight=-0.1))
    leaves = len(model.leaves)
    assert export.tree_text(model).count("leaf ") == leaves and export.tree_dot(model).count("->") == 2 * (leaves - 1)
    for m in (model, boosted):
        n = sum(len(t.leaves) for t in ([m] if m is model else m.trees))
        sas, cs, vba = export.sas(m), export.csharp(m), export.vba(m)
        assert sas.count("estimate = estimate *") == n and sas.count("do;") == sas.count("end;")
        assert cs.count("{") == cs.count("}") and cs.count("return ") >= n and vba.count("End Function") == vba.count("\nFunction ") + 1
    chart = export.chart_data(reports.grouped_stats(tree.apply_tree(data.rows, model), "leaf", "fitted").where("is_train and leaf is not null"), "line", "leaf", ["observed", "fitted"])
    assert len(chart["x"]["leaf"]) == leaves


@pytest.mark.parametrize("kind", ["build_tree", "boosted_tree", "bagged_tree"])
def test_runs_and_measures(data, kind):
    run = run_model(data, ModelSettings(model_type=kind, criterion="sse", min_weight=-0.1, n_scores=20, score_bands=[1, 10]))
    assert set(reports.MEASURES) <= set(run.measures) and run.measures["lift_trn"] > 1
    assert run.scored.count() == 1500


def test_cross_validation_and_search(spark, data):
    short = ModelSettings(min_weight=-0.2, max_depth=2)
    table, stats = cross_validate(data, short, CrossValidation(3))
    assert table.count() == 3 and table.where("error is not null").count() == 0 and stats.where("measure = 'lift_val'").first()["least"] > 0
    sizes = [[data.rows.where(f).count() for f in training_flags(data.rows, o, 1)] for o in (CrossValidation(3), CrossValidation(-3), CrossValidation(2, 0.5))]
    assert sum(sizes[0]) == 3000 and sum(sizes[1]) == 1500 and sizes[0] == [1000] * 3 and sizes[1] == [500] * 3 and sizes[2] == [750] * 2
    found = search(data, [*grid(short, criterion=["sse", "difference"]), ModelSettings(criterion="nope")])
    assert found.where("error is null").count() == 2 and reports.best(found.where("error is null"), "lift_val").count() == 1
    with pytest.raises(ValueError):
        reports.best(found, "nope")
    assert set(reports.MEASURES) <= set(table.columns) and table.where("gini_trn is null or rss_ratio_val is null or min_observed_trn is null").count() == 0


def test_stream_scoring(spark, data, tmp_path):
    model = tree.fit_tree(data, ModelSettings(min_weight=-0.2))
    data.rows.select(*data.features).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(data.rows.select(*data.features).schema).parquet(str(tmp_path / "in"))
    score_stream(stream, model, str(tmp_path / "out"), str(tmp_path / "check"), once=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).where("fitted is not null").count() == 1500


def counted(spark, data):
    """``data`` whose rows are counted each time they are read."""
    seen = spark.sparkContext.accumulator(0)

    def through(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return type(data)(data.rows.mapInArrow(through, data.rows.schema), data.levels, data.numeric, data.categorical), seen


@pytest.mark.parametrize("random", [{}, {"sample_features": 0.7}])
def test_bagging_reads_the_rows_a_few_times_in_all(spark, data, random):
    """Samples of all trees are found in one pass and written in one, with the same trees as one after the other; random growth draws between them."""
    settings = ModelSettings(model_type="bagged_tree", criterion="sse", iterations=3, min_weight=-0.1, **random)
    base, seen = counted(spark, data)
    model = boost.fit_bagged(base, settings)
    assert random or seen.value <= 3 * 1500
    rng, train, trees = np.random.default_rng(settings.seed), data.rows.where("is_train"), []
    for _ in range(3):
        cut = sampling.cutoffs(train, sampling.hashed(F.col("key"), seed := int(rng.integers(1 << 31))), lambda n: [round(0.632 * n)])[0]
        trees.append(tree.fit_tree(data, settings, train.where(sampling.hashed(F.col("key"), seed) <= cut), rng))
    assert [[(i, n.feature, n.codes, n.count) for i, n in sorted(t.nodes.items())] for t in model.trees] == [[(i, n.feature, n.codes, n.count) for i, n in sorted(t.nodes.items())] for t in trees]


def test_folds_read_the_rows_a_few_times_in_all(spark, data, monkeypatch):
    """However many rows share a hash's leading bits: one pass counts, one finds the folds, one writes them."""
    monkeypatch.setattr(sampling, "FEW", 0)
    base, seen = counted(spark, data)
    table, _ = cross_validate(base, ModelSettings(min_weight=-0.2, max_depth=2), CrossValidation(3), ginis=False)
    assert table.where("error is null").count() == 3 and seen.value <= 3 * 1500
    assert cross_validate(data, ModelSettings(model_type="bagged_tree", iterations=2, min_weight=-0.2, max_depth=2), CrossValidation(-2), ginis=False)[0].where("error is null").count() == 2


def test_measures_of_both_parts_equal_those_of_each(data):
    from ratiotree.functions import metrics

    scored = tree.apply_tree(data.rows, tree.fit_tree(data, ModelSettings(min_weight=-0.2))).withColumn("estimate", F.col("fitted"))
    got = reports.measures_row(scored, "leaf", ginis=False)
    want = reports.error_row(scored)
    for s, part in (("trn", scored.where("is_train")), ("val", scored.where("not is_train"))):
        found = metrics.squares(part.withColumn("guess", F.col("estimate") * F.col("denominator")), "numerator", "denominator", "guess").first()
        want |= {f"{m}_{s}": found[m] for m in ("r2", "rss", "r2_ratio", "rss_ratio")}
    assert {k: got[k] for k in want} == pytest.approx(want)
