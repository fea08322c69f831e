import hashlib
import random
import zipfile
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratiotree.functions import running
from ratiotree.functions.running import all_weighted_quantiles, first_at_least, running_sums
from ratiotree.operators import prepare as P
from ratiotree.operators import sampling
from ratiotree.settings import ModelSettings, grid, stats_columns
from ratiotree.sources import tables


@pytest.fixture(scope="module")
def table(spark):
    r = random.Random(1)
    rows = [(i, float(r.random() < 0.3), r.uniform(0.1, 1), r.choice("abcd"), r.gauss(0, 1), r.randint(0, 5), i % 2) for i in range(500)]
    return spark.createDataFrame(rows, "id long, claims double, exposure double, area string, age double, power int, trn int")


def test_roles_codes_and_levels(table):
    data = P.prepare(table, "claims", "exposure", "exposure", "id", "trn", points=10)
    assert data.numeric == ["age", "power"] and data.categorical == ["area"]
    rows = data.rows.toPandas()
    levels = {(r.feature, r.code): (r.number, r.text) for r in data.levels.collect()}
    for _, r in rows.iterrows():
        assert levels["area", r["area#"]][1] == r["area"]
        assert r["age"] <= levels["age", r["age#"]][0] and (r["age#"] == 0 or r["age"] > levels["age", r["age#"] - 1][0])
    assert levels["age", max(c for f, c in levels if f == "age")][0] == rows["age"].max()
    assert rows["is_train"].sum() == 250


@pytest.mark.parametrize("wrong", [
    {"numerator": ""}, {"numerator": "nope"}, {"numerator": "claims", "denominator": "nope"}, {"numerator": "claims", "weight": "nope"}, {"numerator": "claims", "key": "nope"},
    {"numerator": "claims", "as_categorical": ("nope",)}, {"numerator": "claims", "validation": 0.0}, {"numerator": "claims", "validation": 1.0}, {"numerator": "claims", "train": "power"}, {"numerator": "claims", "denominator": "trn"}])
def test_wrong_arguments(table, wrong):
    with pytest.raises(ValueError):
        P.prepare(table, **wrong)


def test_nulls_empty_tables_and_dates_are_refused(spark, table):
    for bad in (table.withColumn("age", F.lit(None).cast("double")), table.withColumn("age", F.lit(float("nan"))), table.where("false"), table.withColumn("age", F.current_date())):
        with pytest.raises(ValueError):
            P.prepare(bad, "claims", "exposure")
    assert P.prepare(table, "claims", "trn", ignore_zero_denominator=True).rows.count() == 500


def test_frequencies_and_other(table):
    got = {r.value: (r.n, r.keep) for r in P.frequencies(table, "area", 2).collect()}
    assert sum(n for n, _ in got.values()) == 500 and sum(k for _, k in got.values()) == 2
    assert sorted(n for n, k in got.values() if k)[0] >= max(n for n, k in got.values() if not k)
    assert all(r.keep == (r.share >= 0.26) for r in P.frequencies(table, "area", -0.26).collect())
    assert {r[0] for r in P.others(table, "area", 2, "zz").select("area").distinct().collect()} == {a for a, (_, k) in got.items() if k} | {"zz"}
    assert P.others_in_all(table, 3).select("area").distinct().count() == 3


@pytest.mark.parametrize("on_driver", [True, False])
def test_weighted_quantiles_equal_numpy(spark, monkeypatch, on_driver):
    if not on_driver:
        monkeypatch.setattr(running, "DRIVER_VALUES", 0)
    r = random.Random(4)
    rows = [(r.choice([1.0, 2.5, 7.0, r.random()]), r.choice([0.0, 1.0, 2.0])) for _ in range(400)] + [(None, 1.0)]
    shares = [(i + 0.5) / 17 for i in range(17)]
    got = all_weighted_quantiles(spark.createDataFrame(rows, "v double, w double"), ["v"], "w", shares)["v"]
    known = sorted((v, w) for v, w in rows if v is not None and w)
    cum = np.cumsum([w for _, w in known])
    assert got == [*(known[int(np.searchsorted(cum, p * cum[-1] * (1 - 1e-12)))][0] for p in shares), known[-1][0]]


def test_running_sums_and_places(spark):
    r = random.Random(5)
    values = [r.randint(0, 50) for _ in range(300)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v int")
    got = sorted((x.v, x.i, x.total) for x in running_sums(df, [F.col("v"), F.col("i")], {"total": F.col("v")}).collect())
    assert [t for _, _, t in got] == np.cumsum(sorted(values)).tolist()
    for bounds in ([3.0, 9.0], [float(b) for b in range(0, 80, 2)]):
        places = df.select("v", first_at_least(F.col("v"), bounds).alias("k")).collect()
        assert all(x.k == int(np.searchsorted(bounds, x.v)) + 1 for x in places)


@pytest.mark.parametrize("few", [0, 4096])
def test_samples_and_folds_are_exact(spark, monkeypatch, few):
    monkeypatch.setattr(sampling, "FEW", few)
    df = spark.range(1003).withColumn("key", F.col("id").cast("string")).withColumn("key", F.expr("if(id = 1002, null, key)"))
    hashes = sorted(int(hashlib.md5(f"{i}:5".encode()).hexdigest()[:15], 16) for i in range(1002))
    got = sampling.cutoffs(df, sampling.hashed(F.col("key"), 5), lambda n: [0, 1, 17, 500, n])
    assert got == [-1, hashes[0], hashes[16], hashes[499], hashes[-1]]
    sizes = {r[0]: r[1] for r in df.where("key is not null").groupBy(sampling.fold(df, 4, 5).alias("f")).count().collect()}
    assert [sizes[i] for i in range(4)] == [250, 251, 251, 250]
    assert df.where(sampling.sampled(df, 0.25, 9)).count() == 250 and sampling.cutoffs(df.where("false"), sampling.hashed(F.col("key"), 5), lambda n: [n]) == [-1]


def test_late_strings_are_not_lost(spark):
    df = spark.range(20_000).select(F.expr("if(id < 15000, cast(id as string), 'x')").alias("a"), F.col("id").cast("string").alias("b"), F.lit(None).cast("string").alias("c"))
    assert dict(tables.typed(df).dtypes) == {"a": "string", "b": "double", "c": "string"}
    assert tables.typed(df, 0.7).where("a is null").count() == 5000


def test_ranks_of_many_values(spark):
    df = spark.range(5000).select((F.col("id") % 2500).alias("v")).union(spark.createDataFrame([(None,)], "v long"))
    got = P.ranks(df, "v", "place")
    assert got.count() == 5000 and got.where("place <> v + 1").count() == 0


def test_archives(tmp_path):
    (tmp_path / "a.txt").write_text("x")
    packed = tables.zip_files([str(tmp_path / "a.txt")], str(tmp_path / "a.zip"))
    assert [Path(f).read_text() for f in tables.unzip_files(packed, str(tmp_path / "out"))] == ["x"]
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as bad:
        bad.writestr("../b.txt", "y")
    with pytest.raises(ValueError):
        tables.unzip_files(str(tmp_path / "bad.zip"), str(tmp_path / "out"))


def test_split_does_not_depend_on_partitions(table):
    a = {r.id: r.is_train for r in P.exact_split(table, "id", 0.35, 3).collect()}
    b = {r.id: r.is_train for r in P.exact_split(table.repartition(13), "id", 0.35, 3).collect()}
    assert a == b and sum(a.values()) == 175


def test_settings():
    base = ModelSettings()
    base.validate()
    assert base.update(min_weight="-0.03", criterion="poisson", score_bands="1,50,900").criterion == "poissondeviance"
    for wrong in ({"min_weight": -1.5}, {"criterion": "x"}, {"iterations": 0}, {"score_bands": [2, 5]}, {"nope": 1}, {"sample_rows": 0.0}, {"n_scores": 8}, {"moderation": [0.1, 0.2, 0.3]}):
        with pytest.raises(ValueError):
            base.update(**wrong)
    assert len(grid(base, min_weight=[-0.1, -0.2], criterion=["sse", "mse", "difference"])) == 6
    assert base.update(iterations=2, moderation=[0.1, 0.3]).rates() == [0.1, 0.3]
    assert stats_columns("2,age", ["area", "power", "age"]) == ["power", "age"]
    with pytest.raises(ValueError):
        stats_columns("x", ["area"])


def test_sources(spark, tmp_path, table):
    (tmp_path / "s.csv").write_text("﻿min_weight,criterion\n-0.2,sse\n", encoding="utf-8")
    assert ModelSettings().update(**tables.read_settings(str(tmp_path / "s.csv"))).min_weight == -0.2
    (tmp_path / "t.csv").write_text("a,b\n1,x\n2.5,y\n")
    assert tables.read_csv(spark, str(tmp_path / "t.csv"), "a double, b string").count() == 2
    assert dict(tables.typed(spark.read.csv(str(tmp_path / "t.csv"), header=True)).dtypes) == {"a": "double", "b": "string"}
    data = P.prepare(table, "claims", "exposure", points=5)
    tables.write_prepared(data, str(tmp_path / "p"))
    again = tables.read_prepared(spark, str(tmp_path / "p"))
    assert again.features == data.features and again.rows.count() == 500
    tables.write_rows(table.select("id", "area"), str(tmp_path / "rows"))
    tables.write_report({"x": table}, str(tmp_path / "report"))
    assert spark.read.parquet(str(tmp_path / "report/x.parquet")).count() == 500
    assert tables.zip_files([str(tmp_path / "s.csv")], str(tmp_path / "z.zip")).endswith("z.zip")


@pytest.mark.parametrize("copies", [1, 400])
def test_all_cutoffs_equal_sorted_hashes(spark, copies):
    """One pass for all seeds; where keys repeat, ranks may lie far from where they are expected, and are counted."""
    df = spark.range(2000).select((F.col("id") / copies).cast("long").cast("string").alias("key")).union(spark.sql("select cast(null as string)"))
    wanted = lambda n: [0, 1, 17, 500, 1999, n, n + 5]
    got = sampling.all_cutoffs(df, "key", list(range(10)), wanted)
    for seed in range(10):
        hashes = sorted(r[0] for r in df.where("key is not null").select(sampling.hashed(F.col("key"), seed)).collect())
        assert got[seed] == [-1, *(hashes[min(r, 2000) - 1] for r in wanted(2000)[1:])]
    assert sampling.all_cutoffs(df.where("false"), "key", [1, 2], lambda n: [n]) == [[-1], [-1]] and df.where(sampling.sampled(df, 0.0, 3)).count() == 0
