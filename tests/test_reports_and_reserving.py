import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratiotree.functions import metrics
from ratiotree.operators import reports, reserving
from ratiotree.settings import ModelSettings

# A published run-off triangle and the reserves that the chain ladder must give.
TRIANGLE = [
    [342431626, 525536094, 589495214, 623289088, 643747688, 658115741, 668855279, 677066219, 683744294, 689307874, 694154508, 697093037],
    [336005294, 524712850, 593509678, 627848671, 649262155, 663904065, 675257097, 683887947, 690866125, 696563657, 701039401],
    [335566419, 526526296, 596023686, 632394354, 654690817, 669943726, 681193641, 690179389, 696873298, 703302023],
    [326717825, 511546204, 578494248, 614118348, 636369693, 651857493, 662800941, 671331480, 677875870],
    [324449376, 516274248, 589041167, 626497310, 649519257, 664965732, 676527770, 685375051],
    [330853302, 527423726, 602763798, 641556507, 665102463, 681069129, 692690207],
    [332076252, 534335267, 613276147, 652941981, 676841151, 692713633],
    [333460179, 541669592, 623047761, 663634517, 687667939],
    [349681110, 566979339, 653357345, 696319972],
    [371161962, 599894766, 690033928],
    [381639663, 620871113],
    [400561775],
]
RESERVES = [0, 2967674, 7728200, 13301269, 20351920, 29728122, 41945740, 58701050, 86343340, 133989345, 224588556, 468301209]


def test_chain_ladder_gives_the_published_reserves(spark):
    cells = spark.createDataFrame([(i, j, float(x)) for i, row in enumerate(TRIANGLE) for j, x in enumerate(row)], "origin int, dev int, cum double")
    out = reserving.chain_ladder(cells)
    assert [round(r.reserve) for r in out.orderBy("origin").collect()] == RESERVES
    total = reserving.totals(out, "origin").where("origin is null").first()
    assert round(total.reserve) == 1087946425 and total.factor == pytest.approx(total.ultimate / total.paid)


def test_row_level_reserving(spark):
    rows = [(i, 1 + i % 3, [10.0 * (i + 1), 20.0 * (i + 1), 25.0 * (i + 1)]) for i in range(60)]
    df = spark.createDataFrame([(i, y, *c, "ab"[i % 2], float(i)) for i, y, c in rows], "id int, ay int, p0 double, p1 double, p2 double, line string, age double")
    paid = reserving.paid_to_date(df, "ay", ["p0", "p1", "p2"], 3).collect()
    assert all(r.paid == (r.p2, r.p1, r.p0)[r.ay - 1] for r in paid)
    trees = reserving.development_trees(df, "ay", ["p0", "p1", "p2"], ["age"], ["line"], 3, ModelSettings(min_weight=-0.2))
    done = reserving.tree_ultimates(df, trees, "ay", ["p0", "p1", "p2"], 3).collect()
    assert len(trees) == 2 and all(r.ultimate == pytest.approx(r.p2) for r in done)
    assert df.where(reserving.monotone(["p0", "p1", "p2"])).count() == 60 and df.where(reserving.monotone(["p1", "p0"])).count() == 0
    assert reserving.reported(df, "ay", "age", 3).count() == sum(1 + i % 3 + i <= 3 for i in range(60))
    errors = reserving.corrected_errors(df, "p2", "p1", 2.0, [0.0, 1.0]).collect()
    assert len(errors) == 2 and errors[0].error < errors[1].error
    assert reserving.wide_triangle(df, "ay", ["p0", "p1", "p2"]).count() == 9
    assert reserving.with_offset(df, "p0", "p1").where("combined = p0 * p1").count() == 60


def scored(spark, n=300):
    r = random.Random(7)
    rows = [(float(r.choice([0, 0, 1, 2])), r.uniform(0.2, 2), r.choice([0.5, 0.8, 1.3]), 1.0, i % 3 > 0, r.randint(1, 4)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "numerator double, denominator double, estimate double, weight double, is_train boolean, band int")


def test_ginis_equal_definitions(spark):
    r = random.Random(2)
    x = sorted(r.uniform(0, 9) for _ in range(200))
    n = len(x)
    want = 2 * sum((i + 1) * v for i, v in enumerate(x)) / (n * sum(x)) - 1
    assert metrics.gini(spark.createDataFrame([(v,) for v in x], "x double"), "x").first()[0] == pytest.approx(want)
    truth, estimate = [r.choice([0.0, 1.0, 3.0]) for _ in range(150)], [r.random() for _ in range(150)]

    def slow(order):
        cum, out = 0.0, 0.0
        for k, i in enumerate(sorted(range(150), key=lambda i: -order[i]), 1):
            cum += truth[i]
            out += cum / sum(truth) - k / 150
        return out

    got = metrics.normalized_gini(spark.createDataFrame(list(zip(truth, estimate, strict=True)), "t double, e double"), "t", "e").first()
    assert got.gini == pytest.approx(slow(estimate)) and got.perfect == pytest.approx(slow(truth)) and got.normalized == pytest.approx(slow(estimate) / slow(truth))


def test_errors_equal_numpy(spark):
    rows, df = scored(spark)
    t, d, e = (np.array([x[i] for x in rows]) for i in range(3))
    est = e * d
    want = np.where(t == 0, 2 * est, 2 * (est - t - t * np.log(np.where(t == 0, 1.0, est / np.where(t == 0, 1.0, t)))))
    assert df.agg(F.avg(metrics.poisson_error(F.col("numerator"), F.col("estimate") * F.col("denominator")))).first()[0] == pytest.approx(want.mean())
    got = metrics.error_stats(df, "numerator", "estimate").first()
    assert (got.mse, got.mae, got.correlation) == pytest.approx((((t - e) ** 2).mean(), abs(t - e).mean(), np.corrcoef(t, e)[0, 1]))
    sq = metrics.squares(df.withColumn("est", F.col("estimate") * F.col("denominator")), "numerator", "denominator", "est").first()
    assert sq.r2 == pytest.approx(1 - ((t - est) ** 2).sum() / ((t - t.mean()) ** 2).sum())
    hist = metrics.error_histogram(df, "numerator", "estimate", 0.1, 1.0).orderBy("bin").collect()
    assert hist[-1].cumulative == 300


def test_roc_auc_confusion_kappa(spark):
    r = random.Random(3)
    rows = [(int(r.random() < 0.4), r.choice([0.1, 0.2, 0.5, 0.9])) for _ in range(200)]
    df = spark.createDataFrame(rows, "t int, s double")
    pairs = [(a, b) for ta, a in rows if ta for tb, b in rows if not tb]
    assert metrics.auc(df, "t", "s").first()[0] == pytest.approx(sum((a > b) + 0.5 * (a == b) for a, b in pairs) / len(pairs))
    curve = metrics.roc(df, "t", "s").orderBy(F.desc("score")).collect()
    assert curve[-1].tpr == 1 and curve[-1].fpr == 1
    hull = metrics.hull([(x.fpr, x.tpr) for x in curve])
    slopes = [(b[1] - a[1]) / (b[0] - a[0]) if b[0] > a[0] else np.inf for a, b in zip(hull, hull[1:], strict=False)]
    assert slopes == sorted(slopes, reverse=True) and hull[0] == (0, 0) and hull[-1] == (1, 1)
    both = df.withColumn("p", (F.col("s") > 0.3).cast("int"))
    assert metrics.confusion(both, "t", "p").agg(F.sum("n")).first()[0] == 200
    assert metrics.accuracy(both, "t", "p").first()[0] == pytest.approx(np.mean([t == (s > 0.3) for t, s in rows]))
    assert metrics.quadratic_kappa(both.withColumn("p", F.col("t")), "t", "p").first()[0] == 1.0


def test_bands_and_two_way(spark):
    _, df = scored(spark)
    stats = reports.grouped_stats(df, "band", "estimate")
    total = {r.is_train: r for r in stats.where("band is null").collect()}
    assert total[True].weight + total[False].weight == 300 and all(r.relativity == 1 for r in total.values())
    assert stats.count() == 10
    row = reports.band_metrics(stats, "band").first()
    by = {(r.is_train, r.band): r for r in stats.where("band is not null").collect()}
    assert row.lift_trn == pytest.approx(by[True, 4].relativity / by[True, 1].relativity)
    assert row.reversals_val == sum(by[False, b + 1].relativity < by[False, b].relativity for b in (1, 2, 3))
    a, b = ([by[t, k].relativity for k in (1, 2, 3, 4)] for t in (True, False))
    assert row.correlation == pytest.approx(np.corrcoef(a, b)[0, 1])
    out = reports.two_way(df, [F.col("band") % 2, reports.random_group(F.monotonically_increasing_id(), 3, 1)], ["odd", "random"], "band", "estimate")
    assert out.where("variable = 'odd'").agg(F.sum("weight")).first()[0] == 300
    assert reports.univariate(df, ["band"], "estimate").count() == 4
    starts = [1, 5, 9]
    got = spark.range(1, 13).select("id", reports.band(F.col("id"), starts).alias("b")).collect()
    assert all(r.b == sum(s <= r.id for s in starts) for r in got) and reports.band_label(starts, 12) == ["1-4", "5-8", "9-12"]


def test_concentration(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 1, 2, 6]], "a double")
    got = {r.share: r.amount_share for r in reserving.concentration(df, "a", [0.25, 0.5, 1.0]).collect()}
    assert got == pytest.approx({0.25: 0.6, 0.5: 0.8, 1.0: 1.0})
