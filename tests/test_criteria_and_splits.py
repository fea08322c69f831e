import math
import random
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ratiotree.functions.criteria import CRITERIA, SUMS, ArrayMath, Side, register
from ratiotree.operators import splits
from ratiotree.operators.histogram import level_sums


def sums_of(rows):
    n, d = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], float)
    return {"c": float(len(rows)), "n": n.sum(), "d": d.sum(), "w": float(len(rows)), "q": (n * n / d).sum(), "r": (n / d).sum(), "r2": ((n / d) ** 2).sum(), "z": float((n != 0).sum())}


def direct(criterion, left, right):
    """The criterion from the rows themselves; deviances as the gain over one mean for both sides."""
    mean = lambda s: sum(n for n, _ in s) / sum(d for _, d in s)
    both = [*left, *right]

    def poisson(s, m):
        return -sum(-(n - d * m) - (n * math.log(d * m / n) if n else 0.0) for n, d in s)

    def gamma(s, m):
        return -sum(-(n - d * m) / (d * m) + (math.log(d * m / n) if n else 0.0) for n, d in s)

    def m2(s):
        return sum(d * (n / d - mean(s)) ** 2 for n, d in s)

    def spread(s):
        r = [n / d for n, d in s]
        return float(np.var(r))

    if criterion == "difference":
        return abs(mean(left) - mean(right))
    if criterion == "poissondeviance":
        return poisson(left, mean(left)) + poisson(right, mean(right)) - poisson(both, mean(both))
    if criterion == "gammadeviance":
        side = lambda s: sum(1 - n / (d * mean(s)) + (math.log(d * mean(s) / n) if n else 0.0) for n, d in s)
        return side(both) - side(left) - side(right)
    if criterion == "sse":
        return m2(both) - m2(left) - m2(right)
    if criterion == "mse":
        return -(m2(left) / (len(left) - 1) + m2(right) / (len(right) - 1))
    if criterion == "msepointwise":
        return -(spread(left) + spread(right))
    values = [mean(left), mean(right)]
    return {"maxvalue": max(values), "maxabsvalue": max(map(abs, values)), "maxminusvalue": max(-v for v in values)}[criterion]


ROW = st.tuples(st.sampled_from([0.0, 0.5, 1.0, 3.25]), st.floats(0.1, 5.0))


@pytest.mark.parametrize("criterion", [c for c in CRITERIA])
@given(st.lists(ROW, min_size=2, max_size=12), st.lists(ROW, min_size=2, max_size=12))
@settings(max_examples=60, deadline=None)
def test_closed_forms_equal_row_sums(criterion, left, right):
    if criterion in ("poissondeviance", "gammadeviance") and not (any(n for n, _ in left) and any(n for n, _ in right)):
        return
    a, b, t = (Side(**{k: np.array(v) for k, v in sums_of(s).items()}) for s in (left, right, [*left, *right]))
    got = float(CRITERIA[criterion].value(a, b, t, ArrayMath))
    assert got == pytest.approx(direct(criterion, left, right), rel=1e-6, abs=1e-6)


def test_own_criterion():
    register("weightbalance", lambda l, r, t, m: -m.abs(l.w - r.w))  # noqa: E741
    with pytest.raises(ValueError):
        register("bad", lambda l, r, t, m: l.n, ("nope",))  # noqa: E741
    del CRITERIA["weightbalance"]


def made(k, seed):
    r = random.Random(seed)
    return {c: [(r.choice([0.0, 1.0, 2.5]), r.uniform(0.2, 2.0)) for _ in range(r.randint(1, 8))] for c in range(k)}


def brute_best(levels, criterion, least, subsets):
    codes = sorted(levels)
    found = []
    if subsets:
        rest = codes[:-1]
        sets = [set(s) for n in range(1, len(rest) + 1) for s in combinations(rest, n)]
    else:
        sets = [set(codes[: i + 1]) for i in range(len(codes) - 1)]
    for s in sets:
        left = [x for c in codes if c in s for x in levels[c]]
        right = [x for c in codes if c not in s for x in levels[c]]
        if len(left) > least and len(right) > least and len(left) > 1 and len(right) > 1:
            found.append(direct(criterion, left, right))
    return max(found, default=None)


@pytest.mark.parametrize("criterion", ["difference", "sse", "mse", "msepointwise", "maxvalue"])
@pytest.mark.parametrize("numeric", [True, False])
@pytest.mark.parametrize("seed", range(4))
def test_search_equals_brute_force(criterion, numeric, seed):
    levels = made(random.Random(seed).randint(2, 6), seed)
    codes = np.array(sorted(levels))
    by = [sums_of(levels[c]) for c in codes]
    sums = {s: np.array([x[s] for x in by]) for s in SUMS}
    found = splits.feature_splits(sums, codes, numeric, criterion, 1.0, 7, len(codes))
    best = max((v for v, _, _ in found), default=None)
    want = brute_best(levels, criterion, 1.0, not numeric)
    assert (best is None) == (want is None) and (best is None or best == pytest.approx(want, rel=1e-9))
    assert len(splits.gray_masks(5)) == 15 == len(set(splits.gray_masks(5)))


def test_query_search_equals_array_search(spark):
    levels = made(6, 11)
    rows = [(str(c), float(c), n, d, 1.0) for c, part in levels.items() for n, d in part]
    df = spark.createDataFrame(rows, "text string, number double, numerator double, denominator double, weight double")
    codes = np.arange(6)
    sums = {s: np.array([sums_of(levels[c])[s] for c in codes]) for s in SUMS}
    for criterion in CRITERIA:
        hist = level_sums(df, ["number"], sums=CRITERIA[criterion].sums, coded=False)
        got = splits.best_of(splits.candidates(hist, criterion, 1.0), ["level"]).collect()
        want = max(((v, left) for v, left, _ in splits.feature_splits(sums, codes, True, criterion, 1.0, 7, 6)), key=lambda x: (x[0], -len(x[1])), default=None)
        assert (not got) == (want is None)
        if want:
            assert got[0].value == pytest.approx(want[0], rel=1e-9) and got[0].level == max(want[1])
        text = level_sums(df, ["text"], sums=CRITERIA[criterion].sums, coded=False)
        masks = splits.subset_candidates(text, criterion, 1.0).agg(F.max("value")).first()[0]
        best = max((v for v, _, _ in splits.feature_splits(sums, codes, False, criterion, 1.0, 7, 6)), default=None)
        assert masks == pytest.approx(best, rel=1e-9)


def test_tie_goes_to_the_earlier_feature_and_the_lighter_side_is_left():
    part = (np.array([0, 1]), {"c": np.array([3.0, 5.0]), "n": np.array([1.0, 5.0]), "d": np.array([3.0, 5.0]), "w": np.array([3.0, 5.0])})
    flip = (np.array([0, 1]), {k: v[::-1] for k, v in part[1].items()})
    a = splits.best_split({"x": part, "y": part}, {"x", "y"}, {"x": 2, "y": 2}, "difference", 1.0, 7)
    b = splits.best_split({"t": flip}, set(), {"t": 2}, "difference", 1.0, 7)
    assert a.feature == "x" and b.left == [1] and b.left_weight == 3.0
    assert splits.best_split({"x": part}, {"x"}, {"x": 2}, "difference", 4.0, 7) is None


def test_many_levels_are_searched_or_refused(spark):
    rows = lambda k: spark.createDataFrame([(1, "f", f"{i:02}", 1.0, float(i % 5 + 1), 2.0, 1.0) for i in range(k)], "node long, feature string, level string, c double, n double, d double, w double")
    assert splits.subset_candidates(rows(13), "difference", 0.0).count() == 2**12 - 1
    with pytest.raises(Exception, match="too many to try all subsets"):
        splits.subset_candidates(rows(splits.MOST_SUBSET_LEVELS + 1), "difference", 0.0).count()
