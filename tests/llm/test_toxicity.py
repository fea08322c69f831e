import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ratiotree.llm import textscan, toxicity


def slow_segments(score):
    """Split at the segment of the greatest sum, the leftmost and then shortest, again and again."""
    best = None
    for i in range(len(score)):
        total = 0.0
        for j in range(i, len(score)):
            total += score[j]
            if total > 0 and (best is None or total > best[2] + 1e-12):
                best = (i, j + 1, total)
    if best is None:
        return []
    i, j, total = best
    return [*slow_segments(score[:i]), (i, j, total), *((a + j, b + j, s) for a, b, s in slow_segments(score[j:]))]


@pytest.mark.parametrize("seed", range(30))
def test_segments_equal_recursive_search(seed):
    r = np.random.default_rng(seed)
    score = np.round(r.normal(-0.3, 1.0, r.integers(0, 40)), 3)
    got = toxicity.segments(score)
    want = slow_segments(score.tolist())
    assert [x[:2] for x in got] == [x[:2] for x in want] and np.allclose([x[2] for x in got], [x[2] for x in want])


def made(spark, n=900):
    r = random.Random(6)
    words = ["".join(r.choices("abcdefghij", k=r.randint(2, 7))) for _ in range(400)]
    bad = ["zorgly", "mwump", "qqrat", "vlexx"]
    rows, labels = [], []
    for i in range(n):
        text = r.choices(words, k=r.randint(20, 200))
        toxic = i % 6 == 0
        if toxic:
            for _ in range(4):
                text.insert(r.randrange(len(text)), r.choice(bad))
        rows.append((i, " ".join(text), "en", "s", 1.0))
        labels.append((i, 0, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = made(spark)
    got = toxicity.score_held_out(docs, labels).toPandas().set_index("doc_id")
    held = got[got.held_out]
    right = (held.predicted == (held.index % 6 == 0)).mean()
    assert len(held) > 200 and right > 0.98 and got.score.between(0, 1).all()


def test_passages_and_edge_rows(spark):
    docs, labels = made(spark)
    labels = labels.union(spark.createDataFrame([(5, 0, None), (None, 0, 1), (77_777, 0, 1)], labels.schema))
    model = toxicity.train(docs, labels)
    odd = [(1, None), (2, ""), (3, "é zorgly mwump! zorgly qqrat e"), (3, "é zorgly mwump! zorgly qqrat e"), (None, "ab ac"), (4, "ab " * 200_000 + "zorgly qqrat vlexx mwump " * 3)]
    rows = toxicity.score_documents(spark.createDataFrame(odd, "doc_id long, text string"), model).collect()
    by = {}
    for x in rows:
        by.setdefault(x.doc_id, []).append(x)
    assert len(rows) == 6 and by[1][0].score == by[2][0].score == by[None][0].score and by[1][0].predicted == 0
    assert len({x.score for x in by[3]}) == 1 and by[3][0].predicted == 1 and by[4][0].predicted == 1
    span = by[3][0].passages[0]
    assert "é zorgly mwump! zorgly qqrat e".encode()[span.start : span.end].decode() == "zorgly mwump! zorgly qqrat"
    kept = toxicity.keep_clean(spark.createDataFrame(odd, "doc_id long, text string"), model).collect()
    assert sorted((x.doc_id or 0) for x in kept) == [0, 1, 2]


def test_no_labels_and_empty_table(spark):
    docs, labels = made(spark, 30)
    assert {x.score for x in toxicity.score_documents(docs, toxicity.train(docs, labels.where("false"))).collect()} == {0.5}
    empty = docs.where("false")
    assert toxicity.score_held_out(empty, labels).count() == 0


def test_repeats_count_once():
    column = pa.array(["aaaa bbbb aaaa", None, "", "cccc"])
    assert len(toxicity.distinct(column)) == 3 and len(toxicity.distinct(column.slice(1, 2))) == 0
    assert len(toxicity.distinct(pa.array(["long word", "long word long"]))) == 4


def test_blocks_do_not_matter(monkeypatch):
    r = random.Random(4)
    words = ["".join(r.choices("abcdefghijkl", k=r.randint(1, 14))) for _ in range(300)]
    column = pa.array([" ".join(r.choices(words, k=k)) for k in (3000, 0, 1, 40, 2500, 700)])
    model = toxicity.Model(np.sort(np.concatenate([next(toxicity.tokens(pa.array([w])))[0][0] for w in words[:20]])), np.linspace(1, 3, 20), np.full(20, 4.0))
    one, many = model.read(column), np.sort(toxicity.distinct(column))
    monkeypatch.setattr(textscan, "BLOCK", 512)
    assert all(np.array_equal(x, y) for x, y in zip(one, model.read(column), strict=True)) and np.array_equal(many, np.sort(toxicity.distinct(column)))


def test_passages_of_words_seen_before(spark):
    model = toxicity.train(*made(spark))
    far, passage = "ab " * 300_000, "zorgly qqrat vlexx mwump"
    alone = " ".join(far + w for w in passage.split())
    texts = [(1, f"{alone} {far}{passage} {far}"), (2, f"{passage} {'ab ' * 3000}{passage} {'ab ' * 3000}{passage}")]
    rows = {x.doc_id: (x, dict(texts)[x.doc_id]) for x in toxicity.score_documents(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    for i, n in ((1, 1), (2, 3)):
        row, text = rows[i]
        assert row.predicted == 1 and [text[p.start : p.end] for p in row.passages] == [passage] * n
    kept = toxicity.keep_clean(spark.createDataFrame(texts, "doc_id long, text string"), model)
    assert kept.count() == 0


def slow_model(texts, labels, o):
    """The model from words as strings, one by one: counts, log-odds, drift, lambda, K and the logistic curve."""
    stop = re.compile(r"[\x20\x09-\x0D!-/:-@\[-`{-~]+")
    words = [[w for w in stop.split(re.sub("[A-Z]", lambda m: m.group().lower(), t)) if w] for t in texts]
    parts = lambda w: {w, *((w[:k], k) for k in o.heads if len(w) > k)}
    counts, total = ({}, {}), [0, 0]
    for ws, y in zip(words, labels, strict=True):
        found = set().union(*map(parts, ws)) if ws else set()
        total[y] += len(found)
        for x in found:
            counts[y][x] = counts[y].get(x, 0) + 1
    known = {}
    for x, t in counts[1].items():
        if t < 2:
            continue
        c = counts[0].get(x, 0)
        prior = o.prior * (c + t) / sum(total) + o.floor
        a, b = t + prior, c + prior
        delta = math.log(a / (total[1] + o.prior - a)) - math.log(b / (total[0] + o.prior - b))
        z = delta / math.sqrt(1 / a + 1 / b)
        if z > o.sure and delta > o.least:
            known[x] = (z, delta)
    word_score = lambda w: max((known[x] for x in parts(w) if x in known), default=(0.0, 0.0))[1]
    plain = [[word_score(w) for w in ws] for ws in words]
    return known, plain


@pytest.mark.parametrize("heads", [(), (4, 6)])
def test_equals_brute_force(spark, heads):
    docs, labels = made(spark, 240)
    options = toxicity.Options(heads=heads, prior=300.0)
    model = toxicity.train(docs, labels, options=options)
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    known, plain = slow_model([t for _, t in rows], [toxic[i] for i, _ in rows], options)
    assert len(known) == len(model.known) and np.allclose(sorted(d for _, d in known.values()), np.sort(model.score)) and np.allclose(sorted(z for z, _ in known.values()), np.sort(model.sure))
    # scores are counted in steps of 0.05 for drift and lambda, so those are near only
    clean = [x for (i, _), s in zip(rows, plain, strict=True) if not toxic[i] for x in s]
    drift = options.drift + sum(clean) / len(clean)
    assert abs(model.drift - drift) < 0.01
    tilt = sum(math.exp(model.rate * (x - model.drift)) for x in clean) + sum(0.5 * math.exp(model.rate * (d - model.drift)) for _, d in known.values())
    assert abs(tilt / (len(clean) + 0.5 * len(known)) - 1) < 0.05
    scored = [[x - model.drift for x in s] for s in plain]
    best = [max((x for _, _, x in slow_segments(s)), default=0.0) for s in scored]
    law = [len(s) * math.exp(-model.rate * b) for (i, _), s, b in zip(rows, scored, best, strict=True) if not toxic[i] and s]
    assert abs(model.log_k + math.log(sum(law) / len(law))) < 1e-6
    evidence = []
    for s in scored:
        expected = [model.log_k + math.log(max(toxicity.SHORT, len(s))) - model.rate * x for _, _, x in slow_segments(s)]
        evidence.append(min(60.0, sum(-x for x in expected if x < math.log(options.level))))
    # the curve has no slope left to gain: its residuals do not follow the evidence
    p = [1 / (1 + math.exp(-(model.bias + model.slope * e))) for e in evidence]
    y = [toxic[i] for i, _ in rows]
    assert abs(sum(a - b for a, b in zip(y, p, strict=True)) - 1e-6 * model.bias) < 1e-3
    assert abs(sum((a - b) * e for a, b, e in zip(y, p, evidence, strict=True)) - 1e-2 * model.slope) < 1e-2
    got = {r.doc_id: r.score for r in toxicity.score_documents(docs, model).collect()}
    assert all(abs(got[i] - q) < 1e-6 for (i, _), q in zip(rows, p, strict=True))


def test_choice_by_folds_of_training_rows(spark):
    docs, labels = made(spark, 300)
    # a held-out label, however wrong, changes nothing
    odd = labels.withColumn("toxic", F.when(toxicity.remainder() == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    tried = {"plain": toxicity.Options(prior=300.0), "strict": toxicity.Options(prior=300.0, sure=50.0)}
    found = [toxicity.choose(docs, x, tried, 2).orderBy("name", "fold").collect() for x in (labels, odd)]
    same = lambda rows: [(r.name, r.fold, round(r.loss, 9), r.missed, r.false_alarms) for r in rows]
    assert same(found[0]) == same(found[1]) and len(found[0]) == 4
    assert all(a.loss < b.loss and a.missed < b.missed for a, b in zip(found[0][:2], found[0][2:], strict=True))
