import random
import re

import pytest

import corpus_pipeline
from ratiotree.llm import queries

from . import test_mixing
from .test_minhash import brute as near_brute

KIND = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder with documents and labels: toxic ones, copies, near copies, nulls, empty texts."""
    r = random.Random(12)
    words = ["".join(r.choices("abcdefghij", k=r.randint(2, 7))) for _ in range(300)]
    docs, labels = [], []
    for i in range(420):
        text = r.choices(words, k=r.randint(15, 120))
        if i % 7 == 0:
            for _ in range(4):
                text.insert(r.randrange(len(text)), r.choice(["zorgly", "mwump", "qqrat"]))
        text = " ".join(text)
        if i % 7 and i % 5 == 0 and i > 20:
            old = docs[i - 9][1] or "x"
            text = old if i % 2 else old + " " + r.choice(words)
        docs.append((i, None if i == 33 else "" if i in (34, 36) else text, r.choice(["en", "de", None]), r.choice(["a", "b"]), 1))
        labels.append((i, 0, int(bool(re.search("zorgly|mwump|qqrat", docs[-1][1] or "")))))
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, KIND).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, docs


def stage(name, spark, rows, path):
    found = dict(corpus_pipeline.STAGES)[name](spark, spark.createDataFrame(rows, KIND), path)
    return sorted((tuple(x) for x in found.collect()), key=str)


def test_stages_equal_brute_force(spark, tables):
    path, rows = tables
    kept = stage("toxicity", spark, rows, path)
    assert {x[0] for x in rows} - {x[0] for x in kept} == {x[0] for x in rows if re.search("zorgly|mwump|qqrat", x[1] or "")}
    groups = {}
    for x in kept:
        key = re.sub(r"[\x20\x09-\x0D]", "", x[1] or "")
        groups[key] = min(groups.get(key, x), x, key=lambda y: (-len(y[1] or ""), y[0]))
    exact = stage("exact dedup", spark, kept, path)
    assert exact == sorted(groups.values(), key=str)
    near = stage("MinHash near-dedup", spark, exact, path)
    stays = {i for i, _, _, keep in near_brute([x[:2] for x in exact], k=5) if keep}
    assert {x[0] for x in near} == stays and len(stays) < len(exact)
    mixed = stage("mixing to target weights", spark, near, path)
    want = {x[0] for x in test_mixing.brute([x[:4] for x in near]) if x[-1]}
    assert {x[0] or -1 for x in mixed} == want
    pieces = dict(corpus_pipeline.STAGES)["best-fit packing"](spark, spark.createDataFrame(mixed, KIND), path).toPandas()
    assert set(pieces.doc_id) == {x[0] for x in mixed}
    got = queries.pipeline(spark, path).toPandas()
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got[key].to_numpy().tolist())) == sorted(map(tuple, pieces[key].to_numpy().tolist()))


def test_repeated_and_null_ids(spark, tables):
    path, _ = tables
    rows = [(1, "a b c d e f", "en", "a", 1), (1, "a b c d e f", "en", "a", 1), (1, "g h i j k l", "en", "a", 1), (None, "a b c d e f", "en", "a", 1), (2, "g h i j k l", "en", "a", 1)]
    for name in ("exact dedup", "MinHash near-dedup"):
        assert [x[:2] for x in stage(name, spark, rows, path)] == [(1, "g h i j k l"), (None, "a b c d e f")]


def test_empty_documents(spark, tables):
    path, _ = tables
    for name, run in corpus_pipeline.STAGES:
        assert run(spark, spark.createDataFrame([], KIND), path).count() == 0, name


def test_long_texts_and_clashing_columns(spark, tables):
    """Each stage keeps further columns as they are, also such that are called like its own, and takes whole texts."""
    path, _ = tables
    long = " ".join(f"word{i}" for i in range(40_000))
    rows = [(1, long, "en", "a", 1), (2, long + " and more", "en", "a", 2), (3, long + " ", "de", "b", 3), (4, "short one", None, None, 4)]
    extra = "_pipeline_row long, kept string, id string, name int, len string, component_id string, weight string, key binary, residual int, row string"
    docs = spark.createDataFrame([(*x, i, "k", "i", 5, "l", "c", "w", b"b", 6, "r") for i, x in enumerate(rows)], f"{KIND}, {extra}")
    want = {"toxicity": [1, 2, 3, 4], "exact dedup": [2, 3, 4], "MinHash near-dedup": [1, 4], "mixing to target weights": None}
    for name, run in corpus_pipeline.STAGES[:-1]:
        found = run(spark, docs, path)
        assert found.columns == docs.columns and found.schema == docs.schema
        got = sorted(tuple(x) for x in found.collect())
        assert set(got) <= {tuple(x) for x in docs.collect()}
        assert want[name] is None or [x[0] for x in got] == want[name], name
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, path).groupBy("doc_id").sum("length").collect()
    assert len(pieces) == 4 and {x[0] for x in pieces if x[1] > 80_000} == {1, 2, 3}
