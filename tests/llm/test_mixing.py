import hashlib
import re

from pyspark.sql import functions as F

from ratiotree.llm.mixing import mix_sources

ROWS = [
    (1, "one two three", "en", "a"), (2, "one " * 400, "en", "a"), (3, "x | y", "de", "b"), (4, None, "de", "b"), (5, "", None, None),
    (6, "word " * 900, "fr", None), (7, "deux mots", "fr", "a"), (7, "deux mots", "fr", "a"), (None, "no id", "en", "b"), (8, "###", "en", "c"),
]
KIND = "doc_id long, text string, lang string, source string"


def topic(t):
    if not t:
        return "empty"
    if " | " in t:
        return "table"
    if "%%%" in t or "###" in t:
        return "marked"
    return "short" if len(t) < 600 else "medium" if len(t) < 4000 else "long"


def brute(rows, power=0.7, rounds=200, seed=20):
    n = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _, _ in rows]
    cell = [(s or "(none)", l or "(none)", topic(t)) for _, t, l, s in rows]
    t = {}
    for c, k in zip(cell, n, strict=True):
        t[c] = t.get(c, 0) + k
    t = {c: v for c, v in t.items() if v}
    total, w, margins = sum(t.values()), {c: float(v) for c, v in t.items()}, []
    for j in range(3):
        sums = {}
        for c, v in t.items():
            sums[c[j]] = sums.get(c[j], 0) + v
        p = {k: (v / total) ** power for k, v in sums.items()}
        margins.append({k: v * total / sum(p.values()) for k, v in p.items()})
    for _ in range(rounds):
        for j in range(3):
            sums = {}
            for c, v in w.items():
                sums[c[j]] = sums.get(c[j], 0) + v
            w = {c: v * margins[j][c[j]] / sums[c[j]] for c, v in w.items()}
    f = {c: w[c] / t[c] for c in w}
    top = max(f.values())
    out = []
    for (i, _, _, _), c, k in zip(rows, cell, n, strict=True):
        u = int(hashlib.md5(f"{'null' if i is None else i}:{seed}".encode()).hexdigest()[:8], 16) / 2**32
        p = f[c] / top if c in f else 1.0
        out.append((i or -1, *c, k, round(f.get(c, 1.0), 6), round(p, 6), u < p))
    return sorted(out)


def test_equals_brute_force(spark):
    df = spark.createDataFrame([(*r, 1, 2.0) for r in ROWS], f"{KIND}, kept int, weight double")
    got = sorted((r.doc_id or -1, r.source, r.lang, r.topic, r.n_tokens, round(r.weight, 6), round(r.probability, 6), r.kept) for r in mix_sources(df, rounds=40).collect())
    assert got == brute(ROWS, rounds=40)


def test_marginals_reach_given_targets(spark):
    df = spark.range(4000).selectExpr("id as doc_id", "repeat('w ', 1 + int(id % 7)) as text", "if(id % 3 = 0, 'en', 'de') as lang", "if(id % 5 = 0, 'a', 'b') as source")
    target = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "value string, share double")
    out = mix_sources(df, {"source": target}, rounds=20)
    share = {r.source: r.t for r in out.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("weight")).alias("t")).collect()}
    assert abs(share["a"] / sum(share.values()) - 0.5) < 1e-6


def test_carry_keeps_the_rows_and_empty_table(spark):
    df = spark.createDataFrame([(*r, "x", 3) for r in ROWS], f"{KIND}, kept string, weight int")
    got = mix_sources(df, carry=True)
    assert got.select("row.*").schema == df.schema and got.count() == len(ROWS)
    assert mix_sources(spark.createDataFrame([], KIND)).count() == 0


def test_long_texts_and_what_is_left(spark, sf_dir):
    df = spark.createDataFrame([(1, "w " * 400_000, "en", "a"), (2, "w", "de", "b")], KIND)
    assert {r.doc_id: r.n_tokens for r in mix_sources(df).collect()} == {1: 400_000, 2: 1}
    # with the rounds of production, no marginal of the example table is off
    assert mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).agg(F.max("residual")).first()[0] == 0
    # targets that no weights can reach: rounds end, and the error is told
    cross = spark.createDataFrame([(1, "w", "en", "a"), (2, "w", "de", "b")], KIND)
    target = lambda a, b: spark.createDataFrame([(a, 0.9), (b, 0.1)], "value string, share double")
    assert mix_sources(cross, {"source": target("a", "b"), "lang": target("de", "en")}, rounds=8).agg(F.max("residual")).first()[0] > 1
