import hashlib
import random
import re

from pyspark.sql import functions as F

from ratiotree.llm.exact import exact_duplicates


def brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i))
    out = []
    for i, t in rows:
        members = groups[norm(t)]
        keep = min(members)[1]
        out.append((i, keep, len(members), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out)


def test_equals_brute_force(spark):
    r = random.Random(2)
    rows = []
    for i in range(300):
        base = "".join(r.choices("aé \n", k=r.choice([1, 2, 5, 30, 200])))
        rows.append((i, base if i < 20 or r.random() < 0.5 else rows[r.randrange(i)][1]))
    long = "".join(r.choices("abc", k=70_000))
    rows += [(1000, long), (1001, long + " "), (1002, long[:-1] + "x"), (1003, None), (1004, ""), (1005, "\t \x0b"), (1006, "\xa0"), (1007, long[:-1])]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, name string, len int")
    for block in (64, 4096):
        assert sorted(map(tuple, exact_duplicates(df, block).collect())) == brute(rows)
    few = [(i, t and t[:500]) for i, t in rows]  # few bits: most names need ranks
    df = spark.createDataFrame(few, "doc_id long, text string")
    assert sorted(map(tuple, exact_duplicates(df, 32, 3).collect())) == brute(few)


def test_names_do_not_follow_partitions(spark):
    from ratiotree.llm import exact

    docs = spark.range(40).selectExpr("cast(repeat(concat('x', id), 50) as binary) as data")
    parts = F.array(F.col("data"), F.substring("data", 1, 16))
    found = []
    for n in (1, 7):
        named, names = exact._block_names(docs.repartition(n), parts, exact.Scratch(spark, "test"), 2)
        found.append({bytes(x.data): x.names for x in named.select("data", names.alias("names")).collect()})
    assert found[0] == found[1] and len({x[0] for x in found[0].values()}) == 40


def test_one_large_group(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, concat('t', id), repeat('same ', 20)) as text")
    got = exact_duplicates(df)
    assert got.where("group_size = 2000 and keep_id = 1").count() == 2000
    assert got.where("kept").count() == 1001


def test_empty_table_null_ids_and_repeated_rows(spark):
    assert exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(None, "a"), (1, "a"), (1, "a"), (1, "a "), (2, "a")], "doc_id long, text string")
    got = sorted(((r.doc_id or -1, r.keep_id or -1, r.group_size, r.kept) for r in exact_duplicates(df).collect()))
    assert got == [(-1, -1, 1, True), (1, 1, 4, False), (1, 1, 4, False), (1, 1, 4, True), (2, 1, 4, False)]
