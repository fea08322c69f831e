import zlib

import numpy as np

from ratiotree.llm.sharding import jump, shard_documents


def slow_jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_equals_the_loop():
    keys = np.random.default_rng(1).integers(0, 2**64, 500, dtype=np.uint64)
    for n in (1, 2, 16, 17, 1000):
        assert jump(keys, n).tolist() == [slow_jump(int(k), n) for k in keys]


def slow_mix(x):
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ x >> 33) * factor % 2**64
    return x ^ x >> 33


def test_query_equals_brute_force(spark):
    """Whole rows, without NumPy: shards by the loop, sizes and checksums, slots as a gapless numbering."""
    rows = [(i * 37 - 500, None if i % 50 == 0 else "ü" * (i % 9) if i % 7 else "") for i in range(700)]
    rows += [(None, "no id"), (5, "again"), (5, "again"), (2**62, "x" * 3_000_000)]
    got = shard_documents(spark.createDataFrame([(*x, "s", 1, "k") for x in rows], "doc_id long, text string, shard string, rank int, _part string")).collect()
    want = []
    for i, t in rows:
        data = (t or "").encode()
        key = slow_mix((i or 0) % 2**64)
        want.append((i, len(data) + 1, zlib.crc32(data), "key", slow_jump(key, 16), slow_jump(key, 17)))
    order = lambda x: tuple(map(str, x))
    assert sorted((tuple(r[c] for c in ("doc_id", "size", "text_crc32", "law", "shard", "grown_shard")) for r in got), key=order) == sorted(want, key=order)
    for s in range(16):
        slots = sorted(r.slot for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_documents(spark):
    rows = [(i, None if i % 50 == 0 else "é" * (i % 9), "x", 1) for i in range(2000)]
    got = shard_documents(spark.createDataFrame(rows, "doc_id long, text string, shard string, slot int")).toPandas()
    assert len(got) == 2000 and set(got.law) == {"key"} and set(got["shard"]) == set(range(16))
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part))) and 80 < len(part) < 180
    assert ((got.grown_shard == got["shard"]) | (got.grown_shard == 16)).all() and (got.grown_shard == 16).sum() > 60
    text = dict((r[0], r[1]) for r in rows)
    for r in got.itertuples():
        data = (text[r.doc_id] or "").encode()
        assert r.size == len(data) + 1 and r.text_crc32 == zlib.crc32(data)


def test_same_place_in_any_table_and_edge_rows(spark):
    kind = "doc_id long, text string"
    a = {r.doc_id: r["shard"] for r in shard_documents(spark.createDataFrame([(i, "t") for i in range(50)], kind)).collect()}
    b = {r.doc_id: r["shard"] for r in shard_documents(spark.createDataFrame([(i, "other") for i in range(0, 50, 3)], kind)).collect()}
    assert all(a[i] == s for i, s in b.items())
    assert shard_documents(spark.createDataFrame([], kind)).count() == 0
    odd = shard_documents(spark.createDataFrame([(None, "a"), (1, "b"), (1, "b")], kind)).collect()
    assert len(odd) == 3 and len({(r["shard"], r.slot) for r in odd}) == 3
