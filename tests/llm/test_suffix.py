import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratiotree.llm import suffix
from ratiotree.llm.suffix import remove_repeats, suffix_array


@pytest.mark.parametrize("text", [b"", b"a", b"mississippi", b"aaaaaaaaaaaaaaaa", b"abababababab", b"ba" * 40 + b"c" + b"ba" * 40, *(bytes(random.Random(i).choices(b"ab" if i % 2 else b"abcde", k=5 * i)) for i in range(2, 40))])
def test_suffix_array(text):
    got = suffix_array(np.frombuffer(text, np.uint8).astype(np.int16)).tolist()
    assert got == sorted(range(len(text)), key=lambda i: text[i:])


@pytest.mark.parametrize("seed", range(12))
def test_suffix_array_of_many_signs(seed):
    """Alphabets about as large as the string, and repeats that need several levels of names."""
    r = np.random.default_rng(seed)
    words = [r.integers(0, 5 if seed % 2 else 400, r.integers(1, 30)) for _ in range(6)]
    t = np.concatenate([words[i] for i in r.integers(0, 6, 60)])
    got = suffix_array(t)
    assert got.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
    for induce in (suffix._induce, suffix._induce_each):
        small, lms = suffix._classified(t)
        order = sorted(lms.tolist(), key=lambda i: t[i:].tolist())
        assert induce(t, small, np.cumsum(np.bincount(t)), np.array(order, dtype=np.int64)).tolist() == got.tolist()
    common = suffix.common_prefixes(t, got, 7, np.ones(len(t), dtype=bool))
    for a, b in zip(got[:-1], got[1:], strict=True):
        k = next((k for k in range(7) if max(a, b) + k >= len(t) or t[a + k] != t[b + k]), 7)
        assert common[b] == k


def test_a_common_gram_is_split(spark):
    """Boilerplate in all documents: its anchor is split by what stands around it, down to whole strings, and nothing changes."""
    r = random.Random(9)
    plate = "".join(r.choices("abcdefgh", k=130))
    rows = [(i, "".join(r.choices("xyz", k=r.randint(0, 90))) + plate[r.randint(0, 60) : r.randint(70, 130)] + "".join(r.choices("uvw", k=r.randint(0, 90)))) for i in range(400)]
    rows += [(1000 + i, rows[i][1][r.randint(0, 9) :] + "!") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (1 << 30, 3000, 300):
        assert sorted(map(tuple, remove_repeats(df, hot=hot).drop("spans").collect())) == brute(rows, 100)


def test_memory_of_an_anchor_in_very_many_segments(spark):
    """No shard passes its size, so a worker's memory does not follow the number of segments."""
    r = random.Random(3)
    plate = "".join(r.choices("abcdefgh", k=40))
    rows = [(i, "".join(r.choices("xyzw", k=70)) + plate + "".join(r.choices("uvqr", k=70))) for i in range(20_000)]
    pieces = spark.createDataFrame([(b"12345678", i, 0, t.encode()) for i, t in rows[:4000]], "key binary, id long, start long, part binary")
    small, marks = suffix._split(pieces, 100, 32, 4096, suffix.Scratch(spark, "test"))
    sizes = [x.groupBy("key").agg(F.sum(F.length("part")).alias("b")).agg(F.max("b")).first()[0] or 0 for x in small]
    assert max(sizes) <= 4096 and marks.count() == 0
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), hot=65_536)
    assert got.agg(F.sum("n_removed")).first()[0] == 0


def brute(rows, length):
    seen, out = set(), []
    for i, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            s = data[p : p + length]
            if s in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(s)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        runs = sum(1 for j, g in enumerate(gone) if g and not (j and gone[j - 1]))
        out.append((i, len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def made(seed):
    r = random.Random(seed)
    passages = ["".join(r.choices("abé \n", k=r.randint(40, 400))) for _ in range(12)]
    rows = []
    for i in range(60):
        parts = [r.choice(passages)[r.randint(0, 20) :] if r.random() < 0.6 else "".join(r.choices("xyzß ", k=r.randint(1, 300))) for _ in range(r.randint(0, 5))]
        rows.append((i, "".join(parts)))
    rows += [(100, None), (101, ""), (102, "a" * 500), (103, "ab" * 300), (104, "a" * 99), (105, "a" * 700), *((200 + i, rows[7][1]) for i in range(5))]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = made(seed)
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).drop("spans")
    assert sorted(map(tuple, got.collect())) == brute(rows, 100)


def test_small_blocks_and_shards(spark, monkeypatch):
    """One long text over several blocks, in the same process."""
    r = random.Random(5)
    base = "".join(r.choices("abcd", k=3000))
    text = base + "".join(r.choices("efgh", k=2500)) + base[500:2600] + "x"
    monkeypatch.setattr(suffix, "BLOCK", 1000)
    import pyarrow as pa

    scan = suffix._scan(100, 32)
    out = pa.Table.from_batches(scan(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], names=["id", "text"])]))).sort_by([("done", "ascending"), ("anchor", "ascending"), ("body", "ascending"), ("id", "ascending"), ("start", "ascending")])
    assert sum(out["size"].to_pylist()) == len(text) - 99
    settled = pa.Table.from_batches(suffix._settle(100, 1 << 30)(iter(out.to_batches(max_chunksize=7)))).to_pylist()
    marks = [(x["start"], x["start"] + x["size"] + 99) for x in settled if not x["open"]]
    parts = [x for x in settled if x["open"]]
    for part, off in suffix.repeats([text.encode()[x["start"] : x["start"] + x["size"] + 99] for x in parts], np.ones(len(parts)), np.array([x["start"] for x in parts]), 100):
        at = parts[part]["start"] + off
        marks.append((at, at + 100))
    assert suffix.merged(marks) == [(5500, 7600)]


def test_empty_table_and_repeated_ids(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string, spans string")).count() == 0
    t = "".join(random.Random(1).choices("abcdef", k=150))
    df = spark.createDataFrame([(1, t), (1, t), (None, t[:120]), (2, "b"), (2, "a")], "doc_id long, text string")
    got = sorted(((r.doc_id or -1, r.n_bytes, r.n_removed, r.n_spans) for r in remove_repeats(df).collect()))
    assert got == [(-1, 120, 0, 0), (1, 150, 120, 1), (1, 150, 150, 1), (2, 1, 0, 0), (2, 1, 0, 0)]
