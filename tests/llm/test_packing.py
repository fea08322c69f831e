import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from ratiotree.llm.packing import pack, plan
from ratiotree.llm.queries import tokenizer_path


@pytest.mark.parametrize("seed", range(12))
def test_plan_places_all_within_capacity(seed):
    r = random.Random(seed)
    capacity = r.choice([1, 7, 100, 2048])
    counts = {r.randint(1, capacity): r.randint(0, 30) for _ in range(r.randint(0, 200))}
    bins, seen = {}, {}
    for length, first, n, sequence, offset in plan(counts, capacity):
        for k in range(n):
            seen.setdefault(length, []).append(first + k)
            bins.setdefault(sequence + k, []).append((offset, length))
    assert {x: n for x, n in counts.items() if n} == {x: len(v) for x, v in seen.items()} and all(sorted(v) == list(range(len(v))) for v in seen.values())
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity and sum(3 * x > capacity for _, x in items) <= 2
    total = sum(x * n for x, n in counts.items())
    large = sum(n for x, n in counts.items() if 2 * x > capacity)
    assert len(bins) >= max(large, -(-total // capacity))
    assert len(bins) <= 1.25 * max(large, total / capacity) + 2


def test_pieces(spark):
    r = random.Random(1)
    rows = [(i, " ".join("".join(r.choices("abcdeé.,'", k=r.randint(1, 9))) for _ in range(r.choice([1, 20, 300, 900])))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, " \n\x0b"), (503, "the long one " * 9000), (503, "the long one"), (None, "Nobody's")]
    got = pack(spark.createDataFrame([(*x, "q", 1) for x in rows], "doc_id long, text string, length string, rank int"), tokenizer_path()).toPandas()
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = []
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            want.append((-1 if i is None else i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], dtype="<u4").tobytes())))
    assert sorted(want) == sorted(got.fillna({"doc_id": -1}).astype({"doc_id": int})[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None))
    for _, part in got.sort_values("offset").groupby("sequence_id"):
        assert part.offset.tolist() == [0, *part.length.cumsum().tolist()[:-1]] and part.length.sum() <= 2048


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).count() == 0


def test_sequences_hold_the_ids(spark):
    texts = {1: "A few words.", 2: "the long one " * 3000, 3: None, 4: "Some more, for one place after another"}
    got = pack(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), tokenizer_path()).toPandas()
    tokenizer = Tokenizer.from_file(tokenizer_path())
    sequences, documents = {}, {}
    for x in got.sort_values("offset").itertuples():
        ids = np.frombuffer(x.ids, "<u4").tolist()
        assert len(ids) == x.length and zlib.crc32(x.ids) == x.ids_crc32 and x.offset == len(sequences.setdefault(x.sequence_id, []))
        sequences[x.sequence_id] += ids
        documents.setdefault(x.doc_id, []).append((x.piece, ids))
    assert {i: [k for _, ids in sorted(v) for k in ids] for i, v in documents.items()} == {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in texts.items()}
    assert all(len(x) <= 2048 for x in sequences.values())
