import hashlib
import random

import numpy as np

from ratiotree.llm.ordermin import compare_neighbours, fingerprint, kmers, least, likeness


def test_least_and_kmers_equal_brute_force():
    r = random.Random(1)
    for n in (0, 1, 5, 8, 9, 100, 9000):
        text = "".join(r.choices("abé", k=n))
        h = kmers(text)
        assert len(h) == (max(1, n - 7) if n else 0) and len(set(h.tolist())) == len(h)
        ranks, places = least(h, 0, 8, 2)
        if n > 8:
            from ratiotree.llm.ordermin import _FACTORS

            for j in range(8):
                full = h * _FACTORS[j]
                want = np.argsort(full, kind="stable")[:2]
                assert places[j].tolist() == want.tolist() and ranks[j].tolist() == full[want].tolist()


def test_order_counts():
    r = random.Random(4)
    a, b = "".join(r.choices("abcdefgh", k=600)), "".join(r.choices("ijklmnop", k=600))
    moved = likeness(fingerprint(a + b), fingerprint(b + a))
    near = likeness(fingerprint(a + b), fingerprint(a[:300] + "x" + a[300:] + b))
    assert near > 0.9 and moved < 0.75 and likeness(fingerprint(a), fingerprint(b)) == 0.0


def brute(rows):
    rows = sorted(rows, key=lambda x: -x[0])
    out = []
    for j, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(j + 1) % len(rows)][1] or ""
        tail = len(t) // 3
        edited = t[: len(t) - tail] + nxt[:tail]
        a, b, c = fingerprint(t), fingerprint(edited), fingerprint(nxt)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), a.hex(), b.hex(), likeness(a, b), likeness(a, c)))
    return sorted(out)


def test_equals_brute_force(spark):
    r = random.Random(9)
    rows = [(i * 7 % 1000, r.choice([None, "", "ab", "".join(r.choices("aé ß𝄞", k=r.randint(1, 300)))])) for i in range(200)]
    rows.append((5000, "".join(r.choices("abcdef", k=20_000))))
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, bucket int, extra string")
    assert sorted(map(tuple, compare_neighbours(df).collect())) == brute(rows)


def test_small_tables(spark):
    kind = "doc_id long, text string"
    assert compare_neighbours(spark.createDataFrame([], kind)).count() == 0
    one = compare_neighbours(spark.createDataFrame([(3, "abcdef" * 5)], kind)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    rows = compare_neighbours(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], kind)).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in rows) == [(0, 1), (1, 3), (1, 3)]


def test_one_id_on_many_rows(spark):
    """Rows of one id are dealt over the partitions in the order of their hashes; nothing else changes."""
    rows = [(7, f"text number {i} " * (i % 5)) for i in range(300)] + [(9, "nine"), (1, "one")]
    got = compare_neighbours(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    placed = [x for _, x in sorted(enumerate(rows), key=lambda x: (x[1][0], digest(x[1][1])))]
    want = brute([(k, t) for k, (_, t) in enumerate(placed)])
    assert sorted(tuple(r)[1:] for r in got) == sorted(x[1:] for x in want)
