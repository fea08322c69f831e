import random
import re
from itertools import combinations

import numpy as np

from ratiotree.llm.minhash import near_duplicates
from ratiotree.llm.textscan import BLOCK, word_hashes


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingle_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def brute(rows, k=4, percent=80):
    sets = [(i, shingle_set(t, k)) for i, t in rows]
    to = {i: i for i, _ in rows}

    def root(x):
        while to[x] != x:
            x = to[x]
        return x

    for (i, a), (j, b) in combinations(sets, 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = sorted((root(i), root(j)))
            to[y] = x
    return sorted((i, len(s), root(i), root(i) == i) for i, s in sets)


def made(seed=7, n=40):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdeéß", k=r.randint(1, 6)))
    rows = []
    for _ in range(n):
        base = [word() for _ in range(r.choice([1, 3, 4, 7, 12, 30, 80, 200]))]
        rows.append(base)
        for _ in range(r.randint(0, 6)):
            other = list(r.choice(rows[-7:]))
            for _ in range(r.randint(0, max(1, len(other) // 30))):
                other[r.randrange(len(other))] = word()
            rows.append(other)
    texts = [r.choice([" ", "\n", "\t "]).join(w.upper() if r.random() < 0.1 and w.isascii() else w for w in x) for x in rows]
    return [*enumerate(texts), (9001, None), (9002, ""), (9003, " \n\t "), (9004, "a b"), (9005, "A\x0bB"), (9006, "a\xa0b")]


def test_equals_brute_force(spark):
    rows = made()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n long, keys string")
    got = sorted(map(tuple, near_duplicates(df, k=4).drop("links_found").collect()))
    assert got == brute(rows)


def test_chain_across_a_hub(spark):
    """b and c are linked with each other but not with a, the smallest of their buckets."""
    r = random.Random(3)
    a = [f"w{i}" for i in range(60)]
    b = a[:48] + [f"x{r.random()}" for _ in range(12)]
    c = b[:-3] + ["y1", "y2", "y3"]
    rows = [(i, " ".join(t)) for i, t in enumerate([a, b, c] + [a[:44] + [f"z{i}{j}" for j in range(16)] for i in range(5)])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, near_duplicates(df, k=4).drop("links_found").collect())) == brute(rows)


def test_empty_table_and_null_id(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (0, "a b c")], "doc_id long, text string")
    assert sorted(((r.doc_id is None, r.doc_id, r.component_id, r.kept) for r in near_duplicates(df).collect()), key=str) == sorted([(True, None, None, True), (False, 0, 0, True), (False, 1, 0, False), (False, 1, 0, False)], key=str)


def test_long_rows_are_scanned_in_blocks():
    r = random.Random(1)
    texts = ["short one", "", "x" * (BLOCK + 77), " ".join("".join(r.choices("abc", k=5)) for _ in range(BLOCK // 2)), "tail words"]
    data = "".join(texts).encode()
    at = np.cumsum([0, *(len(t) for t in texts)])
    h, first = word_hashes(np.frombuffer(data, np.uint8), at)
    for i, t in enumerate(texts):
        one, _ = word_hashes(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))
        assert (h[first[i] : first[i + 1]] == one).all() and len(one) == len(t.split())
    assert len(set(h.tolist())) == len({w for t in texts for w in t.split()})


def test_repeated_ids_are_told_apart(spark):
    """Links are confirmed on the row's own text, also where another row of its doc_id has a different one."""
    a, b = " ".join(f"a{i}" for i in range(100)), " ".join(f"b{i}" for i in range(100))
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (3, "lone words here"), (None, a)]
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(-1, 96, -1, True), (1, 96, 1, True), (1, 96, 1, True), (2, 97, 1, False), (3, 1, 3, True), (3, 97, 1, False)]
