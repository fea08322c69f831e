"""Fingerprints by order MinHash (Marçais, DeBlasio, Pandey and Kingsford, 2019).

A text's k-mers of characters are numbered by occurrence, so repeats differ. For each of m orders the l least k-mers are taken
in text order and hashed as a tuple; the share of equal tuples falls with the edit distance, also where texts hold the same k-mers in another order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .identity import told_apart
from .scratch import Scratch
from .textscan import U, mix, powers, slices

K, L, M = 8, 2, 32
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_FACTORS = mix(np.arange(1, 4097, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)
_TOP = U(0xFFFFFFFFFFFFFFFF)
CHUNK = 4096


def kmers(text: str, k: int = K) -> np.ndarray:
    """A hash for each k-mer and its occurrence number, in text order; a shorter text is one k-mer, an empty one none."""
    signs = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(U)
    n = len(signs)
    if not n:
        return signs
    k = min(k, n)
    total = np.zeros(n + 1, dtype=U)
    np.cumsum(mix(signs + U(1)) * powers(_BASE, n), out=total[1:])
    h = mix((total[k:] - total[:-k]) * powers(_INVERSE, n)[: n - k + 1])
    size = len(h)
    low = U((1 << max(1, int(size).bit_length())) - 1)
    order = np.sort((h & ~low) | np.arange(size, dtype=U))  # equal k-mers stand together, first occurrence first
    same = np.zeros(size, dtype=bool)
    np.equal(order[1:] & ~low, order[:-1] & ~low, out=same[1:])
    if same.any():
        at = np.flatnonzero(same)
        first = np.flatnonzero(~same)
        number = at - first[np.searchsorted(first, at, "right") - 1]
        where = (order[at] & low).astype(np.int64)
        h[where] = mix(h[where] + number.astype(U) * U(0xA24BAED4963EE407))
    return h


def least(x: np.ndarray, offset: int, m: int, l: int) -> tuple[np.ndarray, np.ndarray]:  # noqa: E741
    """For each of m orders, the ranks and positions of the l least of ``x``, rows of m; fewer if there are fewer."""
    ranks, places = [], []
    factors = _FACTORS[:m, None]
    rows = np.arange(m)
    for lo in range(0, len(x), CHUNK):
        part = x[None, lo : lo + CHUNK] * factors
        for _ in range(min(l, part.shape[1])):
            at = part.argmin(1)
            ranks.append(part[rows, at])
            places.append(at + (lo + offset))
            part[rows, at] = _TOP
    if not ranks:
        return np.zeros((m, 0), U), np.zeros((m, 0), np.int64)
    return _best(np.stack(ranks, 1), np.stack(places, 1), l)


def _best(ranks: np.ndarray, places: np.ndarray, l: int) -> tuple[np.ndarray, np.ndarray]:  # noqa: E741
    keep = np.argsort(ranks, axis=1, kind="stable")[:, :l]
    return np.take_along_axis(ranks, keep, 1), np.take_along_axis(places, keep, 1)


def tuples(ranks: np.ndarray, places: np.ndarray) -> np.ndarray:
    """One 32-bit hash for each order, of the k-mers in text order."""
    ranks = np.take_along_axis(ranks, np.argsort(places, axis=1), 1)
    out = np.full(len(ranks), ranks.shape[1], dtype=U)
    for j in range(ranks.shape[1]):
        out = mix(out * U(0x9FB21C651E98DF25) + ranks[:, j])
    return (out >> U(32)).astype(">u4")


def both(text: str, edited: str, shared: int, k: int = K, l: int = L, m: int = M) -> tuple[bytes, bytes]:  # noqa: E741
    """The fingerprints of two texts with the same first ``shared`` characters; an empty text has an empty one."""
    x, y = kmers(text, k), kmers(edited, k)
    head = max(0, min(shared - k + 1, len(x), len(y)))
    start = least(x[:head], 0, m, l)
    out = []
    for h in (x, y):
        if len(h):
            rest = least(h[head:], head, m, l)
            out.append(tuples(*_best(np.hstack([start[0], rest[0]]), np.hstack([start[1], rest[1]]), l)).tobytes())
        else:
            out.append(b"")
    return out[0], out[1]


def likeness(a: bytes, b: bytes) -> float:
    """The share of equal tuples; empty texts are like each other only."""
    if not a or not b:
        return float(a == b)
    return float((np.frombuffer(a, ">u4") == np.frombuffer(b, ">u4")).mean())


def fingerprint(text: str, k: int = K, l: int = L, m: int = M) -> bytes:  # noqa: E741
    return both(text, "", 0, k, l, m)[0]


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` are below ``key``, by halving."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key <= bounds[mid], tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(bounds))


def _compare(k: int, l: int, m: int):  # noqa: E741
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cut, rows = None, None, []

        def made() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        for batch in slices(batches, 3, rows=1024):
            for bucket, extra, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is not None and held[0] == bucket:
                    # the doc before in this bucket is complete now: its next one is here
                    own_doc, own = held[1], held[2]
                    n = len(own)
                    tail = n // 3
                    edited = own[: n - tail] + text[:tail]
                    a, b = both(own, edited, n - tail, k, l, m)
                    if cut is not None:
                        rows[-1][-1] = likeness(cut, a)
                    cut = a
                    rows.append([own_doc, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), a.hex(), b.hex(), likeness(a, b), 0.0])
                    if extra:
                        rows[-1][-1] = likeness(cut, fingerprint(text, k, l, m))
                        cut = None
                held = None if extra else (bucket, doc, text)
            if len(rows) > 1:  # the last one waits for the fingerprint after it
                last = rows.pop() if cut is not None else None
                if rows:
                    yield made()
                if last is not None:
                    rows.append(last)
        if rows:
            yield made()

    return run


def compare_neighbours(docs: DataFrame, k: int = K, l: int = L, m: int = M) -> DataFrame:  # noqa: E741
    """One row for each row of ``docs(doc_id, text, ...)``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one of the next smaller doc_id, after the smallest the largest. The edited text is the text with its last
    floor(n_chars / 3) characters replaced by the first as many (or all) of the next document's. Fingerprints are hexadecimal, 8 digits
    for each of m orders; those of empty and null texts are empty, and like each other alone. Repeated ids follow each other by their texts' hashes, the greatest
    first; a null doc_id counts as the smallest. A single row is its own next one. An empty table gives an empty result.
    Texts of any length are read whole: one text's k-mers are held at a time. Further columns are not read, whatever their names.
    Ids are dealt by ranges, whose bounds and largest ids, one for each partition, are all that the driver sees; rows of one id are numbered first, so they are dealt too.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs, _ = told_apart(docs, Scratch(spark, "ordermin"))
    docs = docs.withColumnRenamed("id", "key")
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = docs.select("key").approxQuantile("key", [i / parts for i in range(1, parts)], 0.2 / parts)
    bounds = sorted({int(x) for x in found})
    docs = docs.withColumn("bucket", _bucket(F.col("key"), bounds))
    largest = sorted(tuple(r) for r in docs.groupBy("bucket").agg(F.max("key")).collect())  # at most a row for each partition
    follows = {largest[i][1]: largest[(i + 1) % len(largest)][0] for i in range(len(largest))}
    table = spark.createDataFrame([(k_, b) for k_, b in follows.items()], "key long, before int")
    rows = docs.join(F.broadcast(table), "key", "left")
    sent = rows.select("key", "doc_id", "text", F.explode(F.expr("if(before is null, array(struct(bucket, false as extra)), array(struct(bucket, false as extra), struct(before as bucket, true as extra)))")).alias("to"))
    dealt = sent.select("key", "doc_id", "text", "to.bucket", "to.extra").repartitionById(parts, F.col("bucket"))
    dealt = dealt.sortWithinPartitions(F.col("bucket"), F.col("extra"), F.col("key").desc()).select("bucket", "extra", "doc_id", "text")
    return dealt.mapInArrow(_compare(k, l, m), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
