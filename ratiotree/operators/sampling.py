"""Samples and folds of exact sizes, decided by a hash of the key alone.

A key's hash comes from md5, so other engines can repeat it. A hash of good keys at a wanted rank lies where its share of all numbers does, so one pass
counts the hashes below that place and lists the few around it, for any number of seeds at once. Where keys repeat so much that it lies elsewhere, hashes
are counted by their leading bits. No task and no driver sorts or holds the rows: a sample is then the filter ``hash <= cutoff``, whatever the partitions.
"""

from __future__ import annotations

from collections.abc import Callable
from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a hash, bits that one count settles, and how many hashes may be sorted on the driver at the end.
BITS, STEP, FEW = 60, 12, 4096
#: Hashes are listed up to so many standard deviations from where a rank is expected, and for so many seeds in one pass.
AROUND, AT_ONCE = 6, 8


def hashed(key: Column, seed: int) -> Column:
    """A whole number of 60 bits, of the key's text and the seed."""
    return F.conv(digits(key, seed), 16, 10).cast("long")


def digits(key: Column, seed: int) -> Column:
    """The same as text of 15 hexadecimal digits, whose order is that of the numbers; taking the number out of it costs more than the hash."""
    return F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")).cast("binary")), 1, BITS // 4)


def _text(number: int) -> str:
    return f"{number:0{BITS // 4}x}"


def cutoffs(rows: DataFrame, hash_of: Column, wanted: Callable[[int], list[int]]) -> list[int]:
    """The hashes at the ranks (from 1; 0 gives -1, below all) that ``wanted`` gives for the number of rows.

    Each count takes 12 bits more, for the few leading bits that a wanted rank falls into. Equal hashes share a fate, so sizes are exact where keys differ.
    """
    hashes = rows.select(hash_of.alias("h")).where("h is not null")
    shift = BITS - STEP
    counts = {r[0]: r[1] for r in hashes.groupBy(F.shiftright("h", shift)).count().collect()}  # at most 4096 rows
    total = sum(counts.values())
    ranks = [min(r, total) for r in wanted(total)]
    place = {r: (None, r) for r in ranks if r > 0}  # leading bits so far, rank among the hashes that have them
    while True:
        for r, (lead, rest) in place.items():
            for b in sorted(x for x in counts if lead is None or x >> STEP == lead):
                if rest <= counts[b]:
                    place[r] = (b, rest)
                    break
                rest -= counts[b]
        if not place or not shift:
            break
        leads = sorted({b for b, _ in place.values()})
        inside = hashes.where(F.shiftright("h", shift).isin(leads))
        if sum(counts[b] for b in leads) <= FEW:
            found: dict[int, list[int]] = {}
            for (h,) in inside.collect():
                found.setdefault(h >> shift, []).append(h)
            place = {r: (sorted(found[b])[rest - 1], rest) for r, (b, rest) in place.items()}
            break
        shift -= STEP
        counts = {r[0]: r[1] for r in inside.groupBy(F.shiftright("h", shift)).count().collect()}  # at most 4096 rows for each wanted rank
    return [place[r][0] if r > 0 else -1 for r in ranks]


def all_cutoffs(rows: DataFrame, key: str, seeds: list[int], wanted: Callable[[int], list[int]]) -> list[list[int]]:
    """``cutoffs`` by the hashes of ``key`` with each seed: one pass for AT_ONCE seeds, after one that counts the rows."""
    rows = rows.select(F.col(key)).where(F.col(key).isNotNull())
    total = rows.count()
    ranks = sorted({min(r, total) for r in wanted(total)} - {0})
    # the hash of a rank is expected at its share of all numbers, give or take some sqrt(total) ranks
    spans: list[list[int]] = []
    for r in ranks:
        reach = AROUND * sqrt(r * (total - r) / total) + AROUND
        low, high = (min(max(0, int(x / total * 2**BITS)), 2**BITS - 1) for x in (r - reach, r + reach))
        if spans and low <= spans[-1][1]:
            spans[-1][1] = high
        else:
            spans.append([low, high])
    out = []
    for at in range(0, len(seeds), AT_ONCE):
        some = seeds[at : at + AT_ONCE]
        found = _around(rows.select(*[digits(F.col(key), s).alias(f"_h{i}") for i, s in enumerate(some)]), len(some), spans) if spans else [{}] * len(some)
        for seed, counts in zip(some, found, strict=True):
            place = {0: -1} | _places(counts, ranks)
            if set(ranks) <= set(place):
                out.append([place[min(r, total)] for r in wanted(total)])
            else:
                out.append(cutoffs(rows, hashed(F.col(key), seed), wanted))
    return out


def _around(hashes: DataFrame, seeds: int, spans: list[list[int]]) -> list[dict[tuple[int, int | None], int]]:
    """For each seed (interval, hash) -> rows. Intervals 1, 3, ... are the spans, whose hashes are told apart: some AROUND * sqrt(rows) for each; others have None."""
    long = hashes.select(F.expr(f"stack({seeds}, {', '.join(f'{i}, _h{i}' for i in range(seeds))}) as (s, h)"))
    interval = sum(((F.col("h") >= _text(low)).cast("int") + (F.col("h") > _text(high)).cast("int") for low, high in spans), F.lit(0))
    counts = long.withColumn("k", interval).groupBy("s", "k", F.when(F.col("k") % 2 == 1, F.col("h")).alias("h")).count().toArrow()
    out: list[dict[tuple[int, int | None], int]] = [{} for _ in range(seeds)]
    for s, k, h, n in zip(*(counts[c].to_pylist() for c in ("s", "k", "h", "count")), strict=True):
        out[s][k, None if h is None else int(h, 16)] = n
    return out


def _places(counts: dict[tuple[int, int | None], int], ranks: list[int]) -> dict[int, int]:
    """The hashes of those of some rising ranks that are in a span."""
    out, before, left = {}, 0, list(ranks)
    for (_, h), n in sorted(counts.items(), key=lambda x: (x[0][0], x[0][1] or 0)):
        before += n
        while left and left[0] <= before:
            r = left.pop(0)
            if h is not None:
                out[r] = h
    return out


def _upto(key: str, seed: int, cut: int) -> Column:
    return digits(F.col(key), seed) <= F.lit(_text(cut) if cut >= 0 else "")


def samples(rows: DataFrame, share: float, seeds: list[int], key: str = "key") -> list[Column]:
    """For each seed, whether a row is among round(share * n) ones."""
    found = all_cutoffs(rows, key, seeds, lambda n: [round(share * n)])
    return [_upto(key, seed, cut) for seed, (cut,) in zip(seeds, found, strict=True)]


def sampled(rows: DataFrame, share: float, seed: int, key: str = "key") -> Column:
    """Whether a row is among round(share * n) ones."""
    return samples(rows, share, [seed], key)[0]


def fold(rows: DataFrame, folds: int, seed: int, key: str = "key") -> Column:
    """0 to folds - 1: in the order of hashes, the rows up to round((i + 1) n / folds) are in fold i at most."""
    if folds < 2:
        raise ValueError("at least two folds are needed")
    (cuts,) = all_cutoffs(rows, key, [seed], lambda n: [round(i * n / folds) for i in range(1, folds)])
    return sum(((~_upto(key, seed, c)).cast("int") for c in cuts), F.lit(0))
