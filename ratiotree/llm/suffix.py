"""Repeated substrings by suffix arrays.

A byte string of the least length holds a window of grams; the gram with the least hash is its anchor, the same wherever the
string stands. The starts that share an anchor make a segment, so all copies of a string meet under one hash, on one
executor. Segments equal to an earlier one are settled by their hashes. Where different segments share an anchor, their bytes go to shards; each
shard is sorted by induced sorting (Nong, Zhang and Chan, 2009): suffixes are classified, leftmost-smaller substrings are sorted by induction and
named, the string of names is sorted by the same means, and its order induces that of all suffixes, in time linear in the shard. The common
prefixes of neighbours, permuted to text order, show every string that stands in an earlier place as well.

An anchor with very many different segments is split by what stands next to it: two equal strings share half of what they hold besides the anchor on its
left or on its right, so starts go by that half's bytes; parts that are still large are halved again, until the whole string is the key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .identity import told_apart
from .scratch import Scratch
from .textscan import TABLE, U, mix, powers, slices, utf8

LENGTH, GRAM = 100, 32
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BASE2 = 0xC2B2AE3D27D4EB4F
_INVERSE2 = pow(_BASE2, -1, 1 << 64)
BLOCK = 1 << 20
#: Bytes of a shard, and of the segments of one anchor beyond which it is split; a shard holds less than both together.
SHARD, HOT = 1 << 20, 256 << 10
_PLACE = U(BLOCK * 2 - 1)


def _anchors(data: np.ndarray, ok: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """The segments of a block: first start, number of starts, hash of the anchor, hash of the bytes. ``ok``: whether a string may start here."""
    n = len(data)
    total = np.zeros(n + 1, dtype=U)
    np.cumsum(TABLE[data] * powers(_BASE, n), out=total[1:])
    back = powers(_INVERSE, n + 1)
    g = mix((total[gram:] - total[:-gram]) * back[: n - gram + 1])
    a = (g & ~_PLACE) | np.arange(len(g), dtype=U)
    least, width, wanted = a, 1, length - gram + 1
    while 2 * width <= wanted:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < wanted:
        more = wanted - width
        least = np.minimum(least[:-more], least[more:])
    at = (least & _PLACE).astype(np.int64)  # the anchor of each start
    ok = ok[: len(at)]
    new = ok.copy()
    new[1:] &= (at[1:] != at[:-1]) | ~ok[:-1]
    first = np.flatnonzero(new)
    stop = np.flatnonzero(ok & ~np.append(ok[1:] & (at[1:] == at[:-1]), False)) + 1
    size = stop - first
    end = stop + length - 1
    anchor = g[at[first]]
    # another base: the two hashes that settle a segment do not fail together
    np.cumsum(TABLE[data] * powers(_BASE2, n), out=total[1:])
    body = mix((total[end] - total[first]) * powers(_INVERSE2, n + 1)[first] + size.astype(U) * U(0xA24BAED4963EE407))
    return first, size, anchor, body


def _later(anchor: np.ndarray, body: np.ndarray, ids: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether a segment's equal stands earlier among these."""
    order = np.lexsort((start, ids, body, anchor))
    out = np.zeros(len(order), dtype=bool)
    out[order[1:]] = (anchor[order][1:] == anchor[order][:-1]) & (body[order][1:] == body[order][:-1])
    return out


def _scan(length: int, gram: int):
    """(anchor, body, id, start, size, done): all segments of all texts. Those done have an equal earlier one in the same block, so no other task need see them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, rows=4096, most=BLOCK // 2):
            data, at = utf8(batch.column(1))
            ids = batch.column(0)
            n = len(data)
            for lo in range(0, max(1, n - length + 1), BLOCK):  # more than one only within a single long text
                hi = min(n, lo + BLOCK + length - 1)
                if hi - lo < length:
                    continue
                ok = np.ones(hi - lo, dtype=bool)
                ok[max(0, hi - lo - length + 1) :] = False
                for e in at[1:-1]:
                    ok[max(0, e - length + 1 - lo) : max(0, e - lo)] = False
                first, size, anchor, body = _anchors(data[lo:hi], ok, length, gram)
                row = np.searchsorted(at, first + lo, "right") - 1
                who, start = ids.take(pa.array(row)), first + lo - at[row]
                done = _later(anchor, body, who.to_numpy(zero_copy_only=False), start)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(body.view(np.int64)), who, pa.array(start), pa.array(size.astype(np.int32)), pa.array(done)], names=["anchor", "body", "id", "start", "size", "done"])

    return run


def _settle(length: int, hot: int):
    """Rows sorted by done, anchor, body, id, start -> those equal to an earlier one (open false), and the first of each body where an anchor has several (open true).

    After an anchor whose open segments have more than ``hot`` bytes comes a row of size 0.
    """
    names = ["anchor", "id", "start", "size", "open"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None  # the last first-of-a-body: its row, and whether it is open already
        weight = [0, 0]  # the anchor at hand, and the bytes of its open segments so far

        def out(anchor, who, start, size, opens) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor, who, start, size, opens)], names=names)
            if not opens.any():
                return
            a, w = anchor[opens], size[opens].astype(np.int64) + (length - 1)
            order = np.argsort(a, kind="stable")
            a, w = a[order], w[order]
            edge = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
            sums = np.add.reduceat(w, edge)
            a = a[edge]
            if a[0] == weight[0]:
                sums[0] += weight[1]
            weight[:] = [int(a[-1]), int(sums[-1])]
            large = sums > hot
            if large.any():
                k = int(large.sum())
                yield pa.RecordBatch.from_arrays([pa.array(a[large]), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array(np.zeros(k, np.int32)), pa.array(np.ones(k, dtype=bool))], names=names)

        for batch in batches:
            over = batch.filter(batch.column(5))
            if over.num_rows:
                yield pa.RecordBatch.from_arrays([*(over.column(i) for i in (0, 2, 3, 4)), pa.array(np.zeros(over.num_rows, dtype=bool))], names=names)
            batch = batch.filter(pc.invert(batch.column(5)))
            if not batch.num_rows:
                continue
            c = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
            anchor, body = c[0], c[1]
            same = np.zeros(len(anchor), dtype=bool)
            same[1:] = (anchor[1:] == anchor[:-1]) & (body[1:] == body[:-1])
            if held is not None:
                same[0] = anchor[0] == held[0][0] and body[0] == held[0][1]
            first = np.flatnonzero(~same)
            rows, opens = [np.flatnonzero(same)], [np.zeros(int(same.sum()), dtype=bool)]
            extra = None
            if len(first):
                fa = anchor[first]
                near = np.zeros(len(first), dtype=bool)
                near[1:] |= fa[1:] == fa[:-1]
                near[:-1] |= fa[1:] == fa[:-1]
                if held is not None:
                    joins = fa[0] == held[0][0]
                    near[0] |= joins
                    if joins or held[1]:
                        extra = held[0]
                held = [tuple(x[first[-1]] for x in c), bool(near[-1])]
                keep = first[:-1][near[:-1]]
                rows.append(keep)
                opens.append(np.ones(len(keep), dtype=bool))
            rows, opens = np.concatenate(rows), np.concatenate(opens)
            columns = [c[0][rows], c[2][rows], c[3][rows], c[4][rows], opens]
            if extra is not None:
                columns = [np.append(x, np.array([v], dtype=x.dtype)) for x, v in zip(columns, (extra[0], extra[2], extra[3], extra[4], True), strict=True)]
            yield from out(*columns)
        if held is not None and held[1]:
            h = held[0]
            yield from out(np.array([h[0]], np.int64), np.array([h[2]], np.int64), np.array([h[3]], np.int64), np.array([h[4]], np.int32), np.array([True]))

    return run


def _induce(t: np.ndarray, small: np.ndarray, ends: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes of ``t`` sorted, given those at ``lms`` in order. ``small``: whether a suffix is less than the next; ``ends``: where each sign's suffixes end."""
    n, signs = len(t), len(ends)
    begins = np.concatenate([[0], ends[:-1]])
    sa = np.empty(n, dtype=np.int64)
    kind = t[lms]
    count = np.bincount(kind, minlength=signs)
    order = np.argsort(kind, kind="stable")
    tails = ends - count
    sa[np.repeat(tails - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(len(lms))] = lms[order]
    fronts = begins.copy()

    def put_l(found: np.ndarray) -> None:
        j = found[found > 0] - 1
        j = j[~small[j]]
        if len(j):
            c = t[j]
            o = np.argsort(c, kind="stable")
            j, c = j[o], c[o]
            edge = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
            size = np.diff(np.append(edge, len(c)))
            to = c[edge]
            sa[np.repeat(fronts[to] - edge, size) + np.arange(len(c))] = j
            fronts[to] += size

    sa[fronts[t[n - 1]]] = n - 1  # before it comes the empty suffix
    fronts[t[n - 1]] += 1
    for c in range(signs):
        if begins[c] == ends[c]:
            continue
        at = begins[c]
        while at < fronts[c]:
            at, part = fronts[c], sa[at : fronts[c]]
            put_l(part)
        put_l(sa[tails[c] : ends[c]])
    tails = ends.copy()

    def put_s(found: np.ndarray) -> None:
        j = found[found > 0] - 1
        j = j[small[j]]
        if len(j):
            c = t[j]
            o = np.argsort(c, kind="stable")
            j, c = j[o], c[o]
            edge = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
            size = np.diff(np.append(edge, len(c)))
            to = c[edge]
            sa[np.repeat(tails[to] - 1 + edge, size) - np.arange(len(c))] = j
            tails[to] -= size

    for c in range(signs - 1, -1, -1):
        if begins[c] == ends[c]:
            continue
        at = ends[c]
        while at > tails[c]:
            at, part = tails[c], sa[tails[c] : at]
            put_s(part[::-1])
        put_s(sa[begins[c] : fronts[c]][::-1])
    return sa


def _classified(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each suffix is less than the next one, and where leftmost-smaller ones begin."""
    n = len(t)
    differs = np.flatnonzero(t[1:] != t[:-1])
    nxt = np.searchsorted(differs, np.arange(n))  # the next place where the sign changes
    small = np.zeros(n, dtype=bool)
    has = nxt < len(differs)
    place = differs[nxt[has]]
    small[has] = t[place] < t[place + 1]
    return small, np.flatnonzero(small[1:] & ~small[:-1]) + 1


def _induce_each(t: np.ndarray, small: np.ndarray, ends: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """As ``_induce``, one suffix after the other: for alphabets about as large as the string, whose buckets are too small to be worth arrays."""
    n = len(t)
    sa = [-1] * n
    s, tail = t.tolist(), ends.tolist()
    for i in reversed(lms.tolist()):
        c = s[i]
        tail[c] = k = tail[c] - 1
        sa[k] = i
    # of each suffix: the sign before it, and whether that begins a larger or a smaller suffix; the last place serves -1, an empty slot
    sign = np.append(np.roll(t, 1), 0).tolist()
    falls, rises = np.zeros(n + 1, dtype=bool), np.zeros(n + 1, dtype=bool)
    falls[1:n], rises[1:n] = ~small[: n - 1], small[: n - 1]
    goes = falls.tolist()
    front = [0, *ends[:-1].tolist()]
    c = s[n - 1]
    sa[front[c]] = n - 1
    front[c] += 1
    for p in sa:  # slots ahead are filled while it runs
        if goes[p]:
            c = sign[p]
            k = front[c]
            sa[k] = p - 1
            front[c] = k + 1
    goes, tail = rises.tolist(), ends.tolist()
    for p in reversed(sa):
        if goes[p]:
            c = sign[p]
            tail[c] = k = tail[c] - 1
            sa[k] = p - 1
    return np.array(sa, dtype=np.int64)


def suffix_array(t: np.ndarray) -> np.ndarray:
    """The suffixes of the small non-negative numbers ``t`` in order, by induced sorting.

    Leftmost-smaller substrings are put in order by one induction and named by it, equal ones alike; unless all names differ, the string of
    names is sorted by a call of this function; a second induction then sorts all. With few signs, each step takes a whole bucket's part at once, as arrays.
    """
    n = len(t)
    if n < 2:
        return np.arange(n)
    small, lms = _classified(t)
    ends = np.cumsum(np.bincount(t))
    induce = _induce if len(ends) * 32 < n else _induce_each
    if len(lms) > 1:
        is_lms = np.zeros(n, dtype=bool)
        is_lms[lms] = True
        sa = induce(t, small, ends, lms)
        order = sa[is_lms[sa]]
        follow = np.append(lms[1:], n)
        length = np.zeros(n, dtype=np.int64)
        length[lms] = follow - lms + 1  # up to and with the next one's first sign
        a, b = order[:-1], order[1:]
        same = length[a] == length[b]
        live = np.flatnonzero(same)
        step = 0
        while len(live):
            x, y = a[live] + step, b[live] + step
            inside = (x < n) & (y < n)
            equal = np.where(inside, t[np.minimum(x, n - 1)] == t[np.minimum(y, n - 1)], False)
            same[live[~equal]] = False
            step += 1
            live = live[equal & (step < length[a[live]])]
        name = np.zeros(n, dtype=np.int64)
        name[order] = np.append(0, np.cumsum(~same))
        names = name[lms]
        lms = order if not same.any() else lms[suffix_array(names)]
    return induce(t, small, ends, lms)


def common_prefixes(t: np.ndarray, sa: np.ndarray, most: int, where: np.ndarray) -> np.ndarray:
    """In text order, how many signs (bytes plus 1, 0 between texts; at most ``most``) each suffix of ``where`` shares with the one before it in the suffix array, if that is in ``where`` too."""
    n = len(t)
    before = np.full(n, -1, dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    padded = np.zeros(n + most + 8, dtype=np.uint16)
    padded[:n] = t
    padded[n:] = 300 + np.arange(most + 8) % 2  # beyond the end nothing is equal for long
    wide = np.zeros(n + most + 4, dtype=U)
    for k in range(4):
        wide |= padded[k : k + len(wide)].astype(U) << U(16 * k)
    out = np.zeros(n, dtype=np.int32)
    live = np.flatnonzero(where & (before >= 0))
    live = live[where[before[live]]]
    for step in range(0, most, 4):
        differ = wide[live + step] ^ wide[before[live] + step]
        equal = differ == 0
        last, rest = live[~equal], differ[~equal]
        out[last] = step + sum((rest & U((1 << 16 * k) - 1) == 0).astype(np.int32) for k in range(1, 4))
        live = live[equal]
    out[live] = most
    return np.minimum(out, most)


def repeats(parts: list[bytes], owner: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """(part, offset) of all strings of ``length`` bytes within a part that stand in an earlier place too. Places are ordered by owner, then start + offset; no two parts hold the same place."""
    sizes = np.array([len(p) for p in parts])
    t = np.frombuffer(b"\0".join(parts) + b"\0", dtype=np.uint8).astype(np.int16) + 1
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    t[begin + sizes] = 0
    n = len(t)
    sa = suffix_array(t)
    part = np.searchsorted(begin, np.arange(n), "right") - 1
    whole = np.arange(n) + length <= (begin + sizes)[part]
    # a string that is whole has no separator, nor has its neighbour's equal part
    pos = np.flatnonzero(common_prefixes(t, sa, length, whole) >= length)
    long = np.zeros(n, dtype=bool)
    long[pos] = True
    inside = whole[sa]
    group = np.cumsum(~long[sa])
    pos, group = sa[inside], group[inside]
    order = np.lexsort((start[part[pos]] + pos - begin[part[pos]], owner[part[pos]], group))
    pos, group = pos[order], group[order]
    later = pos[1:][group[1:] == group[:-1]]
    return np.stack([part[later], later - begin[part[later]]], 1)


def shared_parts(keys: list, parts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each segment the bytes (from, to) that may hold a string of another segment of its key; empty where nothing can.

    Equal strings stand alike around their anchor, so they share the greater half of what they hold besides it on its left or on its right. Starts whose half
    no other segment has are left out.
    """
    data = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts])
    n, begin = len(data), np.concatenate([[0], np.cumsum(sizes)[:-1]])
    total = np.zeros(n + 1, dtype=U)
    np.cumsum(TABLE[data] * powers(_BASE, n), out=total[1:])
    back = powers(_INVERSE, n + 1)
    g = (mix((total[gram:] - total[:-gram]) * back[: n - gram + 1]) & ~_PLACE) | np.arange(n - gram + 1, dtype=U)
    width, wanted = 1, length - gram + 1
    at = np.zeros(0, dtype=np.int64)
    while 2 * width <= wanted:
        g = np.minimum(g[:-width], g[width:])
        width *= 2
    at = (np.minimum(g[begin], g[begin + wanted - width]) & _PLACE).astype(np.int64) - begin  # where the anchor stands in each segment
    half = (length - gram + 1) // 2
    group = np.cumsum(np.array([True, *(a != b for a, b in zip(keys[1:], keys, strict=False))]))
    starts = sizes - length + 1

    def common(lo: np.ndarray, hi: np.ndarray, some: np.ndarray) -> np.ndarray:
        """Whether another segment of the key has the same bytes there, for those of ``some``."""
        a, b = begin[some] + lo[some], begin[some] + hi[some]
        h = mix((total[b] - total[a]) * back[a] + group[some].astype(U) * U(0xA24BAED4963EE407))
        _, which, count = np.unique(h, return_inverse=True, return_counts=True)
        out = np.zeros(len(parts), dtype=bool)
        out[np.flatnonzero(some)] = count[which] > 1
        return out

    left = common(at - half, at + gram, at >= half)
    right = common(at, at + length - half + 1, (at - half + 1 <= starts - 1))
    lo = np.where(left, 0, np.maximum(0, at - half + 1))
    hi = np.where(right, sizes, np.minimum(starts - 1, at - half) + length)
    return np.where(left | right, lo, 0), np.where(left | right, hi, 0)


def _shards(length: int, gram: int):
    """Segments (anchor, id, start, bytes) sorted by anchor -> marks (id, start, stop)."""

    def solve(anchor, ids, starts, parts) -> pa.RecordBatch:  # noqa: ANN001
        lo, hi = shared_parts(anchor, parts, length, gram)
        some = np.flatnonzero(hi > lo)
        parts = [parts[i][lo[i] : hi[i]] for i in some]
        ids, starts = np.array(ids)[some], np.array(starts)[some] + lo[some]
        if not parts:
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 3, names=["id", "start", "stop"])
        found = repeats(parts, np.array(ids), np.array(starts), length)
        part, off = found[:, 0], found[:, 1]
        order = np.lexsort((off, part))
        part, off = part[order], off[order]
        cut = np.append(True, (part[1:] != part[:-1]) | (off[1:] > off[:-1] + length))[: len(part)]
        first = np.flatnonzero(cut)
        last = np.append(first[1:], len(part)) - 1 if len(first) else first
        who = np.array(ids)[part[first]]
        base = np.array(starts)[part[first]]
        return pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), pa.array(base + off[first], pa.int64()), pa.array(base + off[last] + length, pa.int64())], names=["id", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list, list] = ([], [], [], [])
        size = 0
        for batch in slices(batches, 3):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > SHARD and row[0] != held[0][-1]:
                    yield solve(*held)
                    held, size = ([], [], [], []), 0
                for to, v in zip(held, row, strict=True):
                    to.append(v)
                size += len(row[3])
        if size:
            yield solve(*held)

    return run


def _anchor_at(part: bytes, length: int, gram: int) -> int:
    """Where the anchor of a segment stands in its bytes."""
    data = np.frombuffer(part, np.uint8)[:length]
    n = len(data)
    total = np.zeros(n + 1, dtype=U)
    np.cumsum(TABLE[data] * powers(_BASE, n), out=total[1:])
    g = mix((total[gram:] - total[:-gram]) * powers(_INVERSE, n + 1)[: n - gram + 1])
    return int(((g & ~_PLACE) | np.arange(len(g), dtype=U)).argmin())


def _halves(length: int, gram: int):
    """(key, id, start, part, at, a, b) -> the same for smaller sets of starts.

    ``at`` is where the anchor stands in ``part``; the starts are those with ``a`` bytes at least between start and anchor and ``b`` at least after it. They are
    dealt to those with the greater half of the rest before the anchor and those with it after; the new key is of those bytes, all that is known then.
    """
    names = ["key", "id", "start", "part", "at", "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 3):
            rows = []
            for key, who, start, part, at, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at < 0:
                    at = _anchor_at(part, length, gram)
                free = length - gram
                middle = a + (free - b - a + 1) // 2
                starts = len(part) - length + 1
                for lo, hi, left, right in ((at - (free - b), at - middle, middle, b), (at - middle + 1, at - a, a, free - middle + 1)):
                    lo, hi = max(0, lo), min(starts - 1, hi)  # starts from lo to hi have from at - lo down to at - hi bytes before the anchor
                    if lo <= hi:
                        known = part[at - left : at + gram + right]
                        digest = hashlib.blake2b(known, digest_size=16, person=b"%d.%d" % (left, right)).digest()
                        rows.append((key[:8] + digest, who, start + lo, part[lo : hi + length], at - lo, left, right))
            if rows:
                kinds = [pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def _split(pieces: DataFrame, length: int, gram: int, hot: int, scratch: Scratch) -> tuple[list[DataFrame], DataFrame | None]:
    """Segments (key binary, id, start, part) of hot anchors, as tables of the same columns whose keys have at most ``hot`` bytes, and the marks of strings that whole keys settle."""
    state = pieces.select("key", "id", "start", "part", F.lit(-1).alias("at"), F.lit(0).alias("a"), F.lit(0).alias("b"))
    small, marks = [], None
    while True:
        state = scratch.put(state.mapInArrow(_halves(length, gram), "key binary, id long, start long, part binary, at int, a int, b int"))
        whole = state.where(F.col("a") + F.col("b") + gram == length)
        # all strings of a whole key are equal: the first stays, the others are marked; no task sees a key's rows together
        first = whole.groupBy("key").agg(F.min(F.struct("id", "start")).alias("f")).select("key", "f.id", "f.start")
        found = whole.join(first, ["key", "id", "start"], "left_anti").select("id", "start", (F.col("start") + length).alias("stop"))
        marks = found if marks is None else marks.union(found)
        rest = state.where(F.col("a") + F.col("b") + gram < length)
        large = scratch.put(rest.groupBy("key").agg(F.sum(F.length("part")).alias("bytes")).where(F.col("bytes") > hot).select("key"))
        small.append(rest.join(large, "key", "left_anti").select("key", "id", "start", "part"))
        if large.isEmpty():
            return small, marks
        state = rest.join(large, "key", "left_semi")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    for batch in slices(batches, 1):
        data, at = utf8(batch.column(1))
        data = data.tobytes()
        size, gone, runs, sha, kept = [], [], [], [], []
        for i, spans in enumerate(batch.column(2).to_pylist()):
            text = data[at[i] : at[i + 1]]
            spans = merged([(s["start"], s["stop"]) for s in spans or []])
            digest, lo = hashlib.sha256(), 0
            for a, b in spans:
                digest.update(text[lo:a])
                lo = b
            digest.update(text[lo:])
            size.append(len(text))
            gone.append(sum(b - a for a, b in spans))
            runs.append(len(spans))
            sha.append(digest.hexdigest())
            kept.append([{"start": a, "stop": b} for a, b in spans])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, kind)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """One row for each row of ``docs(doc_id, text, ...)``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans.

    Texts are UTF-8 bytes, null as empty. A byte goes if a string of ``length`` bytes over it starts in an earlier place too: in a
    document with a smaller doc_id, or earlier in the same one. All strings are judged on the input; overlaps count; no string spans two
    documents. spans lists the maximal removed runs (start, stop in bytes), kept_sha256 is of the rest.
    Repeated ids are documents in the order of their texts' hashes, so that repeated rows but the first lose all that is long enough; null ids come first.
    Texts of any length are read whole, a megabyte at a time; only their removed runs are held together. Further columns are not read. An empty table gives an empty result.
    An anchor whose different segments have more than ``hot`` bytes is split, so that no task sorts more than a shard of about a megabyte.
    """
    scratch = Scratch(docs.sparkSession, "suffix")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs, _ = told_apart(docs, scratch)
    segments = docs.select("id", "text").mapInArrow(_scan(length, gram), "anchor long, body long, id long, start long, size int, done boolean")
    # what is done already goes anywhere, so that a very common passage sends one segment of each block, not each of its copies, to its anchor's task
    dealt = segments.repartition(F.when(F.col("done"), F.xxhash64("id", "start")).otherwise(F.col("anchor"))).sortWithinPartitions("done", "anchor", "body", "id", "start")
    settled = scratch.put(dealt.mapInArrow(_settle(length, hot), "anchor long, id long, start long, size int, open boolean"))
    texts = docs.select("doc_id", "id", "text")
    cut = lambda rows: rows.join(texts, "id").select("anchor", "id", "start", F.expr(f"substring(cast(text as binary), cast(start + 1 as int), size + {length - 1})").alias("part"))
    wanted = settled.where("open and size > 0").select("anchor", "id", "start", "size")
    large = scratch.put(settled.where("size = 0").select("anchor").distinct())
    marks = settled.where("not open").select("id", "start", (F.col("start") + F.col("size") + (length - 1)).alias("stop"))
    kind = "id long, start long, stop long"
    if large.isEmpty():
        pieces = cut(wanted)
    else:
        split, equal = _split(cut(wanted.join(large, "anchor")).select(F.unhex(F.lpad(F.hex("anchor"), 16, "0")).alias("key"), "id", "start", "part"), length, gram, hot, scratch)
        for part in split:
            marks = marks.union(part.repartition("key").sortWithinPartitions("key").mapInArrow(_shards(length, gram), kind))
        marks = marks.union(equal)
        pieces = cut(wanted.join(large, "anchor", "left_anti"))
    marks = marks.union(pieces.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_shards(length, gram), kind))
    spans = marks.groupBy("id").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return texts.join(spans, "id", "left").select("doc_id", "text", "spans").mapInArrow(_apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,stop:long>>")


def sql(length: int = LENGTH) -> str:
    """The same without spans for DuckDB, by all strings of the length: for tables of some megabytes."""
    return f"""
with d as materialized (select doc_id, encode(coalesce(text, '')) as b, octet_length(encode(coalesce(text, ''))) as n from documents
), s as materialized (
  select doc_id, i, row_number() over (partition by hash(array_slice(b, i, i + {length - 1})) order by doc_id, i) > 1 as again from (select doc_id, b, unnest(range(1, n - {length - 2})) as i from d where n >= {length})
), m as (select doc_id, i, case when i > max(i + {length - 1}) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding) + 1 then 1 else 0 end as new from s where again
), g as (select doc_id, i, sum(new) over (partition by doc_id order by i) as run from m
), r as materialized (select doc_id, run, min(i) as a, max(i) + {length - 1} as z from g group by 1, 2
), t as (select doc_id, a, z, coalesce(lag(z) over (partition by doc_id order by a), 0) as before from r
), k as (
  select doc_id, a, hex(array_slice(b, before + 1, a - 1)) as h from t join d using (doc_id) where a > before + 1
  union all select doc_id, n + 1, hex(array_slice(b, coalesce(z, 0) + 1, n)) from d left join (select doc_id, max(z) as z from r group by 1) using (doc_id) where n > coalesce(z, 0)
)
select doc_id, n as n_bytes, coalesce(gone, 0) as n_removed, coalesce(runs, 0) as n_spans, sha256(unhex(coalesce(h, ''))) as kept_sha256
from d left join (select doc_id, cast(sum(z - a + 1) as bigint) as gone, count(*) as runs from r group by 1) using (doc_id) left join (select doc_id, string_agg(h, '' order by a) as h from k group by 1) using (doc_id)
"""
