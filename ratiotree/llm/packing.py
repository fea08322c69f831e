"""Documents packed into sequences of a fixed number of tokens.

Lengths are small integers, so the whole packing is planned on the counts of each length, at most one per token of capacity,
on the driver: documents above a third of the capacity are matched greedily, two to a sequence at most; the smaller go, longest
first, where they leave the smallest gap. The plan says which numbers of each length go to which sequences; documents are
numbered within their length and look their place up. Nothing but counts leaves the executors. Each piece goes with its token ids.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import numbered
from .scratch import Scratch
from .textscan import slices, utf8

CAPACITY = 2048
#: Beyond either, only those pieces stay in store that the next part of text has.
CACHE_WORDS, CACHE_BYTES = 400_000, 32 << 20
PART = 2 << 20


#: Texts that NFC and lower-casing treat sign by sign, and the tokenizer's own pattern for what it encodes by itself (fixed value).
PLAIN = re.compile("[\x09-\x0d\x20-\x7e\xa1-\u012f\u0131-\u017f]*")
_SIGNS = {k: "".join(c for c in map(chr, range(0x80, 0x180)) if unicodedata.category(c)[0] == k) for k in "LN"}
PIECES = re.compile(f"[a-z{_SIGNS['L']}]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9{_SIGNS['N']}]|[^\\s0-9a-z{_SIGNS['L']}{_SIGNS['N']}]+")


class WordIds:
    """Token ids of texts, as little-endian unsigned 32-bit bytes, by a tokenizer that drops white space and whose tokens at a piece's end end in ``</w>``.

    A text is cut into the pieces that the tokenizer encodes one by one. Only pieces not met before are encoded, many in one call; the
    ``</w>`` tell their ids apart. Words of signs outside ``PLAIN``, or with a special token's beginning, are encoded whole.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.by_piece = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.by_piece.normalizer = normalizers.Sequence([])
        self.by_piece.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _learn(self, new: set[str]) -> None:
        """Keep the ids of pieces, and of whole words, which begin with a space here."""
        pieces, whole = [x for x in new if x[0] != " "], [x for x in new if x[0] == " "]
        for lo in range(0, len(pieces), 1000):
            part = pieces[lo : lo + 1000]
            ids = np.asarray(self.by_piece.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            at = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
            if len(at) == len(part) + 1:
                data = ids.tobytes()
                self.known.update((w, data[i:j]) for w, i, j in zip(part, at, at[1:], strict=False))
            else:
                whole += part
        for word, ids in zip(whole, self.tokenizer.encode_batch_fast([x.strip(" ") for x in whole], add_special_tokens=False), strict=True):
            self.known[word] = np.asarray(ids.ids, dtype="<u4").tobytes()
        self.held += sum(map(len, new))

    @staticmethod
    def _cut(text: bytes) -> list[str]:
        signs = text.decode("utf-8", "replace")
        if PLAIN.fullmatch(signs) and "<|" not in signs:
            return PIECES.findall(signs.lower())
        out: list[str] = []
        for word in text.split():
            signs = word.decode("utf-8", "replace")
            out += PIECES.findall(signs.lower()) if PLAIN.fullmatch(signs) and "<|" not in signs else [f" {signs}"]
        return out

    def all(self, texts: list[bytes]) -> list[bytes]:
        cut = [self._cut(t) for t in texts]
        wanted = set().union(*cut)
        if len(self.known) > CACHE_WORDS or self.held > CACHE_BYTES:
            self.known = {w: self.known[w] for w in wanted.intersection(self.known)}  # the common ones
            self.held = sum(map(len, self.known))
        new = wanted.difference(self.known)
        if new:
            self._learn(new)
        return [b"".join(map(self.known.__getitem__, x)) for x in cut]

    def long(self, text: bytes) -> bytes:
        """The ids of a text of any length, a part after the other."""
        out, lo = [], 0
        while lo < len(text):
            hi = min(len(text), lo + PART)
            while hi < len(text) and text[hi] not in b" \t\n\r\x0b\x0c":
                hi += 1
            out += self.all([text[lo:hi]])
            lo = hi
        return b"".join(out)


_IDS: dict[str, WordIds] = {}


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _IDS.get(path) or _IDS.setdefault(path, WordIds(path))
        for batch in slices(batches, 1, most=PART):
            data, at = utf8(batch.column(1))
            data = data.tobytes()
            texts = [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
            found = [encode.long(t) for t in texts] if len(data) > PART else encode.all(texts)
            row, piece, start, length, crc, parts = [], [], [], [], [], []
            for i in range(batch.num_rows):
                ids = found[i] + b"\0\0\0\0"
                for k, lo in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[lo : lo + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(lo // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    parts.append(part)
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(parts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return run


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first, n, sequence, offset): the numbers first to first + n - 1 of a length go to the sequences from ``sequence`` on, at ``offset``."""
    runs: list[tuple[int, int, int, int, int]] = []
    left = {x: n for x, n in counts.items() if n}
    used = dict.fromkeys(left, 0)
    open_at: dict[int, list[tuple[int, int]]] = {}
    sequences = 0

    def take(length: int, n: int, sequence: int, offset: int) -> None:
        runs.append((length, used[length], n, sequence, offset))
        used[length] += n
        left[length] -= n

    large = sorted(x for x in left if 3 * x > capacity)
    for x in reversed(large):
        while left[x]:
            at = bisect.bisect_right(large, min(x, capacity - x)) - 1
            while at >= 0 and left[large[at]] - (large[at] == x) <= 0:
                at -= 1
            if at < 0:
                n, gap = left[x], capacity - x
                take(x, n, sequences, 0)
            else:
                y = large[at]
                n, gap = (left[x] // 2 if x == y else min(left[x], left[y])), capacity - x - y
                take(x, n, sequences, 0)
                take(y, n, sequences, x)
            open_at.setdefault(gap, []).append((sequences, n))
            sequences += n
    gaps = sorted(open_at)
    for x in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        while left[x]:
            at = bisect.bisect_left(gaps, x)
            if at == len(gaps):  # the next ones open sequences of their own, each with as many as fit
                n = -(-left[x] // (capacity // x))
                gap, first = capacity, sequences
                sequences += n
            else:
                gap = gaps[at]
                first, n = open_at[gap].pop()
                if n > left[x]:
                    open_at[gap].append((first + left[x], n - left[x]))
                    n = left[x]
                if not open_at[gap]:
                    del open_at[gap], gaps[at]
            take(x, n, first, capacity - gap)
            if gap - x not in open_at:
                bisect.insort(gaps, gap - x)
            open_at.setdefault(gap - x, []).append((first, n))
    return runs


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset.

    ids are the piece's token ids, little-endian unsigned 32-bit, that stand in the sequence ``sequence_id`` from ``offset`` on; ids_crc32 is made from them.
    A row of ``docs(doc_id, text, ...)`` is its text's ids (null: none) by the tokenizer file ``tokenizer``, which must drop white
    space, and then id 0. Longer ones than ``capacity`` are cut, whatever their length, a megabyte of text at a time; all pieces are packed. Repeated rows are
    packed one by one, a null doc_id like any other; further columns are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = scratch.put(rows.mapInArrow(_pieces(tokenizer, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"))
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    runs: dict[int, list[tuple[int, int, int]]] = {}
    for length, first, _, sequence, offset in plan(counts, capacity):
        runs.setdefault(length, []).append((first, sequence - first, offset))
    # one row for each length: where its runs begin, rising, and for each what to add to a rank and the offset; the last run that begins at or before a rank is its own
    kinds = pa.schema([("length", pa.int64()), *((c, pa.list_(pa.int64())) for c in ("first", "shift", "offsets"))])
    table = pa.Table.from_arrays([pa.array(list(runs), pa.int64()), *(pa.array([[x[i] for x in r] for r in runs.values()], pa.list_(pa.int64())) for i in range(3))], schema=kinds)
    places = spark.createDataFrame(table)
    ranked = numbered(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], "rank").join(places, "length")
    steps = max(1, max((len(r) for r in runs.values()), default=1).bit_length())
    at = ranked.withColumn("_run", F.lit(0))
    for k in reversed(range(steps)):  # halving: the greatest place whose run begins at or before the rank
        more = F.col("_run") + F.lit(1 << k)
        at = at.withColumn("_run", F.when((more < F.size("first")) & (F.get("first", more) <= F.col("rank")), more).otherwise(F.col("_run")))
    return at.select("doc_id", "piece", "start", "length", "ids", "ids_crc32", (F.col("rank") + F.get("shift", F.col("_run"))).alias("sequence_id"), F.get("offsets", F.col("_run")).alias("offset"))
