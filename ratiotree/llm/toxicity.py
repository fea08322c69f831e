"""Toxic passages as maximal-scoring segments.

Each token's score is its log-odds between toxic and clean training documents under an informative Dirichlet prior (Monroe, Colaresi
and Quinn, 2008), less a drift, so that the mean over clean text is negative. Words and the first 4 to 8 bytes of longer words have
log-odds, as insults are inflected; the surest of a word's counts. All maximal-scoring segments of a document come out of one
scan (Ruzzo and Tompa, 1999). A segment of score S in n tokens of clean text is expected K n exp(-lambda S) times
(Karlin and Altschul, 1990); lambda solves its equation over the clean tokens, K is fitted to the best scores of clean documents.
The significant segments of a document add up, and a logistic curve over that evidence gives the score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .textscan import SPACE, U, slices, utf8, word_blocks

#: At most so many labelled documents train it, those with the least hashes of doc_id: this bounds the model and what the driver holds.
TRAINING_ROWS = 50_000
#: Shorter documents count as so many tokens: the law holds for long ones.
SHORT = 64
_SIEVE = 1 << 16

STOPS = SPACE.copy()
STOPS[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


@dataclass(frozen=True)
class Options:
    """What a model may be told. prior and least are those with the least loss by ``choose``, over two folds of the training rows of two example tables, of 16 settings tried."""

    heads: tuple[int, ...] = (4, 5, 6, 7, 8)  # lengths of words' beginnings that are tokens too
    prior: float = 3000.0  # pseudo-counts in proportion to a token's share
    floor: float = 0.5  # pseudo-counts for each token
    drift: float = 0.02  # what each token loses besides the mean
    sure: float = 3.0  # standard deviations that a token's log-odds must have
    least: float = 3.0  # log-odds that a token must have: topics and languages of toxic documents have less
    level: float = 0.05  # expected number in clean text below which a segment is significant


def tokens(column: pa.Array, heads: tuple[int, ...] = Options.heads) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A block after the other: hashes (a row for the words and one for each beginning), starts and ends (bytes within all rows) of the tokens."""
    return word_blocks(*utf8(column), lower=True, stops=STOPS, heads=heads)


def distinct(column: pa.Array, heads: tuple[int, ...] = Options.heads) -> np.ndarray:
    """The different hashes of each document, of all documents end to end. One document's repeats prove nothing more."""
    _, at = utf8(column)
    found, held, last = [np.zeros(0, U)], np.zeros(0, U), -1
    for hashes, starts, _ in tokens(column, heads):
        row = np.searchsorted(at, starts, "right") - 1
        edge = np.flatnonzero(np.diff(row, prepend=-2))
        for a, b in zip(edge, np.append(edge[1:], len(row)), strict=True):
            new = np.unique(hashes[:, a:b])
            if row[a] != last:
                found.append(held)
                held, last = new, row[a]
            else:  # a long document goes on from the block before
                held = np.union1d(held, new)
    return np.concatenate([*found, held])


def segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) of a sequence; runs without positive scores count as one."""
    plus = np.flatnonzero(score > 0)
    if not len(plus):
        return []
    total = np.concatenate([[0.0], np.cumsum(score)])
    found: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum after
    back: list[int] = []  # of each, the last before it with a lower sum before
    for i, low, high in zip(plus.tolist(), total[plus].tolist(), total[plus + 1].tolist(), strict=True):
        start, end = i, i + 1
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j = back[j]
            if j < 0 or found[j][3] >= high:
                found.append((start, end, low, high))
                back.append(j)
                break
            start, low = found[j][0], found[j][2]
            del found[j:], back[j:]
    return [(s, e, r - l) for s, e, l, r in found]  # noqa: E741


@dataclass
class Model:
    known: np.ndarray  # sorted hashes of the tokens that tell something
    score: np.ndarray  # of each
    sure: np.ndarray  # in standard deviations
    rate: float = 1.0  # lambda
    log_k: float = 0.0
    drift: float = Options.drift
    bias: float = 0.0
    slope: float = 1.0
    options: Options = Options()

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where known tokens stand, and which of the known each is."""
        sieve = np.zeros(_SIEVE, dtype=bool)
        sieve[self.known & U(_SIEVE - 1)] = True
        at = np.flatnonzero(sieve[hashes & U(_SIEVE - 1)])
        which = np.minimum(np.searchsorted(self.known, hashes[at]), max(0, len(self.known) - 1))
        right = self.known[which] == hashes[at] if len(self.known) else np.zeros(0, dtype=bool)
        return at[right], which[right]

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """The score of each token: of the surest of its rows. Each occurrence counts, as a passage may repeat what stood before; the law is calibrated on the same scores."""
        n = hashes.shape[1]
        best, sure = np.zeros(n), np.zeros(n)
        for row in hashes:
            at, which = self._find(row)
            more = self.sure[which] > sure[at]
            at, which = at[more], which[more]
            best[at], sure[at] = self.score[which], self.sure[which]
        return best - self.drift

    def read(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Scores, starts and ends (bytes within all rows) of the tokens, and the number of tokens before each row. Hashes are dropped block by block."""
        score, starts, ends = [np.zeros(0)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for hashes, s, e in tokens(column, self.options.heads):
            score.append(self.of(hashes))
            starts.append(s)
            ends.append(e)
        where = np.concatenate(starts)
        return np.concatenate(score), where, np.concatenate(ends), np.searchsorted(where, utf8(column)[1], "left")

    def passages(self, score: np.ndarray) -> list[tuple[int, int, float, float]]:
        """The segments (start, end, score, log of the expected number) that clean text of this length would show fewer than ``options.level`` times."""
        size = math.log(max(SHORT, len(score)))
        out = [(s, e, x, self.log_k + size - self.rate * x) for s, e, x in segments(score)]
        return [x for x in out if x[3] < math.log(self.options.level)]

    def evidence(self, score: np.ndarray) -> float:
        """Minus the log of the chance that clean text holds its significant segments, each allowed for the others' choice."""
        return min(60.0, sum(-x[3] for x in self.passages(score)))

    def chance(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.bias + self.slope * evidence)))


def _count(only: np.ndarray | None, heads: tuple[int, ...]):
    """(hash, n): in how many documents each token is, of those in ``only`` (sorted) if given; the number of all documents' different tokens as hash 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            found = distinct(batch.column(0), heads)
            total = len(found)
            if only is not None:
                at = np.minimum(np.searchsorted(only, found), max(0, len(only) - 1))
                found = found[only[at] == found] if len(only) else found[:0]
            found, n = np.unique(found, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(found, U(0)).view(np.int64)), pa.array(np.append(n, total))], names=["hash", "n"])

    return run


def counted(texts: DataFrame, least: int, only: np.ndarray | None = None, heads: tuple[int, ...] = Options.heads) -> tuple[np.ndarray, np.ndarray, float]:
    """Sorted hashes of tokens in at least so many documents, in how many, and the number of all documents' different tokens."""
    rows = texts.mapInArrow(_count(only, heads), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).where(f"n >= {least} or hash = 0").toArrow()
    h, n = rows["hash"].to_numpy().view(U), rows["n"].to_numpy().astype(float)
    order = np.argsort(h)
    h, n = h[order], n[order]
    return h[h > 0], n[h > 0], float(n[h == 0].sum())


def log_odds(clean: np.ndarray, toxic: np.ndarray, all_clean: float, all_toxic: float, options: Options = Options()) -> tuple[np.ndarray, np.ndarray]:
    """The difference of each token's log-odds, and the same in standard deviations."""
    prior = options.prior * (clean + toxic) / max(1.0, all_clean + all_toxic) + options.floor
    a, b = toxic + prior, clean + prior
    delta = np.log(a / np.maximum(1e-9, all_toxic + options.prior - a)) - np.log(b / np.maximum(1e-9, all_clean + options.prior - b))
    return delta, delta / np.sqrt(1 / a + 1 / b)


BINS = np.arange(-2.0, 20.0, 0.05)


def _spectrum(model: Model):
    """How many clean tokens have which score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(len(BINS) + 1, np.int64)
        for batch in slices(batches, 0):
            score, _, _, first = model.read(batch.column(0))
            fine = np.repeat(batch.column(1).to_numpy(zero_copy_only=False) == 0, np.diff(first))
            count += np.bincount(np.searchsorted(BINS, score[fine]), minlength=len(count))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(count))), pa.array(count)], names=["bin", "n"])

    return run


def calibrate(s: np.ndarray, n: np.ndarray, known: np.ndarray) -> float:
    """lambda: the positive solution of sum(p exp(lambda s)) = 1, for scores s seen n times; each of the ``known`` tokens' scores counts half a time more, so that it is finite."""
    s, n = np.append(s, known), np.append(n, np.full(len(known), 0.5))
    p = n / n.sum()
    if (p * s).sum() >= 0:
        return 1.0
    f = lambda x: float((p * np.exp(np.minimum(x * s, 700))).sum()) - 1
    hi = 1.0
    while f(hi) < 0 and hi < 64:
        hi *= 2
    lo = hi / 2
    while lo > 1e-6 and f(lo) > 0:
        lo /= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return max(1e-3, (lo + hi) / 2)


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Bias and slope by Newton's method with a small ridge; the slope is not negative."""
    w = np.zeros(2)
    design = np.stack([np.ones_like(x), x], 1)
    ridge = np.diag([1e-6, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ w))
        step = np.linalg.solve((design * (p * (1 - p) + 1e-9)[:, None]).T @ design + ridge, design.T @ (y - p) - ridge @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), max(0.0, float(w[1]))


def _best_segments(model: Model):
    """The best score of each clean document and its number of tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            s, _, _, first = model.read(batch.column(0))
            best = [max((x for _, _, x in segments(s[a:b])), default=0.0) for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(best, pa.float64()), pa.array(np.diff(first), pa.int64())], names=["best", "n"])

    return run


def _evidences(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            s, _, _, first = model.read(batch.column(0))
            evidence = [model.evidence(s[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(evidence, pa.float64()), batch.column(1).cast(pa.int64())], names=["evidence", "toxic"])

    return run


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, options: Options = Options()) -> Model:
    """A model from ``labels(doc_id, toxic)`` and the documents' texts; labels that are null count for nothing, of several for one document the highest counts.

    At most ``rows`` labelled documents are used, those with the least hashes of doc_id; their tokens' counts and one line for each
    of those documents are all that the driver holds. Without toxic or without clean labels every score is 0.5.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = scratch.put(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    texts = scratch.put(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id").groupBy(F.sha2("text", 256).alias("h")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic"))
    hashes, toxic, all_toxic = counted(texts.where("toxic > 0"), 2, heads=options.heads)
    seen, n, all_clean = counted(texts.where("toxic <= 0"), 1, hashes, options.heads)
    if not all_clean or not all_toxic:
        return Model(hashes[:0], toxic[:0], toxic[:0], bias=0.0, slope=0.0, options=options)
    clean = np.zeros(len(hashes))
    clean[np.searchsorted(hashes, seen)] = n
    delta, z = log_odds(clean, toxic, all_clean, all_toxic, options)
    certain = (z > options.sure) & (delta > options.least)
    model = Model(hashes[certain], delta[certain], z[certain], drift=0.0, options=options)
    seen = texts.mapInArrow(_spectrum(model), "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    values, n = np.append(BINS, BINS[-1])[seen.bin.to_numpy()], seen.n.to_numpy(float)
    values[np.abs(values) < 1e-9] = 0.0
    model.drift = options.drift + float((values * n).sum() / max(1.0, n.sum()))  # so that clean text loses on the whole
    model.rate = calibrate(values - model.drift, n, model.score - model.drift)
    fine = texts.where("toxic = 0").mapInArrow(_best_segments(model), "best double, n long").where("n > 0").toArrow().to_pandas()
    # the best score of clean text follows a Gumbel law: exp(-K n exp(-rate S)); this K has the greatest likelihood
    model.log_k = float(-np.log(np.mean(fine.n * np.exp(-model.rate * np.minimum(fine.best, 500 / model.rate))))) if len(fine) else 0.0
    seen = texts.mapInArrow(_evidences(model), "evidence double, toxic long").toArrow().to_pandas()
    model.bias, model.slope = logistic(seen.evidence.to_numpy(), seen.toxic.to_numpy(float))
    return model


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """One row for each row of ``docs(doc_id, text, ...)``: doc_id, score, predicted, n_tokens, passages.

    Text alone decides. passages: the significant segments as array<struct<start,end,score,log_expected>>, start and end in UTF-8 bytes.
    Empty and null texts have no evidence and the score that goes with none; predicted is 1 from ``threshold`` on. Repeated rows each
    give a row. Texts of any length are scored whole, a megabyte at a time; a row holds a number for each token. Further columns are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # at most as many tokens as the bounded training sample proves
    passage = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("log_expected", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in slices(batches, 1):
            s, starts, ends, first = model.read(batch.column(1))
            _, rows = utf8(batch.column(1))
            evidence, found = np.zeros(batch.num_rows), []
            for i in range(batch.num_rows):
                a, b = first[i], first[i + 1]
                part = s[a:b]
                evidence[i] = model.evidence(part)
                found.append([{"start": int(starts[a + x] - rows[i]), "end": int(ends[a + y - 1] - rows[i]), "score": z, "log_expected": e} for x, y, z, e in model.passages(part)])
            chance = model.chance(evidence)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chance), pa.array((chance >= threshold).astype(np.int32)), pa.array(np.diff(first)), pa.array(found, passage)], names=["doc_id", "score", "predicted", "n_tokens", "passages"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, score double, predicted int, n_tokens long, passages array<struct<start:long,end:long,score:double,log_expected:double>>")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs(doc_id, text, ...)`` whose score is below ``threshold``, with all their columns. Null and empty texts stay."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in slices(batches, place):
            s, _, _, first = model.read(batch.column(place))
            evidence = np.array([model.evidence(s[first[i] : first[i + 1]]) for i in range(batch.num_rows)])
            yield batch.filter(pa.array(model.chance(evidence) < threshold))

    return docs.mapInArrow(run, docs.schema)


def remainder():
    """crc32 of doc_id as text, modulo 3; a null doc_id counts as the text ``null``."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")) % 3


def score_held_out(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of all documents, by a model that saw no label of a held-out row."""
    model = train(docs, labels.where(remainder() != 1))
    return score_documents(docs, model).withColumn("held_out", remainder() == 1).select("doc_id", "held_out", "score", "predicted", "n_tokens", F.size("passages").alias("n_passages"))


def choose(docs: DataFrame, labels: DataFrame, candidates: dict[str, Options], folds: int = 3, rows: int = TRAINING_ROWS) -> DataFrame:
    """name, fold, loss, missed, false_alarms of each candidate by folds of the rows that are not held out: a fold is scored by a model of the others.

    loss is the mean logarithmic loss; held-out rows take no part.
    """
    known = labels.where(remainder() != 1).where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(17)), F.lit(folds))
    found = []
    for name, options in candidates.items():
        for k in range(folds):
            model = train(docs, known.where(place != k), rows, options)
            test = known.where(place == k)
            scored = score_documents(docs.join(F.broadcast(test.select("doc_id")), "doc_id", "left_semi"), model).join(test, "doc_id")
            p = F.least(F.greatest(F.col("score"), F.lit(1e-6)), F.lit(1 - 1e-6))
            loss = F.avg(-F.when(F.col("toxic") > 0, F.ln(p)).otherwise(F.ln(1 - p)))
            row = scored.agg(loss, F.count_if((F.col("toxic") > 0) & (F.col("predicted") == 0)), F.count_if((F.col("toxic") == 0) & (F.col("predicted") == 1))).first()
            found.append((name, k, float(row[0]), int(row[1]), int(row[2])))
    return docs.sparkSession.createDataFrame(found, "name string, fold int, loss double, missed long, false_alarms long")
