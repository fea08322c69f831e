"""Near-duplicate classes by one-permutation MinHash.

Each text's distinct word shingles are hashed once; the hash picks a bin and the least hash of a bin is its value. Empty bins
borrow from non-empty ones by rounds of a universal hash (optimal densification: Shrivastava, 2017). Bands of bins make bucket
keys. A bucket gives star edges from its smallest member, each member trying one hub at first; edges count only after the full
shingle sets are compared. What a star leaves open (members of one bucket in different classes) is found afterwards by a prefix
filter on the rarest shingles, so that no link of a bucket is lost, while members already in one class are never paired.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .identity import told_apart
from .scratch import Scratch
from .textscan import U, mix, shingles, slices, utf8

BANDS, ROWS = 40, 5
_SEED = U(0x2545F4914F6CDD1D)


def signatures(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """One row of ``bins`` values for each set; a row of zeros for an empty set."""
    out = np.zeros((len(sets), bins), dtype=U)
    full = np.zeros((len(sets), bins), dtype=bool)
    for i, s in enumerate(sets):
        if len(s):
            b = ((s >> U(32)) * U(bins)) >> U(32)
            first = np.empty(len(s), dtype=bool)  # s is sorted: the first of a bin is its least
            first[0] = True
            np.not_equal(b[1:], b[:-1], out=first[1:])
            b = b[first].astype(np.int64)
            out[i, b] = s[first]
            full[i, b] = True
    some = full.sum(1)
    for i in np.flatnonzero(some == 1):
        out[i] = out[i, full[i]][0]
    row, col = np.nonzero(~full & (some > 1)[:, None])
    attempt = 0
    while len(row):
        attempt += 1
        shift = U(attempt * int(_SEED) & 0xFFFFFFFFFFFFFFFF)
        donor = (mix(col.astype(U) * U(0x9E3779B97F4A7C15) + shift) % U(bins)).astype(np.int64)
        hit = full[row, donor]
        out[row[hit], col[hit]] = out[row[hit], donor[hit]]
        row, col = row[~hit], col[~hit]
    return out


def band_keys(sign: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit bucket key for each row and band."""
    part = sign.reshape(len(sign), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=U) * U(0xD1342543DE82EF95), part.shape[:2]).copy()
    for j in range(rows):
        key = mix(key * U(0x9FB21C651E98DF25) + part[:, :, j])
    return key


def _scan(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            sets = shingles(*utf8(batch.column(1)), k)
            keys = band_keys(signatures(sets, bands * rows), bands, rows).view(np.int64)
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            with np.errstate(over="ignore"):
                one = np.array([mix(s ^ _SEED).sum(dtype=U) for s in sets], dtype=U).view(np.int64)
                two = np.array([np.bitwise_xor.reduce(mix(s + _SEED), initial=U(0)) for s in sets], dtype=U).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(sets) + 1) * bands, bands, dtype=np.int32)), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(one), pa.array(two), lists], names=["doc_id", "n", "s1", "s2", "keys"])

    return run


def _confirm(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, rows=512, most=4 << 20):
            left, right = shingles(*utf8(batch.column(2)), k), shingles(*utf8(batch.column(3)), k)
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i, (x, y) in enumerate(zip(left, right, strict=True)):
                if len(x) and len(y) and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    if len(x) > len(y):
                        x, y = y, x
                    at = np.searchsorted(y, x)
                    common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                    keep[i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep))

    return run


def _spread(k: int):
    """The shingles of each text, a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, rows=256, most=2 << 20):
            sets = shingles(*utf8(batch.column(1)), k)
            sizes = np.array([len(s) for s in sets])
            row = pa.array(np.repeat(np.arange(len(sets)), sizes))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(2).take(row), pa.array(np.repeat(sizes, sizes)), pa.array(np.concatenate(sets).view(np.int64))], names=["doc_id", "of", "n", "s"])

    return run


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row for each row of ``docs(doc_id, text, ...)``: doc_id, n_shingles, component_id, kept, links_found.

    Texts are lower-cased in A-Z and cut into words at ASCII white space. Two texts are linked if the shared part of their sets of
    k-word shingles is at least ``percent`` of the union; component_id is the smallest doc_id that links reach. A text of fewer
    than k words has its whole sequence as one shingle; a null or empty text has none and stays alone.
    At a similarity of 0.8 a pair misses all 40 bands of 5 with probability 1.2e-7; candidates are compared on their full sets.
    links_found: for a set's representative (the smallest doc_id of equal sets) with how many other sets a link was confirmed; members that are in one
    class already are not paired again, so it is a lower bound of all its links.
    Repeated rows each give a row; rows of one doc_id with different texts each get the class of their own text, under their own doc_id's name.
    A row without doc_id is kept, in no class (component_id null). Texts of any length are compared whole; a text's shingles are held by one task at a time.
    Further columns are not read, whatever their names. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    some = docs.where("doc_id is not null")
    rows_of, same = told_apart(some, scratch)
    if same:
        return _classes(docs, scratch, k, percent, bands, rows)
    found = _classes(rows_of.select(F.col("id").alias("doc_id"), "text"), scratch, k, percent, bands, rows).withColumnRenamed("doc_id", "id")
    names = rows_of.select("id", "doc_id")
    named = found.join(names, "id").join(names.select(F.col("id").alias("component_id"), F.col("doc_id").alias("_of")), "component_id")
    named = named.select("doc_id", "n_shingles", F.col("_of").alias("component_id"), (F.col("doc_id") == F.col("_of")).alias("kept"), "links_found")
    return named.unionByName(_classes(docs.where("doc_id is null"), scratch, k, percent, bands, rows))


def _classes(docs: DataFrame, scratch: Scratch, k: int, percent: int, bands: int, rows: int) -> DataFrame:
    """``near_duplicates`` of rows whose ids differ, or are null."""
    scan = scratch.put(docs.mapInArrow(_scan(k, bands, rows), "doc_id long, n long, s1 long, s2 long, keys array<long>"))
    some = scan.where("n > 0 and doc_id is not null")
    groups = scratch.put(some.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep")))
    reps = some.join(groups, ["s1", "s2", "n"]).where("doc_id = rep").dropDuplicates(["doc_id", "s1", "s2", "n"])
    members = reps.select("doc_id", "n", F.explode("keys").alias("key"))
    members = scratch.put(members)
    hubs = members.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("doc_id", "n")).alias("hub")).where("c > 1")
    shared = scratch.put(members.join(hubs, "key").select("key", "doc_id", "n", F.col("hub.doc_id").alias("hub"), F.col("hub.n").alias("hub_n")))
    scratch.drop(members)
    fit = f"100 * least(n, hub_n) >= {percent} * greatest(n, hub_n)"
    stars = scratch.put(shared.where("doc_id <> hub").where(fit).select(F.col("hub").alias("u"), F.col("doc_id").alias("v")).distinct())
    wanted = shared.select("doc_id").distinct()
    texts = scratch.put(docs.join(wanted, "doc_id"))

    def confirm(pairs: DataFrame) -> DataFrame:
        right = texts.select(F.col("doc_id").alias("v"), F.col("text").alias("b"))
        left = texts.select(F.col("doc_id").alias("u"), F.col("text").alias("a"))
        both = pairs.join(right, "v").join(left, "u").select("u", "v", "a", "b")
        return both.mapInArrow(_confirm(k, percent), "u long, v long")

    def classes(links: DataFrame) -> DataFrame:
        return scratch.put(connected_components(links, scratch))

    first = stars.groupBy("v").agg(F.min("u").alias("u")).select("u", "v")
    links = scratch.put(confirm(first))
    found = classes(links)

    def across(pairs: DataFrame) -> DataFrame:
        """Those pairs whose two sides are in different classes so far."""
        of = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"{c}_of"))
        return pairs.join(of("u"), "u", "left").join(of("v"), "v", "left").where("coalesce(u_of, u) <> coalesce(v_of, v)").select("u", "v")

    rest = across(stars.join(first, ["u", "v"], "left_anti"))
    links = scratch.put(links.union(confirm(rest)))
    found = classes(links)
    placed = scratch.put(shared.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("of")))
    scratch.drop(shared)
    open_keys = placed.groupBy("key").agg(F.min("of").alias("lo"), F.max("of").alias("hi")).where("lo < hi").select("key")
    left_open = scratch.put(placed.join(open_keys, "key").select("doc_id", "of").distinct())
    # two linked sets share one of the rarest shingles of either: of n, the first n - ceil(percent / 100 n) + 1 (prefix filter)
    sets = scratch.put(texts.join(left_open, "doc_id").select("doc_id", "text", "of").mapInArrow(_spread(k), "doc_id long, of long, n long, s long"))
    often = sets.groupBy("s").agg(F.count(F.lit(1)).alias("c"), F.min("of").alias("lo"), F.max("of").alias("hi"))
    ranked = sets.join(often, "s").withColumn("at", F.expr("dense_rank() over (partition by doc_id, n order by c, s)"))
    rare = scratch.put(ranked.where(f"lo < hi and at <= n - ({percent} * n + 99) div 100 + 1").select("s", "doc_id", "of", "n", "at"))
    x, y = (rare.select("s", *(F.col(c).alias(f"{side}_{c}") for c in ("doc_id", "of", "n", "at"))) for side in "xy")
    fit = f"""x_doc_id < y_doc_id and x_of <> y_of and 100 * least(x_n, y_n) >= {percent} * greatest(x_n, y_n)
        and {100 + percent} * (least(x_n - x_at, y_n - y_at) + 1) >= {percent} * (x_n + y_n)"""
    pairs = x.join(y, "s").where(fit).select(F.col("x_doc_id").alias("u"), F.col("y_doc_id").alias("v")).distinct()
    pairs = pairs.join(stars, ["u", "v"], "left_anti")
    links = scratch.put(links.union(confirm(pairs)))
    found = classes(links)

    degree = links.select("u").union(links.select("v")).groupBy(F.col("u").alias("rep")).agg(F.count(F.lit(1)).alias("links"))
    named = groups.join(found.withColumnRenamed("node", "rep"), "rep", "left").join(degree, "rep", "left")
    named = named.select("s1", "s2", "n", F.coalesce("component", "rep").alias("component_id"), "rep", "links")
    out = scan.drop("keys").join(named, ["s1", "s2", "n"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")))
    kept = F.coalesce(F.col("doc_id") == own, F.lit(True))
    count = F.when(F.col("doc_id") == F.col("rep"), F.coalesce("links", F.lit(0))).otherwise(F.lit(0)).cast("long")
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), kept.alias("kept"), count.alias("links_found"))


def sql(k: int = 5, percent: int = 80) -> str:
    """The classes for DuckDB, by all pairs that share a shingle: for tables of some thousand documents."""
    return f"""
with recursive w as materialized (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as ws from documents
), s as materialized (
  select distinct doc_id, hash(g) as h from (select doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < {k} then [array_to_string(ws, ' ')]
    else list_transform(range(1, len(ws) - {k - 2}), lambda i: array_to_string(ws[i : i + {k - 1}], ' ')) end) as g from w)
), n as materialized (select doc_id, count(*) as n from s group by 1
), p as materialized (
  select x.doc_id as u, y.doc_id as v, count(*) as c from s x join s y on x.h = y.h and x.doc_id < y.doc_id
  join n a on a.doc_id = x.doc_id join n b on b.doc_id = y.doc_id where 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n) group by 1, 2
), l as materialized (
  select u, v from p join n a on a.doc_id = u join n b on b.doc_id = v where 100 * c >= {percent} * (a.n + b.n - c)
), e as materialized (select u, v from l union select v, u from l
), r as (select u as node, u as root from e union select e.v, r.root from r join e on r.node = e.u where r.root < e.v
), c as (select node, min(root) as root from r group by 1)
select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(root, d.doc_id)) as component_id, d.doc_id = least(d.doc_id, coalesce(root, d.doc_id)) as kept
from documents d left join n using (doc_id) left join c on node = d.doc_id
"""
