"""Exact duplicates by deterministic block naming (Karp, Miller, Rosenberg, 1972).

A normalised text is cut into blocks of a fixed number of bytes. A block's name is its 64-bit hash and its rank among the different
blocks of that hash in sorted order, so different blocks never share a name, whatever the hash, and names depend on neither partitions nor
other engines' numbering. Adjacent names pair up and the pairs are named in the same way, until one name is left for each text: texts of one
length have the same name exactly if they are equal. All blocks of all texts are compared; each different block is shuffled once for each task that has it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

BLOCK = 4096


def _hash(key: Column, bits: int) -> Column:
    return F.xxhash64(key) if bits == 64 else F.pmod(F.xxhash64(key), F.lit(1 << bits))


def _name(key: Column, odd: str | None, bits: int) -> Column:
    """The name of a key; ``odd`` is a column with the ranks of keys that are not the first of their hash."""
    rank = F.coalesce(F.try_element_at(F.col(odd), key), F.lit(0)) if odd else F.lit(0)
    return F.struct(_hash(key, bits).alias("h"), rank.cast("int").alias("r"))


def _ranks(different: DataFrame, clash: DataFrame, name: str) -> DataFrame:
    """One row: a map from key to rank for the keys after the first of the hashes in ``clash``. Of n different keys about n^2 / 2^65 are such: 20 in 100 TB of blocks."""
    many = different.join(clash.select("level", "h"), ["level", "h"], "left_semi")
    ranked = many.withColumn("r", F.expr("row_number() over (partition by level, h order by key) - 1")).where("r > 0")
    return ranked.agg(F.map_from_entries(F.collect_list(F.struct("key", "r"))).alias(name))


def _clashes(different: DataFrame, scratch: Scratch) -> DataFrame:
    """Levels and hashes that several of the different keys share."""
    return scratch.put(different.groupBy("level", "h").agg(F.count(F.lit(1)).alias("c")).where("c > 1"))


def _block_names(docs: DataFrame, parts: Column, scratch: Scratch, bits: int) -> tuple[DataFrame, Column]:
    """``docs``, with ranks where needed, and the array of the names of its blocks."""
    keys = docs.select(F.explode(parts).alias("key"))
    different = keys.select(F.lit(0).alias("level"), _hash(F.col("key"), bits).alias("h"), "key").distinct()
    clash = _clashes(different, scratch)
    odd = None
    if not clash.isEmpty():
        odd = "_odd"
        docs = docs.crossJoin(F.broadcast(_ranks(different, clash, odd)))  # one row on the right side
    return docs, F.transform(parts, lambda p: _name(p, odd, bits))


def _identities(named: DataFrame, scratch: Scratch, bits: int) -> DataFrame:
    """``named`` (row, len, names, ...) with ``name``, the one name of its names."""
    top = named.agg(F.max(F.size("names"))).first()[0] or 1
    levels = (top - 1).bit_length()
    odd: dict[int, DataFrame] = {}
    while True:
        out = named.withColumn("_n0", F.col("names"))
        for k in range(1, levels + 1):
            if k in odd:
                out = out.crossJoin(F.broadcast(odd[k]))  # one row on the right side
            pairs = F.expr(f"transform(sequence(0, cast((size(_n{k - 1}) + 1) div 2 as int) - 1), i -> named_struct('a', get(_n{k - 1}, 2 * i), 'b', get(_n{k - 1}, 2 * i + 1)))")
            out = out.withColumn(f"_p{k}", F.when(F.size(f"_n{k - 1}") > 1, pairs))
            ranks = f"_odd{k}" if k in odd else None
            out = out.withColumn(f"_n{k}", F.coalesce(F.transform(f"_p{k}", lambda p: _name(p, ranks, bits)), F.col(f"_n{k - 1}")))  # noqa: B023
        if not levels:
            break
        keys = out.where(F.size("names") > 1).select(F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.col(f"_p{k}").alias("pairs")) for k in range(1, levels + 1)])).alias("x"))
        different = keys.select("x.level", F.explode("x.pairs").alias("key")).select("level", _hash(F.col("key"), bits).alias("h"), "key").distinct()
        clash = _clashes(different, scratch)
        lowest = clash.where(~F.col("level").isin(list(odd))).agg(F.min("level")).first()[0] if odd else clash.agg(F.min("level")).first()[0]
        if lowest is None:
            break
        odd = {k: v for k, v in odd.items() if k < lowest}  # names above follow from this level's
        odd[lowest] = scratch.put(_ranks(different.where(F.col("level") == lowest), clash, f"_odd{lowest}"))
    return out.withColumn("name", F.col(f"_n{levels}")[0])


def exact_duplicates(docs: DataFrame, block: int = BLOCK, bits: int = 64) -> DataFrame:
    """One row for each row of ``docs(doc_id, text, ...)``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are the same without the characters ``[\\x20\\x09-\\x0D]``; null counts as empty, and empty texts are
    equal to each other. keep_id is the member with the most code points in its whole text, then the smallest doc_id. Of
    repeated rows of one document, one of the longest is kept and the others are not; each counts in group_size.
    A row without doc_id is a group of its own. Texts of any length are compared whole: a row holds the names of its blocks, 12 bytes for each 4 KB. Further
    columns are not read, whatever their names. An empty table gives an empty result. ``bits`` of hashes only decide how often ranks are needed.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.translate(text, " \t\n\x0b\x0c\r", "").cast("binary").alias("data"))
    last = F.greatest(F.ceil(F.octet_length("data") / block).cast("int") - 1, F.lit(0))
    parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring("data", i * block + 1, F.lit(block)))
    docs, names = _block_names(docs, parts, scratch, bits)
    base = scratch.put(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.octet_length("data").cast("long").alias("len"), F.sha2("data", 256).alias("text_sha256"), names.alias("names")))
    named = scratch.put(_identities(base, scratch, bits).select("row", "doc_id", "n_chars", "len", "name", "text_sha256"))
    first = F.min(F.struct((-F.col("n_chars")).alias("m"), "doc_id", "row"))
    # written, so that the join below reads a shuffle that Spark can split where one group has very many rows
    groups = scratch.put(named.where("doc_id is not null").groupBy("len", "name").agg(F.count(F.lit(1)).alias("size"), first.alias("k")).where("size > 1").select("len", "name", "size", F.col("k.doc_id").alias("keep"), F.col("k.row").alias("keep_row")))
    of = named.withColumn("_len", F.when(F.col("doc_id").isNotNull(), F.col("len")))
    out = of.join(groups.withColumnRenamed("len", "_len"), ["_len", "name"], "left")
    return out.select("doc_id", F.coalesce("keep", "doc_id").alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), (F.col("keep_row").isNull() | (F.col("keep_row") == F.col("row"))).alias("kept"), "text_sha256")


SQL = r"""
with d as (
  select doc_id, coalesce(text, '') as t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as x from documents
), g as (
  select doc_id, x, count(*) over (partition by x) as group_size,
         first_value(doc_id) over (partition by x order by length(t) desc, doc_id) as keep_id
  from d
)
select doc_id, keep_id, cast(group_size as bigint) as group_size, doc_id = keep_id as kept, sha256(x) as text_sha256 from g
"""
