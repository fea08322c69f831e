"""A corpus from raw documents: the stages, each a function of (spark, docs, sf_dir).

Toxic documents go, then exact copies but the longest of each group, then near copies but the smallest doc_id of each class; what is
left is sampled towards target weights and packed into sequences. All stages but the last return the columns of ``docs``.
Each stage is written to the shared folder and read again, so a lost executor repeats no finished stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratiotree.llm import exact, minhash, mixing, packing, queries, toxicity
from ratiotree.llm.scratch import Scratch, released


def _only_kept(docs: DataFrame, decide: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """The rows of ``docs`` that ``decide`` keeps, with all their columns.

    If ids repeat or are null, rows get other numbers, in the order of doc_id and a hash of the text, so that each row is judged by itself.
    """
    scratch = Scratch(docs.sparkSession, name)
    row = "_pipeline_row"
    while row in docs.columns:  # a column of the caller's is not touched
        row += "_"
    if docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1 or doc_id is null").isEmpty():
        named = docs.withColumn(row, F.col("doc_id").cast("long"))
    else:
        named = scratch.put(docs.orderBy("doc_id", F.sha2(F.col("text").cast("string").cast("binary"), 256)).withColumn(row, F.monotonically_increasing_id()))
    gone = scratch.put(decide(named.select(F.col(row).alias("doc_id"), "text")).where("not kept").select(F.col("doc_id").alias(row)))
    return named.join(gone, row, "left_anti").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose toxicity score is below 0.7, by a model of the labels of rows that are not held out.

    Null and empty texts have no evidence and stay; texts of any length are scored whole, block by block; repeated rows are scored one by one
    and fare alike; a null doc_id has no label. Further columns, whatever their names, pass through. An empty table stays empty.
    """
    labels = queries.table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(toxicity.remainder() != 1))
    return toxicity.keep_clean(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows whose texts are equal without white space, the one with the longest text, then the smallest doc_id.

    Null and empty texts, and texts of white space alone, are equal to each other, so one of them stays. Of repeated rows one stays; rows without doc_id are
    compared like others. Texts of any length are compared whole. Further columns pass through. An empty table stays empty.
    """
    return _only_kept(docs, exact.exact_duplicates, "pipeline-exact")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class that links of similarity 0.8 or more (shingles of five words) join, the row of the smallest doc_id.

    Null and empty texts, and such without words, are in no class and stay. Of repeated rows one stays; rows without doc_id are compared like
    others. Texts of any length are compared whole. Further columns pass through. An empty table stays empty.
    """
    return _only_kept(docs, minhash.near_duplicates, "pipeline-near")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows sampled by their cell's calibrated probability, so that tokens come near the target weights of sources, languages and topics.

    Null sources and languages are values of their own; rows without words are always kept; repeated rows share their fate; a null doc_id counts as
    the text ``null``. Texts of any length count all their words. Further columns pass through. An empty table stays empty.
    """
    return mixing.mix_sources(docs, carry=True).where("kept").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows with their token ids and their place in sequences of 2048.

    Null and empty texts are one closing id; long texts are cut into as many pieces as they need; repeated rows and rows without doc_id are packed
    like others. Further columns are not carried. An empty table gives no pieces.
    """
    return packing.pack(docs, queries.tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing to target weights", mix),
    ("best-fit packing", pack),
]

ORACLE_SQL = None  # training a classifier and near copies are beyond SQL; tests/llm/test_pipeline.py has a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the packed corpus of the table ``documents``, with their token ids. What a stage left in the shared folder goes when its result is written."""
    scratch = Scratch(spark, "corpus")
    docs = queries.documents(spark, sf_dir)
    for _, stage in STAGES:
        with released():
            kept = scratch.put(stage(spark, docs, sf_dir))
        scratch.drop(docs)
        docs = kept
    return docs
