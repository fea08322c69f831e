"""The queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, exact, licenses, minhash, mixing, ordermin, packing, sharding, suffix, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), k=4).drop("links_found")


def op2_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(documents(spark, sf_dir)).drop("spans")


def op3_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(documents(spark, sf_dir))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, sf_dir))


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordermin.compare_neighbours(documents(spark, sf_dir))


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(added)
    return chat.read_back(chat.format_trees(chat.chains(rows)))


def op8_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path()).drop("ids")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_held_out(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_near_duplicates, op2_repeated_substrings, op3_exact_duplicates, op4_mix_sources, op5_order_minhash,
        op6_shards, op7_chat_format, op8_pack_sequences, op9_toxicity, op10_licenses, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_near_duplicates": minhash.sql(k=4), "op2_repeated_substrings": suffix.sql(), "op3_exact_duplicates": exact.SQL, "op4_mix_sources": mixing.sql(),
        "op7_chat_format": chat.SQL, "op10_licenses": licenses.sql()}
