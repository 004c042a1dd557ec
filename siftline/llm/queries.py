"""The queries of this package, by their names in __spark_entry__.py, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, html_extract, langid, packing, quality, sharding, simhash, tokens, toxicity
from .common import held_out, scratch, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=0, capacity=2048)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return decontaminate.verdicts(decontaminate.find_contamination(docs, benchmark))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    found = toxicity.score(docs, toxicity.fit(docs, labels, langid.fit(docs)))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "lang_pred")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "shards")
    sharded = sharding.shard_documents(table(spark, sf_dir, "documents"), shards=40)
    sharding.write_shards(sharded, path)
    shards = spark.read.schema(sharded.schema).parquet(path)
    return shards.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), distance=4, shingle=4)


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    tokens.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path(), end_id=2)
    return tokens.read_tokens(spark, path)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract(table(spark, sf_dir, "pages"), html_extract.stored_model(spark))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    return quality.judge(docs, quality.fit(docs, labels))


#: For each query, what it runs.
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_chat_format, op2_best_fit_packing, op3_decontamination, op4_language_id, op5_toxicity, op6_sharding, op7_simhash, op8_token_output, op9_html_extraction, op10_quality_rules,
    )
}

ORACLE_SQL: dict[str, str] = {"op1_chat_format": chat.ORACLE, "op3_decontamination": decontaminate.ORACLE}
