"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelsieve.llm import bpe, chat, decontaminate, embeddings, langid, licenses, line_dedup, ngram_join, oracles, sharding, warc
from pixelsieve.llm.common import Scratch, table

SHARDS = 8
COSINE = 0.93


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).withColumn("spans", F.to_json("spans"))


def op3_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), Scratch(spark), COSINE)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark))


#: What the tools that conversations are read as take; ``audit`` has no schema.
TOOLS = [("reply", "prompt", "string", True), ("reply", "length", "integer", True), ("check", "of", "string", True), ("check", "strict", "boolean", False)]


def op5_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = chat.turns_as_tool_messages(table(spark, sf_dir, "conversations"))
    return chat.link_tool_calls(messages, spark.createDataFrame(TOOLS, chat.SCHEMA), Scratch(spark))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_texts(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, keep=["doc_id"])


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all documents and, with doc_id = -1 - page_id, of all pages, which alone declare their language and have hosts of several levels."""
    docs = table(spark, sf_dir, "documents")
    rows = langid.evidence_of_documents(docs).unionByName(langid.evidence_of_pages(table(spark, sf_dir, "pages")))
    return langid.identify(rows, Scratch(spark), langid.train(docs), declared="declared", host=F.col("host"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"), SHARDS)


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.jaccard_components(table(spark, sf_dir, "documents"), Scratch(spark), k=4, num=85, den=100)
    return found.select("doc_id", "n_shingles", "component_id")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), Scratch(spark).path("archives"), least_bytes=0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_dedup, op2_license_scan, op3_embedding_neardup, op4_decontamination, op5_tool_call_linking, op6_byte_bpe, op7_language_id, op8_sharding, op9_ngram_jaccard, op10_warc)}


def oracle_sql() -> dict[str, str]:
    """SQL can express neither patience diff (1), byte-level BPE (6) nor the classifier (7)."""
    return {
        "op2_license_scan": oracles.license_scan(),
        "op3_embedding_neardup": oracles.embedding_neardup(COSINE),
        "op4_decontamination": oracles.decontamination(),
        "op5_tool_call_linking": oracles.tool_call_linking(),
        "op8_sharding": oracles.sharding(SHARDS, sharding.ROWS_PER_BIN, sharding.MOST_BINS, sharding.PIECE, sharding.MULTIPLIER),
        "op9_ngram_jaccard": oracles.ngram_jaccard(4, 85, 100),
        "op10_warc": oracles.warc(),
    }
