"""A training-corpus pipeline over ``documents``: each stage calls one operator of pixelsieve.llm.

Every stage works on all that the one before it kept; all but the last return the columns of
``documents``, which are doc_id, text, lang, source and n_chars, and any others that the table has.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelsieve.llm import bpe, decontaminate, langid, line_dedup, ngram_join
from pixelsieve.llm.common import Scratch, table

#: Near duplicates share this percentage of their word shingles of so many words.
SHINGLE_WORDS, SIMILARITY = 5, 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are in no language.

    The model learns from ``lang``, so what counts as evidence is the text and its ``source``. Null, blank and
    empty texts are in no language; a document with a null doc_id stays, as no later stage could tell
    it from others. Very long texts are read whole; rows that repeat a document go or stay together;
    other columns stay as they are, whatever their names; an empty table gives no rows.
    """
    return langid.keep_identified(docs, Scratch(spark), langid.train(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes blocks of lines that an earlier document has; drops documents of which nothing is left.

    Earlier is the smaller doc_id; rows with a null doc_id or text stay as they are, and rows of one doc_id are not
    compared with each other. A document that was blank before stays. n_chars is counted
    anew where lines went; all other columns stay, also those named as the operator's counts.
    """
    n_lines, n_removed = (name + "_" * max(map(len, docs.columns)) for name in ("n_lines", "n_removed"))  # no column has these names
    out = line_dedup.dedup_lines(docs, Scratch(spark), counts=(n_lines, n_removed))
    nothing = (F.col(n_removed) > 0) & ~F.col("text").rlike(r"\S")
    out = out.where(~F.coalesce(nothing, F.lit(False)))
    counted = F.when(F.col(n_removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", counted).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: that with the smallest doc_id, then text hash.

    Null ids stand last in a group, so a document without an id goes where another of its group has one. Rows
    equal in doc_id and text are one document, and one row of them stays. Null, empty and blank texts
    are in no group. Other columns are those of the row that stays; an empty table gives no rows.
    """
    return ngram_join.keep_first(docs, Scratch(spark), SHINGLE_WORDS, SIMILARITY, 100).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain an item of ``benchmark``.

    Items of any length count, those of fewer than five words where their words stand together; items and
    documents without words match nothing. All rows of a doc_id go where one contains an item; rows with a null
    doc_id stay; an empty benchmark drops nothing; other columns stay as they are.
    """
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"), Scratch(spark)).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes the texts and decodes them again: a row per row, with doc_id, lang, source and the ids.

    Null and empty texts have no tokens; very long texts are encoded whole; repeated rows are encoded each; columns
    other than those named are left out; an empty table gives no rows.
    """
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_texts(docs, path, public_tokenizers.PATTERN, keep=["doc_id", "lang", "source"], with_ids=True)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

#: SQL can express neither the classifier, the alignment nor the merges; tests/llm has brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``, each written and read again."""
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
