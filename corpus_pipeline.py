"""The corpus pipeline: each stage takes all that the one before kept, and its decisions take effect.

Every stage carries all columns of documents along, whatever further ones there are, and gives an empty table for an
empty one. Nulls, ties and repeated rows are each stage's docstring.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessarix.llm import bytebpe, jaccard, mixing, rules, spans
from tessarix.llm.common import cut, few, table, unused


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be of quality stay.

    A null text counts as empty and is scored like any other; rows that share a doc_id are scored each, and one low
    score rejects that doc_id; rows with null doc_id have no decision of their own and stay.
    """
    name = unused(docs, "bad")[0]
    bad = cut(rules.classify(docs, table(spark, sf_dir, "labels")).where("predicted = 0 and doc_id is not null").select(F.col("doc_id").alias(name)).distinct(), "bad")
    return docs.join(few(bad), F.col("doc_id") == F.col(name), "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest doc_id.

    Null and empty texts, and rows with null doc_id, are near nothing and stay; of rows that share a doc_id the first
    text stays.
    """
    return jaccard.one_of_each(docs)


def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated spans go from the texts, n_chars follows; a document of nothing else goes with them.

    Null and empty texts stay as they are; of places that tie the first by doc_id and text hash stays; rows equal in both
    are one document.
    """
    kept = spans.dedup(docs).where("n_removed = 0 or length(trim(text)) > 0")
    return kept.select(*[F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's budget takes them, so a document can stand several times from here on.

    Documents without words, null texts among them, take nothing of a budget and go; a null source is a source of its
    own; of rows equal in doc_id, source and size the mean decides.
    """
    return mixing.copies(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what is left, one row for each row; a null text has no ids."""
    return bytebpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_spans", repeated_spans), ("mixture", mixture), ("tokens", tokens)]

#: SQL can't express the trained classifier, so the pipeline is tested stage by stage against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
