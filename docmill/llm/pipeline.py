"""A corpus pipeline: documents to packed training sequences, in five stages that each call one operator.

Every stage takes (spark, docs, sf_dir). For all of them: an empty table gives an empty table with the same columns; columns
other than doc_id and text (and n_chars, which follows a changed text) are handed on as they are, whatever their names.
Stages whose result runs in Python workers bound the batches of the session (common.bounded_batches), as what batches of long texts take
outside the JVM's heap stays taken for the stages after them.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm import common, exact_dedup, jaccard, packing, substring_dedup, toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that score as toxic.

    Null and empty texts have the score of an empty window. Equal texts, and so repeated rows and ties, share one fate unless they score at the threshold to six places.
    Each row is judged by its text alone, so a null or repeated doc_id changes nothing. Very long texts are scored whole.
    """
    common.bounded_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.drop_toxic(docs, toxicity.fit(docs, labels))


def exact_dedup_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) keep the largest doc_id.

    Null texts equal empty ones. Rows that tie on the largest doc_id all stay, as do rows with a null doc_id; other
    texts under the same doc_id are not touched.
    """
    return exact_dedup.drop_exact_copies(docs)


def near_dedup_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five words, 0.75) keep the smallest doc_id.

    Rows without words (null, empty or white texts) and rows with a null doc_id stay. Rows that share a doc_id are one
    document: all stay or all go.
    """
    return jaccard.drop_near_copies(docs)


def substring_dedup_cut(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut spans that stand earlier in the corpus; n_chars follows the text. No row goes.

    A null text becomes empty. Rows that share a doc_id are one document and keep what they have in common; each row with
    a null doc_id is a document of its own, after all others.
    """
    common.bounded_batches(spark)
    return substring_dedup.drop_repeated_spans(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens, with their ids.

    A null or empty text is its end token alone. Every row is packed, repeated ones and those with a null doc_id as
    well. Long texts are cut into pieces of a sequence at most. Only doc_id and text are read.
    """
    common.bounded_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity_filter),
    ("exact_dedup", exact_dedup_filter),
    ("near_dedup", near_dedup_filter),
    ("substring_dedup", substring_dedup_cut),
    ("packing", pack_sequences),
]

#: A trained score, components and tokenization have no SQL; tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents. Each result but the last is written as Parquet into the shared folder and read again;
    what a stage has left there goes once the next one has been written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        with common.scratch() as keep:
            keep(after := common.saved(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        if k:
            common.discard(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
