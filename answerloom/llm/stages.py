"""Stage functions of the corpus pipeline: (spark, docs, sf_dir) -> DataFrame.

Every stage but the last hands on the columns of documents. In all of them extra columns
of docs, whatever their names, are dropped first, so that they cannot clash; very long
texts are read whole; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerloom.llm import bpe_chunks, fertility, mixing, quality_bayes, simhash
from answerloom.llm.common import DOCUMENT_COLUMNS, table


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*DOCUMENT_COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fertility rules keep.

    Null texts and texts under ten words go. A null lang is judged by the script of the
    text, other nulls do not matter. Repeated rows are judged alike and all stay or go.
    """
    return fertility.judge(_documents(docs)).filter("kept").select(*DOCUMENT_COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the hierarchical classifier keeps.

    A null source or lang is a group of its own. Null texts are judged by zero features
    and null doc_ids have no label. Repeated rows are judged alike and count as often as
    they come. Without labels all stay.
    """
    judged = quality_bayes.classify(_documents(docs), table(spark, sf_dir, "labels"))
    return judged.filter("kept").select(*DOCUMENT_COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the one of smallest doc_id.

    Ties, and rows without a doc_id, which come last, are settled by a hash of the whole
    row; of repeated rows one stays. All texts without a word, null among them, are alike.
    """
    return simhash.keep_one(_documents(docs)).select(*DOCUMENT_COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    A null source is a source of its own, the last. Texts without a word, null among
    them, are not taken. Repeated rows are taken as often as the mix takes them together;
    rows of equal doc_id and size may change places with each other.
    """
    return mixing.mixed_documents(_documents(docs)).select(*DOCUMENT_COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token digests of what is left, one row per row.

    Null texts count as empty; null doc_ids and repeated rows stay as they are.
    """
    return bpe_chunks.encode_documents(_documents(docs).select(F.col("doc_id"), F.col("text")))
