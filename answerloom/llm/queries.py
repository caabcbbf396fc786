"""The registered queries of this subpackage and their SQL, where SQL can say them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerloom.llm import (
    ann_index,
    bin_packing,
    bpe_chunks,
    compaction,
    fertility,
    filter_audit,
    licenses,
    mixing,
    quality_bayes,
    simhash,
    token_counts,
    url_filter,
    vector_codes,
)
from answerloom.llm.common import shared_dir, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_chunks.encode_documents(table(spark, sf_dir, "documents"))


def op2_ann_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann_index.search(vectors, "vec_id % 100 = 0")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return url_filter.judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan(docs).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"
    )


def op8_quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    judged = quality_bayes.classify_narrow(docs, table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "evidence", "shift", "posterior", "kept")


def op9_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    root = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    return compaction.shard_table(docs, root).select(
        "doc_id", compaction.short_name(F.col("shard")).alias("shard"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    )


def op10_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return fertility.judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "kept", "n_tokens", "chars_per_token", "byte_share", "token_entropy", "band",
    )


def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    narrow = bin_packing.pieces(docs).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return bin_packing.place(narrow)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    rows = vector_codes.with_label_error(coded.rows)
    return rows.select(
        "vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(coded.digest()).alias("codebooks_sha256")
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    own = (
        op1_bpe_chunks, op2_ann_index, op3_simhash, op4_token_counts, op5_url_filter, op6_mixing,
        op7_licenses, op8_quality_bayes, op9_compaction, op10_fertility, op11_best_fit, op12_filter_audit,
        op13_vector_codes,
    )
    return {f.__name__: f for f in own} | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_url_filter": url_filter.contract_sql(),
        "op6_mixing": mixing.contract_sql(),
        "op7_licenses": licenses.contract_sql(),
        "op12_filter_audit": filter_audit.contract_sql(),
    }
