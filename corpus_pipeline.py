"""The corpus pipeline: rules, classifier, near-dedup, mixture, tokens.

Each stage works on what its predecessor left, written as Parquet in between, so a
lost executor or a failed stage costs that stage alone. What a stage materialises is
deleted when its result stands, and so is its input then; the last result stays.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from answerloom.llm import stages
from answerloom.llm.common import delete_path, scratch, shared_dir

STAGES = [
    ("quality rules", stages.quality_rules),
    ("quality classifier", stages.quality_classifier),
    ("SimHash near-dedup", stages.near_dedup),
    ("mixing sources", stages.mix_sources),
    ("BPE encoding", stages.encode),
]

#: No SQL: token measures, fitted evidence, hashes and BPE are beyond it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage for the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{root}/{k}")
        docs = spark.read.parquet(f"{root}/{k}")
        if k:
            delete_path(spark, f"{root}/{k - 1}")
    return docs
