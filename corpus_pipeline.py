"""From raw documents to training sequences: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from kmerloom.llm.common import remove_path, shared_folder, table
from kmerloom.llm.op2_packing import pack_documents
from kmerloom.llm.op3_simhash import simhash_dedup
from kmerloom.llm.op8_cnn import keep_classified
from kmerloom.llm.op9_mixing import mix_documents
from kmerloom.llm.op10_rules import keep_good


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose rules' votes make them probably good."""
    return keep_good(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network takes for good."""
    return keep_classified(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of copies and near copies."""
    return simhash_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, each as many times as the mix of sources takes it."""
    return mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in training sequences."""
    return pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("simhash near-dedup", near_dedup),
    ("source mixing", mix_sources),
    ("best-fit packing", pack),
]

#: SQL can express neither the network nor the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's table is deleted once the next one's is written; the last one's stays.

    An empty table of documents gives no rows. Nulls, blank texts and repeated rows are as each stage's operator says.
    """
    docs, last = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        path = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}-{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            remove_path(spark, last)
        last = path
    return docs
