"""Sequences made from tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LETTERS = "abcdefghijklmnopqrstuvwxyz"
DNA = "ACGTACGTACGTACGTACGTACGTAC"
READ_LENGTH = 200
READS_PER_DOCUMENT = 1 << 24  # more than a string of 2 GB has


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DNA-like reads (seq_id, dataset_id, seq): each whole document as letters A, C, G and T, cut into reads.

    Reads of a document don't overlap and leave nothing out; its last read may be shorter. A document without letters, or a
    null one, has no read. seq_id is the document's id and the read's number in it.
    """
    letters = F.regexp_replace(F.translate(F.lower("text"), LETTERS, DNA), "[^ACGT]", "")
    dataset = F.when(F.col("lang") == "de", 0).when(F.col("lang") == "en", 1).when(F.col("lang") == "es", 2).otherwise(3)
    cuts = F.posexplode(F.regexp_extract_all(letters, F.lit(f".{{1,{READ_LENGTH}}}"), F.lit(0))).alias("n", "seq")
    d = table(spark, sf_dir, "documents").select("doc_id", dataset.alias("dataset_id"), cuts)
    return d.select((F.col("doc_id") * READS_PER_DOCUMENT + F.col("n")).alias("seq_id"), "dataset_id", "seq")


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as short sequences with many repeats."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq_id"), F.col("p_name").alias("seq"))
