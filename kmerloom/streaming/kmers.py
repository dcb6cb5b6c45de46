"""Distinct k-mers of a stream of sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.functions.strings import occurrences


def kmer_frequencies(seqs: DataFrame, k: int) -> DataFrame:
    """(mer, freq) so far, for a streaming or a batch DataFrame seqs(seq_id, seq); write it in complete or update mode."""
    return occurrences(seqs.select("seq_id", "seq"), k).groupBy("mer").agg(F.count("*").alias("freq"))
