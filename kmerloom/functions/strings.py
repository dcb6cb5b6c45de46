"""Substring relations over sequences(seq_id, seq [, dataset_id])."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def span(first: Column, last: Column) -> Column:
    """first .. last as an array, empty if last < first."""
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def occurrences(seqs: DataFrame, k: int | Column) -> DataFrame:
    """All columns of seqs but seq, with pos (from 0) and mer of each substring of length k; and its neighbours."""
    k = F.lit(k) if isinstance(k, int) else k
    keep = [c for c in seqs.columns if c != "seq"]
    d = seqs.withColumn("_k", k).select(*keep, "seq", "_k", F.explode(span(F.lit(1), F.length("seq") - F.col("_k") + 1)).alias("_p"))
    p, end = F.col("_p"), F.col("_p") + F.col("_k")
    return d.select(
        *keep, (p - 1).alias("pos"), F.substring("seq", p, F.col("_k")).alias("mer"),
        F.when(p > 1, F.substring("seq", p - 1, F.lit(1))).alias("left"), F.when(end <= F.length("seq"), F.substring("seq", end, F.lit(1))).alias("right"),
    )


def windows(seqs: DataFrame, k_from: int, k_to: int) -> DataFrame:
    """All columns of seqs but seq, with w: from each place, the k_to characters there, or the rest if it has k_from or more.

    A place's k-mers, for each k of the range, are w's prefixes, so whatever is dropped or added up of equal windows needn't
    be repeated for each k.
    """
    keep = [c for c in seqs.columns if c != "seq"]
    d = seqs.select(*keep, "seq", F.explode(span(F.lit(1), F.length("seq") - (k_from - 1))).alias("_p"))
    return d.select(*keep, F.substring("seq", F.col("_p"), F.lit(k_to)).alias("w"))


def mers_of_windows(d: DataFrame, k_from: int, k_to: int) -> DataFrame:
    """All columns of d but w, with k and mer for each k of the range that w is long enough for."""
    keep = [c for c in d.columns if c != "w"]
    ks = span(F.lit(k_from), F.least(F.length("w"), F.lit(k_to)))
    return d.select(*keep, "w", F.explode(ks).alias("k")).select(*keep, "k", F.expr("left(w, k)").alias("mer"))


def common_prefix(d: DataFrame, one: str, other: str, most: int, name: str) -> DataFrame:
    """d with the length of the longest common prefix of two columns that differ; most bounds their lengths."""
    d = d.withColumn(name, F.lit(0))
    for j in reversed(range(most.bit_length())):
        piece = lambda c: F.substring(c, F.col(name) + 1, F.lit(1 << j))  # noqa: B023, E731
        further = piece(one).eqNullSafe(piece(other)) & (F.length(piece(one)) == (1 << j))
        d = d.withColumn(name, F.col(name) + F.when(further, 1 << j).otherwise(0))
    return d
