"""Command line: python -m kmerloom.cli PROGRAM ... (or by spark-submit).

build makes a graph of sequences and stores it, access stores sequences, the others read a graph's folder and write text.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.functions.lineage import global_rank
from kmerloom.operators import index, kmers
from kmerloom.operators.graph import Graph, load, save
from kmerloom.sources import files
from kmerloom.sources.sinks import write_csv, write_text

#: Greatest k of a similarity range by default, and the least length of an edge by default.
BRAY_CURTIS_TO, KMIN = 100, 20


def sequences(spark: SparkSession, path: str, form: str) -> DataFrame:
    """(seq_id, seq) of files: fasta, fastq, text (a sequence a line), ebwt or parquet. Numbered in the order of the files."""
    if form == "parquet":
        return spark.read.parquet(path).select("seq_id", "seq")
    if form == "ebwt":
        return index.recover(files.read_ebwt(spark, path))
    if form == "text":
        d = files.numbered_lines(spark, path).select("file", F.col("line_no").alias("record"), F.upper("value").alias("seq"))
    else:
        d = {"fasta": files.read_fasta, "fastq": files.read_fastq}[form](spark, path)
    return global_rank(d, ["file", "record"], "seq_id").select("seq_id", "seq")


def longest(g: Graph) -> int:
    return g.seqs.agg(F.max(F.length("seq"))).first()[0] or g.kmin


def build(spark: SparkSession, a: argparse.Namespace) -> None:
    g = Graph(sequences(spark, a.input, a.format), a.kmin)
    save(g, a.output)
    if a.text:
        write_text(g.text_rows(), f"{a.output}/text", "line")


def access(spark: SparkSession, a: argparse.Namespace) -> None:
    sequences(spark, a.input, a.format).write.mode("overwrite").parquet(a.output)


def kmer(spark: SparkSession, a: argparse.Namespace) -> None:
    g = load(spark, a.graph)
    if a.k < g.kmin:
        raise ValueError(f"k is {a.k}, this graph answers for {g.kmin} or more")
    write_text(kmers.kmer_list(g.seqs, a.k), a.output, "mer")


def kmer_count(spark: SparkSession, a: argparse.Namespace) -> None:
    g = load(spark, a.graph)
    write_csv(g.kmer_count(a.k_from or g.kmin, a.k_to or longest(g)).orderBy("k").coalesce(1), a.output)


def unitig_count(spark: SparkSession, a: argparse.Namespace) -> None:
    g = load(spark, a.graph)
    write_csv(g.unitig_count(a.k_from or g.kmin + 1, a.k_to or longest(g)).orderBy("k").coalesce(1), a.output)


def cdbg(spark: SparkSession, a: argparse.Namespace) -> None:
    g = load(spark, a.graph)
    if a.k <= g.kmin:
        raise ValueError(f"k is {a.k}, this graph answers for {g.kmin + 1} or more")
    write_text(kmers.unitig_lines(kmers.numbered_unitigs(g.seqs, a.k)), a.output, "line")


def braycurtis(spark: SparkSession, a: argparse.Namespace) -> None:
    g = load(spark, a.graph)
    ranked = global_rank(g.seqs.select("seq_id"), ["seq_id"], "at")
    of = files.read_sample_ids(spark, a.samples, g.seqs.count())
    ids = ranked.join(of, "at").select("seq_id", "dataset_id")
    found = Graph(g.seqs.select("seq_id", "seq").join(ids, "seq_id"), g.kmin).bray_curtis(a.k_from or g.kmin, a.k_to or BRAY_CURTIS_TO)
    write_csv(found.select("id1", "id2", "k", "value").orderBy("id1", "id2", "k"), a.output)


def overlap(spark: SparkSession, a: argparse.Namespace) -> None:
    g = load(spark, a.graph)
    write_csv(kmers.overlap_degrees(g.seqs, max(a.min_length or g.kmin, g.kmin), a.multi), a.output)


def stat(spark: SparkSession, a: argparse.Namespace) -> None:
    g = load(spark, a.graph)
    for d in (g.summary(), g.stat()):
        for r in d.orderBy("kind").collect():
            print(*(f"{k}={v}" for k, v in r.asDict().items()))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kmerloom", description=__doc__)
    sub = p.add_subparsers(dest="program", required=True)

    def add(run, *options: tuple[str, dict], graph: bool = True, output: bool = True) -> None:
        s = sub.add_parser(run.__name__)
        s.set_defaults(run=run)
        if graph:
            s.add_argument("graph", help="folder of a stored graph")
        else:
            s.add_argument("input", help="files of sequences")
            s.add_argument("--format", choices=("fasta", "fastq", "text", "ebwt", "parquet"), default="fasta")
        if output:
            s.add_argument("output", help="folder to write to")
        for name, more in options:
            s.add_argument(name, **more)

    k, span = ("--k", {"type": int, "required": True}), (("--k-from", {"type": int}), ("--k-to", {"type": int}))
    add(build, ("--kmin", {"type": int, "default": KMIN}), ("--text", {"action": "store_true"}), graph=False)
    add(access, graph=False)
    add(kmer, k)
    add(kmer_count, *span)
    add(unitig_count, *span)
    add(cdbg, k)
    add(braycurtis, *span, ("--samples", {"required": True}))
    add(overlap, ("--min-length", {"type": int}), ("--multi", {"action": "store_true"}))
    add(stat, output=False)
    return p


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(arguments)
    a.run(spark or SparkSession.builder.appName(f"kmerloom {a.program}").getOrCreate(), a)


if __name__ == "__main__":
    main(sys.argv[1:])
