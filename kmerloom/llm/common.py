"""What the operators share: tables, lineage cuts, word splitting and connected components."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.functions.lineage import cut, remove, remove_path, shared_folder, stored

__all__ = ["cut", "remove", "remove_path", "shared_folder", "stored"]

BLANK = re.compile(rb"[ \t\n\x0b\x0c\r]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batches(df: DataFrame) -> DataFrame:
    """df, with its session handing texts to Python in Arrow batches that a worker can hold: the same for all operators."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return df


#: Rows of a few numbers up to which a table is broadcast (under 10 MB).
SMALL_ROWS = 1 << 18


def broadcast_small(df: DataFrame) -> DataFrame:
    """df, a stored table of a few numbers a row, marked for broadcast if it has at most SMALL_ROWS rows."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The runs of characters other than ASCII white space of all texts, and where each text's words begin.

    The second value has one more entry than there are texts. A null text has no words.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    words, ends = lists.flatten(), np.diff(lists.offsets.to_numpy())
    filled = pc.not_equal(pc.binary_length(words), 0)
    if pc.all(filled).as_py() is not False:
        return words, np.concatenate([[0], np.cumsum(ends)])
    mask = filled.to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(mask)])
    return words.filter(filled), before[np.concatenate([[0], np.cumsum(ends)])]


def coded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A number for each word, and the distinct words by number."""
    d = words.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of values[starts[i]:starts[i + 1]] for each i, without a wider copy of values."""
    out = np.zeros(len(starts) - 1, np.int64)
    filled = np.flatnonzero(np.diff(starts))
    if len(filled):
        out[filled] = np.add.reduceat(values[: starts[-1]], starts[filled], dtype=np.int64)
    return out


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts one after the other, and where each begins; a null text is empty."""
    a = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    data = a.buffers()[2]
    held = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return held[offsets[0] : offsets[-1]], offsets - offsets[0]


def stretches(raw: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """raw in parts of about `size` bytes, cut at ASCII white space, so that no word is cut; a word may exceed `size`."""
    at = 0
    while len(raw) - at > size:
        found = BLANK.search(raw, at + size)
        if not found:
            break
        yield raw[at : found.end()]
        at = found.end()
    yield raw[at:] if at else raw


def pieces_of(batches: Iterator[pa.RecordBatch], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most about `most` bytes, one row at least. Bounds what a worker holds at once."""
    for b in batches:
        if b.nbytes <= most:
            if b.num_rows:
                yield b
            continue
        step = max(1, int(b.num_rows * most / b.nbytes))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def give_back() -> None:
    """Hand memory that is free in this process back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, whose worker gives its free memory back when a task ends: workers stay, and the next stage's peak comes on top."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b); root is the smallest node that can be reached.

    Alternates large-star and small-star steps until the edges form stars. Each step is a minimum per node, which Spark
    sums up before the shuffle, and a join that adaptive execution can split, so a hub needs no large task. Each round is
    written. Loops and null ends are ignored; without edges the result is empty.
    """

    def least(e: DataFrame, on: str, other: str) -> DataFrame:
        return e.groupBy(F.col(on).alias("n")).agg(F.min(other).alias("m"))

    def large(e: DataFrame) -> DataFrame:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        m = least(both, "a", "b").select("n", F.least("n", "m").alias("m"))
        return both.filter("b > a").join(m, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))

    def small(e: DataFrame) -> DataFrame:
        # every edge already points from its larger end to its smaller end
        m = least(e, "a", "b")
        kept = e.join(m, F.col("a") == F.col("n"))
        return kept.select(F.col("b").alias("a"), F.col("m").alias("b")).union(m.select(F.col("n").alias("a"), F.col("m").alias("b")))

    def tidy(e: DataFrame) -> DataFrame:
        return e.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    edges = stored(tidy(edges.select("a", "b").filter("a is not null and b is not null")))
    before = state(edges)
    while before[0]:
        last, edges = edges, stored(tidy(small(tidy(large(edges)))))
        remove(last)
        now = state(edges)
        if now == before:
            break
        before = now
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())


def smallest_of_groups(classes: DataFrame, stars: DataFrame, of: str) -> DataFrame:
    """(node, first) for each class (node, `of`): the least `of` among the classes that stars(node, root) put together.

    Classes without a partner need no join by root. What has a root meets the table of roots, whose size is known, so that
    the join is a broadcast or one whose large sides are split.
    """
    linked_ = stored(classes.select("node", of).join(stars, "node"))
    least = stored(linked_.groupBy("root").agg(F.min(of).alias("first")))
    together = linked_.join(least, "root").select("node", "first")
    return classes.select("node", of).join(together, "node", "left").select("node", F.coalesce("first", of).alias("first"))


def ranked(df: DataFrame, group: list[str], block: F.Column, order: list, value: str | None = None) -> DataFrame:
    """df with `rank` (rows of the group before this one) and, if a value is named, `before` (their sum).

    Rows of a group are ordered by block, then by `order`. No task holds a group: a window numbers the rows of a block, and
    a second one, over one row per block, tells where each block begins. The group's columns must not be null.
    """
    from pyspark.sql import Window

    held = F.col(value) if value else F.lit(0)
    d = df.withColumn("_block", block)
    keys = [*group, "_block"]
    earlier = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    begins = d.groupBy(*keys).agg(F.count("*").alias("_n"), F.sum(held).alias("_v"))
    begins = begins.select(*keys, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_rank"), F.coalesce(F.sum("_v").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys).orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("rank", F.row_number().over(inside) - 1)
    if value:
        d = d.withColumn("before", F.coalesce(F.sum(value).over(so_far), F.lit(0)))
    d = d.join(begins, keys).withColumn("rank", F.col("rank") + F.col("_rank"))
    if value:
        d = d.withColumn("before", F.col("before") + F.col("_before"))
    return d.drop("_block", "_rank", "_before")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, most_bytes: int):
    """pandas (text, label) of about `rows` labelled documents, all of them if there are fewer, drawn by a hash of the id.

    The draw is made on the labels, so that only a bounded table meets the documents and only its texts reach the driver.
    Documents of more than most_bytes are left out. An id's first text in code point order and least label stand for it.
    """
    named = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id"), F.col(label).alias("_label"))
    n = named.count()
    part = 1 << 30
    draw = F.pmod(F.xxhash64(F.lit("fit"), "_id"), F.lit(part))
    drawn = named.filter(draw < int(part * min(1.0, rows / max(1, n)))).groupBy("_id").agg(F.min("_label").alias("_label"))
    # about `rows` rows of two numbers
    given = docs.filter(F.octet_length("text") <= most_bytes).select("doc_id", "text")
    found = given.join(F.broadcast(drawn), F.col("doc_id") == F.col("_id")).groupBy("doc_id", F.col("_label").alias(label)).agg(F.min("text").alias("text")).toPandas()
    return found.sort_values("doc_id", ignore_index=True)
