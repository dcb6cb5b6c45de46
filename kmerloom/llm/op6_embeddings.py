"""Near copies among embeddings by collision counting on one-dimensional projections.

Each vector is laid on many drawn lines. The signs on several lines together make a cell; two vectors meet if they share the
cell of one of the tables. Within a cell the vectors are sorted along each further line, and a pair collides on a line if one
lies in the window centred at the other. Collisions are counted per pair, a pair goes on with as many as all but one in some
thousands of pairs at the wanted cosine have (the number follows from the lines' normal law), and is then verified in double
precision. Windows are narrow, so that most pairs never collide and the count grows with the collisions, not with all pairs
times all lines. Tables and cells are numbered so that a pair at the wanted cosine meets with a probability of 0.995.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.llm.common import components, cut, partitions, smallest_of_groups, stored, table

#: Vectors of one cell that a task compares; a fuller cell is split into blocks, and blocks meet in pairs.
BLOCK = 1024
#: Lines for counting, the half width of a window in standard deviations of a pair at the wanted cosine, the miss rate.
LINES, WINDOW, MISS = 64, 0.5, 0.0005
#: Collisions that a task lists at once.
LISTED = 1 << 21


def phi(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def least_collisions(lines: int = LINES, window: float = WINDOW, miss: float = MISS) -> int:
    """The largest number that a pair at the wanted cosine falls short of with a probability of at most `miss`."""
    p, total = 2 * phi(window) - 1, 0.0
    for c in range(lines + 1):
        total += math.comb(lines, c) * p**c * (1 - p) ** (lines - c)
        if total > miss:
            return c
    return lines


def tables_for(least: float, halves: int, recall: float = 0.995) -> int:
    """Tables of cells of so many halves that a pair at cosine `least` shares a cell of with probability `recall`."""
    same = (1 - math.acos(least) / math.pi) ** halves
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - same)))


def normalised(lists: pa.Array) -> tuple[list[bytes | None], list[bytes | None]]:
    """Of each vector the digest of its values and the unit vector's bytes, both null for one that links with nothing."""
    digest, unit = [], []
    for x in lists.to_pylist():
        v = np.array(x, np.float64) if x and None not in x else np.zeros(1)
        with np.errstate(over="ignore", invalid="ignore"):
            top = np.abs(v).max()
            ok = np.isfinite(v).all() and top > 0
            u = v / top if ok else v
            u = u / np.linalg.norm(u) if ok else u
        digest.append(hashlib.blake2b((v + 0.0).tobytes(), digest_size=16).digest() if ok else None)
        unit.append(u.tobytes() if ok else None)
    return digest, unit


def cells(classes: DataFrame, least: float, halves: int, tables: int, seed: int) -> DataFrame:
    """(key, tbl, node, weight, cells, unit): each class once per table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: dict[int, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            size = np.array([len(x) // 8 for x in b.column("unit").to_pylist()])
            for d in np.unique(size).tolist():
                part = b.filter(pa.array(size == d))
                x = np.frombuffer(b"".join(part.column("unit").to_pylist()), np.float64).reshape(-1, d)
                if d not in lines:
                    lines[d] = np.random.default_rng([seed, d]).normal(size=(d, halves * tables))
                bits = (x @ lines[d] > 0).reshape(len(x), tables, halves)
                cell = (bits * (1 << np.arange(halves))).sum(2).astype("<i4")
                held = [c.tobytes() for c in cell]
                label = part.column("label").to_pylist()
                for t in range(tables):
                    key = [hashlib.blake2b(f"{d} {t} {c} {name}".encode(), digest_size=8).digest() for c, name in zip(cell[:, t].tolist(), label)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(key), "<i8")), pa.array(np.full(len(x), t, np.int32)), part.column("node"), part.column("weight"), pa.array(held, pa.binary()), part.column("unit")], ["key", "tbl", "node", "weight", "cells", "unit"])

    return classes.select("node", "label", "weight", "unit").mapInArrow(run, "key long, tbl int, node long, weight long, cells binary, unit binary")


def collisions(place: np.ndarray, width: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that collide, once for each line: one lies in the window of half width `width` around the other.

    Each line is sorted; a row's window then is a stretch of the order. The half of it that is further on is listed, so that
    a pair isn't listed from both its ends.
    """
    n = len(place)
    here = np.arange(n)
    for k in range(place.shape[1]):
        order = np.argsort(place[:, k], kind="stable")
        line = place[order, k]
        many = np.searchsorted(line, line + width, "right") - here - 1
        ends = np.cumsum(many)
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] - many[at] + LISTED, "right")))
            m = many[at:to]
            one = np.repeat(here[at:to], m)
            other = np.arange(len(one)) - np.repeat(np.cumsum(m) - m, m) + one + 1
            yield order[one], order[other]
            at = to


def compare(x: np.ndarray, cell: np.ndarray, weight: np.ndarray, half: np.ndarray, tbl: int, least: float, lines: np.ndarray, width: float, need: int) -> tuple[np.ndarray, np.ndarray]:
    """(new links by member, weighted; edges (i, j) of a spanning forest) among vectors of one cell.

    half: 0 and 1 for two blocks, of which only pairs across count, or all 0. Pairs that share a cell of an earlier table
    are counted there.
    """
    n = len(x)
    count = np.zeros(n * n, np.uint8 if lines.shape[1] < 256 else np.uint16)
    for a, b in collisions(x @ lines, width):
        # a line lists a pair once, so no place is met twice
        count[np.minimum(a, b) * n + np.maximum(a, b)] += 1
    i, j = np.divmod(np.flatnonzero(count >= need), n)
    if half.any():
        across = half[i] != half[j]
        i, j = i[across], j[across]
    fresh = np.zeros(n, np.int64)
    near = np.zeros((n, n), bool)
    for at in range(0, len(i), 1 << 16):
        a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        good = np.einsum("ij,ij->i", x[a], x[b]) >= least
        a, b = a[good], b[good]
        near[a, b] = near[b, a] = True
        new = ~(cell[a, :tbl] == cell[b, :tbl]).any(1) if tbl else np.ones(len(a), bool)
        np.add.at(fresh, a[new], weight[b[new]])
        np.add.at(fresh, b[new], weight[a[new]])
    left, edges = np.ones(n, bool), []
    for root in range(n):
        if not left[root]:
            continue
        left[root] = False
        todo = [root]
        while todo:
            at = todo.pop()
            found = np.flatnonzero(near[at] & left)
            left[found] = False
            edges += [(at, f) for f in found.tolist()]
            todo += found.tolist()
    return fresh, np.array(edges, np.int64).reshape(-1, 2)


def embedding_links(vectors: DataFrame, least: float = 0.93, seed: int = 11) -> DataFrame:
    """Links of each row of vectors(vec_id, embedding, label): (vec_id, n_links, component_id, kept).

    Vectors with equal labels link at a cosine of `least` or more. Rows with equal label and equal values are one class,
    compared once and counted by their number. component_id is the smallest vec_id that links lead to, kept marks its row.

    Null labels, and vectors that are null, empty, zero or hold null or non-finite components, link with nothing; so do
    vectors of unequal length. Repeated rows count as other vectors. A null vec_id stays null and is never a component's
    id. Ties: the smallest id. An empty table gives no rows. Other columns are not read.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digest, unit = normalised(b.column(2))
            none = [x is None for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([None if z else x for x, z in zip(digest, none)], pa.binary()), pa.array([None if z else x for x, z in zip(unit, none)], pa.binary())], ["vec_id", "label", "digest", "unit"])

    given = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast("array<double>"))
    base = cut(given.mapInArrow(read, "vec_id long, label string, digest binary, unit binary"))
    valid = base.filter("digest is not null")
    classes = valid.groupBy("label", "digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("unit").alias("unit"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    # cells of a few hundred of the largest label's vectors, were they spread evenly
    halves = max(4, math.ceil(math.log2(max(1, most) / 256)))
    tables = tables_for(least, halves)
    rows = cells(classes, least, halves, tables, seed)
    full = cut(rows.groupBy("key").count().filter(F.col("count") > BLOCK).select(F.col("key").alias("full_key"), F.ceil(F.col("count") / BLOCK).alias("blocks")))
    # a row for each full cell; broadcast while that is small (under 1 MB), so that vectors move once
    full = F.broadcast(full) if full.count() <= 50_000 else full
    rows = rows.join(full, F.col("key") == F.col("full_key"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine = F.pmod(F.xxhash64("node"), F.col("blocks"))
    rows = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
    rows = rows.select("key", "tbl", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "node", "weight", "cells", "unit")
    width, need = WINDOW * math.sqrt(2 - 2 * least), least_collisions()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: dict[int, np.ndarray] = {}

        def group(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            """All rows of one cell, or of two of its blocks."""
            if b.num_rows < 2:
                return
            x = np.frombuffer(b"".join(b.column("unit").to_pylist()), np.float64).reshape(b.num_rows, -1)
            cell = np.frombuffer(b"".join(b.column("cells").to_pylist()), "<i4").reshape(b.num_rows, -1)
            d = x.shape[1]
            if d not in lines:
                lines[d] = np.random.default_rng([seed + 1, d]).normal(size=(d, LINES))
            node, weight = b.column("node").to_numpy(), b.column("weight").to_numpy()
            i, j = b.column("i")[0].as_py(), b.column("j")[0].as_py()
            half = (b.column("mine").to_numpy() == j).astype(int) if i != j else np.zeros(b.num_rows, int)
            fresh, edges = compare(x, cell, weight, half, b.column("tbl")[0].as_py(), least, lines[d], width, need)
            on = np.flatnonzero(fresh)
            a = np.concatenate([node[on], node[edges[:, 0]]])
            to = pa.array(np.concatenate([np.zeros(len(on), np.int64), node[edges[:, 1]]]), mask=np.arange(len(a)) < len(on))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), to, pa.array(np.concatenate([fresh[on], np.zeros(len(edges), np.int64)]))], ["a", "b", "n"])

        held: list[pa.RecordBatch] = []
        name = None
        for b in batches:
            keys = np.stack([b.column(k).to_numpy() for k in ("key", "i", "j")], 1) if b.num_rows else np.zeros((0, 3), np.int64)
            starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist()] if len(keys) else []
            for s, e in zip(starts, [*starts[1:], len(keys)]):
                if held and tuple(keys[s]) != name:
                    yield from group(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    held = []
                name = tuple(keys[s])
                held.append(b.slice(s, e - s))
        if held:
            yield from group(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    met = rows.repartition(partitions(rows), "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long, n long")
    met = cut(met)
    links = met.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    roots = components(met.filter("b is not null").select("a", "b"))
    first = smallest_of_groups(classes.select("node", "rep"), roots, "rep")
    known = classes.select("node", "label", "digest", "weight").join(links, "node", "left").join(first, "node")
    known = stored(known.select(F.col("label").alias("l"), F.col("digest").alias("g"), (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n"), "first"))
    out = base.select("vec_id", "label", "digest").join(known, (F.col("label") == F.col("l")) & (F.col("digest") == F.col("g")), "left")
    component = F.when(F.col("digest").isNull(), F.col("vec_id")).otherwise(F.col("first"))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op6_embedding_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(table(spark, sf_dir, "embeddings"))
