"""SimHash near-duplicates found through an inverted index of fingerprint bytes by position.

A fingerprint has 64 bits. Two of them that differ in at most d bits agree in at least 8 - d of their 8 bytes. Each distinct
fingerprint is posted under its bytes at some positions, one position fewer than must agree and at most three. Of each pair
that a list brings together the positional bytes that it shares are tallied, pairs below the guaranteed minimum go, and what
is left is verified by counting the differing bits. A pair above the minimum shares every list whose positions it agrees in,
so no link is lost.

Lists that are too long for a task are dealt again by one more position each, up to the guaranteed minimum (a pair that
reaches it agrees in one of these too), and what is still too long is compared block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.llm.common import broadcast_small, components, partitions, pieces_of, remove, smallest_of_groups, stored, stretches, table, text_batches, tidied

#: Members of a list, or of a pair of blocks, that a task compares at once.
RUN = 4096
#: Bytes of a fingerprint, and positions of a list at most.
BYTES, WIDTH = 8, 3
#: Share of the documents that tells common shingles.
SAMPLE_SHARE = 0.1
#: Common shingles that every task holds by rank, and as bits of a filter (4 MB), three bits each.
LISTED, FILTERED, FILTER_BITS, FILTER_SHIFTS = 1 << 15, 1 << 22, 1 << 25, (0, 13, 39)
#: Bits of the map of a set by which members of a long list are told apart.
MAP_BITS = 2048
#: Shingles of the members of a list, or of a pair of blocks, that a task compares at once, about (16 MB).
HELD = 1 << 21
#: Members up to which all pairs of a list of shingles are candidates at once.
SHORT = 32
#: Pairs of one document that a task verifies at once, about.
PARTNERS = 1024
SPREAD = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], np.uint64)


def _hashes(found: list[bytes], words: int) -> np.ndarray:
    line = b" ".join(found)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(line, 42)], np.uint64)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1)
    starts, ends, digest = (ends - sizes - 1).tolist(), (ends - 1).tolist(), xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], 42) for a, b in zip(starts, ends[words - 1 :])), np.uint64, len(found) - words + 1)


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `words` words, A-Z lower-cased; of the whole sequence if it is shorter.

    A long text is worked through in stretches of about a megabyte, each with the last words of the one before.
    """
    out: list[np.ndarray] = []
    held: list[bytes] = []
    for raw in stretches((text or "").encode()):
        held += raw.lower().split()
        if len(held) >= words:
            out.append(_hashes(held, words))
            held = held[len(held) - words + 1 :]
    if not out:
        return _hashes(held, words) if held else np.zeros(0, np.uint64)
    return out[0] if len(out) == 1 else np.concatenate(out)


def majority(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each text the 64 bits that over half of hashes[starts[i]:starts[i + 1]] have; zero for none."""
    n = np.diff(starts)
    out = np.zeros(len(n), np.uint64)
    if not len(hashes):
        return out
    # eight counters of one byte each are added up at once, over at most 255 hashes, then widened
    cuts = np.concatenate([np.arange(a, b, 255) for a, b in zip(starts[:-1], starts[1:]) if b > a])
    owner = np.repeat(np.arange(len(n)), -(-n // 255))
    counts = np.zeros((len(n), 64), np.int64)
    digits = hashes.view(np.uint8).reshape(-1, 8)
    for p in range(8):
        eight = np.add.reduceat(SPREAD[digits[:, p]], cuts).view(np.uint8).reshape(-1, 8)
        np.add.at(counts[:, 8 * p : 8 * p + 8], owner, eight)
    over = 2 * counts > n[:, None]
    return np.packbits(over, axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprint(texts: list[str | None], words: int) -> np.ndarray:
    """The fingerprint of each text."""
    return majorities([shingle_hashes(t, words) for t in texts])


def majorities(each: list[np.ndarray]) -> np.ndarray:
    """The fingerprint of each text, from its shingles' hashes."""
    starts = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
    return majority(np.concatenate(each) if each else np.zeros(0, np.uint64), starts)


def guaranteed(max_bits: int) -> int:
    """Positional bytes that fingerprints share which differ in at most so many bits."""
    if not 0 <= max_bits < BYTES:
        raise ValueError("fingerprints that differ in 8 bits need not share a byte")
    return BYTES - max_bits


def linked(a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    """Whether fingerprints share the guaranteed number of positional bytes, and then differ in few enough bits."""
    x = a ^ b
    tally = (x[..., None].view(np.uint8) == 0).sum(-1)
    ok = tally >= guaranteed(max_bits)
    ok[ok] = np.bitwise_count(x[ok]) <= max_bits
    return ok


def forest(f: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Edges that connect what links connect, at most one per fingerprint."""
    left, out = np.arange(len(f)), []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            at = todo.pop()
            ok = linked(f[left], f[at], max_bits)
            found, left = left[ok], left[~ok]
            out += [(at, x) for x in found.tolist()]
            todo += found.tolist()
    return out


def simhash_fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, f) of each row; f is a signed 64-bit number. Null and blank texts have fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces_of(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprint(b.column(1).to_pylist(), words).view(np.int64))], ["doc_id", "f"])

    return text_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidied(run), "doc_id long, f long")


def _lists(prints: DataFrame, width: int) -> DataFrame:
    """(key, node) of fingerprints `node`: each under every combination of `width` positions and its bytes there."""
    plan = list(combinations(range(BYTES), width))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = b.column("node").to_numpy()
            digits = np.ascontiguousarray(f).view(np.uint8).reshape(len(f), -1).astype(np.int64)
            for at in range(0, len(plan), 16):
                keys = [np.full(len(f), i, np.int64) for i in range(at, min(at + 16, len(plan)))]
                for key, where in zip(keys, plan[at:]):
                    for p in where:
                        key <<= 8
                        key |= digits[:, p]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.tile(f, len(keys)))], ["key", "node"])

    return prints.select("node").mapInArrow(tidied(post), "key long, node long")


def _longer_lists(long: DataFrame, width: int) -> DataFrame:
    """Members (key, node) of lists by `width` positions, dealt by each further position."""
    plan = list(combinations(range(BYTES), width))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, f = b.column("key").to_numpy(), b.column("node").to_numpy()
            digits = np.ascontiguousarray(f).view(np.uint8).reshape(len(f), -1).astype(np.int64)
            has = np.array([[p in where for p in range(BYTES)] for where in plan])[key >> (8 * width)]
            for p in range(BYTES):
                on = ~has[:, p]
                # a list's positions and bytes, with one more position and its byte
                name = np.array([xxhash.xxh64_intdigest(k.tobytes(), p) for k in np.stack([key[on], digits[on, p]], 1)], np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(f[on])], ["key", "node"])

    return long.mapInArrow(tidied(post), "key long, node long")


def _dealt(rows: DataFrame, of: str, by: str, name: str) -> DataFrame:
    """rows with a number `name`: rows of one `of` are dealt by `by` into parts of about PARTNERS."""
    many = rows.groupBy(of).agg(F.ceil(F.count("*") / F.lit(PARTNERS)).alias("_of")).filter("_of > 1")
    return rows.join(many, of, "left").withColumn(name, F.coalesce(F.pmod(F.xxhash64(by), F.col("_of")), F.lit(0).cast("long"))).drop("_of")


def block_pairs(long: DataFrame, run: int, size: str | None = None) -> DataFrame:
    """Members (key, node, ...) of over-long lists, dealt to each pair of blocks of their list.

    Blocks of about half a run are dealt by a hash of the node, and each pair of them is a key of its own, so a task
    compares about `run` members at once, whatever the list's length, and no pair of a list is left out. A member is copied
    once per block of its list. If a column of sizes is named, a pair of blocks has about HELD of them at most, too, and the
    rows have a `side`: 0 or 1 for the first or second of two blocks.
    """
    rest = [c for c in long.columns if c not in ("key", "node")]
    of = F.ceil(2 * F.count("*") / F.lit(run))
    many = long.groupBy("key").agg((F.greatest(of, F.ceil(2 * F.sum(size) / F.lit(HELD))) if size else of).alias("_of"))
    d = long.join(many, "key").withColumn("_at", F.pmod(F.xxhash64(F.lit("block"), "node"), F.col("_of")))
    d = d.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_of") - 1)))
    side = [(F.col("_at") > F.col("_other")).cast("long").alias("side")] if size else []
    return d.select(F.xxhash64("key", F.least("_at", "_other"), F.greatest("_at", "_other")).alias("key"), "node", *rest, *side)


def _rows_of(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([c.to_numpy() for c in batch.columns], 1)


def under_keys(posted: DataFrame, order: list[str], run: int | None, found) -> DataFrame:
    """(a, b, n, need) that `found` yields for the members of each key of posted(key, node, ...), all numbers.

    Members come sorted, each node once. A key with more than `run` of them (None: no such) isn't compared: its members
    are returned as rows with the key as `key`, the node as a, and the other columns.
    """
    rest, n = [c for c in posted.columns if c not in ("key", "node")], partitions(posted)
    names, most = ["a", "b", "n", "need", "key", *rest], run or 1 << 62

    def over(rows: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(rows), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(rows[:, 1].copy()), none, none, none, pa.array(rows[:, 0].copy()), *(pa.array(rows[:, 2 + i].copy()) for i in range(len(rest)))], names)

    def whole(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Of keys that have all their members here."""
        rows = rows[np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(1)])] if len(rows) else rows
        if not len(rows):
            return
        starts = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]]))
        size = np.diff(np.append(starts, len(rows)))
        for s, k in zip(starts[size > most], size[size > most]):
            yield over(rows[s : s + k])
        rows = rows[np.repeat((size > 1) & (size <= most), size)]
        for pairs in found(rows) if len(rows) else ():
            yield pa.RecordBatch.from_arrays([*map(pa.array, pairs), *(pa.nulls(len(pairs[0]), pa.int64()) for _ in (0, *rest))], names)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, long = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _rows_of(batch)
            if long is not None:  # the rest of a key that has too many
                more = rows[:, 0] == long
                if more.any():
                    yield over(rows[more])
                    rows = rows[~more]
                if not len(rows):
                    continue
                long = None
            last = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
            if last or (held and held[-1][-1, 0] != rows[0, 0]):
                yield from whole(np.concatenate([*held, rows[:last]]))
                held, count = [], 0
            held.append(rows[last:])
            count += len(rows) - last
            if count > most:
                one = np.concatenate(held)
                one = one[np.concatenate([[True], (one[1:, :2] != one[:-1, :2]).any(1)])]
                held, count = [one], len(one)
                if count > most:
                    long = one[0, 0]
                    yield over(one)
                    held, count = [], 0
        if held:
            yield from whole(np.concatenate(held))

    shape = ", ".join(f"{c} long" for c in names)
    return posted.select("key", "node", *rest).repartition(n, "key").sortWithinPartitions("key", *order).mapInArrow(tidied(runs), shape)


def simhash_edges(prints: DataFrame, max_bits: int, run: int = RUN) -> DataFrame:
    """(a, b) among distinct fingerprints `node`: a spanning forest of the links of each list."""
    least = guaranteed(max_bits)
    width = max(1, min(WIDTH, least - 1))

    def found(rows: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        f = rows[:, 1].copy().view(np.uint64)
        starts = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]]))
        size = np.diff(np.append(starts, len(rows)))
        two = starts[size == 2]
        two = two[linked(f[two], f[two + 1], max_bits)] if len(two) else two
        a, b = [two], [two + 1]
        for s, k in zip(starts[size > 2], size[size > 2]):
            e = np.array(forest(f[s : s + k], max_bits), np.int64).reshape(-1, 2)
            a.append(s + e[:, 0])
            b.append(s + e[:, 1])
        a, b = np.concatenate(a), np.concatenate(b)
        if len(a):
            yield rows[a, 1], rows[b, 1], np.ones(len(a), np.int64), np.ones(len(a), np.int64)

    def links(posted: DataFrame, most: int | None) -> tuple[DataFrame, DataFrame]:
        met = stored(under_keys(posted, ["node"], most, found))
        return met.filter("b is not null").select("a", "b"), met.filter("b is null").select("key", F.col("a").alias("node"))

    edges, long = links(_lists(prints, width), run)
    if width < least:
        more, long = links(_longer_lists(long, width), run)
        edges = edges.union(more)
    return edges.union(links(block_pairs(long, run), None)[0])


def simhash_groups(docs: DataFrame, words: int = 4, max_bits: int = 4, run: int = RUN) -> DataFrame:
    """Fingerprint and group of each row of docs(doc_id, text): (doc_id, f, component_id).

    Rows with equal fingerprints form one class, which is compared once; classes link at max_bits or fewer differing bits,
    and component_id is the smallest doc_id that links lead to. The index finds every link.

    Nulls and blank texts: fingerprint zero. A null doc_id takes part in links but names no group: component_id is null
    if a group has no other. Repeated rows, and rows that repeat a doc_id with another text, each get the group of their
    own text. Ties: the smallest id. An empty table gives no rows. Other columns are not read. A worker holds one text, its
    words of a megabyte, and 8 bytes for each of its shingles.
    """
    prints = stored(simhash_fingerprints(docs, words))
    classes = stored(prints.groupBy(F.col("f").alias("node")).agg(F.min("doc_id").alias("rep")))
    stars = components(simhash_edges(classes, max_bits, run))
    first = smallest_of_groups(classes, stars, "rep").select(F.col("node").alias("f"), F.col("first").alias("component_id"))
    return prints.join(first, "f", "left").select("doc_id", "f", "component_id")


def shingle_sets(texts: list[str | None], words: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """One hash that names the set of each text's shingle hashes, and the sets, sorted."""
    sets = [np.unique(shingle_hashes(t, words)) for t in texts]
    return np.array([set_name(x) for x in sets], np.uint64).view(np.int64), sets


def set_name(x: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(x.tobytes(), 42)


class Common:
    """Which shingles many documents have: a few of them ranked, more of them as bits of a filter of fixed size.

    Only an order of shingles comes from it, so what it doesn't know, or takes for common by chance, costs time and no pair.
    """

    def __init__(self, hashes: np.ndarray, bits: np.ndarray) -> None:
        order = np.argsort(hashes)
        self.hashes, self.rank = hashes[order], (len(hashes) - np.arange(len(hashes)))[order] + 1
        self.bits = bits

    def ranks(self, x: np.ndarray) -> np.ndarray:
        """0 for a rare shingle, 1 for one in the filter, more for the listed ones, the most frequent last."""
        out = np.zeros(len(x), np.int64)
        if len(self.bits):
            out[:] = 1
            for at in FILTER_SHIFTS:
                y = (x >> np.uint64(at)) & np.uint64(FILTER_BITS - 1)
                out &= ((self.bits[y >> np.uint64(6)] >> (y & np.uint64(63))) & np.uint64(1)).astype(np.int64)
        if len(self.hashes) and len(x):
            at = np.minimum(np.searchsorted(self.hashes, x), len(self.hashes) - 1)
            out = np.where(self.hashes[at] == x, self.rank[at], out)
        return out


def common_shingles(texts: DataFrame, words: int) -> Common:
    """The shingles that several documents of a sample, a fixed share of all, have.

    They are put last in the order that prefixes are cut by. Any order finds every pair; this one keeps lists short: a
    shingle of twenty documents or more is likely to be known. Of more than FILTERED such shingles the most frequent ones.
    """
    part = 1 << 30
    drawn = texts.filter(F.pmod(F.xxhash64(F.lit("common"), "text"), F.lit(part)) < int(part * SAMPLE_SHARE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces_of(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shingle_sets(b.column(0).to_pylist(), words)[1]).view(np.int64))], ["shingle"])

    seen = stored(drawn.mapInArrow(tidied(run), "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 1"))
    # the least count of which there are few enough; counts from 64 on are one row
    many = {r["n"]: r["count"] for r in seen.groupBy(F.least("n", F.lit(64)).alias("n")).count().collect()}
    least = next((c for c in range(2, 65) if sum(n for k, n in many.items() if k >= c) <= FILTERED), 65)
    # as Arrow columns: as rows they would take the driver many times their size
    listed = seen.orderBy(F.desc("n"), "shingle").limit(LISTED).select("shingle").toArrow()
    places = F.array(*(F.expr(f"shiftrightunsigned(shingle, {at}) & {FILTER_BITS - 1}") for at in FILTER_SHIFTS))
    places = seen.filter(F.col("n") >= least).select(F.explode(places).alias("at"))
    # a row for each 64 bits of the filter that are not all zero: its size bounds what the driver gets
    held = places.groupBy(F.expr("shiftright(at, 6)").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 64 if len(held) else 0, np.int64)
    if len(held):
        bits[held["word"].to_numpy()] = held["bits"].to_numpy()
    remove(seen)
    return Common(listed["shingle"].to_numpy().astype(np.int64).view(np.uint64), bits.view(np.uint64))


def further(n):
    """Shingles posted beyond the first that similar sets must share, of a set of n."""
    return n // 20


def prefixes(sets: list[np.ndarray], least: float, common: Common) -> list[np.ndarray]:
    """Of each set as many of its rarest shingles that sets of similarity `least` share 1 + further(n) of them, n the smaller size."""
    out = []
    for x in sets:
        r = common.ranks(x)
        x = x[np.argsort(r, kind="stable")] if r.any() else x
        out.append(x[: len(x) - int(np.ceil(least * len(x) - 1e-9)) + 1 + further(len(x))] if len(x) else x)
    return out


def needed(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Posted shingles that sets of sizes a and b share at least, if their similarity is `least` or more."""
    return np.minimum(1 + further(np.minimum(a, b)), np.ceil(least * np.maximum(a, b) - 1e-9).astype(np.int64))


def admissible(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Whether rows (key, node, size, place) can be of similarity `least`, having the key at these places of their order."""
    a, b, p, q = x[:, 2], y[:, 2], x[:, 3], y[:, 3]
    most = np.minimum(p, q) + 1 + np.minimum(a - p, b - q) - 1
    return (np.minimum(a, b) >= least * np.maximum(a, b) - 1e-9) & (most >= (a + b) * (least / (1 + least)) - 1e-9)


def bit_map(x: np.ndarray) -> bytes:
    """MAP_BITS bits, those set that a hash of the set falls on."""
    bits = np.zeros(MAP_BITS, np.uint8)
    bits[(x >> np.uint64(20)).astype(np.int64) & (MAP_BITS - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def may_be_similar(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Whether sets of sizes a and b with these bit maps (a row each) can have similarity `least`.

    A bit that only one of them has stands for a member, at least one, that the other lacks.
    """
    x, y = x.view(np.uint64), y.view(np.uint64)
    only_x, only_y = (np.bitwise_count(z).sum(1, dtype=np.int64) for z in (x & ~y, y & ~x))
    return np.minimum(a - only_x, b - only_y) * (1 + least) >= least * (a + b) - 1e-6


def joining(sets: list[np.ndarray], root: np.ndarray, side: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Of the pairs (i, j) of sets of similarity `least` whose roots differ, and whose sides if there are two, so many that
    they join all roots that these pairs join: fewer than there are roots.

    The members of the most frequent root are compared with the others, not with each other. What a set shares with all
    others is counted at once, by lists of the members that have a shingle.
    """
    size, n, out = np.array([len(x) for x in sets], np.int64), len(sets), []
    shingle, of = np.concatenate(sets), np.repeat(np.arange(n, dtype=np.int32), size)
    order = np.argsort(shingle, kind="stable")
    shingle, of = shingle[order], of[order]
    begin = np.flatnonzero(np.concatenate([[True], shingle[1:] != shingle[:-1]])) if len(shingle) else np.zeros(0, np.int64)
    many = np.diff(np.append(begin, len(shingle)))
    list_of = np.empty(len(shingle), np.int64)
    list_of[order] = np.repeat(np.arange(len(begin)), many)
    ends, two, maps = np.cumsum(size), side.any() and not side.all(), None
    names, label, counts = np.unique(root, return_inverse=True, return_counts=True)
    for i in np.flatnonzero(label != counts.argmax()).tolist():
        ok = (label != label[i]) & (np.minimum(size, size[i]) >= least * np.maximum(size, size[i]) - 1e-9)
        if two:
            ok &= side != side[i]
        at = list_of[ends[i] - size[i] : ends[i]]
        at = at[many[at] > 1]
        if not ok.any() or not len(at):
            continue
        if many[at].sum() > MAP_BITS // 32 * n:  # a look at the maps costs less
            if maps is None:
                maps = np.stack([np.frombuffer(bit_map(x), np.int64) for x in sets])
            on = np.flatnonzero(ok)
            ok[on] = may_be_similar(maps[[i]], maps[on], size[i], size[on], least)
        upto = np.cumsum(many[at])
        shared = np.bincount(of[np.arange(upto[-1]) + np.repeat(begin[at] - (upto - many[at]), many[at])], minlength=n)
        ok &= shared >= least * (size + size[i] - shared)
        while ok.any():
            j = int(ok.argmax())
            out.append((i, j))
            label[label == label[j]] = label[i]
            ok &= label != label[i]
    return out


def sketch(x: np.ndarray) -> bytes:
    """The sorted ends of a set's hashes: two bytes each, four in a set of over 4096."""
    return np.sort(x.astype("<u2" if len(x) <= 4096 else "<u4")).tobytes()


def most_shared(x: np.ndarray, y: np.ndarray) -> int:
    """An upper bound of what two sets share, from their sketches."""
    if x.dtype != y.dtype:
        x, y = np.sort(x.astype("<u2")), np.sort(y.astype("<u2"))
    if not len(x) or not len(y):
        return 0
    one = y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x
    two = x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y
    return int(min(one.sum(), two.sum()))


class Similar:
    """Classes of equal shingle sets of docs(doc_id, text), and the groups that similarity `least` makes of them.

    A row is named by its doc_id (0 for null), whether that is null, and a hash of its text: (none, id, h).

    The first candidates are the links of the fingerprint index: classes whose fingerprints differ in at most `max_bits`
    bits. They are verified on the whole sets. Similar sets may differ in more bits than any number of shared bytes
    guarantees, so the pairs that the index can't promise are searched by shingles, too.

    These candidates are complete. Shingles have one order, common ones last. Of a set of n shingles the first
    n - ceil(least * n) + 1 + further(n) are posted. Two sets of similarity `least` share the first 1 + further(n) that
    they share at all, n being the smaller size. So of lists of up to SHORT members all pairs are counted, and those that
    meet too rarely go. Pairs are bounded by short sketches of the sets, and then verified on the whole sets in rounds:
    first, with the links of fingerprints, each class against its first partner, in a long list that is its first member,
    then all pairs whose ends no link joins already. In the last round members of a long list that are still apart are
    verified where they meet, block by block. So no pair is left out that could change a group, and a large family makes at
    most as many pairs a list as it has members, whether its texts are similar or just below.
    """

    KEYS = ("none", "id", "h")

    def __init__(self, docs: DataFrame, words: int, least: float, run: int, max_bits: int = 4) -> None:
        self.words, self.least = words, least
        given = text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.given = given.select(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.xxhash64("text").alias("h"), "text")
        self.common = docs.sparkSession.sparkContext.broadcast(common_shingles(given.select("text"), words))
        self.prints = stored(self._prints())
        self.classes = stored(self.prints.groupBy("node").agg(F.min(F.struct(*self.KEYS)).alias("rep"), F.min("f").alias("f")))
        marked = self._marked(max_bits, run)
        short, long = self._near()
        first = long.join(stored(long.groupBy("key").agg(F.min("node").alias("a"))), "key")
        near = self._bounded(short.union(first.filter("a < node").select("a", F.col("node").alias("b"))).distinct())
        once = self._verified(near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b").union(marked).distinct())
        links = once.union(self._verified(self._apart(near, components(once))))
        if long.limit(1).count():
            roots = components(links)
            links = links.union(self._across(long, roots, run))
        self.stars = components(links)

    @staticmethod
    def _apart(pairs: DataFrame, stars: DataFrame) -> DataFrame:
        """The pairs that stars(node, root) don't join."""
        for end in ("a", "b"):
            pairs = pairs.join(stars.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left")
        return pairs.filter("root_a is null or root_b is null or root_a <> root_b").select("a", "b")

    def _across(self, long: DataFrame, stars: DataFrame, run: int) -> DataFrame:
        """(a, b) of similar members of one list (key, node, sp), so many that they join all roots that such pairs join.

        Members carry their set and are verified where they meet, so a pair that isn't similar makes no row, and a list no
        more rows than it has members.
        """
        least = self.least

        def found(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            node, root, side, held = zip(*rows)
            pairs = joining([np.frombuffer(x, "<u8") for x in held], np.array(root), np.array(side), least)
            if pairs:
                a, b = np.array(node)[np.array(pairs)].T
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            name, rows = None, []
            for batch in batches:
                for key, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "node", "root", "side", "held"))):
                    if key != name:
                        if len(rows) > 1:
                            yield from found(rows)
                        name, rows = key, []
                    rows.append(row)
            if len(rows) > 1:
                yield from found(rows)

        d = stored(long.join(stars, "node", "left").select("key", "node", F.shiftright("sp", 31).alias("size"), F.coalesce("root", "node").alias("root")))
        several = stored(d.groupBy("key").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).filter("r1 <> r2").select("key"))
        # copies of one text were posted by several tasks
        d = stored(d.join(several, "key", "left_semi").dropDuplicates(["key", "node"]))
        sets = stored(self._sets(d.select("node").distinct(), lambda x: x.astype("<u8").tobytes()).dropDuplicates(["node"]))
        met = block_pairs(d, run, "size").join(sets, "node").select("key", "node", "root", "side", "held")
        met = met.repartition(partitions(met), "key").sortWithinPartitions("key", "node")
        return stored(met.mapInArrow(tidied(meet), "a long, b long").distinct())

    @staticmethod
    def _sized(rows: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, ...]]:
        """Pairs i, j of rows (key, node, sp, ...) of a key that can be similar, and (key, node, size, place) of both.

        Rows are sorted by key and sp, which is size and place.
        """
        rows = np.concatenate([rows[:, :2], rows[:, 2:3] >> 31, rows[:, 2:3] & ((1 << 31) - 1)], 1)
        at, d = np.arange(len(rows)), 0
        while True:
            d += 1
            at = at[at + d < len(rows)]
            # what is too large here is so further on
            at = at[(rows[at, 0] == rows[at + d, 0]) & (rows[at, 2] >= least * rows[at + d, 2] - 1e-9)]
            if not len(at):
                return
            on = at[admissible(rows[at], rows[at + d], least)]
            if len(on):
                yield on, on + d, rows[on], rows[on + d]

    def _prints(self) -> DataFrame:
        """(none, id, h, node, f) of each row; f is its fingerprint."""
        words = self.words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in pieces_of(batches):
                each = [shingle_hashes(t, words) for t in b.column(3).to_pylist()]
                node = np.array([set_name(np.unique(x)) for x in each], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(node), pa.array(majorities(each).view(np.int64))], ["none", "id", "h", "node", "f"])

        return self.given.mapInArrow(tidied(run), "none boolean, id long, h long, node long, f long")

    def _marked(self, max_bits: int, run: int) -> DataFrame:
        """(a, b), a < b, of classes that fingerprints link: the first classes of linked ones, and the first of each with its others."""
        of = stored(self.classes.groupBy("f").agg(F.min("node").alias("first")))
        links = simhash_edges(of.select(F.col("f").alias("node")), max_bits, run)
        for end in ("a", "b"):
            links = links.join(of.select(F.col("f").alias(end), F.col("first").alias(f"first_{end}")), end)
        same = self.classes.join(of, "f").filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
        return stored(links.select(F.least("first_a", "first_b").alias("a"), F.greatest("first_a", "first_b").alias("b")).union(same).distinct())

    def _near(self) -> tuple[DataFrame, DataFrame]:
        """(a, b), a < b, of short lists that share enough posted shingles; and the members (key, node, sp) of long lists.

        A pair that shares a long list needn't be counted: it is looked after there.
        """
        words, least, common = self.words, self.least, self.common

        def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()  # copies are posted once per task
            for b in pieces_of(batches):
                node, sets = shingle_sets(b.column(0).to_pylist(), words)
                new = [i for i, x in enumerate(node.tolist()) if not (x in seen or seen.add(x))]
                heads = prefixes([sets[i] for i in new], least, common.value)
                many = np.fromiter(map(len, heads), np.int64, len(heads))
                if not many.sum():
                    continue
                place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                size = np.repeat(np.array([len(sets[i]) for i in new]), many)
                # size and place in one number, to move fewer bytes
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(heads).view(np.int64)), pa.array(np.repeat(node[new], many)), pa.array(size << 31 | place)], ["key", "node", "sp"])

        def found(rows: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
            """A pair that several of these keys have is one row."""
            out, held = [], 0

            def summed() -> tuple[np.ndarray, ...]:
                a, b, need = np.concatenate(out, 1)
                order = np.lexsort((b, a))
                a, b, need = a[order], b[order], need[order]
                first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
                return a[first], b[first], np.diff(np.append(first, len(a))), need[first]

            for _, _, x, y in Similar._sized(rows, least):
                out.append(np.stack([np.minimum(x[:, 1], y[:, 1]), np.maximum(x[:, 1], y[:, 1]), needed(x[:, 2], y[:, 2], least)]))
                held += len(x)
                if held > 1 << 18:
                    yield summed()
                    out, held = [], 0
            if out:
                yield summed()

        posted = self.given.select("text").mapInArrow(tidied(post), "key long, node long, sp long")
        met = stored(under_keys(posted, ["sp", "node"], SHORT, found))
        long = stored(met.filter("b is null").select("key", F.col("a").alias("node"), "sp"))
        pairs = met.filter("b is not null and a <> b").groupBy("a", "b", "need").agg(F.sum("n").alias("n"))
        near = stored(pairs.filter("n >= need").select("a", "b"))
        remove(met)
        return near, long

    def _sets(self, nodes: DataFrame, form) -> DataFrame:
        """(node, held): form(its set) for each class asked for, made again from its first row's text.

        What is asked for is broadcast while small, so that texts needn't move; beyond that texts are shuffled. A class whose first
        row is there twice is so here, too.
        """
        words = self.words
        wanted = stored(self.classes.join(nodes, "node").select("rep.*", "node"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in pieces_of(batches):
                held = [form(np.unique(shingle_hashes(t, words))) for t in b.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(1), pa.array(held, pa.binary())], ["node", "held"])

        return self.given.join(broadcast_small(wanted), list(self.KEYS)).select("text", "node").mapInArrow(tidied(run), "node long, held binary")

    def _compared(self, pairs: DataFrame, sets: DataFrame, similar) -> DataFrame:
        """The pairs (a, b) whose sets(node, held) are `similar`.

        The sets of a's partners come to a's, which is held, one after the other; an a with many partners has its set at
        several tasks. Each pair moves one set.
        """
        pairs = _dealt(pairs, "a", "b", "part")
        at = pairs.select(F.col("b").alias("node"), "a", "part").union(pairs.select(F.col("a").alias("node"), "a", "part").distinct())

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            name, mine = None, b""
            for batch in batches:
                a, b = [], []
                for x, partner, node, held in zip(*(batch.column(c).to_pylist() for c in ("a", "partner", "node", "held"))):
                    if not partner:  # comes first
                        name, mine = x, held
                    elif name != x:
                        raise ValueError("a partner without its set")
                    elif similar(mine, held):
                        a.append(x)
                        b.append(node)
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        rows = at.join(sets.select("node", "held"), "node").select("a", "part", (F.col("node") != F.col("a")).alias("partner"), "node", "held")
        rows = rows.repartition(partitions(rows), "a", "part").sortWithinPartitions("a", "part", "partner")
        return stored(rows.mapInArrow(tidied(compare), "a long, b long").distinct())

    def _of_ends(self, pairs: DataFrame, form) -> DataFrame:
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        return stored(self._sets(ends, form))

    def _bounded(self, near: DataFrame) -> DataFrame:
        """Without the pairs that their sketches show to be too different."""
        least = self.least
        near = stored(near)
        sets = self._of_ends(near, sketch)

        def similar(x: bytes, y: bytes) -> bool:
            # a sketch of over 8192 bytes has four bytes each
            one, two = (np.frombuffer(z, "<u2" if len(z) <= 8192 else "<u4") for z in (x, y))
            return most_shared(one, two) * (1 + least) >= least * (len(one) + len(two)) - 1e-6

        out = self._compared(near, sets, similar)
        remove(near, sets)
        return out

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets have similarity `least`."""
        least, asked = self.least, stored(pairs)
        sets = self._of_ends(asked, lambda x: x.astype("<u8").tobytes())

        def similar(x: bytes, y: bytes) -> bool:
            one, two = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
            if not len(one) or not len(two):
                return False
            shared = int((one[np.minimum(np.searchsorted(one, two), len(one) - 1)] == two).sum())
            return shared >= least * (len(one) + len(two) - shared)

        out = self._compared(asked, sets, similar)
        remove(asked, sets)
        return out


def similar_groups(docs: DataFrame, words: int = 5, least: float = 0.8, run: int = RUN) -> DataFrame:
    """(doc_id, component_id) of each row of docs(doc_id, text) with a doc_id; sets of shingles link at similarity `least`.

    Equal sets form one class. Blank texts are one class. Ties: the smallest id. Rows without doc_id take part in links
    but aren't returned. An empty table gives no rows.
    """
    found = Similar(docs, words, least, run)
    first = smallest_of_groups(found.classes, found.stars, "rep").select("node", F.col("first.id").alias("component_id"))
    return found.prints.filter("not none").join(first, "node").select(F.col("id").alias("doc_id"), "component_id")


def simhash_dedup(docs: DataFrame, words: int = 5, least: float = 0.8, run: int = RUN) -> DataFrame:
    """docs without all but the first document of each group of Similar.

    First is the smallest doc_id, null after all others, then a hash of the text. Of rows that repeat a doc_id and its
    text one stays. Column names of docs are kept, others than doc_id and text are only carried. A null text is blank, and
    blank texts are one group. An empty table gives no rows. Texts aren't shuffled: rows that go, and the few that repeat
    id and text, are named by small tables.
    """
    found = Similar(docs, words, least, run)
    keys = [f"_{k}" for k in Similar.KEYS]
    rows = found.prints.select("node", *(F.col(k).alias(f"_{k}") for k in Similar.KEYS))
    first = found.classes.join(found.stars, "node", "left").groupBy(F.coalesce("root", "node")).agg(F.min("rep").alias("rep"))
    first = first.select(*(F.col(f"rep.{k}").alias(f"_{k}") for k in Similar.KEYS))
    named = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    gone = stored(named.join(first, keys, "left_anti").select(*keys))
    again = stored(named.filter("n > 1").join(first, keys, "left_semi").select(*keys))
    d = docs.withColumn("_none", F.col("doc_id").isNull()).withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(0))).withColumn("_h", F.xxhash64(F.col("text").cast("string")))
    once = d.join(broadcast_small(stored(gone.union(again))), keys, "left_anti")
    return once.union(d.join(broadcast_small(again), keys, "left_semi").dropDuplicates(keys)).select(*docs.columns)


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_groups(table(spark, sf_dir, "documents"), words=4, max_bits=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")
