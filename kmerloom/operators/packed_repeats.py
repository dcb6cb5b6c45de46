"""Maximal repeats of short sequences over at most four letters, two bits a letter.

Places are dealt by the minimizer of their first kmin letters, as in `packed`, so a bucket has all places of a seed. A run of
places moves as one stretch of letters up to the end of its sequence, from a whole byte on. A bucket's places are sorted by
their first kmin letters; seeds that one letter precedes everywhere go; the places of the others are sorted by all of their
letters. Neighbours' common prefixes make intervals, taken depth by depth for all seeds at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.functions.lineage import remove, stored, stored_alone
from kmerloom.operators.packed import BUCKETS, RUN, buckets

#: Letters that a seed, and a sequence, may have; letters that a worker deals at once; places that it sorts whole at once, about.
SEED, SEQUENCE, CHUNK, PART = 32, 255, 1 << 20, 1 << 18
#: Shares in which buckets are dealt where the results are stored.
TURNS = 4
STRATUM, PLACE = 0, 1
#: Edges to a stratum that the vertex begins with, has within, ends with; and those of a sequence.
PREFIX, INNER, SUFFIX, WHOLE = 1, 2, 3, 4
FIELDS = ("what", "of_seq", "of_pos", "size", "seq_id", "pos", "freq", "left_cnt", "right_cnt", "home_seq", "home_pos")


def fits(letters: str | None, longest: int | None, kmin: int) -> bool:
    return letters is not None and len(letters) <= 4 and letters.isascii() and longest is not None and longest <= SEQUENCE and kmin <= SEED


def spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places begin[i] .. begin[i] + size[i] - 1 of all i, one after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)


def runs(a: np.ndarray, sizes: np.ndarray, ids: np.ndarray, kmin: int, n: int, turn: int = 0, turns: int = 1) -> Iterator[tuple[int, bytes]]:
    """(bucket, runs) of the sequences of these sizes, whose letters follow each other in a; of buckets whose turn it is.

    Runs are one binary value: their number; for each its places, the letters of its last place, where it begins in its
    sequence; the sequences; the letters from the byte that has the one before the first place.
    """
    many = np.maximum(0, sizes - kmin + 1)
    total = int(many.sum())
    if not total:
        return
    bytes_of = -(-sizes // 4)
    ends, upto = np.cumsum(sizes), np.cumsum(bytes_of)
    x = np.zeros(4 * int(upto[-1]), np.uint8)
    x[spans(4 * (upto - bytes_of), sizes)] = a
    x = x.reshape(-1, 4)
    x = x[:, 0] << 6 | x[:, 1] << 4 | x[:, 2] << 2 | x[:, 3]
    owner = np.repeat(np.arange(len(sizes)), many)
    inside = np.arange(total) - (np.cumsum(many) - many)[owner]
    b = buckets(a, kmin, n)[inside + (ends - sizes)[owner]]
    new = inside % RUN == 0
    new[1:] |= b[1:] != b[:-1]
    start = np.flatnonzero(new)
    places = np.diff(np.append(start, total))
    order = np.argsort(b[start], kind="stable")
    order = order[b[start[order]] // np.uint32(2) % np.uint32(turns) == turn]
    if not len(order):
        return
    start, places = start[order], places[order]
    b, of, pos = b[start], owner[start], inside[start]
    first = np.maximum(pos - 1, 0) // 4
    length = bytes_of[of] - first
    held, to = x[spans((upto - bytes_of)[of] + first, length)], np.cumsum(length)
    parts = places.astype(np.uint8), (sizes[of] - (pos + places - 1)).astype(np.uint8), pos.astype(np.uint8), ids[of].astype(np.int64)
    cut = np.append(np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])), len(b))
    for i, j in zip(cut[:-1], cut[1:]):
        yield int(b[i]), np.uint32(j - i).tobytes() + b"".join(c[i:j].tobytes() for c in parts) + held[to[i] - length[i] : to[j - 1]].tobytes()


class Places:
    """The places of a bucket's runs: letters, and for each place where it is in them, its sequence, its place there, its letters."""

    def __init__(self, held: list[bytes]) -> None:
        parts = []
        for raw in held:
            n = int(np.frombuffer(raw, np.uint32, 1)[0])
            parts.append([np.frombuffer(raw, np.uint8, n, 4 + k * n) for k in range(3)] + [np.frombuffer(raw, np.int64, n, 4 + 3 * n), np.frombuffer(raw, np.uint8, -1, 4 + 11 * n)])
        many, last, pos, ids, x = (np.concatenate(c) for c in zip(*parts))
        many, last, pos = many.astype(np.int64), last.astype(np.int64), pos.astype(np.int64)
        first = np.maximum(pos - 1, 0) // 4
        length = -(-(pos + many - 1 + last) // 4) - first
        self.letters = np.concatenate([x, np.zeros(9, np.uint8)])
        self.run = np.repeat(np.arange(len(many), dtype=np.int32), many)
        self.ahead = (np.arange(len(self.run)) - (np.cumsum(many) - many)[self.run]).astype(np.int32)
        # where the place `ahead` of a run is, in letters
        self.base, self.ids, self.begin, self.size = 4 * (np.cumsum(length) - length) + pos - 4 * first, ids, pos, last + many - 1

    def word(self, on: np.ndarray | slice, at: int) -> np.ndarray:
        """32 letters of these places from letter `at` on, as numbers that sort alike; zeros beyond the end."""
        run, ahead = self.run[on], self.ahead[on]
        out = np.zeros(len(run), np.uint64)
        for i in range(0, len(run), PART):
            part = slice(i, i + PART)
            have = np.clip(self.size[run[part]] - ahead[part] - at, 0, 32)
            some = np.flatnonzero(have)
            where = (self.base[run[part]] + ahead[part] + at)[some]
            nine = self.letters[(where >> 2)[:, None] + np.arange(9)]
            shift = (2 * (where & 3)).astype(np.uint64)
            w = np.ascontiguousarray(nine[:, :8]).view(">u8")[:, 0].astype(np.uint64)
            w = w << shift | nine[:, 8].astype(np.uint64) >> (np.uint64(8) - shift)
            out[i + some] = w >> (64 - 2 * have[some]).astype(np.uint64) << (64 - 2 * have[some]).astype(np.uint64)
        return out

    def left(self) -> np.ndarray:
        """The bit of the letter before each place; 16 where there is none."""
        where = self.base[self.run] + self.ahead - 1
        none = self.begin[self.run] + self.ahead == 0
        letter = self.letters[np.maximum(where, 0) >> 2] >> (6 - 2 * (where & 3)).astype(np.uint8) & np.uint8(3)
        return np.where(none, np.uint8(16), np.uint8(1) << letter)


def zeros(x: np.ndarray) -> np.ndarray:
    """Leading zero bits."""
    for by in (1, 2, 4, 8, 16, 32):
        x = x | x >> np.uint64(by)
    return 64 - np.bitwise_count(x).astype(np.int64)


def strata_of(h: np.ndarray, left: np.ndarray, have: np.ndarray, kmin: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(depth, begin, end, letters before, letters after) of the strata of sorted places; h[i] letters are common to i and i + 1."""
    counts = [np.concatenate([[0], np.cumsum(left == bit)]) for bit in (1, 2, 4, 8, 16)]
    for depth, _, *x in intervals_of(h, counts, have, kmin):
        yield depth, *x


def intervals_of(h: np.ndarray, counts: list[np.ndarray], have: np.ndarray, kmin: int) -> Iterator[tuple[np.ndarray, ...]]:
    """As `strata_of`, after the depth all i with h[i] of it; counts: of each context before, how many come before place i."""
    by = np.argsort(have, kind="stable")
    at = np.searchsorted(have[by], np.arange(SEQUENCE + 2))
    on = np.flatnonzero(h >= kmin)
    for depth in np.unique(h[on]).tolist():
        on = on[h[on] >= depth]
        first = np.flatnonzero(np.concatenate([[True], np.diff(on) != 1]))
        own = np.minimum.reduceat(h[on], first) == depth
        begin, end = on[first][own], on[np.append(first[1:], len(on)) - 1][own] + 2
        seen = [c[end] - c[begin] for c in counts]
        letters = sum((c > 0).astype(np.int64) for c in seen[:4])
        ok = (letters > 1) | (seen[4] > 0)
        begin, end, letters = begin[ok], end[ok], letters[ok]
        if not len(begin):
            continue
        exact, ended = on[h[on] == depth], by[at[depth] : at[depth + 1]]
        after = np.searchsorted(exact, end - 1) - np.searchsorted(exact, begin) + 1 - (np.searchsorted(ended, end) - np.searchsorted(ended, begin))
        yield depth, exact, begin, end, letters, after


def of_sorted(h: np.ndarray, left: np.ndarray, have: np.ndarray, seq: np.ndarray, pos: np.ndarray, kmin: int) -> Iterator[list[np.ndarray]]:
    """Columns (FIELDS) of the strata and places of sorted places; h[i] letters are common to i and i + 1."""
    order = np.lexsort((pos, seq))
    rank = np.empty(len(seq), np.int64)
    rank[order] = np.arange(len(seq))
    mixed = (seq.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + pos.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(17) & np.uint64(0xFFFFFFFF)
    drawn = np.lexsort((pos, seq, mixed))
    draw = np.empty(len(seq), np.int64)
    draw[drawn] = np.arange(len(seq))
    for depth, begin, end, letters, after in strata_of(h, left, have, kmin):
        freq = end - begin
        for i, j in slices(freq, 1 << 20):
            many = freq[i:j]
            held, to = spans(begin[i:j], many), np.cumsum(many) - many
            name, home = order[np.minimum.reduceat(rank[held], to)], drawn[np.minimum.reduceat(draw[held], to)]
            none, size = np.zeros(len(many), np.int64), np.full(len(many), depth)
            yield [none + STRATUM, seq[name], pos[name], size, none, none, many, letters[i:j], after[i:j], seq[home], pos[home]]
            name, none = np.repeat(name, many), np.zeros(len(held), np.int64)
            yield [none + PLACE, seq[name], pos[name], none + depth, seq[held], pos[held], none, none, none, none, none]


class Strata:
    """The strata of sorted places, and their edges, from the contexts in which each stratum occurs.

    A context is a letter before or after, or a sequence's begin or end, each on its own. A stratum T is an edge wherever an
    interval is T and can't grow at either side without getting as rare as what it lies in: if all places of T with letter c
    before are all those with letter d after, cTd lies in one vertex of their frequency. If c's places have several contexts
    after, the vertex ends with T, if d's have several before, it begins with T. A place whose own two contexts are the only
    ones of their kind is an edge of its sequence. So each stratum's contexts tell all edges to it, and no place moves. The
    vertex is a stratum (or a sequence) known by its frequency and by its first place, which is where the edge's first one is.

    depth, begin, end, letters, after, first: of each stratum its size, places, letters before and after, first place.
    of, kind, many, at: of each edge its stratum, kind, the frequency of the vertex and its stratum's first place in it.
    """

    def __init__(self, h: np.ndarray, left: np.ndarray, have: np.ndarray, seq: np.ndarray, pos: np.ndarray, kmin: int) -> None:
        n = len(left)
        upto = [np.concatenate([[0], np.cumsum(left == bit, dtype=np.int32)]) for bit in (1, 2, 4, 8, 16)]
        own, child = [], []
        for depth, exact, *x in intervals_of(h, upto, have, kmin):
            begin, end = x[:2]
            low = np.searchsorted(exact, begin)
            cuts = np.searchsorted(exact, end - 1) - low
            at = np.cumsum(cuts + 1) - cuts - 1
            first = np.zeros(int((cuts + 1).sum()), bool)
            first[at] = True
            s = np.empty(len(first), np.int32)
            s[first], s[~first] = begin, exact[spans(low, cuts)] + 1
            e = np.empty_like(s)
            e[:-1] = s[1:]
            e[at + cuts] = end
            own.append([np.full(len(begin), depth), *x, cuts + 1])
            child.append([s, e, have[s] == depth])
        empty = np.zeros(0, np.int64)
        self.depth, self.begin, self.end, self.letters, self.after, parts = (np.concatenate(c) for c in zip(*own)) if own else [empty] * 6
        s, e, ended = (np.concatenate(c) for c in zip(*child)) if child else (empty, empty, empty > 0)
        of = np.repeat(np.arange(len(parts)), parts)
        lone, several, same = e - s == 1, np.zeros(len(s), np.int8), np.zeros(len(s), np.int64)
        some, asked, edges = np.cumsum(parts) - parts, [], []
        for u in range(4):
            inside, all_of = upto[u][e] - upto[u][s], upto[u][self.end] - upto[u][self.begin]
            several += inside > 0
            same = np.where(inside > 0, all_of[of], same)
            if len(parts):
                on = np.flatnonzero((all_of > 1) & (np.add.reduceat((inside > 0).astype(np.int32), some) > 1))
                edges.append((on, SUFFIX, all_of[on]))
                asked.append((np.flatnonzero(left == 1 << u), upto[u][self.begin[on]], upto[u][self.end[on]]))
        begins = upto[4][e] - upto[4][s] > 0
        diverse = (several > 1) | begins
        for kind, ok in ((PREFIX, ~ended & ~lone & diverse), (INNER, ~ended & ~lone & ~diverse & (same == e - s)), (WHOLE, lone & (begins | (same == 1)))):
            on = np.flatnonzero(ok)
            edges.append((of[on], kind, (e - s)[on]))
            asked.append((None, s[on], e[on]))
        asked.append((None, self.begin, self.end))
        order = np.lexsort((pos, seq))
        rank = np.empty(n, np.int32)
        rank[order] = np.arange(n, dtype=np.int32)
        whole = [x for x in asked if x[0] is None]
        found = least(rank, np.concatenate([x[1] for x in whole]), np.concatenate([x[2] for x in whole]))
        found = [*(least(rank[x[0]], x[1], x[2]) for x in asked if x[0] is not None), *np.split(found, np.cumsum([len(x[1]) for x in whole])[:-1])]
        self.first = order[found.pop()]
        self.of, self.many = np.concatenate([x[0] for x in edges]), np.concatenate([x[2] for x in edges]).astype(np.int64)
        self.kind, self.at = np.repeat(np.array([x[1] for x in edges], np.int8), [len(x[0]) for x in edges]), order[np.concatenate(found)]


def least(x: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The least of x[begin[i]:end[i]], none of which is empty: of two stretches of a power of two, from the shortest up."""
    out, wide = np.empty(len(begin), x.dtype), np.frexp((end - begin).astype(np.float64))[1] - 1
    by = np.argsort(wide, kind="stable")
    upto = np.searchsorted(wide[by], np.arange(int(wide.max()) + 2)) if len(by) else [0]
    for k in range(len(upto) - 1):
        on = by[upto[k] : upto[k + 1]]
        out[on] = np.minimum(x[begin[on]], x[end[on] - (1 << k)])
        x = np.minimum(x[: -(1 << k)], x[1 << k :]) if k + 2 < len(upto) else x
    return out


def texts_of(words: list[np.ndarray], on: np.ndarray, size: int, letters: np.ndarray) -> pa.Array:
    """The first `size` letters of the words of places `on`."""
    w = np.ascontiguousarray(np.stack([x[on] for x in words[: -(-size // 32)]], 1).astype(">u8")).view(np.uint8)
    x = letters[np.stack([w >> 6, w >> 4 & 3, w >> 2 & 3, w & 3], 2).reshape(len(on), -1)[:, :size]]
    return pa.StringArray.from_buffers(len(on), pa.py_buffer((np.arange(len(on) + 1) * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x)))


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges i:j of groups of these sizes, with about `most` in all, one group at least."""
    upto, i = np.cumsum(sizes), 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + most, "right")))
        yield i, j
        i = j


def parts_of_bucket(held: list[bytes], kmin: int) -> Iterator[tuple]:
    """A bucket's places of seeds that different letters precede, part by part, sorted by their letters.

    Of each part (h, left, have, id, pos, words): h[i] letters are common to i and i + 1; the letter before; the letters from
    there on; the sequence and the place in it; all letters.
    """
    p = Places(held)
    seed, left = p.word(slice(None), 0) >> np.uint64(64 - 2 * kmin), p.left()
    order = np.argsort(seed, kind="stable").astype(np.int32)
    seed = seed[order]
    first = np.flatnonzero(np.concatenate([[True], seed[1:] != seed[:-1]]))
    size = np.diff(np.append(first, len(seed)))
    found = np.bitwise_or.reduceat(left[order], first)
    ok = (size > 1) & ((np.bitwise_count(found & np.uint8(15)) > 1) | (found > 15))
    first, size = first[ok], size[ok]
    del seed
    for i, j in slices(size, PART):
        on = order[spans(first[i:j], size[i:j])]
        run, ahead = p.run[on], p.ahead[on]
        have = p.size[run] - ahead
        words = [p.word(on, w) for w in range(0, int(have.max()), 32)]
        by = np.lexsort((have, *reversed(words)))
        on, run, ahead, have = on[by], run[by], ahead[by], have[by]
        h, same = np.zeros(len(on) - 1, np.int64), np.ones(len(on) - 1, bool)
        for w in words:
            w = w[by]
            # zero bits of no difference at all are 64
            h += np.where(same, zeros(w[1:] ^ w[:-1]) // 2, 0)
            same &= w[1:] == w[:-1]
        yield np.minimum(h, np.minimum(have[1:], have[:-1])), left[on], have, p.ids[run], p.begin[run] + ahead, [w[by] for w in words]


def joined(columns: Iterator[list], rows: int) -> Iterator[list]:
    """The same rows with about so many in each list of columns, since strata of one size are few."""
    held, n = [], 0
    for c in columns:
        held.append(c)
        n += len(c[0])
        if n >= rows:
            yield [pa.concat_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in one]) for one in zip(*held)]
            held, n = [], 0
    if held:
        yield [pa.concat_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in one]) for one in zip(*held)]


def by_turns(seqs: DataFrame, kmin: int, letters: str, of_bucket, shape: str) -> DataFrame:
    """As `by_buckets`, as stored tables: a TURNS-th of the buckets is dealt at a time, since what is dealt takes several times the input's disk."""
    found = [stored_alone(by_buckets(seqs, kmin, letters, of_bucket, shape, i, TURNS)) for i in range(TURNS)]
    out = reduce(DataFrame.union, found)
    out.parts = found
    return out


def by_buckets(seqs: DataFrame, kmin: int, letters: str, of_bucket, shape: str, turn: int = 0, turns: int = 1) -> DataFrame:
    """Rows of the columns that of_bucket yields for each bucket's values, of seqs(id, seq). Other letters, or over SEQUENCE letters, are an error."""
    n = 2 * int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [c.split()[0] for c in shape.split(", ")]
    number = np.full(256, 255, np.uint8)
    number[np.frombuffer(letters.encode(), np.uint8)] = np.arange(len(letters))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column("seq").is_valid())
            texts, ids = batch.column("seq").cast(pa.large_string()), batch.column("id").to_numpy()
            if not len(texts):
                continue
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            if np.diff(offsets).max() > SEQUENCE:
                raise ValueError(f"a sequence of over {SEQUENCE} letters")
            for i, j in slices(np.diff(offsets), CHUNK):
                a = number[raw[offsets[i] : offsets[j]]]
                if len(a) and a.max() > 3:
                    raise ValueError(f"letters other than {letters}")
                out = list(runs(a, np.diff(offsets[i : j + 1]), ids[i:j], kmin, max(BUCKETS, 4 * n), turn, turns))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], ["bucket", "held"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        name, held = None, []
        for b in batches:
            for bucket, raw in zip(b.column("bucket").to_pylist(), b.column("held").to_pylist()):
                if bucket != name:
                    if held:
                        yield from of_bucket(held)
                    name, held = bucket, []
                held.append(raw)
        if held:
            yield from of_bucket(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in joined(found(batches), 1 << 15):
            for i in range(0, len(columns[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([c[i : i + (1 << 16)] for c in columns], names)

    dealt = seqs.mapInArrow(deal, "bucket int, held binary").repartition(n, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, shape)


def repeat_rows(seqs: DataFrame, kmin: int, letters: str) -> DataFrame:
    """Rows (FIELDS) of all strata and places of seqs(seq_id, seq), ids 0 or more. Other letters, or over SEQUENCE letters, are an error."""

    def of_bucket(held: list[bytes]) -> Iterator[list[np.ndarray]]:
        for *part, _ in parts_of_bucket(held, kmin):
            for columns in of_sorted(*part, kmin):
                yield [c.astype(np.int64) for c in columns]

    return by_buckets(seqs.select(F.col("seq_id").alias("id"), "seq"), kmin, letters, of_bucket, ", ".join(f"{c} long" for c in FIELDS))


def graph_rows(seqs: DataFrame, kmin: int, letters: str, datasets: bool = False) -> DataFrame:
    """Rows (what, id, size, freq, left_cnt, right_cnt, seq_id, pos [, held]) of seqs(seq_id, seq [, dataset_id]): strata, and edges to them.

    An edge (what is its kind) has its stratum's id and size, its vertex's frequency, and where it is in the first place of
    its vertex. Ids are numbers of a task and within it. If datasets are asked for, which `fits_datasets` allows, held has a
    stratum's frequency in each dataset where it occurs.
    """
    given = 0
    kind = pa.struct([("dataset_id", pa.int64()), ("freq", pa.int64())])

    def held_of(s: Strata, dataset: np.ndarray) -> pa.Array:
        names = np.unique(dataset)
        freq = np.empty((len(s.depth), len(names)), np.int64)
        for i, d in enumerate(names):
            upto = np.concatenate([[0], np.cumsum(dataset == d)])
            freq[:, i] = upto[s.end] - upto[s.begin]
        at, d = np.nonzero(freq)
        ends = np.searchsorted(at, np.arange(len(freq) + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(names[d]), pa.array(freq[at, d])], fields=list(kind)))

    def of_bucket(held: list[bytes]) -> Iterator[list[np.ndarray]]:
        nonlocal given
        base = TaskContext.get().partitionId() << 40
        for h, left, have, seq, pos, _ in parts_of_bucket(held, kmin):
            seq, dataset = (seq >> 8, seq & 255) if datasets else (seq, None)
            s = Strata(h, left, have, seq, pos, kmin)
            ids = base + given + np.arange(len(s.depth))
            given += len(ids)
            yield [np.full(len(ids), STRATUM, np.int8), ids, s.depth.astype(np.int32), (s.end - s.begin).astype(np.int64), s.letters.astype(np.int32), s.after.astype(np.int32), seq[s.first], pos[s.first].astype(np.int32), *([held_of(s, dataset)] if datasets else [])]
            none = np.zeros(len(s.of), np.int32)
            yield [s.kind, ids[s.of], s.depth[s.of].astype(np.int32), s.many, none, none, seq[s.at], pos[s.at].astype(np.int32), *([pa.nulls(len(s.of), pa.list_(kind))] if datasets else [])]

    ids = F.col("seq_id") * 256 + F.col("dataset_id") if datasets else F.col("seq_id")
    shape = "what byte, id long, size int, freq long, left_cnt int, right_cnt int, seq_id long, pos int"
    rows = by_turns(seqs.select(ids.cast("long").alias("id"), "seq"), kmin, letters, of_bucket, shape + ", held array<struct<dataset_id:long,freq:long>>" * datasets)
    # each turn's tasks are numbered alike
    numbered = [p.withColumn("id", F.col("id") * TURNS + i) for i, p in enumerate(rows.parts)]
    return reduce(DataFrame.union, numbered)


def fits_datasets(seqs: DataFrame) -> bool:
    """Whether a sequence's id and dataset_id go into one number."""
    if seqs.schema["dataset_id"].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        return False
    fit = F.col("dataset_id").between(0, 255) & F.col("seq_id").between(0, (1 << 54) - 1)
    return not seqs.filter(~F.coalesce(fit, F.lit(False))).limit(1).count()


def edges_of(what: np.ndarray, ids: np.ndarray, size: np.ndarray, freq: np.ndarray, seq: np.ndarray, pos: np.ndarray) -> list[np.ndarray]:
    """(inside, vertex, ord, pos, to, id, shared, seq, at, whole) of the rows of some sequences: edges with their vertices.

    Strata of one frequency whose first places are in one sequence don't lie in each other, so the one that an edge is in is
    the last that begins before it.
    """
    group, rare = np.unique(seq, return_inverse=True)[1], np.unique(freq, return_inverse=True)[1]
    key = (group * (int(rare.max(initial=0)) + 1) + rare) * 256 + pos
    strata, edges = np.flatnonzero(what == STRATUM), np.flatnonzero(what != STRATUM)
    strata = strata[np.argsort(key[strata], kind="stable")]
    inside = what[edges] != WHOLE
    on = edges[inside]
    parent = strata[np.searchsorted(key[strata], key[on] + (what[on] == PREFIX)) - 1] if len(on) else on
    vertex, begin, whole = seq[edges], np.zeros(len(edges), np.int64), np.zeros(len(edges), np.int32)
    vertex[inside], begin[inside], whole[inside] = ids[parent], pos[parent], size[parent]
    at = pos[edges] - begin
    by = np.lexsort((at, vertex, inside))
    edges, vertex, at, inside, whole = edges[by], vertex[by], at[by], inside[by], whole[by]
    to = at + size[edges]
    new = np.ones(len(by), bool)
    new[1:] = (vertex[1:] != vertex[:-1]) | (inside[1:] != inside[:-1])
    starts = np.flatnonzero(new)
    order = np.arange(len(by)) - np.repeat(starts, np.diff(np.append(starts, len(by))))
    shared = np.zeros(len(by), np.int64)
    shared[1:] = np.where(new[1:], 0, np.maximum(to[:-1] - at[1:], 0))
    return [inside, vertex, *(x.astype(np.int32) for x in (order, at, to)), ids[edges], shared.astype(np.int32), seq[edges], pos[edges].astype(np.int32), whole]


def edge_rows(rows: DataFrame) -> DataFrame:
    """(kind, vertex, ord, pos, to, id, shared, seq_id, at, whole) of the rows of `graph_rows`.

    shared: letters in common with the edge before; an occurrence of the edge is in sequence seq_id from letter `at` on, and
    begins pos letters after one of the vertex, which has `whole` letters if it is a stratum.
    """
    columns = ("what", "id", "size", "freq", "seq_id", "pos")
    names = ("inside", "vertex", "ord", "pos", "to", "id", "shared", "seq_id", "at", "whole")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def out(x: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            found = [pa.array(c) for c in edges_of(*x)]
            for i in range(0, len(found[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([c[i : i + (1 << 16)] for c in found], list(names))

        for b in batches:
            x = [b.column(c).to_numpy() for c in columns]
            held = x if held is None else [np.concatenate(c) for c in zip(held, x)]
            whole = int(np.searchsorted(held[4], held[4][-1])) if len(held[4]) else 0
            if whole >= 1 << 15:
                yield from out([c[:whole] for c in held])
                held = [c[whole:] for c in held]
        if held is not None and len(held[0]):
            yield from out(held)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = rows.select(*columns).repartition(n, "seq_id").sortWithinPartitions("seq_id")
    d = d.mapInArrow(run, "inside boolean, vertex long, ord int, pos int, to int, id long, shared int, seq_id long, at int, whole int")
    return d.withColumn("kind", F.when(F.col("inside"), "stratum").otherwise("sequence")).select("kind", *names[1:])


def strata_rows(seqs: DataFrame, kmin: int, letters: str) -> DataFrame:
    """(text, size, freq, left_cnt, right_cnt) of the strata of seqs(seq): neither places nor names of strata move."""
    alphabet = np.frombuffer(letters.ljust(4).encode(), np.uint8)

    def of_bucket(held: list[bytes]) -> Iterator[list]:
        for h, left, have, _, _, words in parts_of_bucket(held, kmin):
            for depth, begin, end, before, after in strata_of(h, left, have, kmin):
                for i in range(0, len(begin), 1 << 14):
                    b, e = begin[i : i + (1 << 14)], end[i : i + (1 << 14)]
                    count = [c[i : i + (1 << 14)].astype(np.int32) for c in (before, after)]
                    yield [texts_of(words, b, depth, alphabet), np.full(len(b), depth, np.int32), (e - b).astype(np.int64), *count]

    return of_stored(seqs, kmin, letters, of_bucket, "text string, size int, freq long, left_cnt int, right_cnt int")


def size_rows(seqs: DataFrame, kmin: int, letters: str) -> DataFrame:
    """(size, strata, edges) of seqs(seq): how many strata, and edges to them, there are of each size, in parts to be added up."""

    def of_bucket(held: list[bytes]) -> Iterator[list[np.ndarray]]:
        strata, edges = np.zeros(SEQUENCE + 1, np.int64), np.zeros(SEQUENCE + 1, np.int64)
        for h, left, have, seq, pos, _ in parts_of_bucket(held, kmin):
            s = Strata(h, left, have, seq, pos, kmin)
            strata += np.bincount(s.depth, minlength=SEQUENCE + 1)
            edges += np.bincount(s.depth[s.of], minlength=SEQUENCE + 1)
        on = np.flatnonzero(strata)
        yield [on.astype(np.int32), strata[on], edges[on]]

    return of_stored(seqs, kmin, letters, of_bucket, "size int, strata long, edges long")


def of_stored(seqs: DataFrame, kmin: int, letters: str, of_bucket, shape: str) -> DataFrame:
    """As `by_turns`, of sequences that are not stored yet and whose ids don't matter."""
    held = stored(seqs.select(F.lit(0).cast("long").alias("id"), "seq"))
    out = by_turns(held, kmin, letters, of_bucket, shape)
    remove(held)
    return out


def dataset_rows(seqs: DataFrame, kmin: int, letters: str) -> DataFrame:
    """(dataset_id, freq, text): how often each stratum of seqs(dataset_id, seq) occurs in each dataset where it does.

    Counted where a bucket's places are sorted, so neither places nor names of strata move. A null dataset_id is a dataset.
    """
    alphabet, none = np.frombuffer(letters.ljust(4).encode(), np.uint8), -(1 << 63)

    def of_bucket(held: list[bytes]) -> Iterator[list]:
        for h, left, have, dataset, _, words in parts_of_bucket(held, kmin):
            names, of = np.unique(dataset, return_inverse=True)
            places = [np.flatnonzero(of == d) for d in range(len(names))]
            for depth, begin, end, _, _ in strata_of(h, left, have, kmin):
                for i in range(0, len(begin), 1 << 14):
                    b, e = begin[i : i + (1 << 14)], end[i : i + (1 << 14)]
                    texts = texts_of(words, b, depth, alphabet)
                    freq = np.stack([np.searchsorted(p, e) - np.searchsorted(p, b) for p in places])
                    d, at = np.nonzero(freq)
                    yield [names[d], freq[d, at], texts.take(pa.array(at))]

    given = seqs.select(F.coalesce(F.col("dataset_id").cast("long"), F.lit(none)).alias("id"), "seq")
    rows = by_buckets(given, kmin, letters, of_bucket, "dataset_id long, freq long, text string")
    return rows.select(F.expr(f"nullif(dataset_id, {none + 1}L - 1L)").cast(seqs.schema["dataset_id"].dataType).alias("dataset_id"), "freq", "text")
