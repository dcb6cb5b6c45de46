"""Distinct k-mers and junctions of sequences over at most four letters, two bits a letter.

A place is where a window of `first` letters begins. Places are dealt by the minimizer of that window, so that equal windows
meet; neighbouring places mostly have the same one, and a run of them moves as one stretch of letters: a place costs one to
three bytes. Runs of a batch go to each bucket as one binary value: their number, for each the number of its places, for each
the letters that its last place has (and whether a letter comes before its first), then letters, each run's from a new byte on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters of a minimizer; places of a run at most; letters that a worker deals at once, about; codes that it holds unsorted.
MINIMIZER, RUN, CHUNK, HELD = 8, 240, 1 << 21, 1 << 22
#: Buckets at least. A worker takes up one after the other, so it holds about one bucket's codes, however few the tasks are.
BUCKETS = 1024
#: Letters that a window, a (k-1)-mer of a junction, or a window of a numbered dataset may have; datasets.
WINDOW, MER, NUMBERED, DATASETS = 60, 28, 24, 256


def fits(letters: str | None, longest: int, most: int) -> bool:
    return letters is not None and len(letters) <= 4 and letters.isascii() and longest <= most


def codes(a: np.ndarray, n: int) -> np.ndarray:
    """At each place of the letters (0 to 3) the next n <= 32 as one number; beyond the end there are zeros."""
    out, have, part, size = np.zeros(len(a), np.uint64), 0, a.astype(np.uint64), 1

    def moved(x: np.ndarray, by: int) -> np.ndarray:
        return np.concatenate([x[by:], np.zeros(min(by, len(x)), x.dtype)])

    while True:
        if n & size:
            out = (out << np.uint64(2 * size)) | moved(part, have)
            have += size
        if have == n:
            return out
        part = (part << np.uint64(2 * size)) | moved(part, size)
        size *= 2


def buckets(a: np.ndarray, first: int, n: int) -> np.ndarray:
    """At each place the bucket, of n, of the window of `first` letters: by the least hash of its minimizers."""
    m = min(MINIMIZER, max(1, first * 3 // 5))
    h = codes(a, m).astype(np.uint32) * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    wide, size = first - m + 1, 1
    while 2 * size <= wide:
        h[: len(h) - size] = np.minimum(h[: len(h) - size], h[size:])
        size *= 2
    if wide > size:
        by = wide - size
        h[: len(h) - by] = np.minimum(h[: len(h) - by], h[by:])
    return ((h * np.uint32(0xC2B2AE35)) >> np.uint32(8)) % np.uint32(n)


def runs(a: np.ndarray, sizes: np.ndarray, first: int, reach: int, before: bool, n: int, placed: bool = False) -> Iterator[tuple[int, bytes]]:
    """(bucket, runs) of the sequences of these sizes, whose letters follow each other in a.

    If `placed`, where each run's first place is in a comes before the letters.
    """
    ends, many = np.cumsum(sizes), np.maximum(0, sizes - first + 1)
    total = int(many.sum())
    if not total:
        return
    owner = np.repeat(np.arange(len(sizes)), many)
    inside = np.arange(total) - (np.cumsum(many) - many)[owner]
    at = inside + (ends - sizes)[owner]
    b = buckets(a, first, n)[at]
    new = inside % RUN == 0
    new[1:] |= b[1:] != b[:-1]
    start = np.flatnonzero(new)
    places = np.diff(np.append(start, total))
    start, places = (x[np.argsort(b[start], kind="stable")] for x in (start, places))
    b, begin = b[start], at[start]
    has = (inside[start] > 0) & before
    last = np.minimum(reach, ends[owner[start]] - (begin + places - 1))
    padded = -(-(has + places - 1 + last) // 4) * 4
    upto = np.cumsum(padded)
    src = np.arange(upto[-1]) + np.repeat(begin - has - (upto - padded), padded)
    x = a[np.minimum(src, len(a) - 1)].reshape(-1, 4)
    x = x[:, 0] | x[:, 1] << 2 | x[:, 2] << 4 | x[:, 3] << 6
    head, tail, where = places.astype(np.uint8), (last | has.astype(np.int64) << 7).astype(np.uint8), begin.astype(np.uint32)
    cut = np.append(np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])), len(b))
    for i, j in zip(cut[:-1], cut[1:]):
        yield int(b[i]), np.uint32(j - i).tobytes() + head[i:j].tobytes() + tail[i:j].tobytes() + (where[i:j].tobytes() if placed else b"") + x[(upto[i] - padded[i]) // 4 : upto[j - 1] // 4].tobytes()


def places_of(held: list[bytes], reach: int, placed: bool = False) -> tuple[np.ndarray, ...]:
    """Letters of all these runs, and of each place where it is in them, its letters, whether there is one before it, and its place if runs have it."""
    heads, tails, wheres, letters = [], [], [], []
    for raw in held:
        n = int(np.frombuffer(raw, np.uint32, 1)[0])
        heads.append(np.frombuffer(raw, np.uint8, n, 4))
        tails.append(np.frombuffer(raw, np.uint8, n, 4 + n))
        wheres.append(np.frombuffer(raw, np.uint32, n if placed else 0, 4 + 2 * n if placed else 0))
        letters.append(np.frombuffer(raw, np.uint8, -1, 4 + (6 if placed else 2) * n))
    many, tail, x = np.concatenate(heads).astype(np.int64), np.concatenate(tails), np.concatenate(letters)
    a = np.stack([x & 3, x >> 2 & 3, x >> 4 & 3, x >> 6], 1).ravel()
    has, last = (tail >> 7).astype(np.int64), (tail & 127).astype(np.int64)
    padded = -(-(has + many - 1 + last) // 4) * 4
    owner = np.repeat(np.arange(len(many)), many)
    j = np.arange(len(owner)) - (np.cumsum(many) - many)[owner]
    at = (np.cumsum(padded) - padded + has)[owner] + j
    out = a, at, np.minimum(reach, (last + many - 1)[owner] - j), (j > 0) | (has[owner] > 0)
    return (*out, np.concatenate(wheres).astype(np.int64)[owner] + j) if placed else out


def letter_numbers(letters: str) -> np.ndarray:
    number = np.full(256, 255, np.uint8)
    number[np.frombuffer(letters.encode(), np.uint8)] = np.arange(len(letters))
    return number


def buckets_of(partitions: int) -> int:
    return max(BUCKETS, 4 * partitions)


def text_chunks(texts: pa.Array, number: np.ndarray, letters: str, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of letters, sizes) of some texts after the other, of about `most` letters. A letter that isn't among `letters` is an error."""
    texts = texts.drop_null().cast(pa.large_string())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        a = number[raw[offsets[i] : offsets[j]]]
        if len(a) and a.max() > 3:
            raise ValueError(f"letters other than {letters}")
        yield a, np.diff(offsets[i : j + 1])
        i = j


def dealt(seqs: DataFrame, letters: str, first: int, reach: int, before: bool, of: str | None = None) -> DataFrame:
    """(bucket, held): the runs of all sequences, dealt by bucket. A letter that isn't among `letters` is an error.

    With a column `of`, an int, runs of its values are apart: (bucket, held, of).
    """
    n = 2 * int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    number = letter_numbers(letters)

    def of_texts(texts: pa.Array) -> Iterator[list[tuple[int, bytes]]]:
        for a, sizes in text_chunks(texts, number, letters, CHUNK):
            out = list(runs(a, sizes, first, reach, before, buckets_of(n)))
            if out:
                yield out

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(1).unique() if of else [None]:
                texts = batch.filter(pc.equal(batch.column(1), name)).column(0) if of else batch.column(0)
                for out in of_texts(texts):
                    columns = [pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())]
                    columns += [pa.array([name.as_py()] * len(out), pa.int32())] if of else []
                    yield pa.RecordBatch.from_arrays(columns, ["bucket", "held", *([of] if of else [])])

    shape = "bucket int, held binary" + (f", {of} int" if of else "")
    return seqs.select("seq", *([of] if of else [])).mapInArrow(deal, shape).repartition(n, "bucket").sortWithinPartitions("bucket")


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], bool]]:
    """Values of buckets that come one after the other, and whether their buckets end with them; the first may be empty then."""
    held, size, since, name = [], 0, 0, None
    for b in batches:
        for bucket, raw in zip(b.column("bucket").to_pylist(), b.column("held").to_pylist()):
            if bucket != name and since > CHUNK // 4:
                yield held, True
                held, size, since = [], 0, 0
            name = bucket
            held.append(raw)
            size, since = size + len(raw), since + len(raw)
            if size > CHUNK // 8:
                yield held, False
                held, size = [], 0
    if since:
        yield held, True


def junction_counts(seqs: DataFrame, k: int, letters: str) -> DataFrame:
    """(l, r, n): how many (k-1)-mers have l letters before and r after them, l + r > 0."""

    def united(keys: list[np.ndarray]) -> np.ndarray:
        x = np.sort(np.concatenate(keys))
        v = x >> np.uint64(8)
        return np.bitwise_or.reduceat(x, np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, new, one, n = [], 0, np.uint64(1), np.zeros(25, np.int64)
        for held, whole in chunks(batches):
            if held:
                a, at, have, led = places_of(held, k)
                left = np.where(led, one << a[np.maximum(at - 1, 0)].astype(np.uint64), np.uint64(0))
                right = np.where(have == k, one << a[np.minimum(at + k - 1, len(a) - 1)].astype(np.uint64), np.uint64(0))
                keys.append(codes(a, k - 1)[at] << np.uint64(8) | left << np.uint64(4) | right)
                new += len(at)
            if whole or new > max(HELD, len(keys[0])):  # what is known by now stands first
                keys, new = [united(keys)], 0
            if whole:
                x, keys = keys[0], []
                n += np.bincount((np.bitwise_count(x >> np.uint64(4) & np.uint64(15)) * 5 + np.bitwise_count(x & np.uint64(15))).astype(np.int64), minlength=25)
        on = np.flatnonzero(n)
        if len(on):
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in (on // 5, on % 5, n[on])], ["l", "r", "n"])

    d = dealt(seqs, letters, k - 1, k, True).mapInArrow(run, "l long, r long, n long")
    return d.groupBy("l", "r").agg(F.sum("n").alias("n")).filter("l + r > 0")


def zeros(x: np.ndarray) -> np.ndarray:
    """Leading zero bits."""
    for by in (1, 2, 4, 8, 16, 32):
        x = x | x >> np.uint64(by)
    return 64 - np.bitwise_count(x).astype(np.int64)


def window_codes(a: np.ndarray, at: np.ndarray, have: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows at these places of letters a as two numbers: 32 letters; 28 letters and the length, so a shorter one comes before those that it begins."""
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    x, y = codes(a, 32)[at], np.concatenate([codes(a[32:], 28), np.zeros(min(32, len(a)), np.uint64)])[at] << np.uint64(8)
    x &= ones << (2 * np.maximum(0, 32 - have)).astype(np.uint64)
    y &= np.where(have > 32, ones << (8 + 2 * np.clip(60 - have, 0, 27)).astype(np.uint64), np.uint64(0))
    return x, y | have.astype(np.uint64)


def shared_letters(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of sorted windows: the letters that each, but the first, has in common with the one before it."""
    size = (y & np.uint64(255)).astype(np.int64)
    p, q = x[1:] ^ x[:-1], (y[1:] ^ y[:-1]) >> np.uint64(8) << np.uint64(8)
    return np.minimum(np.where(p != 0, zeros(p) // 2, 32 + zeros(q) // 2), np.minimum(size[1:], size[:-1]))


def start_counts(seqs: DataFrame, k_from: int, k_to: int, letters: str) -> DataFrame:
    """(k, n): how many k-mers follow a (k-1)-mer that not exactly one letter precedes and one follows, for each k of the range that has some.

    Distinct windows of up to k_to letters are sorted, with the letters before them as bits. A window that shares fewer than k - 1
    letters with its neighbours has its (k-1)-mer alone; the others make groups, which get smaller with k.
    """
    low = k_from - 1

    def united(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        x, y, left = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((y, x))
        x, y, left = x[order], y[order], left[order]
        on = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
        return x[on], y[on], np.bitwise_or.reduceat(left, on)

    def counted(x: np.ndarray, y: np.ndarray, left: np.ndarray) -> np.ndarray:
        """By the letters of the (k-1)-mer."""
        size, h = (y & np.uint64(255)).astype(np.int64), shared_letters(x, y)
        near = np.maximum(np.concatenate([h, [0]]), np.concatenate([[0], h]))
        first, odd = np.maximum(near + 1, low), np.bitwise_count(left) != 1
        odd &= first < size
        n = np.cumsum(np.bincount(first[odd], minlength=k_to + 1) - np.bincount(size[odd], minlength=k_to + 1))
        on = np.flatnonzero(h >= low)
        for m in range(low, k_to):
            on = on[h[on] >= m]
            if not len(on):
                break
            first = np.flatnonzero(np.concatenate([[True], np.diff(on) != 1]))
            last = on[np.append(first[1:], len(on)) - 1] + 1
            before = np.bitwise_count(np.bitwise_or.reduceat(left[on], first) | left[last])
            # the letters after them change where no more is shared; one window may end there
            after = np.add.reduceat((h[on] == m).astype(np.int64), first) + 1 - (size[on[first]] == m)
            n[m] += after[(before != 1) | (after != 1)].sum()
        return n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, new, n = [], 0, np.zeros(k_to + 1, np.int64)
        for held, whole in chunks(batches):
            if held:
                a, at, have, led = places_of(held, k_to)
                known.append((*window_codes(a, at, have), np.where(led, np.uint8(1) << a[np.maximum(at - 1, 0)], np.uint8(0))))
                new += len(at)
            if whole or new > max(HELD, len(known[0][0])):
                known, new = [united(known)], 0
            if whole:
                n += counted(*known[0])
                known = []
        on = np.flatnonzero(n)
        if len(on):
            yield pa.RecordBatch.from_arrays([pa.array(on + 1, pa.int32()), pa.array(n[on], pa.int64())], ["k", "n"])

    return dealt(seqs, letters, low, k_to, True).mapInArrow(run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n"))


def kmer_steps(seqs: DataFrame, k_from: int, k_to: int, letters: str) -> DataFrame:
    """(k, n): by how many there are more distinct k-mers than distinct (k-1)-mers, from none at k_from - 1 on.

    Windows of up to k_to letters are sorted. The prefixes that one doesn't share with the one before it are first seen there.
    """

    def sorted_(hi: list[np.ndarray], lo: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        x, y = np.concatenate(hi), np.concatenate(lo)
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        on = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
        return x[on], y[on]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hi, lo, new, n = [], [], 0, np.zeros(k_to + 2, np.int64)
        for held, whole in chunks(batches):
            if held:
                a, at, have, _ = places_of(held, k_to)
                x, y = window_codes(a, at, have)
                hi.append(x)
                lo.append(y)
                new += len(at)
            if whole or new > max(HELD, len(hi[0])):
                (x, y), new = sorted_(hi, lo), 0
                hi, lo = [x], [y]
            if whole:
                hi, lo = [], []
                size = (y & np.uint64(255)).astype(np.int64)
                shared = np.concatenate([[0], shared_letters(x, y)])
                n += np.bincount(np.maximum(shared + 1, k_from), minlength=k_to + 2) - np.bincount(size + 1, minlength=k_to + 2)
        on = np.flatnonzero(n)
        if len(on):
            yield pa.RecordBatch.from_arrays([pa.array(on, pa.int32()), pa.array(n[on], pa.int64())], ["k", "n"])

    return dealt(seqs, letters, k_from, k_to, False).mapInArrow(run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n"))


def shared_counts(seqs: DataFrame, k_from: int, k_to: int, letters: str, datasets: list[int]) -> DataFrame:
    """(k, id1, id2, n), id1 <= id2, of k-mers that occur twice or more in all: the sum of the lesser frequency in either dataset.

    Where id1 = id2 that is how often the dataset has such k-mers. A window of up to k_to letters, its length and its
    dataset's number are one number, so a window's prefixes of k letters stand together for each k. seqs(dataset_id, seq).
    """
    known = np.array(datasets, np.int64)

    def united(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        key, f = (np.concatenate(c) for c in zip(*held))
        order = np.argsort(key, kind="stable")
        key, f = key[order], f[order]
        on = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        return key[on], np.add.reduceat(f, on)

    def counted(key: np.ndarray, f: np.ndarray, n: np.ndarray) -> None:
        size, of = (key >> np.uint64(8) & np.uint64(255)).astype(np.int64), (key & np.uint64(255)).astype(np.int64)
        for k in range(k_from, k_to + 1):
            on = np.flatnonzero(size >= k)
            mer = key[on] >> np.uint64(16 + 2 * (NUMBERED - k))
            first = np.flatnonzero(np.concatenate([[True], mer[1:] != mer[:-1]])) if len(on) else on
            if not len(first):
                break
            total = np.add.reduceat(f[on], first)
            many = np.diff(np.append(first, len(on)))
            on = on[np.repeat(total > 1, many)]
            many = many[total > 1]
            group = np.repeat(np.arange(len(many)), many)
            each = np.bincount(group * len(known) + of[on], weights=f[on], minlength=len(many) * len(known)).astype(np.int64).reshape(-1, len(known))
            for i in range(len(known)):
                for j in range(i, len(known)):
                    n[k - k_from, i, j] += np.minimum(each[:, i], each[:, j]).sum()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, new, name, n = [], 0, None, np.zeros((k_to - k_from + 1, len(known), len(known)), np.int64)
        for b in batches:
            for bucket, raw, of in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if bucket != name:
                    if held:
                        counted(*united(held), n)
                    held, new, name = [], 0, bucket
                a, at, have, _ = places_of([raw], k_to)
                x = codes(a, NUMBERED)[at] >> (2 * (NUMBERED - have)).astype(np.uint64) << (2 * (NUMBERED - have)).astype(np.uint64)
                held.append((x << np.uint64(16) | have.astype(np.uint64) << np.uint64(8) | np.uint64(np.searchsorted(known, of)), np.ones(len(at), np.int64)))
                new += len(at)
                if new > max(HELD, len(held[0][0])):
                    held, new = [united(held)], 0
        if held:
            counted(*united(held), n)
        k, i, j = np.nonzero(n)
        if len(k):
            yield pa.RecordBatch.from_arrays([pa.array((k + k_from).astype(np.int32)), pa.array(known[i].astype(np.int32)), pa.array(known[j].astype(np.int32)), pa.array(n[k, i, j])], ["k", "id1", "id2", "n"])

    d = dealt(seqs, letters, k_from, k_to, False, "dataset_id").mapInArrow(run, "k int, id1 int, id2 int, n long")
    return d.groupBy("k", "id1", "id2").agg(F.sum("n").alias("n"))
