"""Maximal repeats of a set of sequences, found level by level without listing substrings.

A repeat is maximal if its occurrences don't all have the same letter before them, nor all the same letter after them;
each sequence's begin and end is a context of its own. Level 0 groups places by a hash of their first kmin letters and
looks at the first 2 kmin letters; each further level doubles that. Within a group places are sorted by the letters of the
level; the longest common prefixes of neighbours make a tree of intervals, one for each text that is followed by different
letters. Places that agree in all letters of a level go on to the next, unless the same letter precedes them all: then no
longer repeat that begins there is maximal. So a place is read as far as a maximal repeat can reach, and no further.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.functions.lineage import global_rank, remove, stored
from kmerloom.functions.strings import occurrences
from kmerloom.operators import packed_repeats

STRATUM, PLACE, GOES_ON = 0, 1, 2
FIELDS = ("what", "of_seq", "of_pos", "size", "seq_id", "pos", "freq", "left_cnt", "right_cnt", "home_seq", "home_pos")


def common(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:  # a[:low] agrees, a[:high] doesn't
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def intervals(texts: list[str]) -> Iterator[tuple[int, int, int]]:
    """(depth, begin, end) of sorted texts: texts[begin:end], two or more, share depth letters and no more; inner ones first."""
    held: list[tuple[int, int]] = []
    for i in range(1, len(texts) + 1):
        h, begin = common(texts[i - 1], texts[i]) if i < len(texts) else -1, i - 1
        while held and held[-1][0] > h:
            depth, begin = held.pop()
            yield depth, begin, i
        if h >= 0 and (not held or held[-1][0] < h):
            held.append((h, begin))


def mixed(place: tuple[int, int]) -> int:
    return ((place[0] * 0x9E3779B97F4A7C15 + place[1]) * 0xD6E8FEB86659FD93 >> 17) & 0xFFFFFFFF


def of_group(texts: list[str], left: list[str | None], places: list[tuple[int, int]], base: int, full: int, kmin: int) -> Iterator[tuple]:
    """Rows (FIELDS) of one group of places, sorted by their texts, `full` letters from `base` on.

    A stratum is named by its first place and its size. Its home is a place drawn by hash, so that strata of one frequent
    sequence don't all have their home there.
    """
    for depth, begin, end in intervals(texts):
        before = left[begin:end]
        # a sequence's begin is a context of its own
        if base + depth < kmin or (None not in before and len(set(before)) < 2):
            continue
        held = places[begin:end]
        first = min(held)
        if depth == full:
            yield from ((GOES_ON, *first, base + depth, *p, 0, 0, 0, 0, 0) for p in held)
            continue
        after = {t[depth] for t in texts[begin:end] if len(t) > depth}
        letters = set(before) - {None}
        yield (STRATUM, *first, base + depth, 0, 0, end - begin, len(letters), len(after), *min(held, key=lambda p: (mixed(p), p)))
        yield from ((PLACE, *first, base + depth, *p, 0, 0, 0, 0, 0) for p in held)


def level(members: DataFrame, seqs: DataFrame, base: int, full: int, kmin: int) -> DataFrame:
    """Rows (FIELDS) of the groups of members(of_seq, of_pos, seq_id, pos), looked at from letter base on."""
    n = int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, texts, left, places, out = None, [], [], [], []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], list(FIELDS))

        for b in batches:
            for g, p, s, i, c, t in zip(*(b.column(k).to_pylist() for k in ("of_seq", "of_pos", "seq_id", "pos", "left", "text"))):
                if (g, p) != name:
                    out += of_group(texts, left, places, base, full, kmin)
                    name, texts, left, places = (g, p), [], [], []
                    if len(out) > 1 << 14:
                        yield batch()
                        out = []
                texts.append(t)
                left.append(c)
                places.append((s, i))
        out += of_group(texts, left, places, base, full, kmin)
        if out:
            yield batch()

    before = F.when(F.col("pos") > 0, F.substring("seq", F.col("pos"), F.lit(1))).alias("left")
    d = members.join(seqs.select("seq_id", "seq"), "seq_id").select("of_seq", "of_pos", "seq_id", "pos", before, F.substring("seq", F.col("pos") + 1 + base, F.lit(full)).alias("text"))
    d = d.repartition(n, "of_seq", "of_pos").sortWithinPartitions("of_seq", "of_pos", "text", "seq_id", "pos")
    return d.mapInArrow(run, ", ".join(f"{c} long" for c in FIELDS))


def seeds(seqs: DataFrame, kmin: int) -> DataFrame:
    """(of_seq, of_pos, seq_id, pos): places whose first kmin letters occur after different letters; of_seq is their hash.

    Places with other letters but an equal hash may be in a group; the next step tells them apart.
    """
    d = occurrences(seqs.select("seq_id", "seq"), kmin).select("seq_id", F.col("pos").cast("long").alias("pos"), F.xxhash64("mer").alias("of_seq"), F.coalesce(F.ascii("left").cast("long"), -1 - F.col("seq_id")).alias("l"))
    g = d.groupBy("of_seq").agg(F.min("l").alias("l1"), F.max("l").alias("l2")).filter("l1 <> l2").select("of_seq")
    return d.join(g, "of_seq", "left_semi").select("of_seq", F.lit(0).cast("long").alias("of_pos"), "seq_id", "pos")


def maximal_repeats(seqs: DataFrame, kmin: int, letters: str | None = None, longest: int | None = None) -> tuple[DataFrame, DataFrame]:
    """strata(id, size, freq, left_cnt, right_cnt, sample_seq_id, sample_pos, home_seq_id, home_pos) and occ(id, seq_id, pos, size).

    seqs(seq_id, seq) has unique, non-null ids; null sequences have no places. left_cnt and right_cnt are the numbers of
    letters before and after; ids count up by size and first place. What a task holds is one group's places and their
    letters of one level. Where at most four letters and a length of 255 or less are named, letters move packed, in one level.
    """
    seqs = seqs.select(F.col("seq_id").cast("long").alias("seq_id"), "seq")
    packed = packed_repeats.fits(letters, longest, kmin)
    found = [stored(packed_repeats.repeat_rows(seqs, kmin, letters))] if packed else []
    members, base, full = None if packed else seeds(seqs, kmin), 0, 2 * kmin
    while not packed:
        rows = stored(level(members, seqs, base, full, kmin))
        found.append(rows)
        members = rows.filter(F.col("what") == GOES_ON).select("of_seq", "of_pos", "seq_id", "pos")
        if not members.limit(1).count():
            break
        base, full = base + full, base + full
    rows = found[0]
    for r in found[1:]:
        rows = rows.union(r)
    strata = rows.filter(F.col("what") == STRATUM)
    number = lambda c, name: F.col(c).cast("int").alias(name)
    strata = strata.select(number("size", "size"), "freq", number("left_cnt", "left_cnt"), number("right_cnt", "right_cnt"), F.col("of_seq").alias("sample_seq_id"), number("of_pos", "sample_pos"), F.col("home_seq").alias("home_seq_id"), number("home_pos", "home_pos"))
    strata = stored(global_rank(strata, ["size", "sample_seq_id", "sample_pos"], "id"))
    names = strata.select("id", "size", F.col("sample_seq_id").alias("of_seq"), F.col("sample_pos").alias("of_pos"))
    occ = stored(rows.filter(F.col("what") == PLACE).select("of_seq", "of_pos", "size", "seq_id", F.col("pos").cast("int").alias("pos")).join(names, ["of_seq", "of_pos", "size"]).select("id", "seq_id", "pos", F.col("size").cast("int").alias("size")))
    remove(*found)
    return strata, occ
