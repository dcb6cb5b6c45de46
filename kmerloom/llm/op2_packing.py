"""Best-fit packing of documents into sequences by a grouping genetic algorithm on islands.

Tokens are counted once, in one pass over the texts; what follows moves a few numbers per piece. Pieces that fill a
sequence are done. The others are dealt by hash into blocks of a few hundred to a few thousand. A block that best fit alone
packs into as few sequences as its tokens need is done, too. Every other block evolves on several islands: crossover injects
whole well-filled sequences of one packing into another, takes out what is there twice and best-fits what that displaces;
islands hand their best packing to the next one and evolve again, and the best packing of a block stays. Pieces of poorly
filled sequences of all blocks are dealt and packed once more.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kmerloom.llm.common import coded, cut, partitions, pieces_of, split_words, stretches, table, text_batches, tidied

#: Distinct words whose ids a worker remembers; bytes of text that it takes at once, which take it over ten times as much.
REMEMBER, AT_ONCE = 100_000, 2 << 20
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
SIMPLE = "^[A-Za-zÀ-ÖØ-öø-ÿ]+[" + "".join("\\" + c for c in PUNCTUATION) + "]*$"
NOT_PUNCTUATION = "^[^" + "".join("\\" + c for c in PUNCTUATION) + "]+"


def strings(a: pa.Array) -> list[str]:
    return a.to_numpy(zero_copy_only=False).tolist()


def spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places begin[i] .. begin[i] + size[i] - 1 of all i, one after the other."""
    ends = np.cumsum(size, dtype=np.int64)
    many = int(ends[-1]) if len(ends) else 0
    out = np.repeat((begin - (ends - size)).astype(np.int32 if many < 1 << 30 else np.int64), size)
    out += np.arange(many, dtype=out.dtype)
    return out


class Ids:
    """Token ids of texts, word by word.

    The tokenizer drops white space and no token spans it, so the ids of a text are those of its words in order. A word of
    plain letters with punctuation behind it is two tokens' worth of model input at most, which the model gets without the
    normaliser; any other word takes the whole tokenizer. The ids of words seen before are kept.
    """

    def __init__(self, path: str) -> None:
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        self.letters = {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in shown)}
        self.simple: dict[str, bytes] = {"": b""}
        self.other: dict[str, bytes] = {}

    def of_simple(self, word: str) -> bytes:
        if (got := self.simple.get(word)) is None:
            given = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
            got = self.simple[word] = array("I", [t.id for t in self.model.tokenize(given)]).tobytes()
        return got

    def of_other(self, word: str) -> bytes:
        if (got := self.other.get(word)) is None:
            got = self.other[word] = np.array(self.whole.encode(word, add_special_tokens=False).ids, np.uint32).tobytes()
        return got

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text followed by id 0, and where each text begins."""
        for kept in (self.simple, self.other):
            if len(kept) > REMEMBER:
                kept.clear()
        self.simple[""] = b""
        words, starts = split_words(texts)
        codes, distinct = coded(words)
        low = pc.utf8_lower(distinct)
        plain = pc.match_substring_regex(distinct, SIMPLE).to_numpy(zero_copy_only=False) if len(low) else np.zeros(0, bool)
        cores = pc.if_else(pa.array(plain, pa.bool_()), pc.utf8_rtrim(low, characters=PUNCTUATION), pa.scalar("", low.type))
        core, core_of = coded(cores)
        tails = pc.if_else(pa.array(plain, pa.bool_()), pc.replace_substring_regex(low, NOT_PUNCTUATION, ""), pa.scalar("", low.type))
        tail, tail_of = coded(tails)
        odd = np.flatnonzero(~plain)
        parts = [*map(self.of_simple, strings(core_of)), *map(self.of_simple, strings(tail_of)), *map(self.of_other, strings(distinct.take(pa.array(odd))))]
        first, second = core, tail + len(core_of)
        first[odd] = len(core_of) + len(tail_of) + np.arange(len(odd))
        # a word has up to two parts; the id 0 behind each text is one more word
        held = np.frombuffer(b"".join(parts) + bytes(4), np.uint32)
        size = np.fromiter(map(len, parts), np.int32, len(parts)) // 4
        at = np.cumsum(size, dtype=np.int32) - size
        pair = np.stack([first, second], 1).ravel()
        flat = np.append(held[spans(at[pair], size[pair])], np.uint32(0))
        length = np.append(size[first] + size[second], np.int32(1))
        codes = np.insert(codes.astype(np.int32), starts[1:], len(length) - 1)
        begin = np.cumsum(length, dtype=np.int32) - length
        sizes = length[codes]
        ends = np.cumsum(sizes, dtype=np.int64)
        return flat[spans(begin[codes], sizes)], np.concatenate([[0], ends[starts[1:] + np.arange(len(starts) - 1)]])

    def of_long(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The same for one text, in stretches of about a megabyte, so that little more than its ids is held."""
        parts = [self(pa.array([x.decode()], pa.large_string()))[0][:-1] for x in stretches((text or "").encode())]
        ids = np.concatenate([*parts, np.zeros(1, np.uint32)])
        return ids, np.array([0, len(ids)])


_READY: dict[str, Ids] = {}


def pieces_of_texts(batches: Iterator[pa.RecordBatch], path: str, capacity: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, piece, start, length, ids_crc32) of (doc_id, text), a stretch of texts of about AT_ONCE bytes after the other."""
    if path not in _READY:
        _READY[path] = Ids(path)
    for b in pieces_of(batches, AT_ONCE):
        ids, at = _READY[path](b.column(1)) if b.num_rows > 1 else _READY[path].of_long(b.column(1)[0].as_py())
        total = np.diff(at)
        many = -(-total // capacity)
        row = np.repeat(np.arange(b.num_rows), many)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        start = piece * capacity
        length = np.minimum(capacity, total[row] - start)
        data = ids.astype("<u4").tobytes()
        crc = [zlib.crc32(data[4 * a : 4 * z]) for a, z in zip((at[row] + start).tolist(), (at[row] + start + length).tolist())]
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])


def tokenized_pieces(docs: DataFrame, path: str, capacity: int) -> DataFrame:
    """(uid, doc_id, piece, start, length, ids_crc32) of the pieces of each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return pieces_of_texts(batches, path, capacity)

    found = text_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidied(run), "doc_id long, piece int, start long, length long, ids_crc32 long")
    return found.select(F.monotonically_increasing_id().alias("uid"), "*")


class Packing:
    """Items in bins: the bin of each item and the fill of each bin."""

    def __init__(self, bin_of: np.ndarray, sizes: np.ndarray) -> None:
        self.bin_of = bin_of
        self.fill = np.bincount(bin_of, weights=sizes).astype(np.int64) if len(bin_of) else np.zeros(0, np.int64)

    def fitness(self, capacity: int) -> tuple[int, float]:
        return -len(self.fill), float(((self.fill / capacity) ** 2).sum())


def best_fit(order: np.ndarray, sizes: np.ndarray, capacity: int, bin_of: np.ndarray, fill: list[int]) -> None:
    """Put the items, in this order, each into the fullest bin that has room, or a new one. Changes bin_of and fill."""
    room = sorted((capacity - f, i) for i, f in enumerate(fill) if f < capacity)
    for item, size in zip(order.tolist(), sizes[order].tolist()):
        at = bisect_left(room, (size, -1))
        if at < len(room):
            left, i = room.pop(at)
        else:
            left, i = capacity, len(fill)
            fill.append(0)
        bin_of[item] = i
        fill[i] += size
        if left > size:
            insort(room, (left - size, i))


def fresh(sizes: np.ndarray, capacity: int, draw: np.random.Generator, noise: float) -> Packing:
    order = np.argsort(-sizes * draw.uniform(1 - noise, 1, len(sizes)), kind="stable")
    bin_of: np.ndarray = np.empty(len(sizes), np.int64)
    best_fit(order, sizes, capacity, bin_of, [])
    return Packing(bin_of, sizes)


def crossover(a: Packing, b: Packing, sizes: np.ndarray, capacity: int, draw: np.random.Generator) -> Packing:
    """Inject whole well-filled bins of b into a.

    Bins of a that hold an injected item go; what else they held is displaced and put back by best fit, largest first.
    """
    good = np.flatnonzero(b.fill >= np.quantile(b.fill, 0.5))
    taken = draw.choice(good, max(1, len(good) // 3), replace=False)
    injected = np.isin(b.bin_of, taken)
    gone = np.zeros(len(a.fill), bool)
    gone[a.bin_of[injected]] = True
    displaced = np.flatnonzero(gone[a.bin_of] & ~injected)
    stays = ~gone[a.bin_of] & ~injected
    number = np.cumsum(~gone) - 1
    bin_of = np.empty(len(sizes), np.int64)
    bin_of[stays] = number[a.bin_of[stays]]
    again = np.zeros(len(b.fill), np.int64)
    again[taken] = int((~gone).sum()) + np.arange(len(taken))
    bin_of[injected] = again[b.bin_of[injected]]
    fill = [*a.fill[~gone].tolist(), *b.fill[taken].tolist()]
    best_fit(displaced[np.argsort(-sizes[displaced], kind="stable")], sizes, capacity, bin_of, fill)
    return Packing(bin_of, sizes)


def least_bins(sizes: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins: the items' sum, or the items of which no two fit together."""
    return max(-(-int(sizes.sum()) // capacity), int((2 * sizes > capacity).sum()))


def evolve(sizes: np.ndarray, capacity: int, seed: int, elites: list[np.ndarray], population: int = 8, generations: int = 60) -> np.ndarray:
    """The best bin of each item that an island finds. Ends early when no packing can have fewer bins.

    The population is the elites and packings by best fit in noisy orders. A child replaces the worst if it is better: fewer
    bins, or as many that are more unevenly filled, which leaves room to empty one.
    """
    least = least_bins(sizes, capacity)
    draw = np.random.default_rng(seed)
    people = [Packing(e, sizes) for e in elites]
    while len(people) < population:
        people.append(fresh(sizes, capacity, draw, draw.uniform(0.02, 0.3)))
    for _ in range(generations):
        people.sort(key=lambda p: p.fitness(capacity), reverse=True)
        if len(people[0].fill) <= least:
            break
        i, j = draw.choice(len(people), 2, replace=False)
        child = crossover(people[i], people[j], sizes, capacity, draw)
        if child.fitness(capacity) > people[-1].fitness(capacity):
            people[-1] = child
    return max(people, key=lambda p: p.fitness(capacity)).bin_of


def pack_blocks(items: DataFrame, capacity: int, block: int, islands: int, epochs: int) -> DataFrame:
    """(uid, sequence_id, offset, fill) for items(uid, length); sequence_id is the smallest uid in it."""
    n = items.count()
    blocks, parts = max(1, -(-n // block)), partitions(items)
    state = items.groupBy(F.pmod(F.xxhash64("uid"), F.lit(blocks)).alias("block")).agg(F.sort_array(F.collect_list(F.struct("uid", "length"))).alias("items"))
    shape = "block long, items array<struct<uid:long,length:long>>, island int, bins int, best array<int>"

    def sizes_of(held) -> np.ndarray:
        return np.array([x["length"] for x in held.as_py()], np.int64)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Best fit alone; island -1 says that no packing has fewer sequences."""
        for b in batches:
            for i in range(b.num_rows):
                sizes = sizes_of(b.column("items")[i])
                best = fresh(sizes, capacity, np.random.default_rng(0), 0.0).bin_of
                bins = int(best.max()) + 1
                done = bins <= least_bins(sizes, capacity)
                yield pa.RecordBatch.from_arrays([*b.slice(i, 1).select(["block", "items"]).columns, pa.array([-1 if done else 0], pa.int32()), pa.array([bins], pa.int32()), pa.array([best.tolist()], pa.list_(pa.int32()))], ["block", "items", "island", "bins", "best"])

    def epoch(number: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    row = b.slice(i, 1)
                    sizes = sizes_of(row.column("items")[0])
                    island, key = row.column("island")[0].as_py(), row.column("block")[0].as_py()
                    held = [np.array(e, np.int64) for e in row.column("elites")[0].as_py()]
                    # its own best of the epoch before, and the one that migrates from the island before it in the ring
                    elites = [held[island % len(held)], held[island - 1]] if len(held) > 1 else held
                    best = evolve(sizes, capacity, (key * 31 + island) * 7 + number, elites)
                    yield pa.RecordBatch.from_arrays([row.column("block"), row.column("items"), row.column("island"), pa.array([int(best.max()) + 1], pa.int32()), pa.array([best.tolist()], pa.list_(pa.int32()))], ["block", "items", "island", "bins", "best"])

        return run

    packed = cut(state.repartition(parts, "block").mapInArrow(tidied(first), shape))
    state = packed.filter("island = 0").select("block", "items", F.array("best").alias("elites"), "best")
    for number in range(epochs):
        spread = state.withColumn("island", F.explode(F.array(*(F.lit(i) for i in range(islands))))).repartition(parts, "block", "island")
        lived = cut(spread.select("block", "items", "elites", "island").mapInArrow(tidied(epoch(number)), shape))
        state = lived.groupBy("block").agg(F.first("items").alias("items"), F.transform(F.sort_array(F.collect_list(F.struct("island", "best"))), lambda x: x["best"]).alias("elites"), F.min_by("best", F.struct("bins", "island")).alias("best"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for held, best in zip(b.column("items"), b.column("best")):
                held, best = held.as_py(), np.array(best.as_py(), np.int64)
                uid, size = (np.array([x[k] for x in held], np.int64) for k in ("uid", "length"))
                order = np.lexsort((uid, best))
                uid, size, best = uid[order], size[order], best[order]
                first = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]]))
                many = np.diff(np.append(first, len(best)))
                before = np.cumsum(size) - size
                yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array(np.repeat(uid[first], many)), pa.array(before - np.repeat(before[first], many)), pa.array(np.repeat(np.add.reduceat(size, first), many))], ["uid", "sequence_id", "offset", "fill"])

    whole = packed.filter("island = -1").select("items", "best").union(state.select("items", "best"))
    return cut(whole.mapInArrow(tidied(place), "uid long, sequence_id long, offset long, fill long"))


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = 2048, block: int = 1500, islands: int = 3, epochs: int = 2) -> DataFrame:
    """Pack docs(doc_id, text) into sequences of at most `capacity` tokens.

    Returns (doc_id, piece, start, length, ids_crc32, sequence_id, offset). A document is its ids followed by id 0; only
    documents over the capacity are cut. A null or empty text is the id 0 alone. Rows with a null or repeated doc_id are
    packed like any other. An empty table gives no rows. Other columns are not read. What a task holds is bounded by the
    block, whatever the table's size; equal texts go to different blocks.
    """
    pieces = cut(tokenized_pieces(docs, path or public_tokenizers.path("word_bpe_49k.json"), capacity))
    small = pieces.filter(F.col("length") < capacity).select("uid", "length")
    once = pack_blocks(small, capacity, block, islands, epochs)
    poor = F.col("fill") < capacity * 9 // 10
    again = pack_blocks(once.filter(poor).join(small, "uid").select("uid", "length"), capacity, block, islands, epochs)
    placed = once.filter(~poor).union(again).drop("fill")
    return pieces.join(placed, "uid", "left").select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("sequence_id", "uid").alias("sequence_id"), F.coalesce("offset", F.lit(0)).alias("offset"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
