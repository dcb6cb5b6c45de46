"""Distinct k-mers, maximal unitigs, similarity of samples, compacted de Bruijn graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kmerloom.functions.lineage import cut, rank_stored, remove, stored, stored_alone
from kmerloom.functions.strings import common_prefix, mers_of_windows, occurrences, span, windows
from kmerloom.operators import packed, packed_unitigs


def kmer_list(seqs: DataFrame, k: int) -> DataFrame:
    return occurrences(seqs, k).select("mer").distinct()


def kmer_chop(seqs: DataFrame, k: int) -> DataFrame:
    return occurrences(seqs, k).select("seq_id", "pos", "mer")


def kmer_count(seqs: DataFrame, k_from: int, k_to: int, letters: str | None = None) -> DataFrame:
    """(k, count): distinct k-mers for each k of the range, at a cost that hardly grows with the number of ks.

    Where the letters are named, at most four, and k_to is 60 or less, letters move packed, two bits each. Else one k is a plain distinct count. For more, distinct windows of k_to characters are sorted, by ranges so that no prefix is one task's. The prefixes that a window
    doesn't share with the one before it are those first seen there: one interval of ks per window, added up over k.
    """
    spark = seqs.sparkSession
    if packed.fits(letters, k_to, packed.WINDOW):
        return summed_over_k(packed.kmer_steps(seqs, k_from, k_to, letters), k_from, k_to)
    if k_from == k_to:
        return kmer_list(seqs, k_from).agg(F.count("*").alias("count")).select(F.lit(k_from).alias("k"), "count")
    d = windows(seqs.select("seq").distinct(), k_from, k_to).distinct()
    d = cut(d.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "w").withColumn("part", F.spark_partition_id()))
    last = d.groupBy("part").agg(F.max("w").alias("w"))  # a row per partition
    last = last.select("part", F.lag("w").over(Window.orderBy("part")).alias("end"))
    d = d.withColumn("prev", F.lag("w").over(Window.partitionBy("part").orderBy("w"))).join(F.broadcast(last), "part")
    d = common_prefix(d.select("w", F.coalesce("prev", "end", F.lit("")).alias("prev")), "w", "prev", k_to, "shared")
    steps = F.array(F.struct(F.greatest(F.col("shared") + 1, F.lit(k_from)).alias("k"), F.lit(1).alias("n")), F.struct((F.length("w") + 1).alias("k"), F.lit(-1).alias("n")))
    steps = d.select(F.explode(steps).alias("s")).groupBy("s.k").agg(F.sum("s.n").alias("n"))
    return summed_over_k(steps, k_from, k_to)


def summed_over_k(steps: DataFrame, k_from: int, k_to: int) -> DataFrame:
    """(k, count): for each k of the range the sum of n of steps(k, n) up to it."""
    ks = steps.sparkSession.range(k_from, k_to + 1).select(F.col("id").cast("int").alias("k")).join(steps, "k", "left").na.fill(0, ["n"])
    return ks.select("k", F.sum("n").over(Window.orderBy("k")).alias("count"))


#: Letters that a 64-bit mask holds.
MASK = 62


def alphabet(seqs: DataFrame) -> list[str]:
    """The distinct letters, if there are at most MASK; else an empty list."""
    found = seqs.select(F.explode(F.array_distinct(F.split("seq", ""))).alias("c")).distinct().limit(MASK + 1).collect()
    return sorted(r["c"] for r in found if r["c"]) if len(found) <= MASK else []


def junctions(seqs: DataFrame, k_from: int, k_to: int) -> DataFrame:
    """(k, v, l, r): for each (k-1)-mer the numbers of letters before and after it, that is, of k-mers that end and begin with it.

    Letters are kept as bits, so that one aggregation, partly before the shuffle, does it; with a large alphabet as sets.
    """
    distinct = seqs.select("seq").distinct()
    letters = "".join(alphabet(seqs))
    d = distinct.select("seq", F.explode(span(F.lit(1), F.length("seq") - (k_from - 2))).alias("p"))
    if k_from == k_to:
        d = d.withColumn("k", F.lit(k_from))
    else:
        d = d.withColumn("k", F.explode(F.sequence(F.lit(k_from), F.least(F.lit(k_to), F.length("seq") - F.col("p") + 2))))
    at = lambda p: F.substring("seq", p, F.lit(1))
    before, after = F.when(F.col("p") > 1, at(F.col("p") - 1)), at(F.col("p") + F.col("k") - 1)
    d = d.select("k", F.substring("seq", F.col("p"), F.col("k") - 1).alias("v"), before.alias("before"), F.when(after != "", after).alias("after"), F.lit(letters).alias("abc"))
    if letters:
        bits = lambda c, name: F.coalesce(F.bit_count(F.bit_or(F.expr(f"shiftleft(1L, position({c}, abc))"))), F.lit(0)).cast("long").alias(name)
    else:
        bits = lambda c, name: F.size(F.collect_set(c)).cast("long").alias(name)
    return d.groupBy("k", "v").agg(bits("before", "l"), bits("after", "r")).filter("l + r > 0")


def junction_counts(seqs: DataFrame, k_from: int, k_to: int, letters: str | None) -> DataFrame:
    """(k, l, r, n): how many junctions have l letters before and r after them.

    For one k of 29 or less over at most four named letters they are counted packed.
    """
    if k_from == k_to and k_from > 1 and packed.fits(letters, k_to - 1, packed.MER):
        return packed.junction_counts(seqs, k_from, letters).select(F.lit(k_from).alias("k"), "l", "r", "n")
    return junctions(seqs, k_from, k_to).groupBy("k", "l", "r").agg(F.count("*").alias("n"))


def unitig_count(seqs: DataFrame, k_from: int, k_to: int, letters: str | None = None) -> DataFrame:
    """(k, count): k-mers that begin a maximal unitig, which are those after a (k-1)-mer that is no plain passage.

    A range of ks from 2 to 60 at most over at most four named letters is counted packed, and has a row for each k.
    """
    if 1 < k_from < k_to and packed.fits(letters, k_to, packed.WINDOW):
        n = packed.start_counts(seqs, k_from, k_to, letters)
        ks = seqs.sparkSession.range(k_from, k_to + 1).select(F.col("id").cast("int").alias("k"))
        return ks.join(n, "k", "left").select("k", F.coalesce("n", F.lit(0)).alias("count"))
    return junction_counts(seqs, k_from, k_to, letters).groupBy("k").agg(F.sum(F.when(F.expr("l <> 1 or r <> 1"), F.col("r") * F.col("n")).otherwise(0)).alias("count"))


def unitig_cases(seqs: DataFrame, k: int, letters: str | None = None) -> DataFrame:
    """(case, junctions, starts) for one k."""
    case = F.expr("case when l = 0 then 'tip' when l > 1 and r > 1 then 'crossing' when l > 1 then 'convergence' else 'divergence' end")
    d = junction_counts(seqs, k, k, letters).filter("(l <> 1 or r <> 1) and r > 0")
    return d.groupBy(case.alias("case")).agg(F.sum("n").alias("junctions"), F.sum(F.col("r") * F.col("n")).alias("starts"))


def pairs_of_datasets(seqs: DataFrame) -> DataFrame:
    """(id1, id2), id1 < id2, of the samples in seqs, of which there are few."""
    ids = sorted(r[0] for r in seqs.select("dataset_id").distinct().collect())
    return seqs.sparkSession.createDataFrame([(a, b) for a in ids for b in ids if a < b], "id1 int, id2 int")


def bray_curtis(seqs: DataFrame, k_from: int, k_to: int, letters: str | None = None) -> DataFrame:
    """(id1, id2, k, nominator, denominator, value) for each pair of datasets id1 < id2.

    K-mers that occur once over all datasets are left out. A k-mer adds to the denominator of each pair that its dataset
    is in, which needs no join; only k-mers that two datasets share add to a nominator. value is null without support.
    Over at most four named letters, and for ks of 24 or less, letters move packed.
    """
    datasets = sorted(r[0] for r in seqs.select("dataset_id").distinct().collect()) if packed.fits(letters, k_to, packed.NUMBERED) else None
    if datasets and None not in datasets and len(datasets) <= packed.DATASETS:
        n = stored(packed.shared_counts(seqs, k_from, k_to, letters, datasets))
        of = n.filter("id1 = id2").select("k", F.col("id1").alias("dataset_id"), "n")
        shared = n.filter("id1 < id2").select("k", "id1", "id2", F.col("n").alias("nominator"))
    else:
        n = windows(seqs.select("dataset_id", "seq"), k_from, k_to).groupBy("dataset_id", "w").agg(F.count("*").alias("f"))
        n = mers_of_windows(n, k_from, k_to).groupBy("k", "mer", "dataset_id").agg(F.sum("f").alias("f"))
        held = F.array_sort(F.collect_list(F.struct("dataset_id", "f")))  # at most one entry per dataset
        d = cut(n.groupBy("k", "mer").agg(held.alias("held"), F.sum("f").alias("total")).filter("total >= 2"))
        of = d.select("k", F.explode("held").alias("h")).groupBy("k", "h.dataset_id").agg(F.sum("h.f").alias("n"))
        pairs = F.expr("flatten(transform(held, (x, i) -> transform(slice(held, i + 2, size(held)), y -> struct(x.dataset_id as id1, y.dataset_id as id2, least(x.f, y.f) as m))))")
        shared = d.select("k", F.explode(pairs).alias("p")).groupBy("k", "p.id1", "p.id2").agg(F.sum("p.m").alias("nominator"))
    grid = pairs_of_datasets(seqs).withColumn("k", F.explode(F.sequence(F.lit(k_from), F.lit(k_to))))
    grid = grid.join(shared, ["k", "id1", "id2"], "left")
    for i in (1, 2):
        grid = grid.join(of.select("k", F.col("dataset_id").alias(f"id{i}"), F.col("n").alias(f"n{i}")), ["k", f"id{i}"], "left")
    out = grid.select("id1", "id2", "k", F.coalesce("nominator", F.lit(0)).alias("nominator"), (F.coalesce("n1", F.lit(0)) + F.coalesce("n2", F.lit(0))).alias("denominator"))
    return out.withColumn("value", F.when(F.col("denominator") > 0, 2.0 * F.col("nominator") / F.col("denominator")))


def chains(seqs: DataFrame, k: int) -> DataFrame:
    """(mer, head, dist, is_cycle): each distinct k-mer's unitig, by its first k-mer, and its place in it.

    Within a sequence, k-mers follow each other in one unitig as long as the (k-1)-mers between them are plain passages. So a
    k-mer first points as far back as one of its sequences goes, which mostly is its head. The others double their pointers:
    each round some that aren't on a cycle reach their head; a round that brings none leaves the cycles, which are broken at
    their smallest k-mer.
    """
    plain = junctions(seqs, k, k).filter("l = 1 and r = 1").select("v", F.lit(True).alias("plain"))
    d = occurrences(seqs.groupBy("seq").agg(F.min("seq_id").alias("seq_id")), k).select("seq_id", "pos", "mer", F.expr(f"left(mer, {k - 1})").alias("v"))
    # a run of one letter that is its own only neighbour counts as a head
    alone = F.col("mer") == F.repeat(F.substring("mer", 1, 1), k)
    d = d.join(plain, "v", "left").withColumn("linked", F.coalesce("plain", F.lit(False)) & ~alone)
    begins = F.when(~F.col("linked") | (F.col("pos") == 0), F.struct((~F.col("linked")).alias("done"), "pos", F.col("mer").alias("at")))
    w = Window.partitionBy("seq_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    d = d.select("mer", "pos", F.last(begins, ignorenulls=True).over(w).alias("b"))
    best = F.max(F.struct("b.done", (F.col("pos") - F.col("b.pos")).cast("long").alias("dist"), "b.at"))
    d = stored(d.groupBy("mer").agg(best.alias("x")).select("mer", "x.at", "x.dist", "x.done"))
    # a k-mer that only begins sequences points to the one before it, in another sequence
    only = F.expr("not done and at = mer")
    before = d.select(F.col("mer").alias("prev"), F.expr(f"right(mer, {k - 1})").alias("v"), F.expr("done and dist = 0").alias("head"))
    first = stored(d.filter(only).select("mer", F.expr(f"left(mer, {k - 1})").alias("v"))).join(before, "v")
    d = stored(d.filter(~only).union(first.select("mer", F.col("prev").alias("at"), F.lit(1).cast("long").alias("dist"), F.col("head").alias("done"))))

    def doubled(d: DataFrame) -> DataFrame:
        on = d.select(F.col("mer").alias("at"), F.col("at").alias("further"), F.col("dist").alias("more"), F.col("done").alias("then"))
        todo = d.filter("not done").join(on, "at")
        return stored(d.filter("done").union(todo.select("mer", F.col("further").alias("at"), (F.col("dist") + F.col("more")).alias("dist"), F.col("then").alias("done"))))

    left, before_it = d.filter("not done").count(), -1
    while left and left != before_it:
        last, d, before_it = d, doubled(d), left
        remove(last)
        left = d.filter("not done").count()
    lines = d.filter("done").select("mer", F.col("at").alias("head"), "dist", F.lit(False).alias("is_cycle"))
    if not left:
        return lines
    rest = d.filter("not done").select("mer")
    links = rest.select("mer", F.expr(f"left(mer, {k - 1})").alias("v")).join(rest.select(F.col("mer").alias("prev"), F.expr(f"right(mer, {k - 1})").alias("v")), "v")
    links = stored(links.select("mer", "prev"))
    rest = links.select("mer", F.col("prev").alias("at"), F.least("mer", "prev").alias("least"))
    while True:  # the smallest of twice as many places, until that changes nothing
        on = rest.select(F.col("mer").alias("at"), F.col("at").alias("further"), F.col("least").alias("smaller"))
        wider = stored(rest.join(on, "at").select("mer", F.col("further").alias("at"), F.least("least", "smaller").alias("least")))
        if not wider.select("mer", F.col("least").alias("now")).join(rest, "mer").filter("now <> least").limit(1).count():
            break
        rest = wider
    rest = rest.select("mer", "least")
    # along a cycle, count back to its smallest k-mer
    back = links.join(rest, "mer").select("mer", "least", F.when(F.col("mer") == F.col("least"), F.col("mer")).otherwise(F.col("prev")).alias("at"), F.when(F.col("mer") == F.col("least"), 0).otherwise(1).cast("long").alias("dist"))
    back = stored(back)
    while back.filter("at <> least").limit(1).count():
        on = back.select(F.col("mer").alias("at"), F.col("at").alias("to"), F.col("dist").alias("more"))
        back = stored(back.join(on, "at").select("mer", "least", F.col("to").alias("at"), (F.col("dist") + F.col("more")).alias("dist")))
    return lines.union(back.select("mer", F.col("least").alias("head"), "dist", F.lit(True)))


def unitigs(seqs: DataFrame, k: int, letters: str | None = None) -> DataFrame:
    """(head, content, is_cycle): the compacted de Bruijn graph's nodes.

    Over at most four named letters, and for k from 2 to 29, letters move packed; only sequences round a cycle go by `chains`.
    """
    if k > 1 and packed.fits(letters, k - 1, packed.MER):
        lines, cycles = packed_unitigs.unitigs(seqs, k, letters)
        d = lines.select(F.expr(f"left(content, {k})").alias("head"), "content", F.lit(False).alias("is_cycle"))
        return d if cycles is None else d.union(unitigs(cycles.distinct().withColumn("seq_id", F.monotonically_increasing_id()), k))
    d = chains(seqs, k)
    letters = F.transform(F.array_sort(F.collect_list(F.struct("dist", F.substring("mer", k, 1).alias("c")))), lambda x: x["c"])
    d = d.groupBy("head").agg(F.array_join(letters, "").alias("tail"), F.first("is_cycle").alias("is_cycle"))
    return d.select("head", F.concat(F.col("head").substr(1, k - 1), "tail").alias("content"), "is_cycle")


def with_ends(u: DataFrame, k: int, letters: str | None) -> DataFrame:
    """u with the first and the last k - 1 letters of `content` as begins and ends; as numbers where letters move packed."""
    if k > 1 and packed.fits(letters, k - 1, packed.MER):
        return packed_unitigs.ends(u, k, letters)
    return u.select("*", F.expr(f"left(content, {k - 1})").alias("begins"), F.expr(f"right(content, {k - 1})").alias("ends"))


def unitig_edges(seqs: DataFrame, k: int, letters: str | None = None) -> DataFrame:
    """(content, next_content): an edge for each unitig whose first k-mer can follow a unitig's last."""
    u = with_ends(stored_alone(unitigs(seqs, k, letters).select("content")), k, letters)
    return u.select("content", F.col("ends").alias("v")).join(u.select(F.col("content").alias("next_content"), F.col("begins").alias("v")), "v").select("content", "next_content")


def numbered_unitigs(seqs: DataFrame, k: int, letters: str | None = None) -> DataFrame:
    """(id, nexts, content, is_cycle): unitigs numbered by content, with the ids of those that can follow, in order."""
    given = stored_alone(unitigs(seqs, k, letters).select("content", "is_cycle"))
    u = rank_stored(given, "content", "id")
    of = with_ends(u.select("id", "content"), k, letters).drop("content")
    on = of.select("id", F.col("ends").alias("v")).join(of.select(F.col("id").alias("next"), F.col("begins").alias("v")), "v")
    nexts = on.groupBy("id").agg(F.array_sort(F.collect_list("next")).alias("nexts"))  # at most one per letter
    nexts = stored_alone(nexts)
    remove(given)
    return u.join(nexts, "id", "left").select("id", F.coalesce("nexts", F.array().cast("array<long>")).alias("nexts"), "content", "is_cycle")


def unitig_lines(numbered: DataFrame) -> DataFrame:
    """(id, line): each unitig as `id  nexts    content`."""
    return numbered.select("id", F.concat(F.col("id").cast("string"), F.lit("  "), F.array_join("nexts", " "), F.lit("    "), F.col("content")).alias("line"))


def unitig_invariants(seqs: DataFrame, k: int, letters: str | None = None) -> DataFrame:
    """(unitigs, edges_out, edges_in, missing_kmers, extra_kmers) of a compacted graph.

    As many edges leave (k-1)-mers at the ends of unitigs as enter those at their beginnings, and the unitigs' k-mers are
    the distinct k-mers, each once: the last two are 0.
    """
    u = stored_alone(unitigs(seqs, k, letters))
    of = with_ends(u.select("content"), k, letters).drop("content")
    ends, begins = (of.groupBy(F.col(c).alias("v")).agg(F.count("*").alias(n)) for c, n in (("ends", "n"), ("begins", "m")))
    met = ends.join(begins, "v").agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0)).alias("edges_out"))
    into = begins.join(ends, "v").agg(F.coalesce(F.sum(F.col("m") * F.col("n")), F.lit(0)).alias("edges_in"))
    if packed.fits(letters, k, packed.MER + 1):
        bad = packed_unitigs.balance(seqs, u, k, letters)
    else:
        mine = occurrences(u.select(F.col("content").alias("seq")), k).groupBy("mer").agg(F.count("*").alias("n"))
        both = kmer_list(seqs, k).withColumn("there", F.lit(1)).join(mine, "mer", "full")
        bad = both.agg(F.count_if(F.col("n").isNull()).alias("missing_kmers"), F.coalesce(F.sum(F.coalesce("n", F.lit(1)) - F.coalesce("there", F.lit(0))), F.lit(0)).alias("extra_kmers"))
    one = [d.withColumn("_", F.lit(0)) for d in (u.agg(F.count("*").alias("unitigs")), met, into, bad)]  # one row each
    return one[0].join(one[1], "_").join(one[2], "_").join(one[3], "_").drop("_")


def overlap_degrees(seqs: DataFrame, min_length: int, allow_multi_edge: bool) -> DataFrame:
    """(seq_id, degree_in, degree_out): suffixes of one sequence that are prefixes of another.

    Copies of a sequence are one class with a number of members, so that many copies don't make pairs of copies. With
    multi-edges each length counts, else each ordered pair. A sequence overlaps itself at less than its length.
    """
    classes = seqs.groupBy("seq").agg(F.count("*").alias("m"), F.min("seq_id").alias("c")).filter(F.length("seq") >= min_length)
    d = classes.select("c", "m", "seq", F.explode(F.sequence(F.lit(min_length), F.length("seq"))).alias("n"))
    head = d.select("c", "m", (F.col("n") == F.length("seq")).alias("whole"), F.expr("left(seq, n)").alias("t"))
    tail = d.select("c", "m", (F.col("n") == F.length("seq")).alias("whole"), F.expr("right(seq, n)").alias("t"))
    if allow_multi_edge:
        def degree(one: DataFrame, other: DataFrame) -> DataFrame:
            n = other.groupBy("t").agg(F.sum("m").alias("n"))
            return one.join(n, "t").groupBy("c").agg((F.sum("n") - 1).alias("degree"))  # less itself at full length

        out, into = degree(tail, head), degree(head, tail)
    else:
        pairs = tail.select(F.col("c").alias("i"), F.col("m").alias("mi"), F.col("whole").alias("wi"), "t").join(head.select(F.col("c").alias("j"), F.col("m").alias("mj"), "t"), "t")
        pairs = pairs.groupBy("i", "j", "mi", "mj").agg(F.max((~F.col("wi")).cast("int")).alias("border"))
        # among copies: all other members at full length, itself if some shorter suffix is a prefix
        n = lambda m: F.when(F.col("i") == F.col("j"), F.col(m) - 1 + F.col("border")).otherwise(F.col(m))
        out = pairs.groupBy(F.col("i").alias("c")).agg(F.sum(n("mj")).alias("degree"))
        into = pairs.groupBy(F.col("j").alias("c")).agg(F.sum(n("mi")).alias("degree"))
    of = classes.select("seq", "c").join(into.withColumnRenamed("degree", "degree_in"), "c", "left").join(out.withColumnRenamed("degree", "degree_out"), "c", "left")
    return seqs.join(of, "seq", "left").select("seq_id", F.coalesce("degree_in", F.lit(0)).alias("degree_in"), F.coalesce("degree_out", F.lit(0)).alias("degree_out"))
