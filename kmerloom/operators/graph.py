"""The graph of maximal repeats (strata) of a set of sequences, as tables, and what is read off it.

vertices: sequences and strata, by kind and a number (a sequence's id, a stratum's id). An edge is an occurrence, within a
vertex, of a stratum that lies in no longer stratum's occurrence there. Sizes only get smaller along edges. Whatever is asked
for a range of ks is a sum of ramps or steps over k, so its cost doesn't grow with the number of ks.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kmerloom.functions.lineage import stored, stored_alone
from kmerloom.operators import packed_repeats
from kmerloom.operators.kmers import pairs_of_datasets
from kmerloom.operators.repeats import maximal_repeats

EDGE = ("kind", "vertex", "ord", "pos", "to", "id")
#: Letters of a stretch of a sequence; a stratum meets the repeats within it by the stretches that it spans.
STRETCH = 256


def outermost(d: DataFrame, vertex: str) -> DataFrame:
    """Of intervals (vertex, pos, to, id): the longest at each place, unless an earlier one reaches as far."""
    longest = d.groupBy(vertex, "pos").agg(F.max(F.struct("to", "id")).alias("x")).select(vertex, "pos", "x.to", "x.id")
    w = Window.partitionBy(vertex).orderBy("pos")
    reach = F.max("to").over(w.rowsBetween(Window.unboundedPreceding, -1))
    kept = longest.withColumn("reach", reach).filter("reach is null or to > reach").drop("reach")
    return kept.withColumn("ord", F.row_number().over(w) - 1)


def need_k(k: int, least: int) -> None:
    if k < least:
        raise ValueError(f"k is {k}, this graph answers for {least} or more")


class Graph:
    """The tables of the graph of seqs(seq_id, seq [, dataset_id]) at kmin. seq_id is unique.

    letters and longest, if given, say what letters and how many of them a sequence has; see `maximal_repeats`. Where letters
    are packed, no place of a stratum is stored (see `packed_repeats.Strata`), and strata are numbered in no order; if
    datasets, their frequencies in datasets are counted along.

    strata(id, size, freq, left_cnt, right_cnt, sample_seq_id, sample_pos, home_seq_id, home_pos), occ(id, seq_id, pos, size),
    edges(kind, vertex, ord, pos, to, id).
    """

    def __init__(self, seqs: DataFrame, kmin: int, letters: str | None = None, longest: int | None = None, datasets: bool = False) -> None:
        if kmin < 1:
            raise ValueError("kmin is 1 or more")
        self.kmin, self.seqs = kmin, stored(seqs.withColumn("seq_id", F.col("seq_id").cast("long")))
        self.letters = letters if packed_repeats.fits(letters, longest, kmin) else None
        if self.letters is None:
            self.strata, self.occ = maximal_repeats(self.seqs, kmin, letters, longest)
            return
        place = [F.col(c).alias(f"{of}_{c}") for of in ("sample", "home") for c in ("seq_id", "pos")]
        self.datasets = datasets and packed_repeats.fits_datasets(self.seqs)
        self.rows = packed_repeats.graph_rows(self.seqs, kmin, letters, self.datasets)
        self.strata = self.rows.filter(F.col("what") == packed_repeats.STRATUM).select("size", "freq", "left_cnt", "right_cnt", *place, "id")

    @cached_property
    def occ(self) -> DataFrame:
        """Found when first asked for, where letters are packed: edges don't need them."""
        names = self.strata.select("id", "size", F.col("sample_seq_id").alias("of_seq"), F.col("sample_pos").alias("of_pos"))
        places = packed_repeats.repeat_rows(self.seqs, self.kmin, self.letters).filter(F.col("what") == packed_repeats.PLACE)
        return stored(places.join(names, ["of_seq", "of_pos", "size"]).select("id", "seq_id", F.col("pos").cast("int").alias("pos"), F.col("size").cast("int").alias("size")))

    @cached_property
    def placed(self) -> DataFrame | None:
        """The edges with shared, seq_id, at and whole, where letters are packed; see `packed_repeats.edge_rows`."""
        return None if self.letters is None else stored_alone(packed_repeats.edge_rows(self.rows))

    @cached_property
    def edges(self) -> DataFrame:
        """Found when first asked for: strata and their frequencies don't need them."""
        if self.placed is not None:
            return self.placed.select(*EDGE)
        s = self._seq_edges().select(F.lit("sequence").alias("kind"), F.col("seq_id").alias("vertex"), "ord", "pos", "to", "id")
        return stored(s.union(self._stratum_edges().select(F.lit("stratum"), "parent", "ord", "pos", "to", "id")))

    @classmethod
    def of_tables(cls, seqs: DataFrame, kmin: int, strata: DataFrame, edges: DataFrame) -> Graph:
        """A graph without the occurrences of its strata, which only frequencies per dataset need."""
        g = object.__new__(cls)
        g.kmin, g.seqs, g.strata, g.edges, g.occ, g.letters = kmin, seqs, strata, edges.select(*EDGE), None, None
        g.placed = edges if "shared" in edges.columns else None
        return g

    def _seq_edges(self) -> DataFrame:
        return outermost(self.occ.select("seq_id", F.col("pos").cast("int").alias("pos"), (F.col("pos") + F.col("size")).cast("int").alias("to"), "id"), "seq_id")

    def _stratum_edges(self) -> DataFrame:
        """(parent, ord, pos, to, id): found once, at each stratum's home."""
        p = self.strata.select(F.col("id").alias("parent"), F.col("home_seq_id").alias("seq_id"), F.col("home_pos").alias("begin"), F.col("size").alias("whole"))
        first, last = F.floor(F.col("begin") / STRETCH), F.floor((F.col("begin") + F.col("whole") - self.kmin) / STRETCH)
        p = p.withColumn("stretch", F.explode(F.sequence(first, F.greatest(first, last))))
        inner = self.occ.withColumn("stretch", F.floor(F.col("pos") / STRETCH)).join(p, ["seq_id", "stretch"])
        inner = inner.filter("pos >= begin and pos + size <= begin + whole and size < whole")
        at = F.col("pos") - F.col("begin")
        return outermost(inner.select("parent", at.cast("int").alias("pos"), (at + F.col("size")).cast("int").alias("to"), "id"), "parent")

    def seq_edges(self) -> DataFrame:
        """(seq_id, ord, pos, to, id)"""
        return self.edges.filter("kind = 'sequence'").select(F.col("vertex").alias("seq_id"), "ord", "pos", "to", "id")

    def stratum_edges(self) -> DataFrame:
        """(parent, ord, pos, to, id)"""
        return self.edges.filter("kind = 'stratum'").select(F.col("vertex").alias("parent"), "ord", "pos", "to", "id")

    def texts(self) -> DataFrame:
        """(id, text) of the strata."""
        d = self.strata.select("id", "size", F.col("sample_seq_id").alias("seq_id"), "sample_pos").join(self.seqs.select("seq_id", "seq"), "seq_id")
        return d.select("id", F.substring("seq", (F.col("sample_pos") + 1).cast("int"), F.col("size").cast("int")).alias("text"))

    def named(self, d: DataFrame) -> DataFrame:
        """d with the strata's texts in place of numbers: `text` for id, and for the vertex, if d has a kind and a vertex.

        A sequence's vertex is its id as a string.
        """
        t = stored(self.texts())
        if "id" in d.columns:
            d = d.join(t, "id").drop("id")
        if "vertex" in d.columns:
            v = t.select(F.lit("stratum").alias("kind"), F.col("id").alias("vertex"), F.col("text").alias("_name"))
            d = d.join(v, ["kind", "vertex"], "left").withColumn("vertex", F.coalesce("_name", F.col("vertex").cast("string"))).drop("_name")
        return d

    def named_edges(self) -> DataFrame:
        """The edges with texts in place of numbers, as `named` gives them; where letters are packed, cut from their sequences."""
        if self.placed is None:
            return self.named(self.edges)
        d = self.placed.join(self.seqs.select("seq_id", "seq"), "seq_id")
        vertex = F.when(F.col("kind") == "stratum", F.substring("seq", F.col("at") - F.col("pos") + 1, F.col("whole"))).otherwise(F.col("vertex").cast("string"))
        return d.select("kind", vertex.alias("vertex"), "ord", "pos", "to", F.substring("seq", F.col("at") + 1, F.col("to") - F.col("pos")).alias("text"))

    def vertices(self) -> DataFrame:
        """(kind, vertex, size, freq, left_cnt, right_cnt)"""
        none = F.lit(None).cast("int")
        s = self.seqs.select(F.lit("sequence").alias("kind"), F.col("seq_id").cast("long").alias("vertex"), F.length("seq").alias("size"), F.lit(1).cast("long").alias("freq"), none.alias("left_cnt"), none.alias("right_cnt"))
        return s.union(self.strata.select(F.lit("stratum"), "id", F.col("size").cast("int"), "freq", F.col("left_cnt").cast("int"), F.col("right_cnt").cast("int")))

    def sequence(self, seq_id: int, k: int = 0) -> DataFrame:
        """(ord, pos, to, id) of one sequence's edges, of those of k letters or more."""
        return self.seq_edges().filter((F.col("seq_id") == seq_id) & (F.col("to") - F.col("pos") >= k)).drop("seq_id")

    def stratum(self, stratum_id: int, k: int = 0) -> DataFrame:
        """(ord, pos, to, id) of one stratum's edges, of those of k letters or more."""
        return self.stratum_edges().filter((F.col("parent") == stratum_id) & (F.col("to") - F.col("pos") >= k)).drop("parent")

    def valid_indices(self, k: int) -> DataFrame:
        """(kind, vertex, ord): the edges of k letters or more."""
        return self.edges.filter(F.col("to") - F.col("pos") >= k).select("kind", "vertex", "ord")

    def neighbours(self, k: int) -> DataFrame:
        """(kind, vertex, first, last): the ords of a vertex's first and last edges of k or more; null without any."""
        e = self.valid_indices(k).groupBy("kind", "vertex").agg(F.min("ord").alias("first"), F.max("ord").alias("last"))
        return self.vertices().select("kind", "vertex").join(e, ["kind", "vertex"], "left")

    def next_edges(self, k: int) -> DataFrame:
        """(kind, vertex, ord, next, prev): the ords of the nearest edges of k or more after and before each edge."""
        w = Window.partitionBy("kind", "vertex").orderBy("ord")
        at = F.when(F.col("to") - F.col("pos") >= k, F.col("ord"))
        after, before = w.rowsBetween(1, Window.unboundedFollowing), w.rowsBetween(Window.unboundedPreceding, -1)
        return self.edges.select("kind", "vertex", "ord", F.min(at).over(after).alias("next"), F.max(at).over(before).alias("prev"))

    def parents(self) -> DataFrame:
        """(id, kind, vertex, pos): where each stratum is an edge."""
        return self.edges.select("id", "kind", "vertex", "pos")

    def incoming_degree(self) -> DataFrame:
        return self.edges.groupBy("id").agg(F.count("*").alias("degree"))

    def overlaps(self) -> DataFrame:
        """(kind, vertex, ord, overlap) with the edge before."""
        w = Window.partitionBy("kind", "vertex").orderBy("ord")
        return self.edges.select("kind", "vertex", "ord", F.coalesce(F.greatest(F.lag("to").over(w) - F.col("pos"), F.lit(0)), F.lit(0)).alias("overlap"))

    def spectrum(self, k: int) -> DataFrame:
        """(kind, vertex, from, to, is_stratified): edges of k or more, and between them what holds the other k-mers."""
        e = self.edges.filter(F.col("to") - F.col("pos") >= k)
        v = self.vertices().filter(F.col("size") >= k).select("kind", "vertex", "size")
        edges = F.array_sort(F.collect_list(F.struct("pos", "to")))  # the edges of one vertex, as it stores them
        d = v.join(e.groupBy("kind", "vertex").agg(edges.alias("e")), ["kind", "vertex"], "left").withColumn("e", F.coalesce("e", F.array().cast("array<struct<pos:int,to:int>>")))
        piece = lambda a, b, s: F.struct(a.cast("int").alias("from"), b.cast("int").alias("to"), F.lit(s).alias("is_stratified"))
        strata = F.transform("e", lambda x: piece(x["pos"], x["to"], True))
        middle = F.transform("e", lambda x, i: piece(x["to"] - (k - 1), F.when(F.get("e", i + 1).isNull(), F.col("size")).otherwise(F.get("e", i + 1)["pos"] + (k - 1)), False))
        front = F.array(piece(F.lit(0), F.when(F.size("e") == 0, F.col("size")).otherwise(F.get("e", F.lit(0))["pos"] + (k - 1)), False))
        rest = F.filter(F.concat(front, middle), lambda x: x["to"] - x["from"] >= k)
        return d.select("kind", "vertex", F.explode(F.concat(strata, rest)).alias("p")).select("kind", "vertex", "p.from", "p.to", "p.is_stratified")

    def refracted_ends(self, k: int) -> DataFrame:
        """(kind, vertex, front, back): whether the first and the last k-mer lie in no edge of k or more."""
        e = self.edges.filter(F.col("to") - F.col("pos") >= k).groupBy("kind", "vertex").agg(F.min("pos").alias("first"), F.max("to").alias("last"))
        v = self.vertices().filter(F.col("size") >= k).join(e, ["kind", "vertex"], "left")
        return v.select("kind", "vertex", (F.col("first").isNull() | (F.col("first") > 0)).alias("front"), (F.col("last").isNull() | (F.col("last") < F.col("size"))).alias("back"))

    def summary(self) -> DataFrame:
        e = self.edges.groupBy("kind").agg(F.count("*").alias("edges"))
        v = self.vertices().groupBy("kind").agg(F.count("*").alias("vertices"))
        return v.join(e, "kind", "left").select("kind", "vertices", F.coalesce("edges", F.lit(0)).alias("edges"), F.lit(self.kmin).alias("kmin"))

    def stat(self) -> DataFrame:
        """(kind, none, one, two, many, front, back, longest): vertices by number of edges, covered ends, most edges."""
        e = self.edges.groupBy("kind", "vertex").agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.max("to").alias("last"))
        d = self.vertices().select("kind", "vertex", "size").join(e, ["kind", "vertex"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
        return d.groupBy("kind").agg(
            F.count_if(F.col("n") == 0).alias("none"), F.count_if(F.col("n") == 1).alias("one"), F.count_if(F.col("n") == 2).alias("two"), F.count_if(F.col("n") > 2).alias("many"),
            F.count_if(F.col("first") == 0).alias("front"), F.count_if(F.col("last") == F.col("size")).alias("back"), F.max("n").alias("most"),
        )

    def size_by_kmin(self) -> DataFrame:
        """(size, strata, edges): how many strata, and edges to them, there are of that size or more."""
        e = self.edges.groupBy((F.col("to") - F.col("pos")).alias("size")).agg(F.count("*").alias("e"))
        s = self.strata.groupBy(F.col("size").cast("int").alias("size")).agg(F.count("*").alias("s"))
        w = Window.orderBy(F.desc("size"))  # one row per size
        d = s.join(e, "size", "left")
        return d.select("size", F.sum("s").over(w).alias("strata"), F.sum(F.coalesce("e", F.lit(0))).over(w).alias("edges"))

    def text_rows(self) -> DataFrame:
        """(kind, line): one line per vertex: its name, size, and `from:to(stratum)` of its edges."""
        parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "to", "text"))), lambda x: F.concat(x["pos"], F.lit(":"), x["to"], F.lit("("), x["text"], F.lit(")")))
        e = self.named(self.edges).groupBy("kind", "vertex").agg(F.array_join(parts, " ").alias("line"))
        d = self.named(self.vertices()).join(e, ["kind", "vertex"], "left")
        return d.select("kind", F.concat_ws(" ", "vertex", "size", F.coalesce("line", F.lit(""))).alias("line"))

    def _lengths(self) -> DataFrame:
        """(kind, vertex, length, shared) of the edges: their letters, and those in common with the edge before."""
        length = (F.col("to") - F.col("pos")).alias("length")
        if self.placed is not None:
            return self.placed.select("kind", "vertex", length, "shared")
        w = Window.partitionBy("kind", "vertex").orderBy("ord")
        shared = F.greatest(F.lag("to").over(w) - F.col("pos"), F.lit(0))
        return self.edges.select("kind", "vertex", length, F.coalesce(shared, F.lit(0)).alias("shared"))

    def ramps(self) -> DataFrame:
        """(kind, vertex, length, n): the k-mers that lie in a vertex and in none of its edges are a sum of ramps.

        A vertex of size s has s - k + 1 k-mers, less those in its edges, plus those that two neighbouring edges share: each
        term is n * max(0, length - k + 1).
        """
        e = self._lengths()
        terms = F.array(F.struct(F.col("length"), F.lit(-1).alias("n")), F.struct(F.col("shared").alias("length"), F.lit(1).alias("n")))
        e = e.select("kind", "vertex", F.explode(terms).alias("t")).select("kind", "vertex", "t.length", "t.n").filter("length > 0")
        return self.vertices().select("kind", "vertex", F.col("size").alias("length"), F.lit(1).alias("n")).union(e)

    def kmer_count(self, k_from: int, k_to: int) -> DataFrame:
        """(k, count) of distinct k-mers, for k of kmin or more. Ramps are summed by length, then twice over k."""
        need_k(k_from, self.kmin)
        d = over_k(self.ramps().select("length", F.col("n").cast("long").alias("n")), [], k_from, k_to)
        return every_k(d, k_from, k_to)

    def unitig_cases(self, k: int) -> DataFrame:
        """(case, starts): where the maximal unitigs of one k begin, in the seven cases of unitig_count."""
        need_k(k, self.kmin + 1)
        e = self.edges.groupBy("kind", "vertex").agg(F.max(F.when(F.col("pos") == 0, F.col("to"))).alias("f"), F.max(F.struct("to", "pos")).alias("last"))
        d = self.vertices().filter(F.col("size") >= k - 1).join(e, ["kind", "vertex"], "left")
        n = F.col("size")
        back = F.when(F.col("last.to") == n, n - F.col("last.pos"))
        open_front, open_back = F.coalesce(F.col("f") < k - 1, F.lit(True)), F.coalesce(back < k - 1, F.lit(True))
        longer, left, right = n > k - 1, F.col("left_cnt"), F.col("right_cnt")
        case = lambda when, name, w: F.when(when, F.struct(F.lit(name).alias("case"), F.lit(w).cast("long").alias("w") if isinstance(w, int) else w.cast("long").alias("w")))
        stratum = F.col("kind") == "stratum"
        cases = F.array_compact(F.array(
            case(~stratum & longer & open_front, "sequence tip", 1),
            case(stratum & longer & open_front & (left == 0), "tip", 1), case(stratum & longer & open_front & (left > 1), "convergence", 1), case(stratum & longer & open_back & (right > 1), "divergence", right),
            case(stratum & ~longer & (right == 1) & (left == 0), "whole tip", 1), case(stratum & ~longer & (right == 1) & (left > 1), "whole convergence", 1), case(stratum & ~longer & (right > 1), "whole divergence", right),
        ))
        return d.select(F.explode(cases).alias("c")).groupBy("c.case").agg(F.sum("c.w").alias("starts"))

    def unitig_count(self, k_from: int, k_to: int) -> DataFrame:
        """(k, count) of the k-mers that begin a maximal unitig, for k of kmin + 1 or more.

        Such a k-mer follows a (k-1)-mer that is no plain passage. A (k-1)-mer lies between edges of just one vertex. At the
        front of a sequence, or of a stratum that not exactly one letter precedes, one begins as long as the vertex is long
        enough and the edge at its front, if there is one, is shorter than k - 1; at the back of a stratum that several
        letters follow, one for each of them, while the edge there is shorter than k - 1. A stratum of k - 1 letters is a
        (k-1)-mer itself. So each vertex adds at most two steps over k.
        """
        need_k(k_from, self.kmin + 1)
        e = self.edges.groupBy("kind", "vertex").agg(F.max(F.when(F.col("pos") == 0, F.col("to"))).alias("f"), F.max(F.struct("to", "pos")).alias("last"))
        d = self.vertices().join(e, ["kind", "vertex"], "left")
        low, n = F.lit(k_from), F.col("size")
        back = F.when(F.col("last.to") == n, n - F.col("last.pos"))
        seq, many = F.col("kind") == "sequence", F.col("right_cnt") > 1
        step = lambda first, end, w: F.struct(F.greatest(F.coalesce(first + 2, low), low).alias("first"), end.alias("end"), w.cast("long").alias("w"))
        front = F.when(seq | (F.col("left_cnt") != 1), step(F.col("f"), n + F.when(~seq & (F.col("right_cnt") == 1), 1).otherwise(0), F.lit(1)))
        rear = F.when(~seq & many, step(back, n + 1, F.col("right_cnt")))
        d = d.select(F.explode(F.array_compact(F.array(front, rear))).alias("s")).select("s.*").filter("first <= end").filter(F.col("first") <= k_to)
        ends = F.array(F.struct(F.col("first").alias("k"), F.col("w").alias("n")), F.struct((F.col("end") + 1).alias("k"), (-F.col("w")).alias("n")))
        d = d.select(F.explode(ends).alias("x")).groupBy("x.k").agg(F.sum("x.n").alias("n"))
        ks = d.sparkSession.range(k_from, k_to + 1).select(F.col("id").cast("int").alias("k")).join(d, "k", "left").na.fill(0, ["n"])
        return ks.select("k", F.sum("n").over(Window.orderBy("k")).alias("count"))  # one row per k

    def bray_curtis(self, k_from: int, k_to: int) -> DataFrame:
        """(id1, id2, k, nominator, denominator, value) for each pair of datasets id1 < id2, from the strata alone.

        K-mers that occur once over all datasets are left out; all others lie between edges of one stratum and occur as often
        as it does, in each dataset. value is null without support.
        """
        need_k(k_from, self.kmin)
        if self.letters is not None and self.datasets:
            f = self.rows.filter(F.col("what") == packed_repeats.STRATUM).select("id", "size", "held")
        else:
            f = stratum_frequency_by_dataset(self).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("dataset_id", "freq"))).alias("held"))
            f = f.join(self.strata.select("id", "size"), "id")
        e = self._lengths().filter("kind = 'stratum'").select(F.col("vertex").alias("id"), "length", "shared").join(f.select("id", "held"), "id")
        term = lambda c, n: F.struct(F.col(c).cast("int").alias("length"), F.lit(n).cast("long").alias("n"))
        d = e.select("held", F.array(term("length", -1), term("shared", 1)).alias("t")).union(f.select("held", F.array(term("size", 1)).alias("t")))
        # a dataset's own k-mers are a pair of it with itself
        pairs = F.expr("flatten(transform(held, (x, i) -> transform(slice(held, i + 1, size(held)), y -> struct(x.dataset_id as id1, y.dataset_id as id2, least(x.freq, y.freq) as m))))")
        d = d.select("t", F.explode(pairs).alias("p")).select("p.*", F.explode("t").alias("t")).filter("t.length > 0")
        both = stored_alone(over_k(d.select("id1", "id2", "t.length", (F.col("t.n") * F.col("m")).alias("n")), ["id1", "id2"], k_from, k_to))
        shared, each = both.filter("id1 < id2"), both.filter("id1 = id2").select(F.col("id1").alias("dataset_id"), "k", "count")
        grid = pairs_of_datasets(self.seqs).withColumn("k", F.explode(F.sequence(F.lit(k_from), F.lit(k_to)))).join(shared.withColumnRenamed("count", "nominator"), ["id1", "id2", "k"], "left")
        for i in (1, 2):
            grid = grid.join(each.select(F.col("dataset_id").alias(f"id{i}"), "k", F.col("count").alias(f"n{i}")), [f"id{i}", "k"], "left")
        out = grid.select("id1", "id2", "k", F.coalesce("nominator", F.lit(0)).alias("nominator"), (F.coalesce("n1", F.lit(0)) + F.coalesce("n2", F.lit(0))).alias("denominator"))
        return out.withColumn("value", F.when(F.col("denominator") > 0, 2.0 * F.col("nominator") / F.col("denominator")))


def over_k(ramps: DataFrame, of: list[str], k_from: int, k_to: int) -> DataFrame:
    """(of..., k, count): count(k) = sum of n * max(0, length - k + 1) of ramps(length, n, of...), for each k in the range.

    Summed per length, those beyond k_to as one ramp of k_to and a straight line on top; then sums of sums from the longest
    down. A row per length is left, whatever the ramps are; only groups that have a ramp are returned.
    """
    cut = F.least(F.col("length"), F.lit(k_to))
    by = ramps.filter(F.col("length") >= k_from).groupBy(*of, cut.alias("k")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("length") - cut)).alias("top"))
    groups = by.select(*of).distinct() if of else by.sparkSession.range(1).select()
    grid = groups.select(*of, F.explode(F.sequence(F.lit(k_from), F.lit(k_to))).alias("k"))
    d = grid.join(by, [*of, "k"], "left").na.fill(0, ["n", "top"])
    down = Window.partitionBy(*of).orderBy(F.desc("k"))
    d = d.withColumn("slope", F.sum("n").over(down)).withColumn("count", F.sum("slope").over(down) + F.sum("top").over(Window.partitionBy(*of)))
    return d.select(*of, "k", "count")


def every_k(d: DataFrame, k_from: int, k_to: int) -> DataFrame:
    return d.sparkSession.range(k_from, k_to + 1).select(F.col("id").cast("int").alias("k")).join(d, "k", "left").na.fill(0, ["count"]).select("k", "count")


def stratum_frequency_by_dataset(g: Graph) -> DataFrame:
    """(id, dataset_id, freq)"""
    return g.occ.join(g.seqs.select("seq_id", "dataset_id"), "seq_id").groupBy("id", "dataset_id").agg(F.count("*").alias("freq"))


def named_frequency_by_dataset(seqs: DataFrame, kmin: int, letters: str | None = None, longest: int | None = None) -> DataFrame:
    """(dataset_id, freq, text) of the strata of seqs(seq_id, seq, dataset_id), for each dataset that a stratum occurs in.

    letters and longest as for `Graph`; where letters fit packed, no graph is built.
    """
    if packed_repeats.fits(letters, longest, kmin) and seqs.schema["dataset_id"].dataType.simpleString() in ("tinyint", "smallint", "int"):
        return packed_repeats.dataset_rows(seqs, kmin, letters)
    g = Graph(seqs, kmin, letters, longest)
    return g.named(stratum_frequency_by_dataset(g))


def strata_by_size(seqs: DataFrame, kmin: int, letters: str | None = None, longest: int | None = None) -> DataFrame:
    """As `Graph.size_by_kmin`; where letters fit packed, strata and edges are counted where they are found, without the graph."""
    if not packed_repeats.fits(letters, longest, kmin):
        return Graph(seqs, kmin, letters, longest).size_by_kmin()
    d = packed_repeats.size_rows(seqs, kmin, letters).groupBy("size").agg(F.sum("strata").alias("strata"), F.sum("edges").alias("edges"))
    w = Window.orderBy(F.desc("size"))  # one row per size
    return d.select("size", F.sum("strata").over(w).alias("strata"), F.sum("edges").over(w).alias("edges"))


def named_strata(seqs: DataFrame, kmin: int, letters: str | None = None, longest: int | None = None) -> DataFrame:
    """(text, size, freq, left_cnt, right_cnt) of the strata; where letters fit packed, no graph is built."""
    if packed_repeats.fits(letters, longest, kmin):
        return packed_repeats.strata_rows(seqs, kmin, letters)
    g = Graph(seqs, kmin, letters, longest)
    return g.named(g.strata).select("text", "size", "freq", "left_cnt", "right_cnt")


def save(g: Graph, path: str) -> None:
    """Write the graph's tables as Parquet under path: sequences, strata, edges, and kmin."""
    for name, d in (("seqs", g.seqs), ("strata", g.strata), ("edges", g.edges if g.placed is None else g.placed)):
        d.write.mode("overwrite").parquet(f"{path}/{name}")
    g.seqs.sparkSession.createDataFrame([(g.kmin,)], "kmin int").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")


def load(spark: SparkSession, path: str) -> Graph:
    about = spark.read.parquet(f"{path}/about").collect()
    if len(about) != 1:
        raise ValueError("no graph is stored there")
    return Graph.of_tables(spark.read.parquet(f"{path}/seqs"), about[0]["kmin"], spark.read.parquet(f"{path}/strata"), spark.read.parquet(f"{path}/edges"))
