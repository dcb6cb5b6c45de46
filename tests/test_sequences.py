"""Queries against SQL on the smallest tables, golden values on a small fixture, random string sets against brute force."""

import random
from collections import Counter

import duckdb
import pytest

from kmerloom import cli
from kmerloom.operators import index, kmers, packed
from kmerloom.operators.graph import Graph
from kmerloom.operators.repeats import common, intervals
from kmerloom.plans.queries import ORACLES, QUERIES
from kmerloom.sources import files
from kmerloom.sources.sequences import DNA, LETTERS, READ_LENGTH, READS_PER_DOCUMENT, reads

SF = "/root/testdata/sf0.001"
SAMPLE = ["TGCGATTA", "TGCAGTTA", "TGCAC", "CTTA"]


def frame(spark, seqs):
    return spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "seq_id long, seq string")


def rows(df):
    return Counter(tuple(None if x is None else round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in ("documents", "part"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ["kmer_count_range", "unitig_case_stats", "overlap_degrees", "overlap_degrees_multi", "graph_build", "vertex_spectrum", "graph_kmer_count_range", "cdbg_unitigs", "cdbg_graph", "bwt_recover", "bwt_ranks", "unitig_count_range", "unitig_case_stats_graph", "graph_braycurtis_range", "src_fastq_file", "src_fasta_file", "src_ebwt_file", "src_sample_ids"])
def test_against_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.sql(f"select {', '.join(f'\"{c}\"' for c in columns)} from ({ORACLES[name]})").fetchall()
    assert rows(got.select(columns)) == Counter(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in want)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_golden_sample(spark):
    s = frame(spark, SAMPLE)
    g = Graph(s, 1)
    strata = {r["text"]: (r["freq"], r["left_cnt"], r["right_cnt"]) for r in g.named(g.strata).collect()}
    assert strata == {"A": (6, 3, 3), "C": (5, 2, 3), "G": (5, 3, 3), "T": (9, 4, 3), "TGC": (3, 0, 2), "TTA": (3, 3, 0), "TGCA": (2, 0, 2)}
    assert [r["count"] for r in kmers.kmer_count(s, 1, 8).orderBy("k").collect()] == [4, 12, 12, 12, 9, 6, 4, 2]
    assert [r["count"] for r in g.kmer_count(1, 8).orderBy("k").collect()] == [4, 12, 12, 12, 9, 6, 4, 2]
    assert [r["count"] for r in kmers.unitig_count(s, 2, 8).orderBy("k").collect()] == [12, 7, 5, 3, 2, 2, 2]


def test_cycle(spark):
    s = frame(spark, ["ABABAB"])
    assert kmers.unitig_count(s, 3, 3).collect()[0]["count"] == 0
    assert [tuple(r) for r in kmers.unitigs(s, 3).select("content", "is_cycle").collect()] == [("ABAB", True)]


def test_recover(spark):
    s = frame(spark, ["GGGGCGTAT", "TATTGCGCCA", "GGCGTACCA", "ACGACTACGAC", "A"])
    assert sorted(r["seq"] for r in index.recover(index.bwt(s)).collect()) == sorted(r["seq"] for r in s.collect())


def test_random_graph_counts(spark):
    draw = random.Random(3)
    seqs = ["".join(draw.choice("AC") for _ in range(draw.randint(3, 14))) for _ in range(12)]
    seqs += seqs[:3]
    s = frame(spark, seqs)
    want = [len({x[i : i + k] for x in seqs for i in range(len(x) - k + 1)}) for k in range(2, 15)]
    assert [r["count"] for r in Graph(s, 2).kmer_count(2, 14).orderBy("k").collect()] == want


def test_random_kmer_counts(spark):
    draw = random.Random(5)
    seqs = ["".join(draw.choice("ACG") for _ in range(draw.randint(0, 40))) for _ in range(60)]
    seqs += seqs[:9] + ["A" * 40, "A" * 37, ""]
    want = [len({x[i : i + k] for x in seqs for i in range(len(x) - k + 1)}) for k in range(3, 43)]
    assert [r["count"] for r in kmers.kmer_count(frame(spark, seqs), 3, 42).orderBy("k").collect()] == want


def test_reads_cover_whole_texts(spark, tmp_path):
    texts = ["", None, "?!", "ab cd", "Xyz, " * 1000, "a" * 400]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'en' as lang").write.parquet(f"{tmp_path}/documents.parquet")
    parts = {}
    for r in reads(spark, str(tmp_path)).orderBy("seq_id").collect():
        assert 0 < len(r["seq"]) <= READ_LENGTH
        parts.setdefault(r["seq_id"] // READS_PER_DOCUMENT, []).append(r["seq"])
    code = str.maketrans(LETTERS, DNA)
    want = {i: "".join(c for c in (t or "").lower() if c in LETTERS).translate(code) for i, t in enumerate(texts)}
    assert {i: "".join(p) for i, p in parts.items()} == {i: t for i, t in want.items() if t}
    assert len(parts[5]) == 2


def test_empty(spark):
    s = spark.createDataFrame([], "seq_id long, seq string")
    assert [tuple(r) for r in kmers.kmer_count(s, 3, 4).orderBy("k").collect()] == [(3, 0), (4, 0)]
    assert kmers.kmer_list(s, 3).count() == 0 and Graph(s, 2).edges.count() == 0 and kmers.overlap_degrees(s, 2, True).count() == 0


def brute_strata(seqs, kmin):
    """{text: (freq, left_cnt, right_cnt)} of the maximal repeats."""
    at = {}
    for i, s in enumerate(seqs):
        for p in range(len(s)):
            for n in range(kmin, len(s) - p + 1):
                at.setdefault(s[p : p + n], []).append((s[p - 1] if p else -1 - i, s[p + n] if p + n < len(s) else -1 - i))
    out = {}
    for t, held in at.items():
        left, right = ({x[k] for x in held} for k in (0, 1))
        # each sequence's begin and end is a context of its own
        if len(held) > 1 and (len(left) > 1) and (len(right) > 1):
            out[t] = (len(held), *(sum(isinstance(c, str) for c in x) for x in (left, right)))
    return out


def random_sets(seed, many):
    draw = random.Random(seed)
    for _ in range(many):
        letters = draw.choice(["AC", "ACGT"])
        base = "".join(draw.choice(letters) for _ in range(60))
        seqs = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 25))) for _ in range(10)]
        seqs += [base, base, base[5:50], base[:30] + "C" + base[30:], base[20:] + base[:20], "A" * 17, "AC" * 9, seqs[0], ""]
        yield draw.randint(2, 4), seqs


def test_strata_of_random_sets(spark):
    for kmin, seqs in random_sets(11, 2):
        g = Graph(frame(spark, seqs), kmin)
        got = {r["text"]: (r["freq"], r["left_cnt"], r["right_cnt"]) for r in g.named(g.strata).collect()}
        assert got == brute_strata(seqs, kmin)
        places = Counter((r["text"], r["seq_id"], r["pos"]) for r in g.named(g.occ).collect())
        assert places == Counter((t, i, p) for i, s in enumerate(seqs) for t in got for p in range(len(s)) if s.startswith(t, p))


def starts(seqs, k):
    """k-mers after a (k-1)-mer that isn't entered and left by just one letter."""
    mers = {s[i : i + k] for s in seqs for i in range(len(s) - k + 1)}
    into, out = Counter(m[1:] for m in mers), Counter(m[:-1] for m in mers)
    return sum((into[m[:-1]], out[m[:-1]]) != (1, 1) for m in mers)


def test_graph_ranges_equal_direct_counts(spark):
    for kmin, seqs in random_sets(12, 2):
        s = frame(spark, seqs).selectExpr("seq_id", "seq", "cast(seq_id % 3 as int) as dataset_id")
        g = Graph(s, kmin)
        want = [(k, starts(seqs, k)) for k in range(kmin + 1, 64)]
        assert [tuple(r) for r in g.unitig_count(kmin + 1, 63).orderBy("k").collect()] == want
        assert [tuple(r) for r in g.unitig_count(9, 9).collect()] == [(9, starts(seqs, 9))]
        assert [(r["k"], r["count"]) for r in kmers.unitig_count(s, kmin + 1, 20).orderBy("k").collect()] == want[: 20 - kmin]
        assert sum(r["starts"] for r in g.unitig_cases(8).collect()) == starts(seqs, 8)
        columns = ["id1", "id2", "k", "nominator", "denominator", "value"]
        assert rows(g.bray_curtis(kmin, 62).select(columns)) == rows(kmers.bray_curtis(s, kmin, 62).select(columns))


def test_repeats_of_long_texts(spark):
    draw = random.Random(2)
    base = "".join(draw.choice("ACGT") for _ in range(30_000))
    copy = base[:9_000] + "T" + base[9_000:21_000] + base[21_500:]
    g = Graph(frame(spark, [base, copy, base[100:29_000]]), 24)
    want = [(k, len({s[i : i + k] for s in (base, copy, base[100:29_000]) for i in range(len(s) - k + 1)})) for k in (24, 700, 9_000)]
    assert [tuple(g.kmer_count(k, k).first()) for k, _ in want] == want
    assert g.unitig_count(500, 501).orderBy("k").first()["count"] == starts([base, copy, base[100:29_000]], 500)


def test_intervals():
    assert [common(a, b) for a, b in (("", "a"), ("abc", "abd"), ("abc", "abcd"), ("xa", "ya"))] == [0, 2, 3, 0]
    texts = sorted(["aab", "aab", "aac", "ab", "b", "b"])
    assert sorted(intervals(texts)) == [(0, 0, 6), (1, 0, 4), (1, 4, 6), (2, 0, 3), (3, 0, 2)]


def test_graph_guards_and_storage(spark, tmp_path):
    from kmerloom.operators.graph import load, save

    g = Graph(frame(spark, SAMPLE), 2)
    for ask in (lambda: g.kmer_count(1, 3), lambda: g.unitig_count(2, 3), lambda: g.bray_curtis(1, 2), lambda: g.unitig_cases(2), lambda: Graph(frame(spark, SAMPLE), 0)):
        with pytest.raises(ValueError):
            ask()
    save(g, str(tmp_path / "g"))
    back = load(spark, str(tmp_path / "g"))
    assert back.kmin == 2 and rows(back.named(back.edges)) == rows(g.named(g.edges)) and rows(back.unitig_count(3, 8)) == rows(g.unitig_count(3, 8))


def test_files_in_splits(spark, tmp_path):
    draw = random.Random(9)
    seqs = ["".join(draw.choice("acgt") for _ in range(draw.randint(1, 150))) for _ in range(400)]
    (tmp_path / "a.fastq").write_text("".join(f"@{i}\n{s}\n+\n{'>' * len(s)}\n" for i, s in enumerate(seqs)))
    (tmp_path / "a.fasta").write_text("".join(f">{i}\n" + "\n".join(s[j : j + 40] for j in range(0, len(s), 40)) + "\n" for i, s in enumerate(seqs)))
    (tmp_path / "ids.txt").write_text("0 1\n2\n\n" + " ".join("3" for _ in seqs[3:]) + "\n")
    small = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    held = {k: spark.conf.get(k) for k in small}
    for k in small:
        spark.conf.set(k, "4096")
    try:
        for got in (files.read_fastq(spark, str(tmp_path / "a.fastq")), files.read_fasta(spark, str(tmp_path / "a.fasta"))):
            assert [r["seq"] for r in got.orderBy("record").collect()] == [s.upper() for s in seqs]
        assert [r["dataset_id"] for r in files.read_sample_ids(spark, str(tmp_path / "ids.txt"), 400).orderBy("at").collect()] == [0, 1, 2] + [3] * 397
        for n in (399, 401):
            with pytest.raises(ValueError):
                files.read_sample_ids(spark, str(tmp_path / "ids.txt"), n)
        for text in ("T$TA$", "TT$A", "TT$A\n", "$", "T$\n"):
            (tmp_path / "b.txt").write_text(text)
            assert "".join(r["ch"] for r in files.read_ebwt(spark, str(tmp_path / "b.txt")).orderBy("i").collect()) == text.strip()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_index_counts_beyond_one_stretch(spark):
    draw = random.Random(4)
    text = [draw.choice("$ACG") for _ in range(500)]
    b = spark.createDataFrame(list(enumerate(text)), "i long, ch string")
    got = index.with_earlier(b.selectExpr("i", "ch", "1L as n"), ["ch"], "i", "n", "r", wide=7)
    assert {(r["i"], r["r"]) for r in got.collect()} == {(i, text[:i].count(c)) for i, c in enumerate(text)}
    assert {(r["i"], r["ch"], r["rank"]) for r in index.ranks_at(b, spark.createDataFrame([(0,), (77,), (500,)], "i long")).collect()} == {(i, c, text[:i].count(c)) for i in (0, 77, 500) for c in "$ACG"}


def test_command_line(spark, tmp_path):
    (tmp_path / "s.fasta").write_text("".join(f">{i}\n{s}\n" for i, s in enumerate(SAMPLE)))
    (tmp_path / "ids").write_text("0 0 1 1\n")
    at = lambda name: str(tmp_path / name)
    lines = lambda name: sorted(r["value"] for r in spark.read.text(at(name)).collect())
    cli.main(["build", at("s.fasta"), at("graph"), "--kmin", "1", "--text"], spark)
    cli.main(["access", at("s.fasta"), at("seqs")], spark)
    assert spark.read.parquet(at("seqs")).count() == 4 and len(lines("graph/text")) == 11
    cli.main(["kmer_count", at("graph"), at("counts")], spark)
    assert lines("counts") == [f"{k},{n}" for k, n in enumerate([4, 12, 12, 12, 9, 6, 4, 2], 1)]
    cli.main(["unitig_count", at("graph"), at("starts"), "--k-to", "8"], spark)
    assert lines("starts") == [f"{k},{n}" for k, n in enumerate([12, 7, 5, 3, 2, 2, 2], 2)]
    cli.main(["kmer", at("graph"), at("mers"), "--k", "8"], spark)
    assert lines("mers") == ["TGCAGTTA", "TGCGATTA"]
    cli.main(["cdbg", at("graph"), at("cdbg"), "--k", "7"], spark)
    assert lines("cdbg") == ["0      TGCAGTTA", "1      TGCGATTA"]
    cli.main(["braycurtis", at("graph"), at("bc"), "--samples", at("ids"), "--k-from", "2", "--k-to", "2"], spark)
    assert len(lines("bc")) == 1 and lines("bc")[0].startswith("0,1,2,")
    cli.main(["overlap", at("graph"), at("overlap"), "--min-length", "3"], spark)
    cli.main(["stat", at("graph")], spark)
    assert len(lines("overlap")) == 4
    with pytest.raises(ValueError):
        cli.main(["cdbg", at("graph"), at("cdbg"), "--k", "1"], spark)


def test_stream_of_sequences(spark, tmp_path):
    from kmerloom.streaming.kmers import kmer_frequencies

    frame(spark, SAMPLE).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("seq_id long, seq string").parquet(str(tmp_path / "in"))
    query = kmer_frequencies(stream, 3).writeStream.outputMode("complete").format("memory").queryName("mers").trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = Counter(s[i : i + 3] for s in SAMPLE for i in range(len(s) - 2))
    assert {r["mer"]: r["freq"] for r in spark.table("mers").collect()} == dict(want)


def brute_kmers(seqs, ks):
    return [len({s[i : i + k] for s in seqs for i in range(len(s) - k + 1)}) for k in ks]


@pytest.mark.parametrize("held", [1 << 22, 50])
def test_packed_kmers_and_junctions(spark, monkeypatch, held):
    """Packed letters against brute force: copies, repeats, short, empty and null sequences, runs over RUN places, several chunks."""
    monkeypatch.setattr(packed, "HELD", held)
    monkeypatch.setattr(packed, "CHUNK", 300 if held == 50 else 1 << 21)
    draw = random.Random(4)
    base = "".join(draw.choice("ACGT") for _ in range(900))
    seqs = [base, base, base[100:400], base[300:350] + base[:80], "A" * 700, "ACGT" * 90, "ACGTA", "A", "", *("".join(draw.choice("AC") for _ in range(n)) for n in (19, 20, 21, 59, 60, 61, 62, 300))]
    d = spark.createDataFrame([(i, s) for i, s in enumerate([*seqs, None])], "seq_id long, seq string").repartition(3)
    for low, high in ((1, 60), (20, 60), (7, 33), (5, 5), (32, 32)):
        assert [r["count"] for r in kmers.kmer_count(d, low, high, "ACGT").orderBy("k").collect()] == brute_kmers(seqs, range(low, high + 1))
    for k in (2, 5, 20, 29):
        assert rows(kmers.unitig_count(d, k, k, "ACGT")) == rows(kmers.unitig_count(d, k, k))
        assert rows(kmers.unitig_cases(d, k, "ACGT")) == rows(kmers.unitig_cases(d, k))
    with pytest.raises(Exception, match="letters other than"):
        kmers.unitig_count(d, 5, 5, "ACG").collect()
    none = d.filter("false")
    assert kmers.unitig_count(none, 5, 5, "ACGT").collect() == [] and [r["count"] for r in kmers.kmer_count(none, 3, 4, "ACGT").collect()] == [0, 0]


def test_packed_queries_use_no_strings_of_mers(spark):
    """The headline counts at one gigabyte: a place must not become a row of the shuffle."""
    for name in ("kmer_count_range", "unitig_count_k", "unitig_case_stats"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "sequence(" not in plan, name

def test_packed_repeats(spark, monkeypatch):
    """The packed way against brute force: copies, runs of one letter, begins and ends, short, empty and null sequences, small parts."""
    from kmerloom.operators import packed_repeats

    for part, (kmin, seqs) in zip((1 << 18, 3), random_sets(21, 2)):
        monkeypatch.setattr(packed_repeats, "PART", part)
        monkeypatch.setattr(packed_repeats, "CHUNK", 1 << 20 if part > 3 else 90)
        draw = random.Random(kmin)
        long = "".join(draw.choice("ACGT") for _ in range(255))
        seqs = [*seqs, long, long[30:], long[:200], long[7:240], long, "A" * 255, "A" * 254]
        s = spark.createDataFrame([(i * (1 << 24), x) for i, x in enumerate([*seqs, None])], "seq_id long, seq string").repartition(3)
        for k in (kmin, 20, 32):
            g, plain = Graph(s, k, "ACGT", 255), Graph(s, k)
            assert rows(g.named(g.strata).drop("home_seq_id", "home_pos")) == rows(plain.named(plain.strata).drop("home_seq_id", "home_pos"))
            assert rows(g.named(g.occ)) == rows(plain.named(plain.occ)) and rows(g.named(g.edges)) == rows(plain.named(plain.edges))
    for bad in (["ACGN" * 9], ["A" * 256]):
        with pytest.raises(Exception, match="letters"):
            Graph(frame(spark, bad), 3, "ACGT", 255)
    assert Graph(spark.createDataFrame([], "seq_id long, seq string"), 3, "ACGT", 255).edges.count() == 0


def test_frequencies_by_dataset_are_counted_without_the_graph(spark, monkeypatch):
    """At 0.1 GB of documents neither places nor edges may become rows: `stratum_frequency_by_dataset` builds no graph."""
    from kmerloom.operators import graph, packed_repeats

    for part, (kmin, seqs) in zip((1 << 18, 3), random_sets(33, 2)):
        monkeypatch.setattr(packed_repeats, "PART", part)
        given = [(i, x, None if i % 4 == 3 else i % 4 - 1) for i, x in enumerate([*seqs, "ACGT" * 50, "CGTA" * 60, None])]
        s = spark.createDataFrame(given, "seq_id long, seq string, dataset_id int").repartition(3)
        g = Graph(s, kmin)
        want = g.named(graph.stratum_frequency_by_dataset(g))
        got = graph.named_frequency_by_dataset(s, kmin, "ACGT", 255)
        assert got.schema.simpleString() == want.schema.simpleString() and got.count() and sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    monkeypatch.setattr(graph.Graph, "__init__", lambda *a: 1 / 0)
    assert QUERIES["stratum_frequency_by_dataset"](spark, SF).count()


def test_graph_of_reads_moves_packed_letters(spark):
    """At 0.1 GB of documents a place must not become a row of the shuffle."""
    from kmerloom.operators import repeats

    asked = []
    level, repeats.level = repeats.level, lambda *a: asked.append(a) or level(*a)
    try:
        QUERIES["maximal_repeats"](spark, SF)
    finally:
        repeats.level = level
    assert not asked


@pytest.mark.parametrize("held", [1 << 22, 50])
def test_packed_range_of_unitig_starts(spark, monkeypatch, held):
    """A range of ks at once against brute force, and no row of the shuffle for a place."""
    monkeypatch.setattr(packed, "HELD", held)
    monkeypatch.setattr(packed, "CHUNK", 300 if held == 50 else 1 << 21)
    for seed in (31, 32):
        for _, seqs in random_sets(seed, 2):
            seqs = [*seqs, seqs[10] * 4, "A" * 150, "AC" * 70, seqs[10] + "G" + seqs[10][3:]]
            d = spark.createDataFrame([(i, x) for i, x in enumerate([*seqs, None])], "seq_id long, seq string").repartition(3)
            for low, high in ((2, 60), (20, 60), (31, 35)):
                assert [tuple(r) for r in kmers.unitig_count(d, low, high, "ACGT").orderBy("k").collect()] == [(k, starts(seqs, k)) for k in range(low, high + 1)]
    assert [tuple(r) for r in kmers.unitig_count(d.filter("false"), 5, 6, "ACGT").orderBy("k").collect()] == [(5, 0), (6, 0)]
    plan = QUERIES["unitig_count_range"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "sequence(" not in plan


@pytest.mark.parametrize("held", [1 << 22, 50])
def test_packed_similarity(spark, monkeypatch, held):
    """Packed against the plain way: datasets of copies, short, empty and null sequences; no row of the shuffle for a place."""
    monkeypatch.setattr(packed, "HELD", held)
    monkeypatch.setattr(packed, "CHUNK", 300 if held == 50 else 1 << 21)
    columns = ["id1", "id2", "k", "nominator", "denominator", "value"]
    for _, seqs in random_sets(41, 2):
        d = spark.createDataFrame([(i, x) for i, x in enumerate([*seqs, *seqs[9:12], "A" * 300, None])], "seq_id long, seq string").repartition(3)
        d = d.selectExpr("seq_id", "seq", "cast(if(seq_id % 4 = 3, 300, seq_id % 4) as int) as dataset_id")
        for low, high in ((1, 24), (10, 24), (3, 5)):
            assert rows(kmers.bray_curtis(d, low, high, "ACGT").select(columns)) == rows(kmers.bray_curtis(d, low, high).select(columns))
    assert kmers.bray_curtis(d.filter("false"), 3, 4, "ACGT").count() == 0
    asked = []
    monkeypatch.setattr(kmers, "windows", lambda *a: asked.append(a))
    QUERIES["braycurtis_range"](spark, SF)
    assert not asked


def brute_unitigs(seqs, k):
    mers = {x[i : i + k] for x in seqs for i in range(len(x) - k + 1)}
    before, after = {}, {}
    for x in mers:
        before.setdefault(x[1:], []).append(x)
        after.setdefault(x[:-1], []).append(x)
    links = {b[0]: after[v][0] for v, b in before.items() if len(b) == 1 and len(after.get(v, ())) == 1 and b[0] != after[v][0]}
    out, seen = Counter(), set()
    for cycle, heads in ((False, sorted(mers - set(links.values()))), (True, sorted(mers))):
        for x in heads:
            if x in seen:
                continue
            content, begin = x, x
            while True:
                seen.add(x)
                x = links.get(x)
                if x is None or x == begin:
                    break
                content += x[-1]
            out[(content, cycle)] += 1
    return out


def test_packed_unitigs(spark, monkeypatch):
    """Unitigs over many sequences, none of which has them whole; cycles; runs of one letter; sequences of k letters or fewer."""
    from kmerloom.operators import packed_unitigs

    monkeypatch.setattr(packed_unitigs, "LETTERS", 200)  # many chunks
    draw = random.Random(5)
    base, ring = ("".join(draw.choice("ACGT") for _ in range(n)) for n in (900, 150))
    seqs = [base[i : i + 60] for i in range(0, 840, 23)] + [base[i : i + draw.randint(0, 90)] for i in draw.sample(range(840), 40)]
    seqs += [(2 * ring)[i : i + 100] for i in range(0, 150, 37)] + ["A" * 30, "A" * 12, "C" * 11, "C" * 10, ""]
    want = brute_unitigs(seqs, 11)
    assert any(cycle for _, cycle in want) and any(len(content) > 150 for content, _ in want)
    s = frame(spark, seqs).repartition(3)
    assert Counter(tuple(r) for r in kmers.unitigs(s, 11, "ACGT").select("content", "is_cycle").collect()) == want
    with pytest.raises(Exception, match="letters other than"):
        kmers.unitigs(frame(spark, ["ACGTN" * 9]), 11, "ACGT").collect()


@pytest.mark.parametrize("name", ["unitig_edges", "numbered_unitigs", "unitig_invariants"])
def test_packed_graph_of_unitigs(spark, name):
    """The same rows as without packed letters."""
    draw = random.Random(6)
    base = "".join(draw.choice("ACGT") for _ in range(300))
    s = frame(spark, [base[i : i + 40] for i in range(0, 270, 31)] + [base[50:80] + "ACGTTGCA", base[:20] + base[100:130], "ACGACGACGACG"])
    run = getattr(kmers, name)
    want = Counter(str(r) for r in run(s, 7).collect())
    assert Counter(str(r) for r in run(s, 7, "ACGT").collect()) == want


def test_balance_counts_what_differs(spark):
    from kmerloom.operators import packed_unitigs

    contents = spark.createDataFrame([("ACGT",), ("CGTA",), ("GGG",)], "content string")  # CGT twice, GTA and GGG too many
    assert tuple(packed_unitigs.balance(frame(spark, ["ACGT", "TTT", "TTTT"]), contents, 3, "ACGT").collect()[0]) == (1, 3)


@pytest.mark.parametrize("name", ["bwt_lf", "bwt_recover", "bwt_select"])
def test_transform_rows_are_not_broadcast(spark, monkeypatch, name):
    """At 60 times sf0.1 the suffixes of a file of 10 MB are 12 million rows, more than a driver holds."""
    planned, kind = [], type(spark.range(0))
    join = kind.join
    monkeypatch.setattr(kind, "join", lambda self, *a: planned.append(join(self, *a)) or planned[-1])
    QUERIES[name](spark, SF)
    plans = [d._jdf.queryExecution().executedPlan().toString() for d in planned if "_up" in d.columns and "_before" in d.columns]
    assert plans and all("SortMergeJoin" in p and "BuildLeft" not in p for p in plans)


@pytest.mark.parametrize("name", ["graph_build", "graph_kmer_count_range", "unitig_case_stats_graph"])
def test_no_places_of_strata_are_stored(spark, monkeypatch, name):
    """At 0.1 GB of documents strata have hundreds of millions of places; edges come from the contexts of each stratum."""
    from kmerloom.operators import packed_repeats

    monkeypatch.setattr(packed_repeats, "repeat_rows", lambda *a: 1 / 0)
    assert QUERIES[name](spark, SF).count()


def test_edges_from_contexts(spark):
    """Edges and their texts against the way by places: copies, begins and ends, runs of one letter, strata in strata."""
    for kmin, seqs in random_sets(51, 2):
        seqs = [*seqs, "A" * 60, "A" * 45, "ACGT" * 20, "ACGT" * 20, "CGTACGTTTACG", "ACGTACGTTTAC"]
        s = spark.createDataFrame([(i * (1 << 24), x) for i, x in enumerate([*seqs, None])], "seq_id long, seq string").repartition(3)
        g, plain = Graph(s, kmin, "ACGT", 255), Graph(s, kmin)
        columns = ["kind", "vertex", "ord", "pos", "to", "text"]
        assert rows(g.named_edges().select(columns)) == rows(plain.named(plain.edges).select(columns))
        assert rows(g.overlaps().groupBy("kind", "overlap").count()) == rows(g.placed.groupBy("kind", "shared").count())


def test_similarity_from_counts_of_strata(spark, monkeypatch):
    """`graph_braycurtis_range` at 0.1 GB: strata's frequencies in datasets are counted where they are found; against the way by places."""
    from kmerloom.operators import packed_repeats

    columns = ["id1", "id2", "k", "nominator", "denominator", "value"]
    for kmin, seqs in random_sets(61, 1):
        s = spark.createDataFrame([(i, x, i % 3 * 100) for i, x in enumerate([*seqs, *seqs[5:9], "ACGT" * 20])], "seq_id long, seq string, dataset_id int").repartition(3)
        want = rows(Graph(s, kmin).bray_curtis(kmin, kmin + 9).select(columns))
        assert rows(Graph(s, kmin, "ACGT", 255).bray_curtis(kmin, kmin + 9).select(columns)) == want
        monkeypatch.setattr(packed_repeats, "repeat_rows", lambda *a: 1 / 0)
        assert rows(Graph(s, kmin, "ACGT", 255, True).bray_curtis(kmin, kmin + 9).select(columns)) == want
        monkeypatch.undo()


@pytest.mark.parametrize("name", ["graph_size_by_kmin", "maximal_repeats"])
def test_strata_are_counted_without_the_graph(spark, monkeypatch, name):
    """At 1 GB of documents the graph of reads is not to be stored for these."""
    from kmerloom.operators import graph

    run = {"graph_size_by_kmin": graph.strata_by_size, "maximal_repeats": graph.named_strata}[name]
    for kmin, seqs in random_sets(71, 1):
        s = frame(spark, [*seqs, "A" * 50, "ACGT" * 20, "ACGT" * 20]).repartition(3)
        assert rows(run(s, kmin, "ACGT", 255)) == rows(run(s, kmin))
    monkeypatch.setattr(graph.Graph, "__init__", lambda *a: 1 / 0)
    assert QUERIES[name](spark, SF).count()
