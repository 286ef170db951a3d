"""Hand-worked vectors for functions and operators."""

import pytest
from pyspark.sql import functions as F

from haplospark.functions import stats, strings
from haplospark.operators import alleles, copynumber, depth, graph, haplotypes, intervals, pileup, runs, variants


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


lit = F.lit


@pytest.mark.parametrize("a,b,expect", [("2x1x1", "21x21", (2, 0, 1)), ("1212", "1x22", (2, 1, 1)), ("xx", "12", (0, 0, 0))])
def test_compare(spark, a, b, expect):
    assert tuple(one(spark, strings.compare_haps(lit(a), lit(b)))) == expect


@pytest.mark.parametrize("hap,expect", [("x2x1x", (1, 3)), ("12", (0, 1)), ("xxx", (2, 0))])
def test_start_end(spark, hap, expect):
    assert tuple(one(spark, strings.start_end(lit(hap)))) == expect


@pytest.mark.parametrize("ref,alt,token", [("G", "GAT", "G+2AT"), ("GAT", "G", "G-2NN"), ("A", "C", "C")])
def test_indel_encode(spark, ref, alt, token):
    assert one(spark, strings.indel_encode(lit(ref), lit(alt))) == token


@pytest.mark.parametrize("token,expect", [("+2AT", ("C", "CAT", 2)), ("-3NNN", ("CNNN", "C", 3)), ("A", ("C", "A", 0))])
def test_indel_decode(spark, token, expect):
    assert tuple(one(spark, strings.indel_decode(lit("C"), lit(token)))) == expect


@pytest.mark.parametrize("pos,ref,alt,name", [(9, "A", "AT", "7:g.9_10insT"), (9, "ATG", "A", "7:g.10_11del"), (9, "A", "C", "7:g.9A>C"), (9, "AT", "CG", None)])
def test_hgvs(spark, pos, ref, alt, name):
    assert one(spark, strings.hgvs(lit("7"), lit(pos), lit(ref), lit(alt))) == name


def test_bounds_and_ends(spark):
    assert one(spark, strings.hap_bound(lit(10), lit(20), lit(False), lit(True))) == "10-20truncated"
    assert one(spark, strings.fusion_type(lit("012"), "5p")) == "duplication" and one(spark, strings.fusion_type(lit("012"), "3p")) == "deletion"
    assert one(spark, strings.hap_class(lit("0120"))) == "gene2" and one(spark, strings.hap_class(lit("x12"))) == "gene1"
    assert one(spark, strings.link_direction(lit("x21"), lit("12x"), lit(False))) == "1-2"
    assert one(spark, strings.link_direction(lit("21x"), lit("1xx"), lit(True))) == "0-0"
    assert one(spark, strings.link_direction(lit("121"), lit("212"), lit(False))) == "1-2"
    assert [one(spark, strings.hap_class(lit(h))) for h in ("12121212", "01212120", "0121212x", "x1x")] == ["gene1", "gene2", "fusion", "gene1"]
    assert one(spark, strings.nm_adjusted(lit(900), lit("100M400D50M20I"))) == 500
    assert one(spark, strings.clip_size(lit("12S30M"), "left")) == 12 and one(spark, strings.clip_size(lit("12S30M"), "right")) == 0


def test_thresholds(spark):
    arr = lambda *v: F.array(*map(lit, v))
    assert [one(spark, stats.edge_threshold(arr(*v))) for v in ((1, 12, 30), (4, 4), (1, 7, 9), (1, 300))] == [2, 0, 1, 5]
    p = one(spark, stats.depth_posterior(lit(30), lit(15.0)))
    assert max(range(4), key=p.__getitem__) == 1 and sum(p) == pytest.approx(1)
    assert one(spark, stats.depth_posterior(lit(5), lit(0.0))) is None
    assert one(spark, stats.depth_posterior(lit(0), lit(0.0))) == [0.25] * 4
    assert [one(spark, stats.sex_of(lit(x), lit(y))) for x, y in ((30.0, 1.0), (15.0, 14.0), (30.0, 2.0), (0.0, 1.0), (30.0, 10.0))] == ["female", "male", None, None, "female"]


def test_depths(spark):
    spans = spark.createDataFrame([("a", 0, 10), ("a", 0, 10), ("a", 5, 25), ("a", 7, 7)], "r string, start long, end long")
    points = spark.createDataFrame([("a", 0), ("a", 1), ("a", 10), ("a", 25), ("a", 26), ("b", 1)], "r string, pos long")
    for width in (1, 4, 100):
        got = {(x.r, x.pos): x.depth for x in intervals.depth_at_positions(spans, points, ["r"], width).collect()}
        assert got == {("a", 0): 0, ("a", 1): 2, ("a", 10): 3, ("a", 25): 1, ("a", 26): 0, ("b", 1): 0}
    summary = depth.depth_summary(spark.createDataFrame([("a", float(d)) for d in (1, 2, 3, 4, 60)], "r string, depth double"), ["r"])
    assert depth.coverage_gate(summary).first().callable is False
    assert depth.median_mad(spark.createDataFrame([("a", 10.0), ("a", 12.0), ("a", 20.0)], "r string, depth double"), ["r"]).first().mad_ratio == pytest.approx(2 / 12)
    assert depth.control_positions(spark.createDataFrame([("a", 0, 1000)], "r string, start long, end long"), ["r"]).count() == 101


def test_interval_joins(spark):
    left = spark.createDataFrame([(0, p) for p in (1, 9, 10, 18)], "c int, pos long")
    right = spark.createDataFrame([(0, 10, 100), (0, 20, 200)], "c int, pos long, v long")
    got = {x.pos: x.v for x in intervals.as_of_forward(left, right, ["c"], 5, "v").collect()}
    assert got == {1: None, 9: 100, 10: 100, 18: 200}
    noisy = spark.createDataFrame([(0, 9, 10)], "c int, start long, end long")
    assert {x.pos for x in intervals.outside(left, noisy, ["c"], 3).collect()} == {1, 18}
    assert {x.pos for x in intervals.outside(left, noisy, ["c"], 3, closed=False).collect()} == {1, 9, 10, 18}


def test_consensus_order(spark):
    rows = [(1, "G", 2, "C"), (1, "C", 1, "C"), (2, "G", 1, "C"), (2, "C", 1, "C"), (3, "C+2AT", 3, "C"), (3, "T", 3, "C")]
    got = {x.pos: (x.call, x.dp, x.ad_ref, x.ad, x.gt) for x in pileup.consensus(spark.createDataFrame([("r", *x) for x in rows], "r string, pos int, token string, n long, ref string"), ["r"]).collect()}
    assert got == {1: ("G", 3, 1, 2, 1), 2: ("C", 2, 1, 1, 0), 3: ("T", 6, 0, 3, 1)}


def test_candidate_sites(spark):
    rows = [(1, "A", 10), (1, "C", 10), (2, "A", 30), (3, "C", 20), (3, "G", 1), (4, "A", 9), (4, "C", 9), (4, "*", 5), (5, "A", 6), (5, "G", 6), (6, "A", 2), (6, "C", 2)]
    x = pileup.candidate_sites(spark.createDataFrame([("r", p, t, n, "C") for p, t, n in rows], "r string, pos int, token string, n long, ref string"), ["r"])
    assert {(s.pos, s.alt, s.kind) for s in x.collect()} == {(1, "A", "het"), (2, "A", "hom")}


def haps_of(spark, strings_, name="read"):
    return spark.createDataFrame([("r", i, s) for i, s in enumerate(strings_)], f"r string, {name} long, hap string")


def test_matching(spark):
    reads, haps = haps_of(spark, ["12x", "1xx", "x21", "222"]), haps_of(spark, ["121", "111"], "id")
    m = haplotypes.match_reads(reads, haps, ["r"])
    assert {(x.read, x.hap) for x in m.collect()} == {(0, "121"), (1, "121"), (1, "111"), (2, "121")}
    assert {(x.read, x.hap) for x in haplotypes.unique_support(m, ["r"]).collect()} == {(0, "121"), (2, "121")}
    assert [x.read for x in haplotypes.shared_reads(m, ["r"]).collect()] == [1]
    close = haplotypes.closest_hap(haps_of(spark, ["122"]), haps_of(spark, ["121", "211"], "id"), ["r"]).collect()
    assert [(x.hap, x.mismatch) for x in close] == [("121", 1)]
    tags = haplotypes.tag_reads(reads, haplotypes.unique_support(m, ["r"]), haplotypes.closest_hap(reads, haps, ["r"]), haplotypes.shared_reads(m, ["r"]), ["r"])
    assert {x.read: x.tag for x in tags.collect()}[1] in ("111", "121")


def test_matches_by_string(spark):
    """Nine sites are two numbers; what follows from the strings is what follows from the reads, and no pair of haplotypes is made."""
    reads = haps_of(spark, ["12xxxxxx1", "12xxxxxx1", "xxxxxxxx2", "xxxxxxxxx", "2xxxxxxx1"])
    haps = haps_of(spark, ["121111111", "12xxxxxx2", "xxxx11xx1", "2xxxxxxxx", "11xxxxxx2"], "id")
    found = {(x.read_hap, x.hap): (x.match, x.mismatch) for x in haplotypes.compared(reads, haps, ["r"]).collect()}
    assert len(found) == 4 * 5 and found["12xxxxxx1", "121111111"] == (3, 0) and found["12xxxxxx1", "11xxxxxx2"] == (1, 2) and found["xxxxxxxxx", "2xxxxxxxx"] == (0, 0)
    m = haplotypes.string_matches(reads, haps, ["r"])
    sole = haplotypes.of_reads(reads, haplotypes.sole_matches(m, ["r"]), ["r"])
    assert {(x.read, x.hap) for x in sole.collect()} == {(4, "xxxx11xx1"), (4, "2xxxxxxxx")}
    old = haplotypes.unique_support(haplotypes.match_reads(reads, haps, ["r"]), ["r"])
    assert {(x.read, x.hap) for x in old.collect()} == {(x.read, x.hap) for x in sole.collect()}
    shared = haplotypes.shared_reads(m, ["r"], "read_hap")
    tags = haplotypes.tag_reads(reads, haplotypes.sole_matches(m, ["r"]), haplotypes.closest_strings(reads, haps, ["r"]), shared, ["r"], "read_hap")
    assert {x.read: x.tag for x in tags.collect()}[3] == "Unassigned"


def test_haps_of_the_tables_have_three_calls(spark):
    from haplospark.plans import analogues

    found = [x.hap for x in analogues.haps(spark, "/root/testdata/sf0.01").collect()]
    assert min(7 - h.count("x") for h in found) == 3


def test_low_support(spark):
    reads = haps_of(spark, ["11"] * 5 + ["22"] * 2 + ["12"])
    assert {x.hap for x in haplotypes.low_support(reads, haps_of(spark, ["11", "22", "12", "21"], "id"), ["r"], 3).collect()} == {"11"}


def test_graph(spark):
    reads = haps_of(spark, ["111"] * 20 + ["222"] * 20 + ["121"])
    edges = graph.edge_counts(reads, ["r"])
    assert {(e.idx, e.src, e.dst): e.n for e in edges.collect()}[0, "1", "1"] == 20
    pruned = graph.prune_edges(edges, ["r"])
    assert {(e.idx, e.src, e.dst) for e in pruned.where("weak").collect()} == {(0, "1", "2"), (1, "2", "1")}
    kept = haps_of(spark, ["11"] * 20 + ["22"] * 20 + ["12"] * 1 + ["21"] * 12)
    weak = graph.prune_edges(graph.edge_counts(kept, ["r"]), ["r"])
    assert {(e.src, e.dst) for e in weak.where("weak").collect()} == {("1", "2")}
    assert {x.hap for x in graph.mask_reads(haps_of(spark, ["12", "11"]), weak, ["r"]).collect()} == {"11"}
    assert {x.path for x in graph.paths(edges, ["r"], 0, 2).collect()} == {"111", "222", "122", "121", "221"}


def test_assembly(spark):
    """Reads that overlap by a site link into two full haplotypes; keys are kept apart."""
    strings_ = ["11xx"] * 6 + ["x11x"] * 6 + ["xx12"] * 6 + ["22xx"] * 6 + ["x22x"] * 6 + ["xx21"] * 6
    reads = haps_of(spark, strings_).unionByName(haps_of(spark, ["12"] * 5).withColumn("r", F.lit("q")))
    assert {(x.r, x.hap) for x in graph.assemble(reads, ["r"]).collect()} == {("r", "1112"), ("r", "2221"), ("q", "12")}
    assert graph.assemble(reads.limit(0), ["r"]).collect() == []


def test_assembly_of_branches(spark):
    """Three haplotypes that share stretches: reads of four sites tell which ends belong together; a fourth region has too few reads to join its halves."""
    true = ["1112211", "1122112", "2211222"]
    windows = [h for t in true for i in range(4) for h in ["x" * i + t[i : i + 4] + "x" * (3 - i)] * 5]
    halves = [h for a, b in [("111", "222"), ("222", "111"), ("112", "221")] for h in [a + "xxx"] * 6 + ["xxx" + b] * 6]
    reads = haps_of(spark, windows).unionByName(haps_of(spark, halves).withColumn("r", F.lit("s")))
    found = {(x.r, x.hap) for x in graph.assemble(reads, ["r"]).collect()}
    assert {h for r, h in found if r == "r"} == set(true)
    assert {h for r, h in found if r == "s"} == {"111xxx", "222xxx", "112xxx", "xxx222", "xxx111", "xxx221"}


def test_alleles(spark):
    links = spark.createDataFrame([("r", "a", "b"), ("r", "b", "c"), ("r", "d", "e"), ("s", "z", "y")], "r string, a string, b string")
    got = {(x.r, x.hap): x.allele for x in alleles.alleles(links, ["r"]).collect()}
    assert got == {("r", "a"): "a", ("r", "b"): "a", ("r", "c"): "a", ("r", "d"): "d", ("r", "e"): "d", ("s", "y"): "y", ("s", "z"): "y"}
    every = spark.createDataFrame([("r", h) for h in "abcde"] + [("s", h) for h in "xyz"], "r string, hap string")
    both = {x.r: x.alleles for x in alleles.filter_alleles(alleles.alleles(links, ["r"]), every, ["r"]).collect()}
    assert both == {"r": [["a", "b", "c"], ["d", "e"]], "s": [["y", "z"], ["x"]]}


def test_runs(spark):
    cls = lambda v: spark.createDataFrame([("r", i, c) for i, c in enumerate(v)], "r string, pos int, cls int")
    assert [tuple(x)[1:] for x in runs.segments(cls([2, 2, 10, 10]), ["r"]).orderBy("first").collect()] == [(0, 2, 2), (2, 4, 10)]
    assert [tuple(x)[1:] for x in runs.segments(cls([10, 2, 10]), ["r"]).collect()] == [(0, 3, 10)]
    split = lambda s: runs.breakpoint(spark.createDataFrame([("r", i, c) for i, c in enumerate(s)], "r string, idx int, symbol string"), ["r"], "1", "2").first().split
    assert split("1112222") == 3 and split("2222111") is None


def test_copy_numbers(spark):
    counts = spark.createDataFrame([("r", "a", 40), ("r", "b", 20), ("s", "a", 21), ("s", "b", 20)], "r string, hap string, n long")
    assert {x.r: x.two_copies for x in copynumber.two_copies_by_reads(counts, ["r"]).collect()} == {"r": True, "s": False}
    rows = [(1, 0, 30, 15.0, False), (2, 0, 30, 15.0, True), (2, 0, 60, 15.0, False), (0, 0, 0, 15.0, False), (2, 1, 30, 15.0, False)]
    x = copynumber.total_copies(spark.createDataFrame(rows, "haps int, two_copy_haps int, depth int, genome_depth double, exempt boolean"))
    assert [r.copies for r in x.collect()] == [4, 2, 4, None, 3]


def test_merged_variants(spark):
    rows = [("r", "h1", 5, "C", "A", "1"), ("r", "h2", 5, "C", "A", "0"), ("r", "h1", 6, "C", "*", "1"), ("r", "h1", 7, "C", "T", ".")]
    x = variants.merged(spark.createDataFrame(rows, "r string, hap string, pos int, ref string, alt string, gt string"), ["r"], ["h1", "h2"])
    assert [tuple(v) for v in x.collect()] == [("r", 5, "C", "A", "PASS", "1", "0")]
