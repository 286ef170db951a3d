"""Masks of sequence, directed links and haplogroups on small rows; expected values worked out by hand."""

from pyspark.sql import functions as F

from haplospark.operators import alleles as A
from haplospark.operators import haplogroups as N
from haplospark.operators import masks as M
from haplospark.operators import pileup as P


def bases(spark, **texts):
    return spark.createDataFrame([(r, i, c) for r, text in texts.items() for i, c in enumerate(text)], "region string, pos long, base string")


def marked(df):
    found = {}
    for x in df.collect():
        found.setdefault(x.region, {}).setdefault(x.label, set()).add(x.pos)
    return {r: {k: sorted(v) for k, v in m.items()} for r, m in found.items()}


def span(first, last):
    return list(range(first, last + 1))


def test_homopolymers(spark):
    texts = {
        "plain": "CAAAAAGT",  # one run
        "end": "CCGAAAAA",  # its last base is never looked at
        "near": "GAAAACCAAAAATG",  # four, two others between, five
        "far": "GAAAACCCCCAAAAATG",  # five between make a run of their own and part the two
        "two": "GAAAACGAAAAATG",  # what lies between is of two kinds
        "chain": "CAAAAAGAAAATTTTAAAACAAAATG",  # each four leans on the one before
        "left": "CGGGGGTGGGGTTTGGGGA",
        "gap": "CAAAAGAAAAC",  # fours alone
    }
    found = marked(M.homopolymers(bases(spark, **texts), ["region"]))
    assert found["plain"] == {"A": span(1, 5)} and "end" not in found and "gap" not in found
    assert found["near"] == {"A": span(1, 11)}
    assert found["far"] == {"A": span(10, 14), "C": span(5, 9)}
    assert found["two"] == {"A": span(7, 11)}
    assert found["chain"] == {"A": span(1, 23)}
    assert found["left"] == {"G": span(1, 17)}


def test_positions_that_are_missing_or_in_other_tiles(spark):
    at = M.TILE - 3
    x = spark.createDataFrame([("r", at + i, c) for i, c in enumerate("CAAAAACCAAAAGT")] + [("s", at + i, "a") for i in (0, 1, 2, 4, 5, 6)] + [("s", at + 9, None)], "region string, pos long, base string")
    assert marked(M.homopolymers(x, ["region"])) == {"r": {"A": span(at + 1, at + 11)}}
    assert M.homopolymers(x.limit(0), ["region"]).count() == 0


def test_dinucleotides(spark):
    texts = {"plain": "GGACACACACGG", "three": "GGACACACGG", "near": "GGACACACACTGTGACACGG", "apart": "GGACACACACTTGTACACGG", "close": "GGACACACACGACACGG"}
    found = marked(M.dinucleotides(bases(spark, **texts), ["region"]))
    assert found["plain"] == {"AC": span(2, 9), "CA": span(3, 8)} and "three" not in found
    assert found["near"]["AC"] == span(2, 17)  # TGTG between alternates
    assert found["apart"]["AC"] == span(2, 9)  # TTGT doubles a base
    assert found["close"]["AC"] == span(2, 14)  # one base between


def test_sequence_masks(spark):
    found = {x.pos: x["mask"] for x in M.sequence_masks(bases(spark, r="GCAAAAAGTACACACACTT"), ["region"]).collect()}
    assert found == {1: "A", 2: "A,C,G,T", **{i: "A" for i in span(3, 6)}, 7: "A,1", **{i: "A,C" for i in span(9, 16)}}


SEGMENTS = "region string, read int, seq int, haps array<string>, hap string"


def test_directed_links(spark):
    rows = [
        ("r", 1, 1, ["a"], "x11"), ("r", 1, 2, ["b"], "11x"),  # a's end joins b's start
        ("r", 2, 1, ["b"], "11x"), ("r", 2, 2, ["a"], "x11"),  # the other order of the same
        ("r", 3, 1, ["a"], "x11"), ("r", 3, 2, ["b", "c"], "11x"),  # c may be meant
        ("r", 4, 1, ["a", "b"], "x11"), ("r", 4, 2, ["b", "c"], "11x"),  # both may be others
        ("r", 5, 1, ["a"], "x1x"), ("r", 5, 2, ["b"], "11x"),  # no end tells
        ("r", 6, 1, ["c"], "x11"), ("r", 6, 2, ["c"], "11x"), ("r", 7, 1, ["a"], "111"),
        ("r", 8, 1, ["a"], "x11"), ("r", 8, 2, ["b"], "11x"), ("r", 8, 3, ["b"], "11x"),  # a read counts once, its pairs twice
    ]
    x = spark.createDataFrame(rows, SEGMENTS)
    found = {(r.kind, r.a, r.b): r.n for r in A.directed_links(x, ["region"], F.lit(False)).collect()}
    assert found == {("undirected", "a", "b"): 3, ("undirected", "b", "a"): 1, ("directed", "a", "b"): 4, ("loose", "a", "b"): 5, ("loose", "a", "c"): 1}
    turned = spark.createDataFrame([("r", 1, 1, ["a"], "11x"), ("r", 1, 2, ["b"], "1x1"), ("r", 2, 1, ["a"], "11x"), ("r", 2, 2, ["c"], "xx1")], SEGMENTS)
    found = {(r.kind, r.a, r.b): r.n for r in A.directed_links(turned, ["region"], F.lit(True)).collect()}
    assert found == {("undirected", "a", "b"): 1, ("undirected", "a", "c"): 1, ("directed", "a", "b"): 1, ("loose", "a", "b"): 1}
    assert A.directed_links(x.limit(0), ["region"], F.lit(False)).count() == 0


def test_phase_alleles(spark):
    link = lambda r, a, b, n: [(r, 10 * i + ord(a) + 1000 * ord(b), s, [h], "x11" if s == 1 else "11x") for i in range(n) for s, h in ((1, a), (2, b))]
    rows = link("two", "a", "b", 2) + link("two", "c", "d", 3) + link("weak", "a", "b", 1) + link("one", "a", "b", 2) + link("odd", "a", "b", 2) + link("odd", "b", "c", 2)
    haps = spark.createDataFrame([(r, h) for r, names in (("two", "abcd"), ("weak", "ab"), ("one", "abc"), ("odd", "abcde")) for h in names], "region string, hap string")
    phase = lambda **more: {x.region: x.alleles for x in A.phase_alleles(spark.createDataFrame(rows, SEGMENTS), haps, ["region"], F.lit(False), **more)[0].collect()}
    assert phase() == {"two": [["a", "b"], ["c", "d"]], "weak": None, "one": [["a", "b"], ["c"]], "odd": None}
    gone = spark.createDataFrame([("odd", "e"), ("two", "d")], "region string, hap string")
    assert phase(excluded=gone) == {"two": [["a", "b"], ["c"]], "weak": None, "one": [["a", "b"], ["c"]], "odd": [["a", "b", "c"], ["d"]]}


def test_haplogroups(spark):
    queries = spark.createDataFrame([("q", 0, 20_000), ("short", 0, 11_000)], "hap string, start long, end long")
    known = spark.createDataFrame([("k1", "S1", 5_000, 30_000), ("k2", "S1", 0, 20_000), ("k3", "S2", 0, 20_000), ("k4", "S2", 9_000, 40_000)], "name string, haplogroup string, start long, end long")
    mine = spark.createDataFrame([("q", p, "A") for p in (100, 6_000, 7_000)], "hap string, pos long, variant string")
    theirs = [("k1", 6_000, "A"), ("k1", 7_000, "A"), ("k1", 25_000, "T"), ("k2", 100, "A"), ("k2", 6_000, "G")] + [("k3", p, "C") for p in range(0, 2_000, 100)]
    found = N.haplogroup_distances(queries, known, mine, spark.createDataFrame(theirs, "name string, pos long, variant string"))
    # k1 is compared from 5,000 on; k2 lacks two and has one of its own; k3 shares nothing; k4 overlaps too little
    assert {(x.hap, x.name): x.distance for x in found.collect()} == {("q", "k1"): 0, ("q", "k2"): 3, ("q", "k3"): 23}
    assert [tuple(x) for x in N.best_haplogroup(found).collect()] == [("q", "S1")]
    assert [tuple(x) for x in N.best_haplogroup(found.where("name <> 'k2'")).collect()] == [("q", None)]  # one member alone
    assert [tuple(x) for x in N.best_haplogroup(found.where("haplogroup = 'S1'")).collect()] == [("q", None)]  # nothing to compare with
    near = found.withColumn("distance", F.when(F.col("name") == "k3", 2).otherwise(F.col("distance")))
    assert [tuple(x) for x in N.best_haplogroup(near).collect()] == [("q", None)]


def test_genotypes_in_haps(spark):
    rows = [
        ("a", "alt", 3, 0), ("b", "ref", 20, 0), ("b", "alt", 2, 9), ("c", "ref", 12, 0), ("c", "alt", 2, 0), ("d", "alt", 2, 0), ("e", "alt", 2, 1), ("e", "ref", 0, 0),
        ("f", "other", 9, 0), ("f", "alt", 1, 0), ("g", "alt", 2, 5), ("g", "ref", 0, 5),
    ]
    x = spark.createDataFrame([("r", h, 1, c, u, s) for h, c, u, s in rows], "region string, hap string, site int, call string, unique_reads long, shared_reads long")
    # c: two of twelve are more than 15 %; d: too few; e: with its shared read; f: the winner is neither; g: shared reads divide it
    assert {v.hap: v.genotype for v in P.genotype_in_haps(x, ["region"]).collect()} == {"a": "1", "b": "0", "c": ".", "d": ".", "e": "1", "f": ".", "g": "."}


def test_growth_broadcasts_no_more_than_its_bound(spark, monkeypatch):
    """Joins of the growth shuffle beyond BROADCAST_ROWS, however small the files are, with the same rows."""
    rows = bases(spark, r="GCAAAAAGTACACACACTTAAAACCAAAAGAAAAATCACACACGGCACATT", s="ACACACACACTTCACACGACAC")
    expect = [sorted(map(tuple, f(rows, ["region"]).collect())) for f in (M.homopolymers, M.dinucleotides, M.sequence_masks)]
    plans, seen = [], M.written

    def kept(df, name):
        plans.append((name, df._jdf.queryExecution().sparkPlan().toString()))
        return seen(df, name)

    monkeypatch.setattr(M, "written", kept)
    monkeypatch.setattr(M, "BROADCAST_ROWS", 0)
    found = [sorted(map(tuple, f(rows, ["region"]).collect())) for f in (M.homopolymers, M.dinucleotides, M.sequence_masks)]
    assert found == expect and all(map(len, found))
    assert any(name == "reached" for name, _ in plans)
    assert not [name for name, plan in plans if name in ("marks", "reached") and "Broadcast" in plan]
