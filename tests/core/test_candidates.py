"""Choices among candidates and functions on calls, on small rows with ties, nulls and empty tables."""

from pyspark.sql import functions as F

from haplospark.functions import calls as C
from haplospark.operators import candidates as N


def of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_missing_and_highest_copy_number(spark):
    haps = lambda *x: spark.createDataFrame([("r", h) for h in x], "region string, hap string")
    assert of(N.missing(haps("1122", "12x1"), haps("11", "12", "21", "21"), haps("22", "x1", "11"), ["region"])) == [("r", "left", "21"), ("r", "right", "11")]
    assert N.missing(haps("1122"), haps("1").limit(0), haps("2").limit(0), ["region"]).count() == 0
    # three at sites 1 and 2; those of site 2 have fewer uncalled sites
    assert of(N.highest_copy_number(haps("x11", "122", "21x", "1xx"), ["region"])) == [("r", h, 3) for h in ("122", "21x", "x11")]
    assert N.highest_copy_number(haps("xxx", ""), ["region"]).count() == 0


def test_reduce_candidates(spark):
    candidates = spark.createDataFrame([(k, c) for k in range(5) for c in "ab"], "k int, candidate string")
    rows = [(0, "a", 9)] * 4 + [(0, "b", 3)] * 9  # a wins
    rows += [(1, "a", 9)] * 3 + [(1, "b", 3)] * 9  # too few reads
    rows += [(2, "b", 1)]  # the only one with reads
    rows += [(3, "a", 5)] * 4 + [(3, "b", 5)] * 4  # a tie; nothing supports those of 4
    support = spark.createDataFrame(rows, "k int, candidate string, matches int")
    assert of(N.reduce_candidates(candidates, support, ["k"])) == [(0, "a"), (1, "a"), (1, "b"), (2, "b"), (3, "a"), (3, "b")]
    assert N.reduce_candidates(candidates, support.limit(0), ["k"]).count() == 0


def test_splice_presence_and_names(spark):
    bases = spark.createDataFrame([("s", 1, "C", "A"), ("s", 2, "c", None), ("s", 2, "C", "A"), ("s", 3, "T", "C"), ("s", 4, "T", None), (None, 5, None, None)], "sample string, read int, base string, next string")
    gone = spark.createDataFrame([("s", 1), ("t", 2)], "sample string, n int")
    assert of(N.splice_presence(bases, gone, ["sample"])) == [("s", 2, 1, True, True), ("t", 0, 0, False, True), (None, 0, 0, False, False)]
    x = spark.createDataFrame([("a", True, 5, 7), ("a", False, 1, 2), ("b", True, 5, 7)], "name string, supplementary boolean, start int, size int")
    listed = spark.createDataFrame([("a",), ("a_sup_5_7",), ("b_sup_5_7",), (None,)], "name string")
    assert of(N.read_names(x, listed).select("as")) == [("a",), ("a",), ("a_sup_5_7",), ("b_sup_5_7",)]


def test_ranges_and_codes(spark):
    row = spark.createDataFrame([("x12x", [10, 20, 30, 40], None)], "hap string, at array<int>, none string").select(
        C.hap_range(F.col("hap"), F.col("at"), F.lit(1), F.lit(99)).alias("range"), C.hap_range(F.lit("1221"), F.col("at"), F.lit(1), F.lit(99)).alias("whole"),
        C.confident_range(F.lit(11), F.lit(39), F.col("at"), F.lit(1), F.lit(99), F.lit(False), F.lit(True)).alias("sure"), C.confident_range(F.lit(50), F.lit(60), F.array().cast("array<int>"), F.lit(1), F.lit(99), F.lit(False), F.lit(False)).alias("bare"),
        C.pivot_index(F.array(F.lit("5_A_C"), F.lit("7_A_C"), F.lit("7_A_T")), F.lit(7)).alias("i"), C.pivot_index(F.array(F.lit("5_A_C")), F.lit(7)).alias("none_i"),
        C.reviewed_pathogenic(F.col("none"), F.col("none"), F.lit(True)).alias("p"), C.reviewed_pathogenic(F.lit("Pathogenic"), F.col("none"), F.lit(True)).alias("q"),
    ).first()
    assert tuple(row.range) == (11, 39) and tuple(row.whole) == (1, 99) and tuple(row.sure) == (20, 39) and tuple(row.bare) == (50, 60)
    assert (row.i, row.none_i, row.p, row.q) == (1, -1, False, True)
