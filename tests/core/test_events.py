"""Evidence of alignments on small rows, with borders, nulls, repeated rows and empty tables."""

from pyspark.sql import functions as F

from haplospark.operators import events as E


def of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_cigar_blocks(spark):
    made = spark.createDataFrame([("2S3M1I4D2M5H", 10), ("", 1), (None, 1)], "cigar string, start int").select(E.cigar_blocks(F.col("cigar"), F.col("start")).alias("b")).collect()
    assert [tuple(b) for b in made[0].b] == [("S", 2, 10, 0), ("M", 3, 10, 2), ("I", 1, 13, 5), ("D", 4, 13, 6), ("M", 2, 17, 6), ("H", 5, 19, 8)]
    assert made[1].b == [] and made[2].b is None


def test_clip_sites_are_apart_and_off_known_ones(spark):
    rows = [("r", p, p + 50, "900S50M") for p in (2000, 2100, 2101, 2250, 3000) for _ in range(6)] + [("r", 2600, 2650, "900S50M")] * 5 + [("r", 2700, 2750, "799S50M")] * 9
    x = spark.createDataFrame(rows + [("r", None, None, None)], "region string, start int, end int, cigar string")
    regions = spark.createDataFrame([("r", 0, 9000)], "region string, left int, right int")
    known = spark.createDataFrame([("r", "5p", 3100, 3100), ("r", "3p", 2000, 2000)], "region string, side string, first int, last int")
    # 2100 is not more than 100 behind 2000; a known site ahead by 100 is out of reach
    assert of(E.clip_sites(x, regions, known, ["region"])) == [("r", "5p", p, 6) for p in (2000, 2101, 2250, 3000)]
    near = known.withColumn("first", F.col("first") - 1).withColumn("last", F.col("first"))
    assert of(E.clip_sites(x, regions, near, ["region"])) == [("r", "5p", p, 6) for p in (2000, 2101, 2250)]
    assert E.clip_sites(x.limit(0), regions, known, ["region"]).count() == 0


def test_long_deletion_reads(spark):
    deletions = spark.createDataFrame([("r", 5000, 5100, 6000, 6100, 1000), ("s", 5000, 5100, 6000, 6100, 1000)], "region string, p3_1 int, p3_2 int, p5_1 int, p5_2 int, size int")
    rows = [("r", "both", 3000, 5050, "2050M400S"), ("r", "both", 6050, 8000, "400S1950M"), ("r", "left", 3000, 5050, "2050M300S"), ("r", "short", 3000, 5050, "2050M299S"), ("r", "whole", 4000, 7100, "1000M1049D1051M"),
            ("r", "other", 4000, 7100, "1000M1050D1050M"), ("s", "left", 3000, 5050, "2050M400S"), ("s", "bare", 5200, 5300, "100M")]
    x = spark.createDataFrame(rows, "region string, read string, start int, end int, cigar string")
    found = of(E.long_deletion_reads(x, deletions, ["region"]))
    # a deletion in the CIGAR is run through as well; in s no read is clipped at the other side
    assert found == [("r", "both", True, True, False), ("r", "left", False, True, False), ("r", "other", False, False, True), ("r", "whole", True, True, True)]


def test_variant_reads_and_flanks(spark):
    tokens = spark.createDataFrame([("r", 1, "a", "c"), ("r", 1, "b", "C+2AT"), ("r", 1, "b", "T"), ("r", 1, "d", "*"), ("r", 2, "a", "A"), ("r", 1, "e", None)], "region string, pos int, read string, token string")
    variants = spark.createDataFrame([("r", 1, "C", "CAT"), ("r", 1, "C", "CAT"), ("q", 2, "A", "T")], "region string, pos int, ref string, alt string")
    assert of(E.variant_reads(tokens, variants, ["region"]).select("read", "call")) == [("a", "ref"), ("b", "alt"), ("d", "."), ("e", ".")]
    regions = spark.createDataFrame([("c", "region1", 20_000, 30_000, "5p", "3p"), ("c", "region2", 40_000, 50_000, "3p", "5p")], "chrom string, name string, first int, last int, before string, after string")
    reads = spark.createDataFrame([("c", "a", 14_999, 20_000), ("c", "b", 15_000, 20_000), ("c", "a", 29_000, 55_001), ("c", "d", 1, 19_999)], "chrom string, read string, start int, end int")
    assert [(r.read, r.side, r.names) for r in E.flank_regions(reads, regions, ["chrom"]).orderBy("side").collect()] == [("a", "3p", ["region1", "region2"]), ("a", "5p", ["region1", "region2"])]


def test_position_match(spark):
    x = spark.createDataFrame([("b", 0, "1S2M", 50, 60, False, True), ("a", 1, "2M", 70, 80, True, True), ("a", 0, "9M", 1, 9, False, False)], "name string, start int, cigar string, first int, last int, reverse boolean, primary boolean")
    assert of(E.position_match(x, 10)) == [(10, 51), (11, 52), (12, 79)]


def test_spurious_and_variants(spark):
    haps = spark.createDataFrame([("r", "111111", 9), ("r", "111112", 5), ("r", "111121", 5), ("r", "11112x", 6), ("q", "111112", 1)], "region string, hap string, n int")
    flanks = spark.createDataFrame([("r", "111111", 5, "ACG"), ("r", "111112", 5, "ACG"), ("r", "111121", 4, "TTT"), ("r", "111111", 4, "GGG"), ("r", "111121", 0, "A"), ("r", "111111", 0, "A"), ("q", "111112", 5, "ACG")], "region string, hap string, idx int, flank string")
    assert of(E.without_spurious(haps, flanks, ["region"])) == [("q", "111112", 1), ("r", "111111", 9), ("r", "111121", 5), ("r", "11112x", 6)]
    assert E.without_spurious(haps, flanks.limit(0), ["region"]).count() == 5
    homs = spark.createDataFrame([("r", 15, "15_G_T"), ("r", 31, "31_G_T"), ("r", 31, "31_G_T")], "region string, pos int, code string")
    strings = spark.createDataFrame([("r", "x2x"), ("r", "211"), ("q", "1xx")], "region string, hap string")
    sites = [(10, "10_A_C"), (20, "20_A_C"), (30, "30_A_C")]
    found = of(E.variants_of_haps(strings, sites, homs, ["region"], 1, 40))
    assert found == [("q", "1xx", 1, 19, []), ("r", "211", 1, 40, ["10_A_C", "15_G_T", "31_G_T"]), ("r", "x2x", 11, 29, ["15_G_T", "20_A_C"])]
