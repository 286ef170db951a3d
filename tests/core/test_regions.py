"""Decision tables on hand-worked rows."""

from pyspark.sql import functions as F

from haplospark.plans import regions as R


def test_clip_classes_and_names(spark):
    rows = [("a", 0, 0), ("b", 100, 900), ("c", 0, 950), ("d", 100, 950), ("e", 100, 0), ("f", None, 0), ("g", 55, 0), ("h", 0, 0)]
    x = spark.createDataFrame([("s", *r) for r in rows], "s string, hap string, c5 int, c3 int")
    x = R.numbered(x.withColumn("cls", R.clip_class(F.col("c5"), F.col("c3"), [100], [900, 950], R.F8_CLASSES)), ["s"], "f8")
    assert {r.hap: r.name for r in x.collect()} == {"a": "f8_int22h2hap1", "h": "f8_int22h2hap2", "b": "f8_int22h1hap1", "c": "f8_int22h3hap1", "d": "f8_int22invhap1", "e": "f8_int22delhap1", "f": "f8_unknownhap1", "g": "f8_unknownhap2"}


def test_f8_events(spark):
    rows = [("int22del", "male", 0.5, 30.0), ("int22del", "male", 12.0, 30.0), ("int22del", "female", 15.0, 30.0), ("int22del", "female", 31.0, 30.0), ("int22inv", None, 0.0, 30.0), ("int22invordup", "male", 0.0, 30.0)]
    x = R.f8_events(spark.createDataFrame(rows, "cls string, sex string, exon_depth double, genome_depth double"))
    assert [r.event for r in x.collect()] == ["deletion", None, "deletion", None, "inversion", None]


def test_hba(spark):
    names = ["hba1", "hba2", "3p7del", "3p7dup", "4p2del", "4p2dup", "homology", "unknown"]
    rows = [((2, 2, 0, 0, 0, 0, 0, 0), 4, None), ((1, 2, 0, 0, 0, 0, 0, 0), 3, None), ((1, 1, 0, 0, 0, 0, 0, 0), 2, 30), ((1, 1, 0, 0, 0, 0, 0, 0), 2, 14), ((0, 0, 1, 0, 0, 0, 0, 0), 1, None), ((1, 1, 0, 0, 1, 0, 0, 0), 3, None)]
    x = spark.createDataFrame([(*c, n, float(d or 0), 30.0 if d else None) for c, n, d in rows], ", ".join(f"n_{n} int" for n in names) + ", n_haps int, around_depth double, genome_depth double")
    assert [(r.hba1, r.hba2, r.del3p7, r.copies) for r in R.hba_copies(x).collect()][:3] == [(2, 2, 0, 4), (2, 2, 0, 4), (2, 2, 0, 4)]
    assert [r.copies for r in R.hba_copies(x).collect()][4:] == [2, 3]


def test_small_tables(spark):
    hap = lambda h: spark.range(1).select(R.tri_class(F.lit(h)).alias("c")).first().c
    assert [hap(h) for h in ("111111", "222222", "111222", "222111")] == ["tri1", "tri3", "tri2", "tri2"]
    x = spark.createDataFrame([(2, 0, 5), (3, 1, 5), (3, 0, 5), (1, 0, 0), (4, 0, 3)], "haps int, two_copies int, het_sites int")
    assert [r.copies for r in R.identical_pairs(x).collect()] == [4, 4, None, 4, 4]
    calls = spark.createDataFrame([("s", "A", 3, {"a": "x"}), ("s", "B", 2, {"b": "y"}), ("t", "A", 2, {"a": "x"})], "s string, region string, copies int, haps map<string,string>")
    assert {r.s: (r.copies, dict(r.haps)) for r in R.cluster(calls, ["s"], "A", "B", "C").collect()} == {"s": (2, {"a": "x", "b": "y"}), "t": (None, {"a": "x"})}


def test_groups_and_clips(spark):
    rows = [("h", "g1", "m1", 1), ("h", "g1", "m2", 5), ("h", "g2", "m3", 9), ("i", "g1", "m1", 4), ("i", "g2", "m3", 5)]
    x = R.best_group(spark.createDataFrame([("s", *r) for r in rows], "s string, hap string, grp string, member string, apart int"), ["s"])
    assert {r.hap: r.grp for r in x.collect()} == {"h": "g1", "i": None}
    sites = spark.createDataFrame([("s", h, 100 * i, c) for h in ("0x12", "1212", "1200", "0012") for i, c in enumerate(h)], "s string, hap string, pos int, symbol string")
    clips = spark.createDataFrame([("s", 150), ("s", 160)], "s string, clip int")
    assert {r.hap: r.clip for r in R.clip_of(sites, ["s"], clips, "5p").collect()} == {"0x12": 150, "1212": 0, "1200": None, "0012": 150}
    assert {r.hap: r.clip for r in R.clip_of(sites, ["s"], clips, "3p").collect()}["1200"] == 150
