"""Matches of reads and haplotypes: far more rows than reads, so they are made last, from reads that were encoded once."""

from haplospark.entry import QUERIES
from haplospark.operators import haplotypes
from haplospark.plans import analogues

DATA = "/root/testdata/sf0.001"


def of(df):
    return sorted(map(tuple, df.collect()))


def test_reads_are_encoded_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(analogues, "symbols", lambda *a, f=analogues.symbols: made.append(a) or f(*a))
    found = QUERIES["hap_match"](spark, DATA)
    assert len(made) == 1 and not [f for f in found.inputFiles() if "lineitem" in f]
    assert found.count() == 4178


def test_matches_are_made_after_the_join(spark, monkeypatch):
    """Folded matches go to all tasks while they are small; beyond that reads meet them by a shuffle, with the same rows."""
    reads = [("r", 1, "12xxxxxx1"), ("r", 2, "12xxxxxx1"), ("r", 3, "xxxxxxxx2"), ("r", 4, "xxxxxxxxx"), ("q", 1, "2xxxxxxx1"), ("q", 1, "2xxxxxxx1"), (None, 5, "12xxxxxx1")]
    haps = [("r", "121111111"), ("r", "121111111"), ("r", "1xxxxxxxx"), ("r", "12xxxxxx2"), ("q", "2xxxxxxxx"), ("q", "1xxxxxxx1"), (None, "121111111")]
    reads, haps = spark.createDataFrame(reads, "k string, read int, hap string"), spark.createDataFrame(haps, "k string, hap string")
    found = haplotypes.match_reads(reads, haps, ["k"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan and plan.index("Generate explode") < plan.index("Join Inner")
    assert found.rdd.getNumPartitions() == 4
    monkeypatch.setattr(haplotypes, "BROADCAST_BYTES", 1)
    other = haplotypes.match_reads(reads, haps, ["k"])
    assert "strategy=broadcast" not in other._jdf.queryExecution().optimizedPlan().toString()
    long, short = "12xxxxxx1", "2xxxxxxx1"
    wanted = [("r", i, long, h, n) for i in (1, 2) for h, n in (("121111111", 3), ("1xxxxxxxx", 1))] + [("r", 3, "xxxxxxxx2", "12xxxxxx2", 1)] + [("q", 1, short, "2xxxxxxxx", 1)] * 2
    assert of(found) == of(other) == sorted(wanted)
    assert haplotypes.match_reads(reads, haps.limit(0), ["k"]).collect() == haplotypes.match_reads(reads.limit(0), haps, ["k"]).collect() == []
