"""Queries that do the whole job, and steps that spread it over tasks."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from haplospark.entry import ORACLE_SQL, QUERIES
from haplospark.operators import alleles, events, intervals, runs, spread
from haplospark.plans import analogues

DATA = "/root/testdata/sf0.001"


def rows(found) -> list[str]:
    columns = sorted(found.columns)
    return sorted(repr([str(r[c]) for c in columns]) for r in found.collect())


def by_sql(name: str) -> list[str]:
    db = duckdb.connect()
    for file in os.listdir(DATA):
        db.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{DATA}/{file}'")
    cursor = db.execute(ORACLE_SQL[name])
    at = sorted(range(len(cursor.description)), key=lambda i: cursor.description[i][0])
    return sorted(repr([str(r[i]) for i in at]) for r in cursor.fetchall())


def test_unique_support_of_three_calls(spark):
    found = QUERIES["unique_support"](spark, DATA)
    assert min(len(r.hap.replace("x", "")) for r in found.collect()) == 3
    assert rows(found) == by_sql("unique_support")


def test_deletions_of_few_keys_go_to_all_tasks(spark, monkeypatch):
    al = spark.createDataFrame([("a", 1, 500, 3500, "1000M300D1700M"), ("a", 2, 4000, 4100, "100M"), ("b", 3, 900, 2300, "1400M300S")], "k string, read int, start int, end int, cigar string")
    gone = spark.createDataFrame([(k, 1400, 1600, 1700, 1900, 300) for k in "ab"], "k string, p3_1 int, p3_2 int, p5_1 int, p5_2 int, size int")
    found = events.long_deletion_reads(al, gone, ["k"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
    monkeypatch.setattr(spread, "BROADCAST_ROWS", 1)
    other = events.long_deletion_reads(al, gone, ["k"])
    assert "strategy=broadcast" not in other._jdf.queryExecution().optimizedPlan().toString()
    assert rows(found) == rows(other) and ("a", 1, True, True) in [(r.k, r.read, r.full, r.partial) for r in found.collect()]


def spread_over(found) -> int:
    return found.rdd.getNumPartitions()


def test_segments_of_reads_stay_dealt(spark):
    one = spark.createDataFrame([("r", i % 3, i, f"h{i}") for i in range(9)], "region string, read int, seq int, hap string")
    assert spread_over(alleles.read_pairs(one, ["region"])) == 4


def test_links_count_over_dealt_segments(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(alleles, "dealt", lambda rows, *keys: asked.append(keys) or spread.dealt(rows, *keys))
    x = spark.createDataFrame([(1, 1, i, [f"h{i}"], "121") for i in range(3)], "region int, read int, seq int, haps array<string>, hap string")
    haps = spark.createDataFrame([(1, f"h{i}") for i in range(3)], "region int, hap string")
    found, links = alleles.phase_alleles(x, haps, ["region"], F.lit(False), 1, haps.where("hap = 'h2'"))
    assert ("region", "read") in asked and asked.count(("region",)) == 2
    assert [r.alleles for r in found.collect()] == [[["h0", "h1"]]]


def test_symbols_and_breakpoints_stay_dealt(spark):
    assert spread_over(analogues.reads(spark, DATA)) == spread_over(analogues.spans(spark, DATA)) == 4
    symbols = spark.createDataFrame([("a", i, s) for i, s in enumerate("1122")], "k string, idx int, symbol string")
    found = runs.breakpoint(symbols, ["k"], "1", "2")
    assert spread_over(found) == 4 and [r.split for r in found.collect()] == [2]


@pytest.mark.parametrize("name", ["called_fusions", "sites_for_phasing"])
def test_dealt_queries_equal_sql(spark, name):
    found = QUERIES[name](spark, DATA)
    assert "RepartitionByExpression" in found._jdf.queryExecution().analyzed().toString()
    assert rows(found) == by_sql(name)


def test_regions_of_one_start_are_one(spark):
    reads = spark.createDataFrame([("1", 5, 1, 20), ("1", 6, 25, 27), ("1", 7, 50, 60)], "chrom string, read int, start int, end int")
    regions = spark.createDataFrame([("1", 3, 6), ("1", 3, 26), ("1", 3, 6)], "chrom string, start int, end int")
    found = intervals.overlapping(reads, regions, 10)
    assert "max(end" in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.read for r in found.collect()) == [5, 6]
