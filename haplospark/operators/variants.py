"""Per-haplotype variants and merged tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hap_calls(counts: DataFrame, keys: list[str], least: int = 4, share: float = 0.7) -> DataFrame:
    """counts(keys, hap, pos, call, dp, ad, gt) -> with filter: LowDP below ``least`` reads, LowQual below ``share`` for the call, else PASS; gt is '.' unless PASS."""
    state = F.when(F.col("dp") < least, "LowDP").when(F.col("ad") < share * F.col("dp"), "LowQual").otherwise("PASS")
    return counts.withColumn("filter", state).withColumn("gt", F.when(state == "PASS", F.col("gt").cast("string")).otherwise("."))


def merged(calls: DataFrame, keys: list[str], haps: list[str], low_quality: bool = False) -> DataFrame:
    """calls(keys, hap, pos, ref, alt, gt, filter) -> keys, pos, ref, alt, filter and a column for each haplotype ('.' if it has no call).
    Rows for the reference, * or '.' go; rows without a gt of 1 stay only with ``low_quality``."""
    real = calls.where(~F.col("alt").isin("*", ".") & (F.col("alt") != F.col("ref")))
    at = lambda h: F.coalesce(F.max(F.when(F.col("hap") == h, F.col("gt"))), F.lit("."))
    out = real.groupBy(*keys, "pos", "ref", "alt").agg(F.when(F.max(F.col("gt") == "1"), "PASS").otherwise("LowQual").alias("filter"), *[at(h).alias(h) for h in haps])
    return out if low_quality else out.where("filter = 'PASS'")


def recurrent_events(events: DataFrame, keys: list[str], least: int, most: int = 2, padding: int = 50) -> DataFrame:
    """events(keys, read, start, end) -> the most common spans, with windows of ``padding`` around each end."""
    from pyspark.sql import Window

    n = events.groupBy(*keys, "start", "end").agg(F.count_distinct("read").alias("n")).where(F.col("n") >= least)
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), "start", "end")
    return n.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).withColumn("start_window", F.array(F.col("start") - padding, F.col("start") + padding)).withColumn("end_window", F.array(F.col("end") - padding, F.col("end") + padding))


def region_report(haps: DataFrame, keys: list[str]) -> DataFrame:
    """haps(keys, hap, overlaps, nonfunctional) -> keys, n_haps, n_nonfunctional, n_functional of those that overlap the gene."""
    x = haps.where("overlaps").groupBy(*keys).agg(F.count("*").alias("n_haps"), F.count_if("nonfunctional").alias("n_nonfunctional"))
    return x.withColumn("n_functional", F.col("n_haps") - F.col("n_nonfunctional"))
