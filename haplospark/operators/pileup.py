"""Pile-ups as rows (region, pos, read, token): histograms, consensus, candidate sites, filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def token_histogram(tokens: DataFrame, keys: list[str]) -> DataFrame:
    return tokens.groupBy(*keys, "pos", "token").agg(F.count("*").alias("n"))


def top_tokens(histogram: DataFrame, keys: list[str], most: int = 3) -> DataFrame:
    """The most frequent tokens of a position; ties by token."""
    order = Window.partitionBy(*keys, "pos").orderBy(F.desc("n"), "token")
    return histogram.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def consensus(histogram: DataFrame, keys: list[str]) -> DataFrame:
    """histogram(keys, pos, token, n, ref) -> keys, pos, call, dp, ad_ref, ad, gt. The call has the most reads, then
    is shortest, then equals the reference, then comes first."""
    at = Window.partitionBy(*keys, "pos")
    order = at.orderBy(F.desc("n"), F.length("token"), F.col("token") != F.col("ref"), "token")
    x = histogram.select(*keys, "pos", "token", "n", "ref", F.row_number().over(order).alias("rank"), F.sum("n").over(at).alias("dp"), F.coalesce(F.sum(F.when(F.col("token") == F.col("ref"), F.col("n"))).over(at), F.lit(0)).alias("ad_ref"))
    return x.where("rank = 1").select(*keys, "pos", F.col("token").alias("call"), "dp", "ad_ref", F.col("n").alias("ad"), (F.col("token") != F.col("ref")).cast("int").alias("gt"))


def candidate_sites(histogram: DataFrame, keys: list[str], least_reads: int = 5, least_share: float = 0.11, sure_reads: int = 20, targeted: bool = False, hom_share: float = 0.85) -> DataFrame:
    """histogram(keys, pos, token, n, ref) -> keys, pos, ref, alt, kind (hom or het). A position needs least_reads reads
    and fewer deletions (*) than that. hom: one token besides deletions, or the top one above max(n - 5, 85 %), not
    the reference. het: tokens among the three most frequent other than the reference, with enough reads in number and
    share of the depth (deletions included) or, unless targeted, sure_reads; the reference must be present."""
    at = Window.partitionBy(*keys, "pos")
    plain = F.col("token") != "*"
    x = histogram.withColumn("depth", F.sum("n").over(at)).withColumn("gone", F.coalesce(F.sum(F.when(~plain, F.col("n"))).over(at), F.lit(0)))
    x = x.where((F.col("depth") >= least_reads) & (F.col("gone") < least_reads)).where(plain)
    order = at.orderBy(F.desc("n"), "token")
    x = x.withColumn("rank", F.row_number().over(order)).withColumn("kinds", F.count("*").over(at)).withColumn("called", F.col("depth") - F.col("gone"))
    x = x.withColumn("top_n", F.max("n").over(at)).withColumn("has_ref", F.max(F.col("token") == F.col("ref")).over(at))
    sure = (F.col("kinds") == 1) | (F.col("top_n") > F.greatest(F.col("called") - 5, hom_share * F.col("called")))
    enough = (F.col("n") >= least_reads) & (F.col("n") >= F.col("depth") * least_share)
    if not targeted:
        enough = enough | (F.col("n") >= sure_reads)
    hom = sure & (F.col("rank") == 1)
    het = ~sure & (F.col("rank") <= 3) & enough & F.col("has_ref")
    return x.where((F.col("token") != F.col("ref")) & (hom | het)).select(*keys, "pos", "ref", F.col("token").alias("alt"), F.when(sure, "hom").otherwise("het").alias("kind"), "n")


def drop_multiallelic(sites: DataFrame, keys: list[str], kept: list[int] | None = None) -> DataFrame:
    """Positions with one alternative stay; of a position in ``kept`` the first stays."""
    at = Window.partitionBy(*keys, "pos")
    x = sites.withColumn("alts", F.count("*").over(at)).withColumn("first", F.row_number().over(at.orderBy("alt")) == 1)
    return x.where((F.col("alts") == 1) | (F.col("pos").isin(kept or []) & F.col("first"))).drop("alts", "first")


def previous_flag(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose read has no insertion or deletion in the column before."""
    before = F.lag(F.col("token").rlike(r"^[*+-]")).over(Window.partitionBy(*keys, "read").orderBy("pos"))
    return tokens.withColumn("before", before).where(F.coalesce(~F.col("before"), F.lit(True))).drop("before")


def read_quality(reads: DataFrame, mapq: int = 50, length: int = 800, mismatch: float = 0.05) -> DataFrame:
    return reads.where((F.col("mapq") >= mapq) & (F.col("aligned") >= length) & (F.col("nm") < F.col("ref_length") * mismatch))


def split_homopolymer_sites(sites: DataFrame, masks: DataFrame, keys: list[str]) -> DataFrame:
    """sites(keys, pos, ref, alt), masks(keys, pos, bases 'A,C' or with '1') -> with use: phase, report or null (dropped).
    In a masked position a substitution is dropped if its base is in the mask; else it is reported only, and also
    phased if the mask holds 1."""
    joined = sites.join(masks.select(*keys, "pos", F.split("bases", ",").alias("mask")), [*keys, "pos"], "left")
    use = F.when(F.col("mask").isNull(), "phase").when(F.array_contains("mask", F.col("alt")), None).when(F.array_contains("mask", F.lit("1")), "phase").otherwise("report")
    return joined.withColumn("use", use).drop("mask")


def genotype_in_haps(support: DataFrame, keys: list[str]) -> DataFrame:
    """support(keys, hap, site, call, unique_reads, shared_reads), call ref, alt or other -> keys, hap, site, genotype: 1 where most reads have alt, 0 where most have
    ref, else ``.``. Unique reads count, with shared ones where fewer than 3 are unique; 3 are needed, and the runner-up may have 15 % of the
    top and 2 at most."""
    at = Window.partitionBy(*keys, "hap", "site")
    n = F.when(F.sum("unique_reads").over(at) < 3, F.col("unique_reads") + F.col("shared_reads")).otherwise(F.col("unique_reads"))
    order = at.orderBy(F.desc("n"), "call")
    x = support.withColumn("n", n).withColumn("rank", F.row_number().over(order)).withColumn("total", F.sum("n").over(at)).withColumn("second", F.coalesce(F.lead("n").over(order), F.lit(0)))
    sure = (F.col("total") >= 3) & (F.col("second") <= F.least(0.15 * F.col("n"), F.lit(2)))
    return x.where("rank = 1").select(*keys, "hap", "site", F.when(sure & (F.col("call") == "alt"), "1").when(sure & (F.col("call") == "ref"), "0").otherwise(".").alias("genotype"))
