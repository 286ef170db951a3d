"""Copy numbers from read counts and depths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haplospark.functions.stats import depth_posterior
from haplospark.operators.alleles import split_by_depth


def two_copies_by_reads(counts: DataFrame, keys: list[str], cutoff: float = 0.05, least: int = 10) -> DataFrame:
    """counts(keys, hap, n) -> keys, hap, p1, two_copies: the top haplotype has two copies if the second has reads enough and
    one copy is unlikely given the second's reads as the haploid depth."""
    top = split_by_depth(counts, keys)
    p1 = F.element_at(depth_posterior(F.col("n"), F.col("second").cast("double")), 1)
    return top.withColumn("p1", p1).withColumn("two_copies", F.coalesce((F.col("p1") < cutoff) & (F.col("second") >= least), F.lit(False)))


def two_copies_by_sites(sites: DataFrame, keys: list[str], share: float = 0.6, least: int = 5) -> DataFrame:
    """sites(keys, hap, site, own, others, other_copies) -> keys, hap: reads on sites private to a haplotype against those of the others. A
    site speaks for two copies if P(1) < 0.25; so must ``share`` of at least ``least`` sites; only if one haplotype wins."""
    p1 = F.element_at(depth_posterior(F.col("own"), F.col("others") / F.col("other_copies")), 1)
    votes = sites.groupBy(*keys, "hap").agg(F.count(p1).alias("n"), F.count_if(p1 < 0.25).alias("yes"))
    won = votes.where((F.col("n") >= least) & (F.col("yes") >= share * F.col("n")))
    return won.withColumn("winners", F.count("*").over(Window.partitionBy(*keys))).where("winners = 1").select(*keys, "hap")


def total_copies(regions: DataFrame) -> DataFrame:
    """regions(haps, two_copy_haps, depth, genome_depth, exempt) with counts -> also copies: haplotypes and their second copies; one
    haplotype alone is 2; 2 becomes 4 where the depth says so, unless exempt; 1 or less is unknown (null)."""
    base = F.when(F.col("haps") == 1, 2).otherwise(F.col("haps") + F.col("two_copy_haps"))
    p1 = F.element_at(depth_posterior(F.col("depth"), F.col("genome_depth")), 1)
    doubled = F.when((base == 2) & ~F.col("exempt") & (p1 < 0.75), 4).otherwise(base)
    return regions.withColumn("copies", F.when(doubled > 1, doubled))


def gene_assignment(haps: DataFrame, own: str = "1", deleted: str = "3") -> DataFrame:
    """haps(hap, pivot symbol) -> gene: by the pivot's symbol."""
    return haps.withColumn("gene", F.when(F.col("pivot") == own, "gene1").when(F.col("pivot") == deleted, "gene2_deletion").otherwise("gene2"))


def allele_annotation(found: DataFrame, keys: list[str]) -> DataFrame:
    """found(keys, allele, n copies, variants array) -> keys, annotation for an array of two alleles: WT, deletion or duplication by the number of copies."""
    kind = F.when(F.col("n") == 1, "deletion").when(F.col("n") == 2, F.when(F.size("variants") == 0, "WT").otherwise(F.array_join(F.array_sort("variants"), ","))).otherwise("duplication")
    return found.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(kind)), "/").alias("annotation"))


def update_from_region(calls: DataFrame, keys: list[str], target: str, source: str, column: str) -> DataFrame:
    """A region's column where another region of the same sample has a value for it."""
    w = Window.partitionBy(*keys)
    other = F.max(F.when(F.col("region") == source, F.col(column))).over(w)
    return calls.withColumn(column, F.when((F.col("region") == target) & other.isNotNull(), other).otherwise(F.col(column)))
