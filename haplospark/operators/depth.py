"""Depth of coverage: summaries, gates and sex."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haplospark.functions.stats import sex_of


def control_positions(regions: DataFrame, keys: list[str], n: int = 100) -> DataFrame:
    """regions(keys, start, end) -> keys, pos: about n even steps through each."""
    step = F.greatest(F.lit(1), F.floor((F.col("end") - F.col("start")) / n)).cast("long")
    return regions.select(*keys, F.explode(F.sequence(F.col("start"), F.col("end"), step)).alias("pos"))


def depth_summary(depths: DataFrame, keys: list[str]) -> DataFrame:
    """keys, median and 80th percentile."""
    return depths.groupBy(*keys).agg(F.median("depth").alias("median_depth"), F.percentile("depth", F.lit(0.8)).alias("p80_depth"))


def median_mad(depths: DataFrame, keys: list[str]) -> DataFrame:
    """keys, median, and the median absolute deviation over the median (null for median 0)."""
    middle = depths.groupBy(*keys).agg(F.median("depth").alias("median_depth"))
    off = depths.join(middle, keys).select(*keys, "median_depth", F.abs(F.col("depth") - F.col("median_depth")).alias("off"))
    return off.groupBy(*keys, "median_depth").agg(F.try_divide(F.median("off"), F.col("median_depth")).alias("mad_ratio"))


def genome_gate(summary: DataFrame, least: float = 10, most_mad: float = 0.25) -> DataFrame:
    """Depth, or null where it is too low or too uneven to use."""
    return summary.withColumn("usable_depth", F.when((F.col("median_depth") >= least) & (F.col("mad_ratio") <= most_mad), F.col("median_depth")))


def coverage_gate(summary: DataFrame) -> DataFrame:
    """callable: false without depth, or where the median is 8 or less and the 80th percentile below 50."""
    low = F.col("median_depth").isNull() | ((F.col("median_depth") <= 8) & (F.col("p80_depth") < 50))
    return summary.withColumn("callable", ~low)


def sex(depths: DataFrame, keys: list[str]) -> DataFrame:
    """depths(keys, chrom, depth) with chrom X and Y -> keys, x_depth, y_depth, sex."""
    of = lambda c: F.median(F.when(F.col("chrom") == c, F.col("depth")))
    return depths.groupBy(*keys).agg(of("X").alias("x_depth"), of("Y").alias("y_depth")).withColumn("sex", sex_of(F.col("x_depth"), F.col("y_depth")))
