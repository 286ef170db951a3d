"""Runs, gaps and anchors along ordered positions, by window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haplospark.operators.spread import dealt


def islands(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """keys, first, last, value, size of each run of equal values."""
    w = Window.partitionBy(*keys).orderBy(order)
    group = F.row_number().over(w) - F.row_number().over(Window.partitionBy(*keys, value).orderBy(order))
    return rows.withColumn("g", group).groupBy(*keys, value, "g").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("size")).drop("g")


def segments(classes: DataFrame, keys: list[str]) -> DataFrame:
    """classes(keys, pos, cls) -> keys, first, last, cls: runs, after a lone 2 between two 10s became 10; last is the position after the run's last gap."""
    w = Window.partitionBy(*keys).orderBy("pos")
    lone = (F.col("cls") == 2) & (F.lag("cls").over(w) == 10) & (F.lead("cls").over(w) == 10)
    fixed = classes.withColumn("fixed", F.when(lone, 10).otherwise(F.col("cls"))).select(*keys, "pos", F.col("fixed").alias("cls"))
    return islands(fixed, keys, "pos", "cls").select(*keys, "first", (F.col("last") + 1).alias("last"), "cls")


def letter_runs(text: Column, letters: str, least: int = 5) -> Column:
    """array<struct<base, size>> of runs of one letter, at least so long, in order of letters."""
    each = [F.transform(F.regexp_extract_all(text, F.lit(f"({c}{{{least},}})"), F.lit(1)), lambda r, c=c: F.struct(F.lit(c).alias("base"), F.length(r).alias("size"))) for c in letters]
    return F.concat(*each)


def gap_fill(het: DataFrame, hom: DataFrame, regions: DataFrame, keys: list[str], gap: int = 10_000, most: int = 10) -> DataFrame:
    """het and hom(keys, pos), regions(keys, start, end) -> hom sites to add: those in a gap wider than ``gap`` between het sites or
    the region's ends, thinned by a stride to ``most`` a gap. Sites meet gaps by bins as wide as ``gap``."""
    ends = regions.select(*keys, F.explode(F.array("start", "end")).alias("pos"))
    w = Window.partitionBy(*keys).orderBy("pos")
    gaps = het.select(*keys, "pos").unionByName(ends).distinct().withColumn("next", F.lead("pos").over(w)).where(F.col("next") - F.col("pos") > gap).select(*keys, F.col("pos").alias("gap_start"), F.col("next").alias("gap_end"))
    binned = gaps.withColumn("bin", F.explode(F.sequence(F.floor(F.col("gap_start") / gap), F.floor(F.col("gap_end") / gap))))
    met = hom.withColumn("bin", F.floor(F.col("pos") / gap)).join(binned, [*keys, "bin"])
    inside = met.where((F.col("pos") > F.col("gap_start")) & (F.col("pos") < F.col("gap_end"))).drop("bin")
    at = Window.partitionBy(*keys, "gap_start")
    x = inside.withColumn("i", F.row_number().over(at.orderBy("pos")) - 1).withColumn("stride", F.ceil(F.count("*").over(at) / most))
    return x.where(F.col("i") % F.col("stride") == 0).select(*keys, "pos", "gap_start", "gap_end")


def clip_anchors(clips: DataFrame, sites: DataFrame, keys: list[str], shift: int = 30) -> DataFrame:
    """clips and sites(keys, pos) -> keys, pos: clip + shift for each clip with no site before the next clip; for the last clip, with none behind it."""
    rows = clips.select(*keys, "pos", F.lit(True).alias("is_clip")).unionByName(sites.select(*keys, "pos", F.lit(False).alias("is_clip"))).distinct()
    w = Window.partitionBy(*keys).orderBy("pos", F.col("is_clip"))
    return rows.withColumn("next_is_clip", F.coalesce(F.lead("is_clip").over(w), F.lit(True))).where(F.col("is_clip") & F.col("next_is_clip")).select(*keys, (F.col("pos") + shift).alias("pos"))


def breakpoint(symbols: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """symbols(keys, idx, symbol) -> keys, split: the index before which ``left`` and from which ``right`` is most frequent; the first such; null at either end."""
    symbols, w = dealt(symbols.select(*keys, "idx", "symbol"), *keys), Window.partitionBy(*keys).orderBy("idx")
    before = F.coalesce(F.sum((F.col("symbol") == left).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum((F.col("symbol") == right).cast("int")).over(w.rowsBetween(0, Window.unboundedFollowing))
    scored = symbols.withColumn("score", before + after).withColumn("last", F.max("idx").over(Window.partitionBy(*keys))).withColumn("start", F.min("idx").over(Window.partitionBy(*keys)))
    best = scored.groupBy(*keys).agg(F.max(F.struct("score", (-F.col("idx")).alias("m"), "start", "last")).alias("b")).withColumn("at", -F.col("b.m"))
    return best.select(*keys, F.when((F.col("at") != F.col("b.start")) & (F.col("at") != F.col("b.last")), F.col("at")).alias("split"))
