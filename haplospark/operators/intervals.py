"""Joins of intervals with points and intervals, by bins instead of nested loops."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def depth_at_positions(intervals: DataFrame, positions: DataFrame, keys: list[str], width: int) -> DataFrame:
    """intervals(keys, start, end), positions(keys, pos) -> keys, pos, depth: intervals with
    start < pos <= end; 0 where there is none. Equal intervals are counted before the join, each interval
    goes to the bins it touches, and a point is in one bin, so nothing meets twice."""
    counted = intervals.where("start < end").groupBy(*keys, "start", "end").agg(F.count("*").alias("n"))
    bins = F.sequence(F.floor((F.col("start") + 1) / width), F.floor(F.col("end") / width))
    placed = counted.withColumn("bin", F.explode(bins))
    points = positions.select(*keys, "pos").distinct().withColumn("bin", F.floor(F.col("pos") / width))
    right = placed.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("bin").alias("_bin"), "start", "end", "n")
    on = (F.col("bin") == F.col("_bin")) & (F.col("start") < F.col("pos")) & (F.col("end") >= F.col("pos"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    return points.join(right, on, "left").groupBy(*keys, "pos").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("depth"))


def as_of_forward(left: DataFrame, right: DataFrame, keys: list[str], within: int, value: str) -> DataFrame:
    """left(keys, pos), right(keys, pos, value) -> each left row with the value at the first right position in
    [pos, pos + within). Both sides share one sort by (keys, block of positions); a block also gets the right
    rows of the next one, so long contigs split over many tasks."""
    block = lambda p: F.floor(p / within)
    rows = right.groupBy(*keys, "pos").agg(F.min(value).alias(value))
    copies = rows.withColumn("block", F.explode(F.array(block(F.col("pos")), block(F.col("pos")) - 1))).withColumn("side", F.lit(1))
    asked = left.select(*keys, "pos").distinct().withColumn(value, F.lit(None).cast(right.schema[value].dataType)).withColumn("block", block(F.col("pos"))).withColumn("side", F.lit(0))
    both = asked.unionByName(copies)
    ahead = Window.partitionBy(*keys, "block").orderBy("pos").rangeBetween(0, within - 1)
    found = both.withColumn("found", F.first(value, ignorenulls=True).over(ahead)).where("side = 0")
    return found.select(*keys, "pos", F.col("found").alias(value))


def outside(points: DataFrame, intervals: DataFrame, keys: list[str], width: int, closed: bool = True) -> DataFrame:
    """Rows of points(keys, pos) in no interval (start, end). closed: the ends count as inside."""
    bins = F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width)))
    right = intervals.select(*[F.col(k).alias(f"_{k}") for k in keys], "start", "end", bins.alias("_bin"))
    inside = (F.col("pos") >= F.col("start")) & (F.col("pos") <= F.col("end")) if closed else (F.col("pos") > F.col("start")) & (F.col("pos") < F.col("end"))
    on = (F.floor(F.col("pos") / width) == F.col("_bin")) & inside
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    return points.join(right, on, "left_anti")


def overlapping(reads: DataFrame, regions: DataFrame, width: int) -> DataFrame:
    """Rows of reads(chrom, start, end) that overlap any region(chrom, start, end); each once."""
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor((F.col(b) - 1) / width)))
    longest = regions.groupBy(F.col("chrom").alias("c"), F.col("start").alias("s")).agg(F.max("end").alias("e"))  # meets all that others of its start meet
    right = longest.withColumn("b", bins("s", "e"))
    on = (F.col("chrom") == F.col("c")) & (F.col("b") == F.col("bin")) & (F.col("start") < F.col("e")) & (F.col("end") > F.col("s"))
    keyed = reads.withColumn("bin", bins("start", "end"))
    return keyed.join(right, on, "left_semi").drop("bin").distinct()
