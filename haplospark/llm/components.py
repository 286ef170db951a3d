"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haplospark.llm.common import drop_staged, staged

#: While edges are at most so many (pairs of numbers), a step is one task without a shuffle.
FEW_EDGES = 200_000


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b), numbers -> node, component (the least node), for nodes with an edge. Each step
    gives edges one minimum a node: by a window in one task while the counted edges are few, so that no edge is made
    twice; else by a join, where a hub is skewed and Spark splits it. The number of steps grows with the logarithm of the longest path."""

    def with_least(pairs: DataFrame, few: bool) -> DataFrame:
        """a, b, m: the least b of a."""
        if few:
            return pairs.withColumn("m", F.min("b").over(Window.partitionBy("a")))
        return pairs.join(pairs.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n"), F.col("a") == F.col("n")).drop("n")

    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    count, state = now.count(), None
    while count:
        few = count <= FEW_EDGES
        start = now.coalesce(1) if few else now
        both = start.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
        large = with_least(both, few).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        joined = with_least(large, few)
        after = joined.select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        after = staged(after, "edges")
        summed = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_staged(now)
        now, count = after, summed[0]
        if summed == state:
            break
        state = summed
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
