"""Nearest known haplotypes by their variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haplospark.operators.rounds import written

#: Known variants up to which they are broadcast.
BROADCAST_ROWS = 300_000


def _meeting(start: Column, end: Column, overlap: int) -> Column:
    """Multiples of ``overlap`` in a span: two spans that share so many positions share one."""
    first, last = F.ceil(start / overlap), F.floor(end / overlap)
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def haplogroup_distances(queries: DataFrame, known: DataFrame, query_variants: DataFrame, known_variants: DataFrame, overlap: int = 12_000) -> DataFrame:
    """queries(hap, start, end), known(name, haplogroup, start, end), query_variants(hap, pos, variant), known_variants(name, pos, variant) -> hap, name, haplogroup,
    distance: for spans that share ``overlap`` positions, variants in the shared stretch that one has and the other lacks.

    Pairs of spans meet at a multiple of ``overlap`` inside both; the distance is what each has there, counted once a stretch, less twice what they share. A query's variants in
    a stretch are looked up in the known ones and counted in the same stage, so that they are not shuffled where the known ones can be broadcast. No pair is compared that
    does not overlap."""
    x = queries.select("hap", F.col("start").alias("s1"), F.col("end").alias("e1"), F.explode(_meeting(F.col("start"), F.col("end"), overlap)).alias("at"))
    y = known.select("name", "haplogroup", F.col("start").alias("s2"), F.col("end").alias("e2"), F.explode(_meeting(F.col("start"), F.col("end"), overlap)).alias("at"))
    pairs = x.join(y, "at").select("hap", "name", "haplogroup", F.greatest("s1", "s2").alias("first"), F.least("e1", "e2").alias("last")).where(F.col("last") - F.col("first") >= overlap).distinct()
    own, other = query_variants.select("hap", "pos", "variant").distinct(), written(known_variants.select("name", "pos", "variant").distinct(), "known")
    inside = F.col("pos").between(F.col("first"), F.col("last"))
    stretch = lambda side, key, name: pairs.select(key, "first", "last").distinct().join(side, key).where(inside).groupBy(key, "first", "last").agg(F.count("*").alias(name))
    index = F.broadcast(other) if other.count() <= BROADCAST_ROWS else other
    shared = pairs.select("hap", "name", "first", "last").join(own, "hap").where(inside).join(index, ["name", "pos", "variant"]).groupBy("hap", "name").agg(F.count("*").alias("both"))
    both = pairs.join(stretch(own, "hap", "n1"), ["hap", "first", "last"], "left").join(stretch(other, "name", "n2"), ["name", "first", "last"], "left").join(shared, ["hap", "name"], "left").fillna(0, ["n1", "n2", "both"])
    return both.select("hap", "name", "haplogroup", (F.col("n1") + F.col("n2") - 2 * F.col("both")).alias("distance"))


def best_haplogroup(distances: DataFrame, most: int = 15) -> DataFrame:
    """distances(hap, haplogroup, distance) -> hap, haplogroup, or null: the group of the least distance (ties: by name) if it has two members of which the second is
    within ``most`` (or the first within 2), the first is nearer by more than 2 than any of the next group, and the second nearer too. With one group
    alone there is none to compare with: null."""
    ranked = distances.withColumn("r", F.row_number().over(Window.partitionBy("hap", "haplogroup").orderBy("distance")))
    groups = ranked.groupBy("hap", "haplogroup").agg(F.min("distance").alias("d0"), F.min(F.when(F.col("r") == 2, F.col("distance"))).alias("d1"))
    order = Window.partitionBy("hap").orderBy("d0", "haplogroup")
    best = groups.withColumns({"place": F.row_number().over(order), "next": F.lead("d0").over(order)}).where("place = 1")
    sure = ((F.col("d1") <= most) | (F.col("d0") <= 2)) & (F.col("d0") < F.col("next") - 2) & (F.col("d1") < F.col("next"))
    return best.select("hap", F.when(sure, F.col("haplogroup")).alias("haplogroup"))
