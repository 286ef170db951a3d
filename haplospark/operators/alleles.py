"""Links between haplotypes by reads in several segments, and alleles as connected haplotypes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haplospark.functions.strings import link_direction
from haplospark.operators.spread import dealt


def read_pairs(segments: DataFrame, keys: list[str]) -> DataFrame:
    """segments(keys, read, seq, hap) -> keys, read, a, b for segments a before b of one read on two haplotypes."""
    segments = dealt(segments.select(*keys, "read", "seq", "hap"), *keys, "read")
    later = segments.select(*keys, "read", F.col("seq").alias("seq2"), F.col("hap").alias("b"))
    return segments.join(later, [*keys, "read"]).where((F.col("seq") < F.col("seq2")) & (F.col("hap") != F.col("b"))).select(*keys, "read", F.col("hap").alias("a"), "b")


def hap_links(pairs: DataFrame, keys: list[str], least: int = 2, directed: bool = False) -> DataFrame:
    """keys, a, b, n: reads that link two haplotypes, at least so many for each order of the two; undirected links take the lesser name first."""
    n = pairs.groupBy(*keys, "a", "b").agg(F.count_distinct("read").alias("n")).where(F.col("n") >= least)
    return n if directed else n.select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "n").groupBy(*keys, "a", "b").agg(F.sum("n").alias("n"))


def directed_links(segments: DataFrame, keys: list[str], reverse: Column) -> DataFrame:
    """segments(keys, read, seq, haps array, hap string over sites) -> keys, kind, a, b, n. Of a read's segments, taken in pairs by ``seq``, two that match one haplotype
    each link the two: ``undirected`` counts reads, in the order of the pair; where their ends tell (``link_direction``; ``reverse``: segments lie on opposite
    strands), ``directed`` counts pairs from the first to the second along the gene. If one side alone is ambiguous, all its haplotypes count, as ``loose``; so do the
    directed ones. Both ambiguous: nothing. A read has a few segments; reads are spread by the join."""
    segments = dealt(segments.select(*keys, "read", "seq", "haps", "hap"), *keys, "read")
    one = segments.select(*keys, "read", "seq", F.col("haps").alias("haps1"), F.col("hap").alias("aln1"))
    two = segments.select(*keys, "read", F.col("seq").alias("seq2"), F.col("haps").alias("haps2"), F.col("hap").alias("aln2"))
    sure = (F.size("haps1") == 1) & (F.size("haps2") == 1)
    x = one.join(two, [*keys, "read"]).where((F.col("seq") < F.col("seq2")) & ((F.size("haps1") == 1) | (F.size("haps2") == 1))).withColumns({"way": link_direction(F.col("aln1"), F.col("aln2"), reverse), "sure": sure})
    x = x.select(*keys, "read", "way", "sure", F.explode("haps1").alias("h1"), "haps2").select(*keys, "read", "way", "sure", "h1", F.explode("haps2").alias("h2")).where("h1 <> h2")
    back = F.col("way") == "2-1"
    directed = x.where("way IS NOT NULL").select(*keys, "sure", F.when(back, F.col("h2")).otherwise(F.col("h1")).alias("a"), F.when(back, F.col("h1")).otherwise(F.col("h2")).alias("b"))
    plain = x.where("sure").groupBy(*keys, F.lit("undirected").alias("kind"), F.col("h1").alias("a"), F.col("h2").alias("b")).agg(F.count_distinct("read").alias("n"))
    kinds = F.explode(F.when(F.col("sure"), F.array(F.lit("directed"), F.lit("loose"))).otherwise(F.array(F.lit("loose"))))
    return plain.unionByName(directed.select(*keys, kinds.alias("kind"), "a", "b").groupBy(*keys, "kind", "a", "b").agg(F.count("*").alias("n")))


def phase_alleles(segments: DataFrame, haps: DataFrame, keys: list[str], reverse: Column, least: int = 2, excluded: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """segments as in ``directed_links``, haps(keys, hap) -> (keys, alleles; all links). Haplotypes linked by ``least`` reads in one order are an allele; ``filter_alleles``
    drops sets that cannot be right. excluded(keys, hap): haplotypes that count neither in segments nor among those to be placed."""
    if excluded is not None:
        gone = excluded.groupBy(*keys).agg(F.collect_set("hap").alias("gone"))
        segments = dealt(segments, *keys).join(gone, keys, "left").withColumn("haps", F.array_except("haps", F.coalesce("gone", F.array().cast("array<string>")))).drop("gone")
        haps = haps.join(excluded.select(*keys, "hap"), [*keys, "hap"], "left_anti")
    links = directed_links(segments, keys, reverse)
    strong = links.where(F.col("kind") == "undirected").where(F.col("n") >= least).select(*keys, "a", "b")
    return filter_alleles(alleles(strong, keys), haps, keys), links


def alleles(links: DataFrame, keys: list[str]) -> DataFrame:
    """links(keys, a, b) -> keys, hap, allele (the least haplotype of the component). A region has dozens of haplotypes at most, so one row
    holds its links, and a fold over them merges the sets that each link touches."""
    rows = links.groupBy(*keys).agg(F.sort_array(F.collect_set(F.array("a", "b"))).alias("links"))
    none = F.array().cast("array<array<string>>")
    merge = lambda sets, link: F.concat(F.filter(sets, lambda s: ~F.arrays_overlap(s, link)), F.array(F.array_sort(F.array_union(link, F.flatten(F.filter(sets, lambda s: F.arrays_overlap(s, link)))))))
    sets = rows.select(*keys, F.explode(F.aggregate("links", none, merge)).alias("members"))
    return sets.select(*keys, F.explode("members").alias("hap"), F.element_at("members", 1).alias("allele"))


def filter_alleles(found: DataFrame, haps: DataFrame, keys: list[str]) -> DataFrame:
    """found(keys, hap, allele), haps(keys, hap) all haplotypes -> keys, alleles array<array>: none if more than two, or two that leave a haplotype
    out; one that leaves exactly one of two or three out gets it as the second."""
    sets = found.groupBy(*keys, "allele").agg(F.array_sort(F.collect_set("hap")).alias("members")).groupBy(*keys).agg(F.array_sort(F.collect_list("members")).alias("alleles"))
    every = dealt(haps.select(*keys, "hap"), *keys).groupBy(*keys).agg(F.array_sort(F.collect_set("hap")).alias("every"))
    x = every.join(sets, keys, "left").withColumn("left", F.array_except("every", F.coalesce(F.flatten("alleles"), F.array().cast("array<string>"))))
    n, out = F.size("alleles"), F.size("left")
    kept = F.when((n == 2) & (out == 0), F.col("alleles")).when((n == 1) & (out == 0), F.col("alleles")).when((n == 1) & (out == 1) & F.size("every").between(2, 4), F.array_append("alleles", F.col("left")))
    return x.select(*keys, kept.alias("alleles"))


def split_by_depth(depths: DataFrame, keys: list[str]) -> DataFrame:
    """The two most covered haplotypes of each key: keys, hap, n, second."""
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), "hap")
    return depths.withColumn("rank", F.row_number().over(order)).withColumn("second", F.lead("n").over(order)).where("rank = 1").drop("rank")
