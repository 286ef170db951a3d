"""Decision tables of single regions: classes of haplotypes, their numbers, copies and events.

A haplotype row has keys (sample, region), hap, and what the table reads. Clips are
the genomic positions where a haplotype begins or ends inside the region: 0 if it
runs through, null if unknown."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haplospark.functions.stats import depth_posterior

# Which clip (number in the region's list, 0 for none) at the 5' and the 3' end makes which class.
F8_CLASSES = {(0, 0): "int22h2", (1, 1): "int22h1", (0, 2): "int22h3", (1, 2): "int22inv", (1, 0): "int22del", (0, 1): "int22invordup"}
HBA_CLASSES = {(0, 0): "hba2", (1, 1): "hba1", (0, 1): "3p7del", (0, 2): "4p2dup", (1, 0): "3p7dup", (2, 0): "4p2del", (2, 2): "homology"}


def clip_class(clip5: Column, clip3: Column, clips5: list[int], clips3: list[int], classes: dict[tuple[int, int], str]) -> Column:
    """The class of a pair of clips; unknown if either is null or the pair is in no row."""
    at = lambda c, known: F.when(c == 0, 0).otherwise(F.coalesce(*[F.when(c == p, i) for i, p in enumerate(known, 1)], F.lit(-1)))
    a, b = at(clip5, clips5), at(clip3, clips3)
    found = F.coalesce(*[F.when((a == i) & (b == j), F.lit(name)) for (i, j), name in classes.items()], F.lit("unknown"))
    return F.when(clip5.isNull() | clip3.isNull(), "unknown").otherwise(found)


def numbered(haps: DataFrame, keys: list[str], gene: str) -> DataFrame:
    """haps(keys, hap, cls) -> name: gene_classhap1, gene_classhap2, ... by order of the string."""
    order = Window.partitionBy(*keys, "cls").orderBy("hap")
    return haps.withColumn("name", F.concat(F.lit(f"{gene}_"), "cls", F.lit("hap"), F.row_number().over(order).cast("string")))


def class_counts(haps: DataFrame, keys: list[str], classes: list[str]) -> DataFrame:
    """keys and a count for each class."""
    return haps.groupBy(*keys).agg(*[F.count_if(F.col("cls") == c).alias(f"n_{c}") for c in classes])


def f8_events(haps: DataFrame) -> DataFrame:
    """haps(cls, sex, exon_depth, genome_depth) -> event: an inversion by its class; a deletion if the depth of exons 1 to 22 agrees: in a
    female one copy against half the genome's depth, in a male none."""
    female = (F.col("sex") == "female") & (F.element_at(depth_posterior(F.floor("exon_depth"), F.col("genome_depth") / 2), 1) > 0.75)
    male = (F.col("sex") == "male") & (F.col("exon_depth") < 1)
    deletion = F.col("cls").contains("del") & (female | male)
    return haps.withColumn("event", F.when(deletion, "deletion").when(F.col("cls").contains("inv") & ~F.col("cls").contains("dup"), "inversion"))


def hba_copies(counts: DataFrame) -> DataFrame:
    """counts(n_<class> of HBA_CLASSES, n_haps, around_depth, genome_depth) -> hba1, hba2, del3p7, second (classes with a second copy) and
    copies. One copy of a gene is doubled where the others say that two alleles are there; one of each is two pairs unless depth says one."""
    one, two = F.col("n_hba1"), F.col("n_hba2")
    single = F.element_at(depth_posterior(F.floor("around_depth"), F.col("genome_depth") / 2), 1) >= 0.999
    no_del = (F.col("n_3p7del") == 0) & (F.col("n_4p2del") == 0)
    pair = no_del & (one == 1) & (two == 1) & ~F.coalesce(single & F.col("genome_depth").isNotNull(), F.lit(False))
    first = (F.col("n_3p7del") == 0) & (F.col("n_4p2del") == 1) & (one == 1) & (two == 1) | no_del & (one == 1) & (two == 2) | pair
    second = no_del & (one == 2) & (two == 1) | pair
    alone = (F.col("n_3p7del") == 1) & (one + two + F.col("n_3p7dup") + F.col("n_4p2del") + F.col("n_4p2dup") == 0)
    x = counts.withColumns({"hba1": one + first.cast("int"), "hba2": two + second.cast("int"), "del3p7": F.col("n_3p7del") + alone.cast("int")})
    more = first.cast("int") + second.cast("int") + alone.cast("int")
    copies = F.col("n_haps") + more - F.col("n_homology") - F.col("n_4p2del") - F.col("n_unknown")
    names = F.array_compact(F.array(F.when(first, "hba1"), F.when(second, "hba2"), F.when(alone, "3p7del")))
    return x.withColumn("second", names).withColumn("copies", F.when(copies > 1, copies))


def tri_class(hap: Column) -> Column:
    """Which of three repeats a haplotype is: by the majority of 1 and 2 among its first and its last sites (half of them, 10 at most)."""
    n = F.least(F.floor(F.length(hap) / 2), F.lit(10)).cast("int")
    more = lambda part: F.regexp_count(part, F.lit("1")) >= F.regexp_count(part, F.lit("2"))
    start, end = more(F.substr(hap, F.lit(1), n)), more(F.when(n > 0, F.substr(hap, -n, n)).otherwise(""))
    return F.when(start & end, "tri1").when(~start & ~end, "tri3").otherwise("tri2")


def identical_pairs(calls: DataFrame) -> DataFrame:
    """calls(haps, two_copies, het_sites) counts of a gene of two copies in two places -> copies: up to two haplotypes are pairs of equal copies, no
    het site means four, fewer than four is unknown."""
    doubled = F.when(F.col("haps") <= 2, F.col("haps")).when(F.col("haps") == 3, F.col("two_copies")).otherwise(0)
    copies = F.when(F.col("het_sites") == 0, 4).otherwise(F.col("haps") + doubled)
    return calls.withColumn("copies", F.when(copies >= 4, copies))


def cluster(calls: DataFrame, keys: list[str], first: str, second: str, name: str) -> DataFrame:
    """calls(keys, region, copies, haps map) of two regions as one: haplotypes of both, the lesser of the copies; null if either is missing."""
    of = lambda region, c: F.first(F.when(F.col("region") == region, F.col(c)), ignorenulls=True)
    x = calls.where(F.col("region").isin(first, second)).groupBy(*keys).agg(of(first, "copies").alias("a"), of(second, "copies").alias("b"), of(first, "haps").alias("ha"), of(second, "haps").alias("hb"))
    none = F.create_map().cast("map<string,string>")
    both = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.least("a", "b"))
    return x.select(*keys, F.lit(name).alias("region"), both.alias("copies"), F.map_concat(F.coalesce("ha", none), F.coalesce("hb", none)).alias("haps"))


def best_group(distances: DataFrame, keys: list[str], most: int = 15, close: int = 2, margin: int = 2) -> DataFrame:
    """distances(keys, hap, grp, member, apart) -> keys, hap, grp: the group of the nearest known haplotype, if it is near enough, or the
    second of the same group is, and the best of all other groups is further by more than the margin; else null."""
    order = Window.partitionBy(*keys, "hap", "grp").orderBy("apart", "member")
    x = distances.withColumn("rank", F.row_number().over(order))
    groups = x.groupBy(*keys, "hap", "grp").agg(F.min("apart").alias("best"), F.min(F.when(F.col("rank") == 2, F.col("apart"))).alias("second"))
    by = Window.partitionBy(*keys, "hap").orderBy("best", "grp")
    top = groups.withColumn("r", F.row_number().over(by)).withColumn("other", F.lead("best").over(by)).where("r = 1")
    near = (F.col("second") <= most) | (F.col("best") <= close)
    apart = F.col("other").isNull() | ((F.col("best") < F.col("other") - margin) & F.coalesce(F.col("second") < F.col("other"), F.lit(True)))
    return top.select(*keys, "hap", F.when(near & apart, F.col("grp")).alias("grp"))


def clip_of(hap_sites: DataFrame, keys: list[str], clips: DataFrame, side: str, within: int = 5000) -> DataFrame:
    """hap_sites(keys, hap, pos, symbol), clips(keys, clip) -> keys, hap, clip: the position where the string turns from absent (0) to called
    (side 5p) or from called to absent (3p); x between is passed over if the clip is within reach; 0 if all is called; else null. Turns meet clips by bins."""
    called = hap_sites.where("symbol <> 'x'")
    w = Window.partitionBy(*keys, "hap").orderBy("pos")
    x = called.withColumn("next", F.lead("symbol").over(w)).withColumn("next_pos", F.lead("pos").over(w))
    turn = (F.col("symbol") == "0") & (F.col("next") != "0") if side == "5p" else (F.col("symbol") != "0") & (F.col("next") == "0")
    turns = x.where(turn).select(*keys, "hap", "pos", "next_pos")
    wide = 2 * within
    bins = F.explode(F.sequence(F.floor(F.col("pos") / wide), F.floor(F.col("next_pos") / wide)))
    near = turns.where(F.col("next_pos") - F.col("pos") <= wide).withColumn("bin", bins)
    at = near.join(clips.select(*keys, "clip", F.floor(F.col("clip") / wide).alias("bin")), [*keys, "bin"]).where((F.col("clip") >= F.col("pos")) & (F.col("clip") <= F.col("next_pos")))
    found = at.groupBy(*keys, "hap").agg(F.min("clip").alias("clip"))
    through = called.groupBy(*keys, "hap").agg(F.max(F.col("symbol") == "0").alias("absent"))
    return through.join(found, [*keys, "hap"], "left").select(*keys, "hap", F.coalesce("clip", F.when(~F.col("absent"), 0)).alias("clip"))


#: Rules by region; a user adds a region by adding a function of its haplotype rows.
RULES: dict[str, Callable[[DataFrame], DataFrame]] = {"hba": hba_copies, "f8": f8_events, "cfc1": identical_pairs}
