"""Choices among candidate haplotypes, and evidence of reads at a pivot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haplospark.functions.calls import read_name
from haplospark.operators.haplotypes import row_reads


def missing(assembled: DataFrame, left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """assembled, left and right(keys, hap) -> keys, side, hap: left ones that begin and right ones that end no assembled haplotype.
    Assembled ones meet them by their beginnings and ends, one for each length."""
    lengths = F.sequence(F.lit(1), F.length("hap"))
    whole = assembled.where(F.length("hap") > 0)
    begins = whole.select(*keys, F.explode(F.transform(lengths, lambda n: F.substr("hap", F.lit(1), n))).alias("hap")).distinct()
    ends = whole.select(*keys, F.explode(F.transform(lengths, lambda n: F.right("hap", n))).alias("hap")).distinct()
    gone = lambda side, have, name: side.select(*keys, "hap").distinct().join(have, [*keys, "hap"], "left_anti").select(*keys, F.lit(name).alias("side"), "hap")
    return gone(left, begins, "left").unionByName(gone(right, ends, "right"))


def highest_copy_number(haps: DataFrame, keys: list[str]) -> DataFrame:
    """haps(keys, hap), equally long in a key -> keys, hap, highest_cn: the haplotypes called at the site where most are; ties: fewer
    uncalled sites among them, then the later site."""
    called = haps.select(*keys, "hap", F.posexplode(F.split("hap", "")).alias("site", "symbol")).where("symbol NOT IN ('x', '')")
    unknown = F.length("hap") - F.length(F.replace("hap", F.lit("x"), F.lit("")))
    sites = called.groupBy(*keys, "site").agg(F.count("*").alias("n"), F.sum(unknown).alias("unknown"))
    best = sites.groupBy(*keys).agg(F.max(F.struct("n", (-F.col("unknown")).alias("u"), "site")).alias("b")).select(*keys, F.col("b.site").alias("site"), F.col("b.n").alias("highest_cn"))
    return called.join(best, [*keys, "site"]).select(*keys, "hap", "highest_cn")


def best_set(sets: DataFrame, keys: list[str]) -> DataFrame:
    """sets(keys, id, at_pivot, represented, called) -> the one with most haplotypes at the pivot, then most represented, then most called
    sites; ties: the least id."""
    order = Window.partitionBy(*keys).orderBy(F.desc("at_pivot"), F.desc("represented"), F.desc("called"), "id")
    return sets.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def reduce_candidates(candidates: DataFrame, support: DataFrame, keys: list[str], least: int = 4) -> DataFrame:
    """candidates(keys, candidate), support(keys, candidate, matches), a row for each read, or counted (``row_reads``) -> keys, candidate: the only one with reads;
    else the one whose median, of ``least`` matches and reads or more, is above all others' maximum; else all. None where no read supports any."""
    times = F.col("reads") if "reads" in support.columns else F.lit(1)
    each = support.groupBy(*keys, "candidate").agg(F.percentile("matches", F.lit(0.5), times).alias("median"), F.max("matches").alias("most"), row_reads(support).alias("n"))
    by = Window.partitionBy(*keys)
    ranked = each.withColumn("place", F.row_number().over(by.orderBy(F.desc("most"), "candidate"))).withColumn("supported", F.count("*").over(by))
    top = lambda p: F.max(F.when(F.col("place") == p, F.col("most"))).over(by)
    others = ranked.withColumn("others", F.when(F.col("place") == 1, top(2)).otherwise(top(1)))
    wins = (F.col("supported") == 1) | ((F.col("median") > F.col("others")) & (F.col("median") >= least) & (F.col("n") >= least))
    won = others.where(wins).select(*keys, "candidate")
    open_ = others.select(*keys).distinct().join(won, keys, "left_anti")
    return won.unionByName(candidates.select(*keys, "candidate").distinct().join(open_, keys, "left_semi").select(*keys, "candidate"))


def pivot_tokens(tokens: DataFrame, keys: list[str], gene: str, pseudo: str) -> DataFrame:
    """tokens(keys, token) at the pivot -> keys, gene_reads, pseudo_reads."""
    upper = F.upper("token")
    return tokens.groupBy(*keys).agg(F.count_if(upper == gene).alias("gene_reads"), F.count_if(upper == pseudo).alias("pseudo_reads"))


def splice_presence(bases: DataFrame, deleted: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """bases(keys, read, base, next) at the pivot, deleted(keys, n) reads over a deletion of the second copy -> keys, n1 reads with C,
    n2 with T not before C, has1, has2. Keys of one side alone have 0 of the other."""
    base = F.upper("base")
    second = (base == "T") & (F.coalesce(F.upper("next"), F.lit("")) != "C")
    n = bases.groupBy(*keys).agg(F.count_distinct(F.when(base == "C", F.col("read"))).alias("n1"), F.count_distinct(F.when(second, F.col("read"))).alias("n2"))
    both = n.join(deleted.groupBy(*keys).agg(F.sum("n").alias("gone")), keys, "full").fillna(0, ["n1", "n2", "gone"])
    return both.select(*keys, "n1", "n2", (F.col("n1") >= least).alias("has1"), (F.col("n2") + F.col("gone") >= least).alias("has2"))


def read_names(alignments: DataFrame, partial: DataFrame) -> DataFrame:
    """alignments(name, supplementary, start, size), partial(name) -> alignments and ``as``: the alignment's own name, and for a
    supplementary one the read's too if both are in ``partial``."""
    mine = alignments.withColumn("own", read_name(F.col("name"), F.col("supplementary"), F.col("start"), F.col("size")))
    listed = partial.select("name").distinct()
    x = mine.join(listed.select(F.col("name").alias("own"), F.lit(True).alias("own_in")), "own", "left").join(listed.select("name", F.lit(True).alias("name_in")), "name", "left")
    twice = F.col("supplementary") & F.col("own_in").isNotNull() & F.col("name_in").isNotNull()
    return x.select(*alignments.columns, F.explode(F.when(twice, F.array("own", "name")).otherwise(F.array("own"))).alias("as"))


def high_impact(variants: DataFrame, consequences: DataFrame, transcripts: DataFrame) -> DataFrame:
    """variants(variant), consequences(variant, transcript, impact), transcripts(transcript) -> variant, high: whether any of the listed
    transcripts has an impact HIGH."""
    found = consequences.where("impact = 'HIGH'").join(transcripts.select("transcript").distinct(), "transcript", "left_semi").select("variant").distinct()
    return variants.select("variant").distinct().join(found.withColumn("high", F.lit(True)), "variant", "left").select("variant", F.coalesce("high", F.lit(False)).alias("high"))


def with_default_calls(regions: DataFrame, calls: DataFrame, keys: list[str]) -> DataFrame:
    """regions(keys, depth, ...), calls(keys, ...) -> a row for each region; those without a call keep only what the region has."""
    return regions.join(calls, keys, "left")
