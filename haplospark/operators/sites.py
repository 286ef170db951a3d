"""From candidate sites to sites for phasing: masks of sequence, sizes of indels, shifted clips, several alternatives; labels of known variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haplospark.functions.strings import indel_decode
from haplospark.operators.spread import dealt


def in_spans(points: DataFrame, spans: DataFrame, keys: list[str], name: str, width: int = 1000, closed: bool = True) -> DataFrame:
    """points(keys, pos, ...) with a boolean ``name``: whether pos lies in a span of spans(keys, first, last), the ends inside if ``closed``. Distinct positions meet
    spans by bins of ``width``; a null position lies in none."""
    bins = F.explode(F.sequence(F.floor(F.col("first") / width), F.floor(F.col("last") / width)))
    binned = spans.where(F.col("first") <= F.col("last")).select(*keys, "first", "last", bins.alias("bin"))
    within = F.col("pos").between(F.col("first"), F.col("last")) if closed else (F.col("pos") > F.col("first")) & (F.col("pos") < F.col("last"))
    hit = points.select(*keys, "pos").distinct().withColumn("bin", F.floor(F.col("pos") / width)).join(binned, [*keys, "bin"]).where(within)
    return points.join(hit.select(*keys, "pos", F.lit(True).alias(name)).distinct(), [*keys, "pos"], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def without_deleted(histogram: DataFrame, keys: list[str], allowed: DataFrame, least: int = 5) -> DataFrame:
    """histogram(keys, pos, token, n) less the positions where ``least`` reads or more are deleted (*), unless they lie in allowed(keys, first, last), the spans of
    known long deletions: there, reads without the deletion tell the site."""
    gone = histogram.groupBy(*keys, "pos").agg(F.coalesce(F.sum(F.when(F.col("token") == "*", F.col("n"))), F.lit(0)).alias("gone")).where(F.col("gone") >= least)
    drop = in_spans(gone, allowed, keys, "ok").where(~F.col("ok")).select(*keys, "pos")
    return histogram.join(drop, [*keys, "pos"], "left_anti")


def sites_for_phasing(candidates: DataFrame, masks: DataFrame, shifted: DataFrame, white: DataFrame, keys: list[str], most: int = 25) -> DataFrame:
    """candidates(keys, pos, ref, alt token, kind hom or het, n), masks(keys, pos, bases as 'A,C' or with '1'), shifted(keys, first, last) spans of shifted clips, white(keys, pos, base) ->
    keys, pos, ref, alt, size, use.

    In a masked position, a substitution by a masked base goes and so does any indel; another substitution of a het site is reported only, and phased if
    the mask has 1. An indel of ``most`` bases or more goes; a shorter one is not phased. Het sites within a shifted span go, its ends are outside. A position with
    several substitutions to phase goes, unless it is in the white list: then the most frequent other than its base stays (the least of equals). Of
    several to be reported at a position, the least frequent stays, as a later one takes an earlier one's place. use: ``hom``, ``phase`` or ``report``."""
    each = masks.select(*keys, "pos", F.explode(F.split("bases", ",")).alias("bases"))
    mask = each.groupBy(*keys, "pos").agg(F.collect_set("bases").alias("mask"))
    x = dealt(candidates, *keys, "pos").select(*keys, "pos", "alt", "kind", "n", indel_decode(F.col("ref"), F.regexp_extract("alt", r"([+-].*|.)$", 1)).alias("d")).join(mask, [*keys, "pos"], "left")
    masked, indel = F.col("mask").isNotNull(), F.col("d.size") > 0
    bad = F.when(indel, masked | (F.col("d.size") >= most)).otherwise(masked & F.array_contains("mask", F.col("d.alt")))
    use = F.when(F.col("kind") == "hom", "hom").when(indel | (masked & ~F.array_contains("mask", F.lit("1"))), "report").otherwise("phase")
    y = x.where(~F.coalesce(bad, F.lit(False))).select(*keys, "pos", "d.ref", "d.alt", "d.size", use.alias("use"), "n")
    y = in_spans(y, shifted, keys, "off", closed=False).where((F.col("use") == "hom") | ~F.col("off")).drop("off")
    listed = white.groupBy(*keys, "pos").agg(F.min("base").alias("white"))
    at = Window.partitionBy(*keys, "pos", "use")
    z = y.join(listed, [*keys, "pos"], "left").withColumn("several", F.count("*").over(at) > 1)
    other = F.coalesce(F.col("alt") != F.col("white"), F.lit(False))
    order = F.when(F.col("use") == "report", F.col("n")).otherwise(F.when(other, -F.col("n")))
    first = F.row_number().over(at.orderBy(F.asc_nulls_last(order), "alt")) == 1
    z = z.withColumn("first", first)
    kept = ~F.col("several") | F.when(F.col("use") == "phase", F.col("first") & other).otherwise(F.col("first"))
    return z.where(kept).select(*keys, "pos", "ref", "alt", "size", "use")


def known_labels(variants: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """variants(keys, hap, code), known(code, label) -> keys, hap, code, label of those that are known; of several labels of a code the greatest."""
    named = known.where("code IS NOT NULL").groupBy("code").agg(F.max("label").alias("label"))
    return variants.select(*keys, "hap", "code").distinct().join(named, "code").select(*keys, "hap", "code", "label")
