"""Reads as strings over sites in two rounds: calls, sites that turn out to be of one kind, clips, and long deletions.

Calls stay rows (one a read and site) until the strings are made; only sites are gathered by key, as a region has some hundred of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haplospark.operators.rounds import written
from haplospark.operators.runs import clip_anchors

SITE = ["pos", "ref", "alt"]


def site_symbols(calls: DataFrame, sites: DataFrame, keys: list[str], also_ref: DataFrame | None = None) -> DataFrame:
    """calls(keys, read, pos, base), sites(keys, pos, ref, alt) -> keys, read, pos, ref, alt, symbol: 1 for the reference base or that of
    also_ref(keys, pos, base), 2 for the alternative, x for another base. Of several calls the least symbol counts; case doesn't matter."""
    x = calls.select(*keys, "read", "pos", F.upper("base").alias("base")).join(sites.select(*keys, *SITE).distinct(), [*keys, "pos"])
    like = F.col("base") == F.upper("ref")
    if also_ref is not None:
        more = also_ref.select(*keys, "pos", F.upper("base").alias("base"), F.lit(True).alias("also")).distinct()
        x = x.join(more, [*keys, "pos", "base"], "left")
        like = like | F.coalesce("also", F.lit(False))
    symbol = F.when(like, "1").when(F.col("base") == F.upper("alt"), "2").otherwise("x")
    return x.groupBy(*keys, "read", *SITE).agg(F.min(symbol).alias("symbol"))


def clipped_symbols(reads: DataFrame, clips: DataFrame, sites: DataFrame, keys: list[str], buffer: int = 20, least: int = 50) -> DataFrame:
    """reads(keys, read, start, end, clip_left, clip_right), clips(keys, side, pos) -> keys, read, pos, ref, alt: sites at which a read is absent, behind
    a 3p clip position or before a 5p one near which it is clipped by ``least`` bases. Reads meet clips by bins of ``buffer``."""
    bins = F.explode(F.sequence(F.floor(F.col("pos") / buffer) - 1, F.floor(F.col("pos") / buffer) + 1))
    known = clips.select(*keys, "side", F.col("pos")).distinct().select(*keys, "side", F.col("pos").alias("clip"), bins.alias("bin"))
    ends = reads.where(F.col("clip_right") >= least).select(*keys, "read", F.lit("3p").alias("side"), F.col("end").alias("at"))
    starts = reads.where(F.col("clip_left") >= least).select(*keys, "read", F.lit("5p").alias("side"), F.col("start").alias("at"))
    near = ends.unionByName(starts).withColumn("bin", F.floor(F.col("at") / buffer)).join(known, [*keys, "side", "bin"]).where(F.abs(F.col("at") - F.col("clip")) < buffer)
    # of a read's clips on one side, the one nearest to the sites decides for all of them
    cut = near.groupBy(*keys, "read").agg(F.min(F.when(F.col("side") == "3p", F.col("clip"))).alias("after"), F.max(F.when(F.col("side") == "5p", F.col("clip"))).alias("before"))
    listed = sites.groupBy(*keys).agg(F.collect_set(F.struct(*SITE)).alias("sites"))
    gone = F.filter("sites", lambda s: F.coalesce(s["pos"] > F.col("after"), F.lit(False)) | F.coalesce(s["pos"] < F.col("before"), F.lit(False)))
    return cut.join(listed, keys).select(*keys, "read", F.inline(gone))


def judged_sites(symbols: DataFrame, sites: DataFrame, keys: list[str], kept: DataFrame, homs: DataFrame, least: int = 3) -> DataFrame:
    """symbols(keys, read, pos, ref, alt, symbol), kept and homs(keys, pos, ref, alt) -> keys, pos, ref, alt, keep, absent. A site without a 1 or 2 goes;
    so does one of which both are held by ``least`` reads or fewer; of which one is, unless it is kept: then, if it is a hom site, that symbol is ``absent``."""
    n = lambda s: F.count_if(F.col("symbol") == s)
    count = symbols.groupBy(*keys, *SITE).agg(n("1").alias("refs"), n("2").alias("alts"))
    marked = lambda df, name: df.select(*keys, *SITE, F.lit(True).alias(name)).distinct()
    on = [*keys, *SITE]
    x = sites.select(*on).distinct().join(count, on, "left").join(marked(kept, "kept"), on, "left").join(marked(homs, "hom"), on, "left").fillna(0, ["refs", "alts"]).fillna(False, ["kept", "hom"])
    few_refs, few_alts = F.col("refs") <= least, F.col("alts") <= least
    stays = ~(few_refs & few_alts) & (F.col("kept") | ~(few_refs | few_alts))
    return x.select(*on, stays.alias("keep"), F.when(stays & F.col("hom"), F.when(few_alts, "2").when(few_refs, "1")).alias("absent"))


def anchor_sites(sites: DataFrame, clips: DataFrame, bases: DataFrame, keys: list[str], shift: int = 30) -> DataFrame:
    """keys, pos, ref, alt: a site ``shift`` before each 5p clip with none between it and the clip before, and behind each 3p clip with none before the next
    clip. bases(keys, pos, base) has the reference; the alternative is the first other letter. A position without a base gets no site."""
    side = lambda df, way: df.select(*keys, (F.col("pos") * way).alias("pos"))
    added = lambda name, way: side(clip_anchors(side(clips.where(F.col("side") == name), way), side(sites, way), keys, shift), way)
    ref = F.upper("base")
    return added("5p", -1).unionByName(added("3p", 1)).join(bases, [*keys, "pos"]).select(*keys, "pos", ref.alias("ref"), F.when(ref == "A", "C").otherwise("A").alias("alt")).distinct()


def strings(symbols: DataFrame, sites: DataFrame, keys: list[str]) -> DataFrame:
    """keys, read, hap: one symbol for each site of the key by position (then by bases), x where the read has none."""
    order = sites.groupBy(*keys).agg(F.sort_array(F.collect_set(F.struct(*SITE))).alias("sites"))
    own = symbols.groupBy(*keys, "read").agg(F.map_from_entries(F.collect_list(F.struct(F.struct(*SITE), "symbol"))).alias("own"))
    hap = F.transform("sites", lambda s: F.coalesce(F.try_element_at("own", s), F.lit("x")))
    return own.join(order, keys).select(*keys, "read", F.array_join(hap, "").alias("hap"))


def encode_twice(calls: DataFrame, reads: DataFrame, sites: DataFrame, keys: list[str], *, clips: DataFrame, bases: DataFrame, kept: DataFrame, homs: DataFrame, added: DataFrame, also_ref: DataFrame | None = None, buffer: int = 20, least_clip: int = 50, shift: int = 30) -> tuple[DataFrame, DataFrame]:
    """-> (keys, read, hap; the sites of its symbols keys, pos, ref, alt, absent). The first round judges the sites; the second encodes the reads over those
    that stay, ``added`` ones and anchors around clips. 0 stands wherever a clip makes a read absent, whatever base it has there; a hom site's absent
    symbol is x. The judged sites are written in ``spark.checkpoint.dir``. Reads with neither a call at a site nor a clip have no row, nor do reads of a key whose sites all go; empty tables give no rows."""

    def absent(at: DataFrame) -> DataFrame:
        return clipped_symbols(reads, clips, at, keys, buffer, least_clip).withColumn("zero", F.lit(True)).distinct()

    def over(at: DataFrame) -> DataFrame:
        both = site_symbols(calls, at, keys, also_ref).join(absent(at), [*keys, "read", *SITE], "full")
        return both.select(*keys, "read", *SITE, F.when(F.col("zero"), "0").otherwise(F.col("symbol")).alias("symbol"))

    # written, as all that follows reads the judged sites several times, and would count all calls anew each time
    judged = written(judged_sites(over(sites), sites, keys, kept, homs).where("keep").select(*keys, *SITE, "absent"), "judged-sites")
    more = added.select(*keys, *SITE).distinct().join(judged, [*keys, *SITE], "left_anti")
    stay = judged.unionByName(more.withColumn("absent", F.lit(None).cast("string")))
    around = anchor_sites(stay, clips, bases, keys, shift).join(stay, [*keys, *SITE], "left_anti")
    final = stay.unionByName(around.withColumn("absent", F.lit(None).cast("string")))
    second = over(final).join(final.where("absent IS NOT NULL"), [*keys, *SITE], "left")
    symbols = second.withColumn("symbol", F.when(F.col("symbol") == F.col("absent"), "x").otherwise(F.col("symbol")))
    return strings(symbols, final, keys), final


def with_deletion(hap: Column, first: Column, second: Column, partial: Column, negative: Column, symbol: Column) -> Column:
    """A read's string after a deletion between the sites ``first`` and ``second`` (index of the first site behind either end, null for none). With sites inside,
    those are ``symbol`` in reads that hold it (partial). With none, a symbol is put in at the place: that of the deletion in reads that hold it, 0 between 0s,
    1 if the read runs through (negative, at the strings' ends) or has calls at two sites on both sides, else x."""
    n = F.length(hap)
    cut = lambda a, b: F.substr(hap, a + 1, F.greatest(b - a, F.lit(0)))  # noqa: E731, a up to and without b
    filled = lambda a, b: F.when(partial, F.concat(cut(F.lit(0), a), F.repeat(symbol, b - a), cut(b, n))).otherwise(hap)
    left, right = F.substr(hap, first, F.lit(1)) == "0", F.substr(hap, first + 1, F.lit(1)) == "0"
    called = ~F.contains(cut(F.greatest(first - 2, F.lit(0)), F.least(first + 2, n)), F.lit("x"))
    put = lambda zero, one: F.when(partial, symbol).when(zero, "0").when(one, "1").otherwise("x")
    none = first.isNull() & second.isNull()
    return (
        F.when(none, F.concat(hap, put((n > 0) & (F.right(hap, F.lit(1)) == "0"), negative)))
        .when(second.isNull(), filled(first, n))
        .when(first < second, filled(first, second))
        .when((first == second) & (first == 0), F.concat(put(right, negative), hap))
        .when(first == second, F.concat(cut(F.lit(0), first), put(left & right, called), cut(first, n)))
        .otherwise(hap)
    )


def mark_deletions(haps: DataFrame, sites: DataFrame, deletions: DataFrame, evidence: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """haps(keys, read, hap), sites(keys, pos, code) in their order, deletions(keys, n1, n2, name, symbol), one a key, evidence(keys, read, partial, negative) ->
    (haps, sites), a site named ``name`` at n1 added where none lies inside. Reads known by evidence alone begin as unknown at all sites; a key without a
    deletion or without sites stays as it is."""
    behind = lambda n: F.sum((F.col("pos") <= F.col(n)).cast("int"))
    at = sites.join(deletions, keys).groupBy(*keys, "n1", "n2", "name", "symbol").agg(F.count("*").cast("int").alias("n"), behind("n1").cast("int").alias("a"), behind("n2").cast("int").alias("b"))
    index = lambda c: F.when(F.col(c) < F.col("n"), F.col(c))
    at = at.select(*keys, "n1", "name", "symbol", "n", index("a").alias("first"), index("b").alias("second"))
    known = evidence.groupBy(*keys, "read").agg(F.coalesce(F.bool_or("partial"), F.lit(False)).alias("partial"), F.coalesce(F.bool_or("negative"), F.lit(False)).alias("negative")).where("partial OR negative")
    x = haps.select(*keys, "read", "hap").join(known, [*keys, "read"], "full").join(at, keys, "left")
    x = x.fillna(False, ["partial", "negative"]).withColumn("hap", F.coalesce("hap", F.repeat(F.lit("x"), F.col("n"))))
    made = with_deletion(F.col("hap"), F.col("first"), F.col("second"), F.col("partial"), F.col("negative"), F.col("symbol"))
    marked = x.select(*keys, "read", F.when(F.col("n").isNull(), F.col("hap")).otherwise(made).alias("hap")).where("hap IS NOT NULL")
    new = at.where(F.col("first").eqNullSafe(F.col("second"))).select(*keys, F.col("n1").alias("pos"), F.col("name").alias("code"))
    return marked, sites.select(*keys, "pos", "code").unionByName(new)


def deletions_in_turn(haps: DataFrame, sites: DataFrame, steps: list[tuple[DataFrame, DataFrame]], keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """``mark_deletions`` for (deletions, evidence) one after the other; a later one sees the sites of those before."""
    return reduce(lambda now, step: mark_deletions(*now, *step, keys), steps, (haps, sites))
