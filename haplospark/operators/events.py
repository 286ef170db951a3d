"""Evidence of alignments: clips, long deletions, tokens at variants, flanks, matched positions, misaligned haplotypes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haplospark.functions.calls import hap_range
from haplospark.functions.strings import clip_size, compare_haps, indel_encode
from haplospark.operators.haplotypes import explode_haps
from haplospark.operators.rounds import written
from haplospark.operators.spread import if_small


def cigar_blocks(cigar: Column, start: Column) -> Column:
    """array<struct<op, size, ref, read>>: where each operation begins on the reference and in the read, clipped bases counted."""
    sizes, ops = (F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(i)) for i in (1, 2))
    each = F.zip_with(sizes, ops, lambda n, op: F.struct(n.cast("long").alias("size"), op.alias("op")))
    none = F.array().cast("array<struct<op:string,size:bigint,ref:bigint,read:bigint>>")

    def step(state: Column, x: Column) -> Column:
        moves = lambda kinds, n: F.when(x["op"].isin(*kinds), n).otherwise(F.lit(0).cast("long"))
        block = F.struct(x["op"].alias("op"), x["size"].alias("size"), state["ref"].alias("ref"), state["read"].alias("read"))
        return F.struct((state["ref"] + moves("MDN=X", x["size"])).alias("ref"), (state["read"] + moves("MIS=X", x["size"])).alias("read"), F.concat(state["blocks"], F.array(block)).alias("blocks"))

    first = F.struct(start.cast("long").alias("ref"), F.lit(0).cast("long").alias("read"), none.alias("blocks"))
    return F.aggregate(each, first, step, lambda s: s["blocks"])


def clip_sites(alignments: DataFrame, regions: DataFrame, known: DataFrame, keys: list[str], clip: int = 800, least: int = 6, inside: int = 1000, near: int = 100) -> DataFrame:
    """alignments(keys, start, end, cigar), regions(keys, left, right), known(keys, side, first, last) -> keys, side, pos, n: positions where ``least``
    reads or more are clipped by ``clip`` bases, ``inside`` the region, off the known spans (met by bins), and more than ``near`` behind the last one kept."""
    left = alignments.where(clip_size(F.col("cigar"), "left") >= clip).select(*keys, F.lit("5p").alias("side"), F.col("start").alias("pos"))
    right = alignments.where(clip_size(F.col("cigar"), "right") >= clip).select(*keys, F.lit("3p").alias("side"), F.col("end").alias("pos"))
    counted = left.unionByName(right).groupBy(*keys, "side", "pos").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    within = counted.join(regions, keys).where((F.col("pos") > F.col("left") + inside) & (F.col("pos") < F.col("right") - inside))
    wide = 10 * near + 1
    bins = F.explode(F.sequence(F.floor((F.col("first") - near) / wide), F.floor((F.col("last") + near) / wide)))
    spans = known.where(F.col("first") <= F.col("last")).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("side").alias("_side"), "first", "last", bins.alias("_bin"))
    on = [F.col(k) == F.col(f"_{k}") for k in [*keys, "side"]] + [F.floor(F.col("pos") / wide) == F.col("_bin"), F.col("last") >= F.col("pos") - near, F.col("first") < F.col("pos") + near]
    free = within.join(spans, on, "left_anti").select(*keys, "side", "pos", "n")
    sites = free.groupBy(*keys, "side").agg(F.array_sort(F.collect_list(F.struct("pos", "n"))).alias("s"))  # recurrent positions of a region alone
    apart = lambda kept, x: F.when((F.size(kept) == 0) | (x["pos"] - F.element_at(kept, -1)["pos"] > near), F.concat(kept, F.array(x))).otherwise(kept)
    return sites.select(*keys, "side", F.inline(F.aggregate("s", F.slice("s", 1, 0), apart)))


def long_deletion_reads(alignments: DataFrame, deletions: DataFrame, keys: list[str], clip: int = 300, extend: int = 1000, pad: int = 300) -> DataFrame:
    """alignments(keys, read, start, end, cigar), deletions(keys, p3_1, p3_2, p5_1, p5_2, size), one a key -> keys, read, full, partial, negative.
    full: the deletion is in the CIGAR, or the read is clipped at both sides of it; partial: or at one; negative: the read runs through either
    side. Where no read of a key has it in the CIGAR, and not both sides are clipped by any, full and partial are false. Keys may be few: up to a
    bound their deletions go to all tasks, so that no task holds a key's alignments."""
    x = alignments.join(if_small(deletions), keys)
    over = lambda a, b: (F.col("start") < F.col(b)) & (F.col("end") > F.col(a))
    through = lambda a, b: over(a, b) & (F.col("start") < F.col(a) - pad) & (F.col("end") > F.col(b) + pad)
    slack = F.col("size") * 0.1
    fits = lambda b: (b["op"] == "D") & (F.abs(b["size"] - F.col("size")) < F.least(slack, F.lit(50))) & (b["ref"] >= F.col("p3_1") - slack) & (b["ref"] <= F.col("p3_2") + slack)
    gone = over("p3_1", "p3_2") & F.exists(cigar_blocks(F.col("cigar"), F.col("start")), fits)
    p3 = (F.col("end") > F.col("p3_1")) & (F.col("end") < F.col("p3_2")) & (clip_size(F.col("cigar"), "right") >= clip) & (F.col("start") < F.col("p3_1") - extend)
    p5 = (F.col("start") > F.col("p5_1")) & (F.col("start") < F.col("p5_2")) & (clip_size(F.col("cigar"), "left") >= clip) & (F.col("end") > F.col("p5_2") + extend)
    each = x.groupBy(*keys, "read").agg(F.bool_or(gone).alias("gone"), F.bool_or(p3).alias("p3"), F.bool_or(p5).alias("p5"), F.bool_or(through("p3_1", "p3_2") | through("p5_1", "p5_2")).alias("negative"))
    each = written(each, "deletion_reads")  # read twice
    called = each.groupBy(*keys).agg((F.bool_or("gone") | (F.bool_or("p3") & F.bool_or("p5"))).alias("called"))
    full, some = F.col("gone") | (F.col("p3") & F.col("p5")), F.col("gone") | F.col("p3") | F.col("p5")
    judged = each.join(if_small(called, deletions), keys).select(*keys, "read", (F.col("called") & full).alias("full"), (F.col("called") & some).alias("partial"), "negative")
    return judged.where("full OR partial OR negative")


def variant_reads(tokens: DataFrame, variants: DataFrame, keys: list[str]) -> DataFrame:
    """tokens(keys, pos, read, token), variants(keys, pos, ref, alt) -> keys, pos, ref, alt, read, call: ref, alt or ``.``; of several tokens of a read, the least."""
    one = tokens.groupBy(*keys, "pos", "read").agg(F.min(F.upper("token")).alias("token"))
    x = one.join(variants.select(*keys, "pos", "ref", "alt").distinct(), [*keys, "pos"])
    wanted = F.when(F.length("ref") == F.length("alt"), F.substring("alt", 1, 1)).otherwise(indel_encode(F.col("ref"), F.col("alt")))
    call = F.when(F.col("token") == F.substring("ref", 1, 1), "ref").when(F.col("token") == wanted, "alt").otherwise(".")
    return x.select(*keys, "pos", "ref", "alt", "read", call.alias("call"))


def flank_regions(alignments: DataFrame, regions: DataFrame, keys: list[str], extend: int = 5000, width: int = 10_000) -> DataFrame:
    """alignments(keys, read, start, end), regions(keys, name, first, last, before, after) -> keys, read, side, names: the regions over whose edge a
    read lies and beyond which it goes by more than ``extend``; ``before`` and ``after`` name the side of either edge. Edges meet reads by bins."""
    edge = lambda pos, side, left: regions.select(*keys, "name", F.col(pos).alias("pos"), F.col(side).alias("side"), F.lit(left).alias("is_first"))
    edges = edge("first", "before", True).unionByName(edge("last", "after", False)).withColumn("bin", F.floor(F.col("pos") / width))
    spread = alignments.select(*keys, "read", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))).alias("bin"))
    over = (F.col("start") < F.col("pos")) & (F.col("end") >= F.col("pos"))
    beyond = F.when(F.col("is_first"), F.col("start") < F.col("pos") - extend).otherwise(F.col("end") > F.col("pos") + extend)
    return spread.join(edges, [*keys, "bin"]).where(over & beyond).groupBy(*keys, "read", "side").agg(F.array_sort(F.collect_set("name")).alias("names"))


def position_match(alignments: DataFrame, offset: int) -> DataFrame:
    """alignments(name, start, cigar, first, last, reverse, primary) of a second gene on the first -> pos1, pos2: matched positions, pos2 counted
    from ``first``, or back from ``last`` on the other strand; where several lie over a position, that of the least start and name."""
    blocks = alignments.where("primary").select("name", "start", "first", "last", "reverse", F.explode(cigar_blocks(F.col("cigar"), F.col("start"))).alias("b")).where("b.op IN ('M', '=', 'X') AND b.size > 0")
    each = blocks.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("b.size") - 1)).alias("i"))
    read = F.col("b.read") + F.col("i")
    matched = each.select((F.col("b.ref") + F.col("i") + offset).alias("pos1"), F.struct("start", "name", F.when(F.col("reverse"), F.col("last") - read).otherwise(F.col("first") + read).alias("pos2")).alias("m"))
    return matched.groupBy("pos1").agg(F.min("m").alias("m")).select("pos1", F.col("m.pos2").alias("pos2"))


def without_spurious(haps: DataFrame, flanks: DataFrame, keys: list[str], matches: int = 5, weak: int = 5, strong: int = 6) -> DataFrame:
    """haps(keys, hap, n reads), flanks(keys, hap, idx, flank), a read's bases around a site -> haps less those of ``weak`` reads or fewer that
    differ at one site alone, with ``matches`` agreeing, from one of ``strong`` or more, and share bases around that site with it. Only
    haplotypes with bases in common at a site meet."""
    side = lambda rows, name: flanks.distinct().join(rows, [*keys, "hap"]).select(*keys, "idx", "flank", F.col("hap").alias(name))
    met = side(haps.where(F.col("n") <= weak), "hap").join(side(haps.where(F.col("n") >= strong), "other"), [*keys, "idx", "flank"])
    differ = F.zip_with(F.split("hap", ""), F.split("other", ""), lambda a, b: a.isin("1", "2") & b.isin("1", "2") & (a != b))
    alone = (F.size(F.filter(differ, lambda v: v)) == 1) & F.get(differ, F.col("idx"))
    drop = met.where(alone & (compare_haps(F.col("hap"), F.col("other")).match >= matches)).select(*keys, "hap").distinct()
    return haps.join(drop, [*keys, "hap"], "left_anti").select(*keys, "hap", "n")


def variants_of_haps(haps: DataFrame, sites: list[tuple[int, str]], homs: DataFrame, keys: list[str], left: int, right: int, width: int = 10_000) -> DataFrame:
    """haps(keys, hap), sites (position, code) of its symbols, homs(keys, pos, code) -> keys, hap, first, last, variants: codes of the sites where it has
    2 and of the hom sites within the range that it may span, by position. Hom sites meet ranges by bins of ``width``."""
    at = hap_range(F.col("hap"), F.array(*[F.lit(p) for p, _ in sites]), F.lit(left), F.lit(right))
    ranged = haps.select(*keys, "hap").distinct().withColumn("r", at).select(*keys, "hap", "r.first", "r.last")
    named = F.create_map(*[F.lit(v) for i, (p, c) in enumerate(sites) for v in (i, c)])
    placed = F.create_map(*[F.lit(v) for i, (p, c) in enumerate(sites) for v in (i, p)])
    own = explode_haps(ranged.select(*keys, "hap"), keys).where("symbol = '2'").select(*keys, "hap", placed[F.col("idx")].cast("long").alias("pos"), named[F.col("idx")].alias("code"))
    bins = F.explode(F.sequence(F.floor(F.col("first") / width), F.floor(F.col("last") / width)))
    met = ranged.where(F.col("first") <= F.col("last")).withColumn("bin", bins).join(homs.withColumn("bin", F.floor(F.col("pos") / width)), [*keys, "bin"])
    shared = met.where(F.col("pos").between(F.col("first"), F.col("last"))).select(*keys, "hap", F.col("pos").cast("long").alias("pos"), "code")
    listed = own.unionByName(shared).distinct().groupBy(*keys, "hap").agg(F.array_sort(F.collect_list(F.struct("pos", "code"))).code.alias("variants"))
    return ranged.join(listed, [*keys, "hap"], "left").select(*keys, "hap", "first", "last", F.coalesce("variants", F.array().cast("array<string>")).alias("variants"))
