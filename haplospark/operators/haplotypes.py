"""Reads as strings over sites; reads against haplotypes; support and its filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haplospark.operators.rounds import written
from haplospark.operators.spread import dealt

#: Parts of a key's strings.
SALTS = 16

#: Bytes of matches, folded by string, that a join broadcasts at most.
BROADCAST_BYTES = 128 << 20


def row_reads(rows: DataFrame) -> Column:
    """An aggregate: the reads that ``rows`` stand for. A row is one read, or as many as its column ``reads`` says, so that equal strings can be counted once
    and for all."""
    return F.sum("reads") if "reads" in rows.columns else F.count("*")


def encode_reads(symbols: DataFrame, keys: list[str], sites: list, least: int = 0) -> DataFrame:
    """symbols(keys, read, site, symbol) -> keys, read, hap: one symbol a site of ``sites``, x where the read has none; the
    least symbol where it has several. ``least``: calls that a read needs. One aggregation, no join."""
    at = lambda s: F.coalesce(F.min(F.when(F.col("site") == s, F.col("symbol"))), F.lit("x"))
    made = symbols.groupBy(*keys, "read").agg(F.concat(*[at(s) for s in sites]).alias("hap"))
    return made.where(F.length(F.regexp_replace("hap", "x", "")) >= least) if least else made


def explode_haps(haps: DataFrame, keys: list[str], name: str = "hap") -> DataFrame:
    """keys, hap, idx (from 0), symbol."""
    return haps.select(*keys, name, F.posexplode(F.split(name, "")).alias("idx", "symbol"))


def drop_sites(haps: DataFrame, keys: list[str]) -> DataFrame:
    """haps(keys, read, hap) -> keys, idx, why, of sites to remove: nothing called but absence; or, with 1 and 2 alone, both seen 3 times or
    less (``rare``), or one of them (``one_sided``)."""
    each = explode_haps(haps, [*keys, "read"]).groupBy(*keys, "idx").agg(
        F.count_if(F.col("symbol") == "1").alias("refs"), F.count_if(F.col("symbol") == "2").alias("alts"), F.count_if(~F.col("symbol").isin("1", "2", "x", "0")).alias("others")
    )
    plain = F.col("others") == 0
    why = F.when(plain & (F.col("refs") + F.col("alts") == 0), "empty").when(plain & (F.col("refs") <= 3) & (F.col("alts") <= 3), "rare").when(plain & ((F.col("refs") <= 3) | (F.col("alts") <= 3)), "one_sided")
    return each.withColumn("why", why).where(F.col("why").isNotNull())


def _calls(hap: str, first: int) -> Column:
    """The symbols of seven sites from ``first`` on as the bytes of a number, 0 for x and behind the end."""
    return F.conv(F.hex(F.rpad(F.substring(hap, first + 1, 7), 7, "x")), 16, 10).cast("long").bitwiseXOR(F.lit(0x78787878787878))


def compared(reads: DataFrame, haps: DataFrame, keys: list[str]) -> DataFrame:
    """reads(keys, hap), haps(keys, hap), strings of one length and of ASCII symbols -> keys, read_hap, hap, match, mismatch of each distinct read string and haplotype of its
    key. How many pairs there are follows from the strings, not from the reads; a pair costs a few operations on bits for seven sites. Strings are few bytes and many pairs:
    they are dealt by salt and keep all partitions."""
    strings = written(reads.select(*keys, F.col("hap").alias("read_hap")).distinct(), "strings")
    starts = range(0, strings.agg(F.max(F.length("read_hap"))).first()[0] or 0, 7)
    one = lambda rows, hap, side: rows.select(*keys, hap, *[_calls(hap, i).alias(f"_{side}{i}") for i in starts])
    left = one(strings, "read_hap", "a").withColumn("_salt", F.pmod(F.hash("read_hap"), F.lit(SALTS)))
    right = one(haps, "hap", "b").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pairs = left.repartition(int(strings.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "_salt").join(right, [*keys, "_salt"])
    high, low = F.lit(0x80808080808080), F.lit(0x7F7F7F7F7F7F7F)
    some = lambda v: (v + low).bitwiseAND(high)  # noqa: E731  the high bit of each byte that isn't 0
    both = [some(F.col(f"_a{i}")).bitwiseAND(some(F.col(f"_b{i}"))) for i in starts]
    apart = [m.bitwiseAND(some(F.col(f"_a{i}").bitwiseXOR(F.col(f"_b{i}")))) for i, m in zip(starts, both)]
    total = lambda bits: sum((F.bit_count(v) for v in bits), F.lit(0))
    return pairs.select(*keys, "read_hap", "hap", (total(both) - total(apart)).alias("match"), total(apart).alias("mismatch"))


def string_matches(reads: DataFrame, haps: DataFrame, keys: list[str]) -> DataFrame:
    """keys, read_hap, hap, match: distinct read strings and haplotypes without a mismatch and with a match."""
    return compared(reads, haps.select(*keys, "hap").distinct(), keys).where("mismatch = 0 AND match >= 1").drop("mismatch")


def of_reads(reads: DataFrame, strings: DataFrame, keys: list[str]) -> DataFrame:
    """reads(keys, read, hap) with what strings(keys, read_hap, ...) say of their strings."""
    return reads.withColumnRenamed("hap", "read_hap").join(strings, [*keys, "read_hap"])


def match_reads(reads: DataFrame, haps: DataFrame, keys: list[str]) -> DataFrame:
    """reads(keys, read, hap), haps(keys, hap) -> keys, read, read_hap, hap, match: pairs without a mismatch and with a match.
    Distinct read strings meet the haplotypes of their own key. There are far more rows than reads, so a read meets the haplotypes of its string folded in a row for each number
    of matches, and rows are made last: reads are dealt by read, neither sorted nor gathered by string, as long as what is folded can be broadcast; that is bounded by its bytes."""
    found = string_matches(reads, haps.repartition(SALTS, "hap"), keys)  # few tasks, as each sends to all
    folded = written(found.groupBy(*keys, "read_hap", "match").agg(F.collect_list("hap").alias("haps")), "matches")
    string = F.ceil(F.length("read_hap") / 8) * 8 + 8  # bytes in an array
    few = (folded.agg(F.sum(F.size("haps") * string)).first()[0] or 0) <= BROADCAST_BYTES
    flat = lambda rows: rows.withColumn("hap", F.explode("haps")).drop("haps")
    each = flat(of_reads(dealt(reads, "read"), F.broadcast(folded), keys)) if few else of_reads(reads, flat(folded), keys)
    return each.select(*keys, "read", "read_hap", "hap", "match")


def sole_matches(matches: DataFrame, keys: list[str]) -> DataFrame:
    """matches(keys, read_hap, hap), each once -> keys, read_hap, hap where the haplotype is the string's only match, or shares no called site with any other:
    as many sites where it alone is called as it has calls."""
    each = matches.select(*keys, "read_hap", "hap", F.posexplode(F.split("hap", ""))).where("col <> 'x'")
    alone = each.groupBy(*keys, "read_hap", "pos").agg(F.count("*").alias("n"), F.min("hap").alias("hap")).where("n = 1")
    calls = F.length(F.replace("hap", F.lit("x"), F.lit("")))
    return alone.groupBy(*keys, "read_hap", "hap").agg(F.count("*").alias("n")).where(F.col("n") == calls).drop("n")


def unique_support(matches: DataFrame, keys: list[str]) -> DataFrame:
    """matches(keys, read, read_hap, hap) -> keys, read, hap where the haplotype is the read's only match, or shares no called site with any other match. What a
    read matches follows from its string; ``sole_matches`` and ``of_reads`` do the same without the matches of all reads."""
    unique = sole_matches(matches.select(*keys, "read_hap", "hap").distinct(), keys)
    return matches.join(unique, [*keys, "read_hap", "hap"], "left_semi").select(*keys, "read", "hap").distinct()


def shared_reads(matches: DataFrame, keys: list[str], of: str = "read") -> DataFrame:
    """Reads with more than one match, and what they match; with ``of`` read_hap, strings."""
    return matches.groupBy(*keys, of).agg(F.sort_array(F.collect_set("hap")).alias("haps")).where(F.size("haps") > 1)


def low_support(reads: DataFrame, haps: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """haps left after dropping those without unique reads, then those with fewer than ``least``; a read has one row. Whatever is dropped, a read that
    is unique to a haplotype stays so, hence the second drop leaves none with too few: repeating it would change nothing. Reads may come counted (``row_reads``)."""
    counts = written(reads.groupBy(*keys, "hap").agg(row_reads(reads).alias("n")), "strings")
    strings, now = counts.withColumnRenamed("hap", "read_hap"), haps
    for floor in (1, least):
        support = sole_matches(string_matches(counts, now, keys), keys).join(strings, [*keys, "read_hap"]).groupBy(*keys, "hap").agg(F.sum("n").alias("n"))
        now = support.where(F.col("n") >= floor).select(*keys, "hap")
    return now


def closest_strings(reads: DataFrame, haps: DataFrame, keys: list[str]) -> DataFrame:
    """keys, read_hap, hap, mismatch: of distinct read strings, the haplotype with one or two mismatches, if the next has at least two more."""
    least = compared(reads, haps, keys).groupBy(*keys, "read_hap").agg(F.min(F.struct("mismatch", "hap")).alias("m"), *[F.count_if(F.col("mismatch") <= k).alias(f"to{k}") for k in (2, 3)])
    alone = F.when(F.col("m.mismatch") == 1, F.col("to2") == 1).when(F.col("m.mismatch") == 2, F.col("to3") == 1)
    return least.where(alone).select(*keys, "read_hap", "m.hap", "m.mismatch")


def closest_hap(reads: DataFrame, haps: DataFrame, keys: list[str]) -> DataFrame:
    """For reads: the haplotype with one or two mismatches, if the next has at least two more; keys, read, hap, mismatch."""
    return of_reads(reads, closest_strings(reads, haps, keys), keys).select(*keys, "read", "hap", "mismatch")


def covered_stretch(depths: DataFrame, keys: list[str], least: int = 5) -> DataFrame:
    """depths(keys, hap, idx, n) -> keys, first, last: the longest run of sites where every haplotype has at least so many calls; the first of equals."""
    good = depths.groupBy(*keys, "idx").agg(F.min("n").alias("least")).where(F.col("least") >= least)
    group = F.col("idx") - F.row_number().over(Window.partitionBy(*keys).orderBy("idx"))
    runs = good.withColumn("g", group).groupBy(*keys, "g").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.count("*").alias("size"))
    return runs.groupBy(*keys).agg(F.max(F.struct("size", (-F.col("first")).alias("m"), "last")).alias("b")).select(*keys, (-F.col("b.m")).alias("first"), F.col("b.last").alias("last"))


def name_haps(haps: DataFrame, keys: list[str], prefix: Column) -> DataFrame:
    """prefix_hap1, prefix_hap2, ... by order of the string."""
    order = Window.partitionBy(*keys).orderBy("hap")
    return haps.withColumn("name", F.concat(prefix, F.lit("_hap"), F.row_number().over(order).cast("string")))


def tag_reads(reads: DataFrame, unique: DataFrame, closest: DataFrame, shared: DataFrame, keys: list[str], of: str = "read") -> DataFrame:
    """keys, read, tag: the unique haplotype, else the closest, else one of those it matches by the read's hash, else Unassigned. ``of`` read_hap: reads(keys, read, hap), and
    the other three have a row a string; they are joined first, so that reads are joined once."""
    pick = F.element_at("haps", (F.pmod(F.xxhash64("read"), F.size("haps")) + 1).cast("int"))
    on = [*keys, of]
    one = unique.groupBy(*on).agg(F.min("hap").alias("u"))
    known = one.join(closest.select(*on, F.col("hap").alias("c")), on, "full").join(shared, on, "full")
    x = (reads.select(*keys, "read") if of == "read" else reads.select(*keys, "read", F.col("hap").alias(of))).join(known, on, "left")
    return x.select(*keys, "read", F.coalesce("u", "c", pick, F.lit("Unassigned")).alias("tag"))
