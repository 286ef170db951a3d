"""Column functions on site strings, CIGARs, variants and segment names.

Site strings hold one symbol a site: 1 reference, 2 alternative, x unknown,
0 absent (clipped), 3 and 4 known deletions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def symbols(hap: Column) -> Column:
    return F.split(hap, "")


def _count(a: Column, b: Column, test) -> Column:
    pairs = F.zip_with(symbols(a), symbols(b), lambda x, y: test(x, y).cast("int"))
    return F.aggregate(pairs, F.lit(0), lambda s, v: s + v)


def compare_haps(a: Column, b: Column) -> Column:
    """struct(match, mismatch, extra) of two strings of equal length: sites called in both that agree
    or differ, and sites called in ``a`` alone."""
    return F.struct(
        _count(a, b, lambda x, y: (x != "x") & (y != "x") & (x == y)).alias("match"),
        _count(a, b, lambda x, y: (x != "x") & (y != "x") & (x != y)).alias("mismatch"),
        _count(a, b, lambda x, y: (x != "x") & (y == "x")).alias("extra"),
    )


def start_end(hap: Column) -> Column:
    """struct(first, last) index of a called site, from 0; for no call, last comes before first."""
    n = F.length(hap)
    first = n - F.length(F.regexp_replace(hap, "^x+", ""))
    last = F.length(F.regexp_replace(hap, "x+$", "")) - 1
    none = first == n
    return F.struct(F.when(none, n - 1).otherwise(first).alias("first"), F.when(none, 0).otherwise(last).alias("last"))


def site_code(pos: Column, ref: Column, alt: Column) -> Column:
    return F.concat_ws("_", pos.cast("string"), ref, alt)


def cigar_sum(cigar: Column, op: str, least: int = 0) -> Column:
    """Total length of the operations ``op`` longer than ``least``."""
    sizes = F.regexp_extract_all(cigar, F.lit(rf"(\d+){op}"), F.lit(1))
    return F.aggregate(F.transform(sizes, lambda s: s.cast("long")), F.lit(0).cast("long"), lambda t, s: t + F.when(s > least, s).otherwise(0))


def clip_size(cigar: Column, side: str) -> Column:
    """Clipped bases (S or H) at the ``left`` or ``right`` end."""
    pattern = r"^(\d+)[SH]" if side == "left" else r"(\d+)[SH]$"
    return F.when(cigar.rlike(pattern), F.regexp_extract(cigar, pattern, 1).cast("long")).otherwise(0)


def nm_adjusted(nm: Column, cigar: Column, least: int = 300) -> Column:
    """Edit distance without long insertions and deletions."""
    return nm - cigar_sum(cigar, "I", least) - cigar_sum(cigar, "D", least)


def indel_decode(ref: Column, token: Column) -> Column:
    """struct(ref, alt, size) of a pile-up token: ``+nSEQ`` or ``-nNNN``; other tokens are the base itself."""
    kind, n, bases = F.substring(token, 1, 1), F.regexp_extract(token, r"^[+-](\d+)", 1).cast("int"), F.regexp_extract(token, r"^[+-]\d+(.*)$", 1)
    return F.struct(
        F.when(kind == "-", F.concat(ref, F.repeat(F.lit("N"), n))).otherwise(ref).alias("ref"),
        F.when(kind == "+", F.concat(ref, bases)).when(kind == "-", ref).otherwise(token).alias("alt"),
        F.coalesce(F.when(kind.isin("+", "-"), n), F.lit(0)).alias("size"),
    )


def indel_encode(ref: Column, alt: Column) -> Column:
    """The base for a substitution, ``ref+nSEQ`` for an insertion, ``base-nNN`` for a deletion."""
    more, less = F.length(alt) - F.length(ref), F.length(ref) - F.length(alt)
    first = F.substring(ref, 1, 1)
    return F.when(more > 0, F.concat(first, F.lit("+"), more.cast("string"), F.substr(alt, F.length(ref) + 1))).when(less > 0, F.concat(first, F.lit("-"), less.cast("string"), F.repeat(F.lit("N"), less))).otherwise(alt)


def hgvs(chrom: Column, pos: Column, ref: Column, alt: Column) -> Column:
    """Genomic HGVS of a substitution, insertion or deletion with an anchor base; else null."""
    at = lambda c: c.cast("string")
    more, less = F.length(alt) - 1, F.length(ref) - 1
    head = F.concat(chrom, F.lit(":g."))
    return (
        F.when((F.length(ref) == 1) & (F.length(alt) == 1), F.concat(head, at(pos), ref, F.lit(">"), alt))
        .when((F.length(ref) == 1) & (more > 0), F.concat(head, at(pos), F.lit("_"), at(pos + 1), F.lit("ins"), F.substr(alt, F.lit(2))))
        .when((F.length(alt) == 1) & (less > 0), F.concat(head, at(pos + 1), F.lit("_"), at(pos + less), F.lit("del")))
    )


def hap_bound(start: Column, end: Column, cut_left: Column, cut_right: Column) -> Column:
    word = F.lit("truncated")
    return F.concat(start.cast("string"), F.when(cut_left, word).otherwise(""), F.lit("-"), end.cast("string"), F.when(cut_right, word).otherwise(""))


def link_direction(a: Column, b: Column, reverse: Column) -> Column:
    """How two segments of one read join: ``1-2`` if a's end and b's start are called, else ``2-1`` if b's end and a's start
    are; on opposite strands ``0-0`` if both ends or both starts are called; else null."""
    start = lambda h: F.substring(h, 1, 1) != "x"
    end = lambda h: F.substring(h, -1, 1) != "x"
    same = F.when(end(a) & start(b), "1-2").when(start(a) & end(b), "2-1")
    turned = F.when((start(a) & start(b)) | (end(a) & end(b)), "0-0")
    return F.when(reverse, turned).otherwise(same)


def fusion_type(hap: Column, mode: str) -> Column:
    """From which end is absent (0): in mode 5p a missing start is a duplication and a missing end a deletion; 3p the other way."""
    first, last = F.substring(hap, 1, 1) == "0", F.substring(hap, -1, 1) == "0"
    at_start, at_end = ("duplication", "deletion") if mode == "5p" else ("deletion", "duplication")
    return F.when(first & ~last, at_start).when(last & ~first, at_end)


def hap_class(hap: Column) -> Column:
    """gene1 if no end is absent (0), gene2 if both are, fusion if one is; an end that isn't called counts as present."""
    first, last = F.substring(hap, 1, 1), F.substring(hap, -1, 1)
    return F.when((first == "0") & (last == "0"), "gene2").when((first == "0") | (last == "0"), "fusion").otherwise("gene1")


def symmetric_difference(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))


def contains_all(have: Column, wanted: Column) -> Column:
    return F.size(F.array_intersect(have, wanted)) == F.size(F.array_distinct(wanted))


def overlap_class(start: Column, end: Column, first: Column, last: Column) -> Column:
    """How the span start-end covers the transcript first-last."""
    return F.when((end < first) | (start > last), "no_overlap").when((start <= first) & (end >= last), "fully_contained").when((start > first) & (end < last), "partial").otherwise("truncated")
