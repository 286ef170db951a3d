"""Column functions on calls: ranges of haplotypes, names of reads, codes of known variants, reviewed classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from haplospark.functions.strings import contains_all, start_end


def hap_range(hap: Column, positions: Column, left: Column, right: Column) -> Column:
    """struct(first, last) positions that a haplotype may span: up to its uncalled neighbour sites, or the region's bounds at its ends."""
    at = start_end(hap)
    return F.struct(
        F.when(at["first"] == 0, left).otherwise(F.get(positions, at["first"] - 1) + 1).alias("first"),
        F.when(at["last"] == F.length(hap) - 1, right).otherwise(F.get(positions, at["last"] + 1) - 1).alias("last"),
    )


def confident_range(first: Column, last: Column, positions: Column, left: Column, right: Column, cut_left: Column, cut_right: Column) -> Column:
    """struct(first, last): the next site inside each bound; a bound that is the region's or a truncation stays. With no site
    inside, the farthest one; with none at all, the bound."""
    inner = F.coalesce(F.array_min(F.filter(positions, lambda p: p > first)), F.array_max(positions), first)
    outer = F.coalesce(F.array_max(F.filter(positions, lambda p: p < last)), F.array_min(positions), last)
    return F.struct(F.when((first == left) | cut_left, first).otherwise(inner).alias("first"), F.when((last == right) | cut_right, last).otherwise(outer).alias("last"))


def pivot_index(sites: Column, position: Column) -> Column:
    """Index from 0 of the first site (``pos_ref_alt``) at a position, -1 if there is none."""
    return F.array_position(F.transform(sites, lambda s: F.substring_index(s, "_", 1).cast("long")), position.cast("long")) - 1


def read_name(name: Column, supplementary: Column, start: Column, size: Column) -> Column:
    """The name of an alignment: supplementary ones are told apart by where they lie."""
    return F.when(supplementary, F.concat(name, F.lit("_sup_"), start.cast("string"), F.lit("_"), size.cast("string"))).otherwise(name)


def variant_code(variants: Column, rules: list[tuple[list[str], str, str]]) -> Column:
    """A letter for each rule (wanted variants, letter if all are there, letter if not)."""
    letters = [F.when(contains_all(variants, F.array(*map(F.lit, wanted))), alt).otherwise(ref) for wanted, alt, ref in rules]
    return F.concat(*letters)


def reviewed_pathogenic(significance: Column, review: Column, listed: Column) -> Column:
    """Whether a record is pathogenic by several submitters who agree, or pathogenic and the variant is ``listed``; null counts as no."""
    agreed = review.contains("o conflicts") & review.contains("multiple")
    return F.coalesce(significance.contains("athogenic"), F.lit(False)) & (F.coalesce(agreed, F.lit(False)) | F.coalesce(listed, F.lit(False)))
