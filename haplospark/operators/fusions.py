"""Fusions of two genes: classes and copies of haplotypes, and breakpoints in the positions of both genes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haplospark.functions.strings import fusion_type, hap_class
from haplospark.operators.haplotypes import explode_haps
from haplospark.operators.intervals import as_of_forward
from haplospark.operators.runs import breakpoint


def name_classes(haps: DataFrame, keys: list[str]) -> DataFrame:
    """haps(keys, hap, name, rank) -> keys, hap, name, cls, two_copies. Names become gene_gene1hap1, gene_fusionhap1, ... by class and rank, the gene being the
    name up to its first _. With both ends of all haplotypes called, a lone gene1 or gene2 counts twice where no fusion is among three haplotypes
    or fewer; so does a fusion that is the only haplotype. A region's haplotypes are few, and meet in a window."""
    region = Window.partitionBy(*keys)
    number = F.row_number().over(Window.partitionBy(*keys, "cls").orderBy("rank", "hap"))
    open_end = F.startswith("hap", F.lit("x")) | F.endswith("hap", F.lit("x"))
    x = haps.withColumn("cls", hap_class(F.col("hap"))).select(
        *keys, "hap", "cls", F.concat(F.substring_index("name", "_", 1), F.lit("_"), "cls", F.lit("hap"), number.cast("string")).alias("name"), F.bool_or(open_end).over(region).alias("open"),
        F.count("*").over(region).alias("all"), F.count_if(F.col("cls") == "fusion").over(region).alias("fusions"), F.count("*").over(Window.partitionBy(*keys, "cls")).alias("same"),
    )
    plain = (F.col("fusions") == 0) & (F.col("all") < 4) & (F.col("same") == 1)
    return x.select(*keys, "hap", "name", "cls", (~F.col("open") & (plain | ((F.col("fusions") == 1) & (F.col("all") == 1)))).alias("two_copies"))


def breakpoint_symbols(haps: DataFrame, hets: DataFrame, homs: DataFrame, keys: list[str], defining: DataFrame, clips: DataFrame) -> DataFrame:
    """haps(keys, hap), hets(keys, pos, code) in the order of the symbols, homs and defining(keys, pos, code), clips(keys, side, pos) -> keys, hap, idx, pos, symbol: haplotypes over the
    sites that tell the genes apart. A key with defining sites takes those: 2 if hom, the haplotype's symbol if het, else 1. Another takes its
    hom (2) and het sites behind all 5p and before all 3p clips. Sites stand by position, then code."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("pos", "code")) - 1
    own = explode_haps(haps.select(*keys, "hap").distinct(), keys).join(hets.select(*keys, "pos", "code").distinct().withColumn("idx", place), [*keys, "idx"]).select(*keys, "hap", "pos", "code", "symbol")
    defined = defining.select(*keys, "pos", "code").distinct()
    edges = clips.groupBy(*keys).agg(F.max(F.when(F.col("side") == "5p", F.col("pos"))).alias("low"), F.min(F.when(F.col("side") == "3p", F.col("pos"))).alias("high"))
    free = hets.select(*keys, "pos", "code").unionByName(homs.select(*keys, "pos", "code")).distinct().join(defined.select(*keys).distinct(), keys, "left_anti").join(edges, keys, "left")
    inside = free.where((F.col("low").isNull() | (F.col("pos") > F.col("low"))) & (F.col("high").isNull() | (F.col("pos") < F.col("high")))).select(*keys, "pos", "code")
    sites = defined.unionByName(inside).withColumn("idx", place).join(homs.select(*keys, "pos", "code", F.lit("2").alias("hom")).distinct(), [*keys, "pos", "code"], "left")
    x = haps.select(*keys, "hap").distinct().join(sites, keys).join(own, [*keys, "hap", "pos", "code"], "left")
    return x.select(*keys, "hap", "idx", "pos", F.coalesce("hom", "symbol", F.lit("1")).alias("symbol"))


def switch_index(symbols: DataFrame, keys: list[str]) -> DataFrame:
    """keys, hap, split of symbols(keys, hap, idx, symbol): where a haplotype absent (0) at its start turns from 2 to 1, or one absent at its end from 1 to 2; null
    if the best place is the first or last site. Other haplotypes have no row."""
    first, last = F.startswith("hap", F.lit("0")), F.endswith("hap", F.lit("0"))
    turned = F.when(first, F.translate("symbol", "12", "21")).otherwise(F.col("symbol"))
    return breakpoint(symbols.where(first != last).withColumn("symbol", turned), [*keys, "hap"], "1", "2")


def fusions(haps: DataFrame, hets: DataFrame, homs: DataFrame, match: DataFrame, keys: list[str], *, mode: str, defining: DataFrame, clips: DataFrame, reach: int = 1000) -> DataFrame:
    """match(keys, pos, pos2): positions in the other gene -> keys, hap, type, sequence, first, first_end, second, second_end: fusions and the last site before and
    first site behind their breakpoint, in the gene of lower positions and in the other one. A position without a match takes that of the next within
    ``reach``; without one for the site behind, there is no fusion, for the one before, it is null. Haplotypes with an unknown end are left out."""
    whole = haps.where(~F.startswith("hap", F.lit("x")) & ~F.endswith("hap", F.lit("x")) & (F.startswith("hap", F.lit("0")) != F.endswith("hap", F.lit("0"))))
    symbols = breakpoint_symbols(whole, hets, homs, keys, defining, clips)
    split = switch_index(symbols, keys).where("split IS NOT NULL")
    x = symbols.join(split, [*keys, "hap"]).groupBy(*keys, "hap").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("idx", "symbol")))["symbol"], "").alias("sequence"),
        F.max(F.when(F.col("idx") == F.col("split"), F.col("pos"))).cast("long").alias("behind"), F.max(F.when(F.col("idx") == F.col("split") - 1, F.col("pos"))).cast("long").alias("before"),
    )
    asked = x.select(*keys, F.explode(F.array("behind", "before")).alias("pos"))
    other = as_of_forward(asked, match.select(*keys, F.col("pos").cast("long").alias("pos"), F.col("pos2").cast("long").alias("pos2")), keys, reach, "pos2")
    at = lambda name, value: other.select(*keys, F.col("pos").alias(name), F.col("pos2").alias(value))
    found = x.join(at("behind", "behind2"), [*keys, "behind"]).join(at("before", "before2"), [*keys, "before"]).where("behind2 IS NOT NULL")
    lower = F.col("behind") < F.col("behind2")
    pick = lambda a, b: F.when(lower, F.col(a)).otherwise(F.col(b))
    return found.select(
        *keys, "hap", fusion_type(F.col("hap"), mode).alias("type"), "sequence", pick("before", "before2").alias("first"), pick("behind", "behind2").alias("first_end"),
        pick("before2", "before").alias("second"), pick("behind2", "behind").alias("second_end"),
    )
