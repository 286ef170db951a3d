"""Writers: VCF text, JSON by sample, CSV reports, tagged reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLORS = {"": "166,206,227", "allele1": "178,223,138", "allele2": "177,156,217"}


def vcf_lines(variants: DataFrame, haps: list[str], chrom: str) -> DataFrame:
    """value: a VCF body from merged variants (pos, ref, alt, filter and a column for each haplotype)."""
    calls = [F.col(h) for h in haps]
    return variants.select("pos", "alt", F.concat_ws("\t", F.lit(chrom), F.col("pos").cast("string"), F.lit("."), "ref", "alt", F.lit("."), "filter", F.lit("."), F.lit("GT"), *calls).alias("value"))


def write_vcf(variants: DataFrame, haps: list[str], chrom: str, length: int, path: str) -> None:
    """One sorted file a region, header first: a region's variants are few."""
    head = ["##fileformat=VCFv4.2", f"##contig=<ID={chrom},length={length}>", '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">', "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *haps])]
    top = variants.sparkSession.createDataFrame([(i - len(head), "", h) for i, h in enumerate(head)], "pos long, alt string, value string")
    body = vcf_lines(variants, haps, chrom).select(F.col("pos").cast("long").alias("pos"), "alt", "value")
    top.unionByName(body).repartition(1).sortWithinPartitions("pos", "alt").select("value").write.text(path)


def write_calls(calls: DataFrame, path: str) -> None:
    """JSON lines in a folder for each sample, regions in order."""
    calls.repartition("sample").sortWithinPartitions("sample", "region").write.partitionBy("sample").json(path)


def write_report(report: DataFrame, path: str) -> None:
    report.write.option("header", True).csv(path)


def color_tag(hap, allele1, allele2):
    """Colour of a read by its haplotype's allele."""
    return F.when(F.array_contains(allele1, hap), COLORS["allele1"]).when(F.array_contains(allele2, hap), COLORS["allele2"]).otherwise(COLORS[""])


def write_tagged(reads: DataFrame, path: str) -> None:
    """Reads with their tag, in coordinate order within each region."""
    reads.repartition("region").sortWithinPartitions("region", "chrom", "start").write.partitionBy("region").parquet(path)


def merged_reads(tagged: DataFrame, untagged: DataFrame) -> DataFrame:
    """Tagged rows, and untagged ones of reads that have no tagged row, by coordinate."""
    rest = untagged.join(tagged.select("region", "read").distinct(), ["region", "read"], "left_anti")
    return tagged.unionByName(rest, allowMissingColumns=True).orderBy("chrom", "start", "read")
