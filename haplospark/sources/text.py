"""Text formats as DataFrames: SAM, BED, FASTA, VCF, transcripts, depth files, region configs."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haplospark.functions.strings import cigar_sum, clip_size

SECONDARY, SUPPLEMENTARY, UNMAPPED, QC_FAIL, DUPLICATE, REVERSE = 0x100, 0x800, 0x4, 0x200, 0x400, 0x10


def has_flag(flag: Column, bit: int) -> Column:
    return flag.bitwiseAND(F.lit(bit)) != 0


def tag(rest: Column, name: str) -> Column:
    """Value of an optional field, as text; null if absent."""
    found = F.regexp_extract(rest, rf"(?:^|\t){name}:[A-Za-z]:([^\t]*)", 1)
    return F.when(found != "", found)


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments: read, flag, chrom, start (0-based), end, mapq, cigar, seq, qual, nm, aligned, ref_length, sample-independent. Header lines are left out."""
    lines = spark.read.text(path).where(~F.col("value").startswith("@")).select("value", F.split("value", "\t").alias("f"))
    rest = F.array_join(F.slice("f", 12, F.size("f")), "\t")
    x = lines.select(
        F.col("f")[0].alias("read"), F.col("f")[1].cast("int").alias("flag"), F.col("f")[2].alias("chrom"), (F.col("f")[3].cast("long") - 1).alias("start"), F.col("f")[4].cast("int").alias("mapq"),
        F.col("f")[5].alias("cigar"), F.col("f")[9].alias("seq"), F.col("f")[10].alias("qual"), tag(rest, "NM").cast("int").alias("nm"), tag(rest, "SA").alias("sa"), tag(rest, "rq").cast("double").alias("rq"),
    )
    c = F.col("cigar")
    matched = cigar_sum(c, "M") + cigar_sum(c, "=") + cigar_sum(c, "X")
    length = matched + cigar_sum(c, "D") + cigar_sum(c, "N")
    return x.withColumns({"end": F.col("start") + length, "ref_length": length, "aligned": matched + cigar_sum(c, "I"), "clip_left": clip_size(c, "left"), "clip_right": clip_size(c, "right")})


def sample_of(spark: SparkSession, path: str, stem: str) -> DataFrame:
    """One row: the only sample name of the header's read groups, spaces as _, else ``stem``."""
    names = spark.read.text(path).where(F.col("value").startswith("@RG")).select(F.regexp_extract("value", r"\tSM:([^\t]*)", 1).alias("s")).where("s <> ''").distinct()
    return names.agg(F.when(F.count("*") == 1, F.replace(F.first("s"), F.lit(" "), F.lit("_"))).otherwise(stem).alias("sample"))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end; lines with # are left out."""
    f = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(f[0].alias("chrom"), f[1].cast("long").alias("start"), f[2].cast("long").alias("end"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """name, sequence. A record is split off by its '>' as a line separator, so a file may hold many."""
    records = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    name = F.regexp_extract("value", r"^(\S+)", 1)
    return records.select(name.alias("name"), F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n", ""), r"\s", "")).alias("sequence"))


def bases(sequences: DataFrame, start: Column) -> DataFrame:
    """name, pos, base of sequences(name, sequence), the first at ``start``."""
    return sequences.select("name", start.alias("s"), F.posexplode(F.split("sequence", "")).alias("i", "base")).where("base <> ''").select("name", (F.col("s") + F.col("i")).alias("pos"), "base")


def reference_slice(sequences: DataFrame, name: str, start: int, end: int) -> DataFrame:
    """One record named name_start_end; start is 1-based, both ends are inside."""
    return sequences.where(F.col("name") == name).select(F.lit(f"{name}_{start}_{end}").alias("name"), F.substring("sequence", start, end - start + 1).alias("sequence"))


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """chrom, pos, ref, alt, filter, hap, gt of PASS rows without symbolic alternatives; columns 10 and on are haplotypes, named by the header of the
    row's own file (null without one). Files meet their headers by name; a header is one row a file."""
    f = F.split("value", "\t")
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    headers = lines.where(F.col("value").startswith("#CHROM")).select("file", F.slice(f, 10, F.size(f)).alias("names")).groupBy("file").agg(F.min("names").alias("names"))
    rows = lines.where(~F.col("value").startswith("#")).select("file", f.alias("f")).where((F.col("f")[6] == "PASS") & ~F.col("f")[4].startswith("<"))
    each = rows.join(headers, "file", "left").select("f", "names", F.posexplode(F.slice("f", 10, F.size("f"))).alias("i", "call"))
    return each.select(F.col("f")[0].alias("chrom"), F.col("f")[1].cast("long").alias("pos"), F.col("f")[3].alias("ref"), F.col("f")[4].alias("alt"), F.col("f")[6].alias("filter"), F.get("names", F.col("i")).alias("hap"), F.split("call", ":")[0].alias("gt"))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """gene, transcript and the other columns of a CSV with a header; a gene's first row by the file's ``row`` column, else by transcript."""
    from pyspark.sql import Window

    x = spark.read.option("header", True).csv(path)
    order = F.col("row").cast("long") if "row" in x.columns else F.col("transcript")
    return x.withColumn("__n", F.row_number().over(Window.partitionBy("gene").orderBy(order))).where("__n = 1").drop("__n")


def read_known_variants(spark: SparkSession, path: str) -> DataFrame:
    """code (position_ref_alt of the second to fourth column) and label, the last column; columns are parted by white space, shorter lines left out."""
    f = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.size(f) >= 4).select(F.concat_ws("_", f[1], f[2], f[3]).alias("code"), F.element_at(f, -1).alias("label"))


def read_depth_file(spark: SparkSession, path: str) -> DataFrame:
    """sample, depth: first and last column."""
    f = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(f[0].alias("sample"), F.element_at(f, -1).cast("double").alias("depth"))


def region_config(spark: SparkSession, text: str, build: str = "38") -> DataFrame:
    """region, chrom, start, end, and the whole config as JSON, from a JSON object {region: {"realign_region": "chr1:10-20", ...}}. Build 37 names have no chr."""
    rows = []
    for region, config in sorted(json.loads(text).items()):
        chrom, span = config["realign_region"].split(":")
        start, end = span.split("-")
        rows.append((region, chrom.removeprefix("chr") if build == "37" else chrom, int(start), int(end), json.dumps(config, sort_keys=True)))
    return spark.createDataFrame(rows, "region string, chrom string, start long, end long, config string")


def chosen_regions(regions: DataFrame, wanted: list[str] | None, defaults: list[str] | None = None) -> DataFrame:
    """The wanted regions that exist, else the defaults, else all; by name."""
    names = wanted or defaults
    return (regions.where(F.col("region").isin(names)) if names else regions).orderBy("region")
