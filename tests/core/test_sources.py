"""Readers and writers on small files."""

import json

from pyspark.sql import functions as F

from haplospark.sources import sinks, text


def test_sam(spark, tmp_path):
    (tmp_path / "a.sam").write_text("@HD\tVN:1\n@RG\tID:1\tSM:my sample\nr1\t0\tchr1\t101\t60\t5S10M2D8M1I\t*\t0\t0\tACGT\tIIII\tNM:i:3\trq:f:0.99\nr2\t256\tchr1\t5\t0\t10M3H\t*\t0\t0\t*\t*\n")
    rows = {r.read: r for r in text.read_sam(spark, str(tmp_path / "a.sam")).collect()}
    r = rows["r1"]
    assert (r.start, r.end, r.nm, r.aligned, r.clip_left, r.clip_right, r.rq) == (100, 120, 3, 19, 5, 0, 0.99)
    assert rows["r2"].nm is None and rows["r2"].clip_right == 3
    flagged = text.read_sam(spark, str(tmp_path / "a.sam")).where(~text.has_flag(F.col("flag"), text.SECONDARY))
    assert [x.read for x in flagged.collect()] == ["r1"]
    assert text.sample_of(spark, str(tmp_path / "a.sam"), "stem").first().sample == "my_sample"


def test_bed_fasta_depth_config(spark, tmp_path):
    (tmp_path / "a.bed").write_text("# x\nchr1 10\t20 name\n\nchr2\t1\t2\n")
    assert [tuple(r) for r in text.read_bed(spark, str(tmp_path / "a.bed")).collect()] == [("chr1", 10, 20), ("chr2", 1, 2)]
    (tmp_path / "a.fa").write_text(">s1 words\nACgt\nAC\n>s2\nGG\n")
    fasta = text.read_fasta(spark, str(tmp_path / "a.fa"))
    assert {r.name: r.sequence for r in fasta.collect()} == {"s1": "ACGTAC", "s2": "GG"}
    assert tuple(text.reference_slice(fasta, "s1", 2, 4).first()) == ("s1_2_4", "CGT")
    assert [tuple(r) for r in text.bases(fasta.where("name = 's2'"), F.lit(7)).collect()] == [("s2", 7, "G"), ("s2", 8, "G")]
    (tmp_path / "d.txt").write_text("a x 31.5\nb 2\n")
    assert {r.sample: r.depth for r in text.read_depth_file(spark, str(tmp_path / "d.txt")).collect()} == {"a": 31.5, "b": 2.0}
    regions = text.region_config(spark, json.dumps({"g2": {"realign_region": "chr2:5-9"}, "g1": {"realign_region": "chr1:10-20"}}), "37")
    assert [(r.region, r.chrom, r.start) for r in text.chosen_regions(regions, None).collect()] == [("g1", "1", 10), ("g2", "2", 5)]
    assert [r.region for r in text.chosen_regions(regions, ["g2", "none"]).collect()] == ["g2"]


def test_vcf_round_trip(spark, tmp_path):
    rows = [(7, "C", "A", "PASS", "1", "0"), (5, "C", "T", "PASS", ".", "1")]
    variants = spark.createDataFrame(rows, "pos int, ref string, alt string, filter string, h1 string, h2 string")
    sinks.write_vcf(variants, ["h1", "h2"], "chr1", 1000, str(tmp_path / "v"))
    back = text.read_vcf(spark, str(tmp_path / "v")).collect()
    assert {(r.pos, r.hap, r.gt) for r in back} == {(7, "h1", "1"), (7, "h2", "0"), (5, "h1", "."), (5, "h2", "1")}
    lines = "".join(p.read_text() for p in sorted((tmp_path / "v").glob("part-*"))).splitlines()
    assert lines[0].startswith("##fileformat") and [x.split("\t")[1] for x in lines[4:]] == ["5", "7"]


def test_transcripts_and_outputs(spark, tmp_path):
    (tmp_path / "t.csv").write_text("row,gene,transcript\n2,g,t1\n1,g,t2\n1,k,t3\n")
    assert {r.gene: r.transcript for r in text.read_transcripts(spark, str(tmp_path / "t.csv")).collect()} == {"g": "t2", "k": "t3"}
    calls = spark.createDataFrame([("s1", "b", 2), ("s1", "a", 1)], "sample string, region string, copies int")
    sinks.write_calls(calls, str(tmp_path / "calls"))
    assert spark.read.json(str(tmp_path / "calls")).count() == 2
    sinks.write_report(calls, str(tmp_path / "report"))
    assert spark.read.option("header", True).csv(str(tmp_path / "report")).columns == ["sample", "region", "copies"]
    tagged = spark.createDataFrame([("g", "r1", "c", 5, "h1")], "region string, read string, chrom string, start int, tag string")
    untagged = spark.createDataFrame([("g", "r1", "c", 5), ("g", "r2", "c", 1)], "region string, read string, chrom string, start int")
    assert [(r.read, r.tag) for r in sinks.merged_reads(tagged, untagged).collect()] == [("r2", None), ("r1", "h1")]
