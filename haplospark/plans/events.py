"""Queries of the evidence of alignments, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from haplospark.operators import events as E
from haplospark.operators.haplotypes import explode_haps
from haplospark.plans import analogues as X
from haplospark.plans.analogues import LONG_HAPS, READS, SITES, SPANS, TOKENS
from haplospark.plans.queries import K, query


@query("""WITH RECURSIVE clips AS (SELECT l_returnflag AS region, '5p' AS side, l_suppkey * 60 AS pos FROM lineitem WHERE 30 * l_quantity::INT >= 800
 UNION ALL SELECT l_returnflag, '3p', l_suppkey * 60 + 500 FROM lineitem WHERE 300 * l_linenumber >= 800),
sites AS (SELECT region, side, pos, count(*) AS n FROM clips WHERE pos > 100 AND pos < 4000 GROUP BY ALL HAVING count(*) >= 6),
known AS (SELECT substr('RAN', n_nationkey::INT + 1, 1) AS region, '5p' AS side, n_nationkey * 1000 AS first, n_nationkey * 1000 + 50 AS last FROM nation WHERE n_nationkey < 3),
free AS (SELECT * FROM sites s WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.region = s.region AND k.side = s.side AND last >= pos - 100 AND first < pos + 100)),
next AS (SELECT a.region, a.side, a.pos, min(b.pos) AS after FROM free a JOIN free b ON a.region = b.region AND a.side = b.side AND b.pos > a.pos + 100 GROUP BY ALL),
kept AS (SELECT region, side, min(pos) AS pos FROM free GROUP BY 1, 2 UNION ALL SELECT k.region, k.side, after FROM kept k JOIN next n ON k.region = n.region AND k.side = n.side AND k.pos = n.pos)
SELECT f.region, f.side, f.pos, n FROM free f JOIN kept k ON f.region = k.region AND f.side = k.side AND f.pos = k.pos""")
def clip_sites(spark, d):
    clipped = F.concat((30 * F.col("l_quantity").cast("int")).cast("string"), F.lit("S500M"), (300 * F.col("l_linenumber")).cast("string"), F.lit("H"))
    x = X.t(spark, d, "lineitem").select(F.col("l_returnflag").alias("region"), (F.col("l_suppkey") * 60).alias("start"), (F.col("l_suppkey") * 60 + 500).alias("end"), clipped.alias("cigar"))
    regions = x.select("region").distinct().select("region", F.lit(-900).alias("left"), F.lit(5000).alias("right"))
    n = F.col("n_nationkey")
    known = X.t(spark, d, "nation").where(n < 3).select(F.substr(F.lit("RAN"), (n + 1).cast("int"), F.lit(1)).alias("region"), F.lit("5p").alias("side"), (n * 1000).alias("first"), (n * 1000 + 50).alias("last"))
    return E.clip_sites(x, regions, known, K)


@query("""WITH parts AS (SELECT l_returnflag AS region, l_orderkey AS read, (l_partkey % 40) * 100 AS a, (l_suppkey % 5) * 100 AS c1, 500 + l_partkey % 1000 AS m1, l_quantity::INT * 10 AS del, 600 + (l_orderkey % 7) * 400 AS m2, (l_linenumber % 4) * 150 AS c2
 FROM lineitem), al AS (SELECT *, a + m1 + del + m2 AS z FROM parts),
each_one AS (SELECT region, read, bool_or(a < 2600 AND z > 2000 AND abs(del - 300) < 30 AND a + m1 BETWEEN 1970 AND 2630) AS gone, bool_or(z > 2000 AND z < 2600 AND c2 >= 300 AND a < 1000) AS p3,
 bool_or(a > 3000 AND a < 3600 AND c1 >= 300 AND z > 4600) AS p5, bool_or((a < 1700 AND z > 2900) OR (a < 2700 AND z > 3900)) AS negative FROM al GROUP BY 1, 2),
called AS (SELECT region, bool_or(gone) OR (bool_or(p3) AND bool_or(p5)) AS called FROM each_one GROUP BY 1),
judged AS (SELECT region, read, called AND (gone OR (p3 AND p5)) AS "full", called AND (gone OR p3 OR p5) AS partial, negative FROM each_one JOIN called USING (region))
SELECT * FROM judged WHERE "full" OR partial OR negative""")
def long_deletion_reads(spark, d):
    line = {"a": (F.col("l_partkey") % 40) * 100, "c1": (F.col("l_suppkey") % 5) * 100, "m1": 500 + F.col("l_partkey") % 1000, "del": F.col("l_quantity").cast("int") * 10, "m2": 600 + (F.col("l_orderkey") % 7) * 400, "c2": (F.col("l_linenumber") % 4) * 150}
    text = lambda name: line[name].cast("string")
    cigar = F.concat(text("c1"), F.lit("S"), text("m1"), F.lit("M"), text("del"), F.lit("D"), text("m2"), F.lit("M"), text("c2"), F.lit("S"))
    x = X.t(spark, d, "lineitem").select(F.col("l_returnflag").alias("region"), F.col("l_orderkey").alias("read"), line["a"].alias("start"), (line["a"] + line["m1"] + line["del"] + line["m2"]).alias("end"), cigar.alias("cigar"))
    deletions = spark.createDataFrame([(r, 2000, 2600, 3000, 3600, 300) for r in "RAN"], "region string, p3_1 int, p3_2 int, p5_1 int, p5_2 int, size int")
    return E.long_deletion_reads(x, deletions, K)


@query("""SELECT region, pos, ref, alt, read, CASE WHEN token = 'C' THEN 'ref' WHEN token = CASE alt WHEN 'CAT' THEN 'C+2AT' ELSE alt END THEN 'alt' ELSE '.' END AS call
 FROM (SELECT *, CASE pos % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'CAT' ELSE 'G' END AS alt FROM tokens)""", (TOKENS,))
def variant_reads(spark, d):
    tokens = X.tokens(spark, d)
    alt = F.when(F.col("pos") % 3 == 0, "A").when(F.col("pos") % 3 == 1, "CAT").otherwise("G")
    return E.variant_reads(tokens, tokens.select("region", "pos", "ref", alt.alias("alt")).distinct(), K)


_FLANKS = """edges AS (SELECT * FROM (VALUES ('region1', 2500, '5p', true), ('region1', 2600, '3p', false), ('region2', 3000, '5p', true), ('region2', 3100, '3p', false), ('region3', 3500, '3p', true), ('region3', 3600, '5p', false)) v(name, pos, side, is_first))"""


@query("""SELECT region, read, side, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM spans, edges
 WHERE "start" < pos AND "end" >= pos AND CASE WHEN is_first THEN "start" < pos - 30 ELSE "end" > pos + 30 END GROUP BY 1, 2, 3""", (SPANS, _FLANKS))
def flank_regions(spark, d):
    spans = X.spans(spark, d)
    flanks = spark.createDataFrame([("region1", 2500, 2600, "5p", "3p"), ("region2", 3000, 3100, "5p", "3p"), ("region3", 3500, 3600, "3p", "5p")], "name string, first int, last int, before string, after string")
    regions = X.t(spark, d, "orders").select(F.col("o_orderpriority").alias("region")).distinct().crossJoin(flanks)  # five regions, three flanks
    return E.flank_regions(spans, regions, K, 30, 365).withColumn("names", F.array_join("names", ","))


@query("""SELECT pos1, arg_min(pos2, who) AS pos2 FROM (SELECT s_suppkey * 20 + b.ref + i + 100 AS pos1, s_suppkey AS who, CASE WHEN s_nationkey % 2 = 1 THEN s_suppkey * 1000 + 67 - (b.read + i) ELSE s_suppkey * 1000 + b.read + i END AS pos2
 FROM supplier, (VALUES (0, 5, 30), (32, 35, 20), (52, 58, 10)) b(ref, read, size), (SELECT unnest(range(0, 30)) AS i) WHERE i < b.size AND s_nationkey % 5 <> 0) GROUP BY 1""")
def position_match(spark, d):
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    x = X.t(spark, d, "supplier").select(key.alias("name"), (key * 20).alias("start"), F.lit("5S30M2D20M3I10M").alias("cigar"), (key * 1000).alias("first"), (key * 1000 + 67).alias("last"), (nation % 2 == 1).alias("reverse"), (nation % 5 != 0).alias("primary"))
    return E.position_match(x, 100)


_SUPPORTED = """counted AS (SELECT region, hap, count(*) AS n FROM reads WHERE length(replace(hap, 'x', '')) >= 3 GROUP BY 1, 2),
flanks AS (SELECT DISTINCT region, hap, i, read % 4 AS flank FROM reads, (SELECT unnest(range(1, 8)) AS i) WHERE length(replace(hap, 'x', '')) >= 3),
met AS (SELECT DISTINCT w.region, w.hap, s.hap AS other, wf.i FROM counted w JOIN flanks wf ON w.region = wf.region AND w.hap = wf.hap JOIN flanks sf ON sf.region = wf.region AND sf.i = wf.i AND sf.flank = wf.flank JOIN counted s ON s.region = sf.region AND s.hap = sf.hap WHERE w.n <= 1 AND s.n >= 2),
gone AS (SELECT DISTINCT region, hap FROM met WHERE substr(hap, i, 1) IN ('1', '2') AND substr(other, i, 1) IN ('1', '2') AND substr(hap, i, 1) <> substr(other, i, 1)
 AND len(list_filter(range(1, 8), lambda j: substr(hap, j::INT, 1) <> substr(other, j::INT, 1) AND substr(hap, j::INT, 1) <> 'x' AND substr(other, j::INT, 1) <> 'x')) = 1
 AND len(list_filter(range(1, 8), lambda j: substr(hap, j::INT, 1) = substr(other, j::INT, 1) AND substr(hap, j::INT, 1) <> 'x')) >= 3)"""


@query("SELECT c.region, c.hap, n FROM counted c WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.region = c.region AND g.hap = c.hap)", (READS, _SUPPORTED))
def without_spurious(spark, d):
    reads = X.reads(spark, d).where(F.length(F.replace("hap", F.lit("x"), F.lit(""))) >= 3)
    haps = reads.groupBy("region", "hap").agg(F.count("*").alias("n"))
    flanks = explode_haps(reads, ["region", "read"]).select("region", "hap", "idx", (F.col("read") % 4).alias("flank"))
    return E.without_spurious(haps, flanks, K, 3, 1, 2)


_SPANNED = """ranged AS (SELECT region, hap, CASE WHEN f = 0 THEN 5 ELSE 10 * f + 1 END AS first, CASE WHEN l = 6 THEN 75 ELSE 10 * (l + 2) - 1 END AS last
 FROM (SELECT region, hap, length(hap) - length(ltrim(hap, 'x')) AS f, length(rtrim(hap, 'x')) - 1 AS l FROM haps)),
listed AS (SELECT region, hap, 10 * i AS pos, concat(10 * i, '_A_C') AS code FROM haps, (SELECT unnest(range(1, 8)) AS i) WHERE substr(hap, i::INT, 1) = '2'
 UNION ALL SELECT region, hap, 10 * i + 5, concat(10 * i + 5, '_G_T') FROM ranged, (SELECT unnest(range(1, 7)) AS i) WHERE 10 * i + 5 BETWEEN first AND last)"""


@query("SELECT region, hap, first, last, coalesce((SELECT string_agg(code, ',' ORDER BY pos) FROM listed l WHERE l.region = r.region AND l.hap = r.hap), '') AS variants FROM ranged r", (READS, LONG_HAPS, _SPANNED))
def variants_of_haps(spark, d):
    homs = X.t(spark, d, "orders").select(F.col("o_orderpriority").alias("region")).distinct().select("region", F.explode(F.array(*[F.lit(10 * i + 5) for i in range(1, 7)])).alias("pos"))
    homs = homs.withColumn("code", F.concat(F.col("pos").cast("string"), F.lit("_G_T")))
    return E.variants_of_haps(X.haps(spark, d, 5), [(10 * s, f"{10 * s}_A_C") for s in SITES], homs, K, 5, 75).withColumn("variants", F.array_join("variants", ","))
