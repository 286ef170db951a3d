"""Queries of fusions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from haplospark.operators import fusions as U
from haplospark.operators.spread import dealt
from haplospark.plans import analogues as X
from haplospark.plans.queries import K, query

_HAPS = """letters_of AS (SELECT o_custkey AS region, l_orderkey AS id, l_linenumber AS line, CASE WHEN l_linestatus = 'O' AND l_linenumber IN (1, 4) THEN '0' WHEN l_returnflag = 'R' THEN '1' WHEN l_returnflag = 'A' THEN '2' WHEN l_quantity > 25 THEN '1' ELSE '2' END AS s
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber <= 4),
haps AS (SELECT region, id, string_agg(s, '' ORDER BY line, s) AS hap FROM letters_of GROUP BY 1, 2 HAVING count(*) = 4)"""


def _haps(spark, d):
    """A customer is a region; its orders with four lines numbered up to 4 are haplotypes over those, absent (0) at lines 1 and 4 where still open."""
    line = F.col("l_linenumber")
    symbol = F.when((F.col("l_linestatus") == "O") & line.isin(1, 4), "0").when(F.col("l_returnflag") == "R", "1").when(F.col("l_returnflag") == "A", "2").when(F.col("l_quantity") > 25, "1").otherwise("2")
    x = dealt(X.t(spark, d, "lineitem").where(line <= 4).select("l_orderkey", "l_linenumber", "l_linestatus", "l_returnflag", "l_quantity"), "l_orderkey").join(X.t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    made = x.groupBy(F.col("o_custkey").alias("region"), F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(F.struct(line, symbol.alias("s"))))["s"].alias("s"))
    return made.where(F.size("s") == 4).select("region", "id", F.array_join("s", "").alias("hap"))


_CLASSES = """distinct_haps AS (SELECT region, hap, min(id) AS rank FROM haps GROUP BY 1, 2),
classes AS (SELECT *, CASE WHEN hap[1] = '0' AND hap[4] = '0' THEN 'gene2' WHEN hap[1] = '0' OR hap[4] = '0' THEN 'fusion' ELSE 'gene1' END AS cls FROM distinct_haps)"""


@query("""SELECT region, hap, cls, 'g_' || cls || 'hap' || row_number() OVER (PARTITION BY region, cls ORDER BY rank) AS name,
 (count(*) FILTER (cls = 'fusion') OVER r = 0 AND count(*) OVER r < 4 AND count(*) OVER (PARTITION BY region, cls) = 1) OR (count(*) OVER r = 1 AND cls = 'fusion') AS two_copies
 FROM classes WINDOW r AS (PARTITION BY region)""", (_HAPS, _CLASSES))
def fusion_classes(spark, d):
    haps = _haps(spark, d).groupBy("region", "hap").agg(F.min("id").alias("rank")).withColumn("name", F.concat(F.lit("g_hap"), F.col("rank").cast("string")))
    return U.name_classes(haps, K)


_FUSIONS = """sites AS (SELECT region, pos FROM (SELECT DISTINCT region FROM haps), (SELECT unnest([30, 100, 150, 200, 250, 300, 350, 400, 470]) AS pos)
 WHERE CASE WHEN region % 2 = 0 THEN pos <> 250 ELSE pos IN (100, 200, 250, 300, 400) END),
fused AS (SELECT DISTINCT region, hap FROM haps WHERE (hap[1] = '0') <> (hap[4] = '0')),
letters AS (SELECT f.region, hap, pos, row_number() OVER (PARTITION BY f.region, hap ORDER BY pos) - 1 AS idx, CASE WHEN pos IN (30, 250, 470) THEN '2' WHEN pos IN (150, 350) THEN '1' ELSE hap[(pos / 100)::INT] END AS s
 FROM fused f JOIN sites USING (region)),
scored AS (SELECT *, coalesce(count(*) FILTER (s = CASE WHEN hap[1] = '0' THEN '2' ELSE '1' END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + count(*) FILTER (s = CASE WHEN hap[1] = '0' THEN '1' ELSE '2' END) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS score,
 lag(pos) OVER w AS before FROM letters WINDOW w AS (PARTITION BY region, hap ORDER BY idx)),
best AS (SELECT region, hap, string_agg(s, '' ORDER BY idx) AS sequence, arg_max(idx, score * 100 - idx) AS split, max(idx) AS last, arg_max(pos, score * 100 - idx) AS b1, arg_max(before, score * 100 - idx) AS b3 FROM scored GROUP BY 1, 2),
matched AS (SELECT *, CASE WHEN region % 4 < 2 THEN 5000 ELSE -5000 END + (b1 + 7) // 8 * 8 AS b2, CASE WHEN region % 4 < 2 THEN 5000 ELSE -5000 END + (b3 + 7) // 8 * 8 AS b4 FROM best WHERE split NOT IN (0, last))"""


@query("""SELECT region, hap, CASE WHEN hap[1] = '0' THEN 'duplication' ELSE 'deletion' END AS type, sequence, CASE WHEN b1 < b2 THEN b3 ELSE b4 END AS first, CASE WHEN b1 < b2 THEN b1 ELSE b2 END AS first_end,
 CASE WHEN b1 < b2 THEN b4 ELSE b3 END AS second, CASE WHEN b1 < b2 THEN b2 ELSE b1 END AS second_end FROM matched""", (_HAPS, _FUSIONS))
def called_fusions(spark, d):
    """Even regions have defining sites, odd ones clips at 50 and 450; every eighth position has a match in the other gene."""
    haps = _haps(spark, d).select("region", "hap").distinct()
    regions = haps.select("region").distinct()
    site = lambda p: F.struct(F.lit(p).alias("pos"), F.lit(f"{p}_A_C").alias("code"))
    at = lambda *positions: regions.select("region", F.inline(F.array(*map(site, positions))))
    even, odd = F.col("region") % 2 == 0, F.col("region") % 2 == 1
    defining = at(30, 100, 150, 200, 300, 350, 400, 470).where(even)
    clip = lambda s, p: F.struct(F.lit(s).alias("side"), F.lit(p).alias("pos"))
    clips = regions.where(odd).select("region", F.inline(F.array(clip("5p", 50), clip("3p", 450))))
    matches = regions.select("region", F.explode(F.sequence(F.lit(0), F.lit(504), F.lit(8))).alias("pos")).withColumn("pos2", F.col("pos") + F.when(F.col("region") % 4 < 2, 5000).otherwise(-5000))
    return U.fusions(haps, at(100, 200, 300, 400), at(30, 250, 470), matches, K, mode="5p", defining=defining, clips=clips)
