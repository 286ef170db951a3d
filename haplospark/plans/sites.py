"""Queries of sites for phasing and of known variants, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from haplospark.operators import sites as T
from haplospark.plans import analogues as X
from haplospark.plans.queries import K, query

_PHASING = """found AS (SELECT l_returnflag AS region, l_partkey AS pos, CASE WHEN l_partkey % 7 = 0 THEN 'hom' ELSE 'het' END AS kind, CASE l_suppkey % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'C' WHEN 2 THEN 'G' WHEN 3 THEN 'TAT' ELSE 'T' END AS alt,
 CASE WHEN l_suppkey % 5 < 3 THEN 0 WHEN l_suppkey % 5 = 3 THEN 2 WHEN l_linenumber > 3 THEN 30 ELSE 1 END AS size, count(*) AS n FROM lineitem GROUP BY ALL),
usable AS (SELECT region, pos, 'T' || CASE WHEN alt = 'T' THEN repeat('N', size) ELSE '' END AS ref, alt, size, n, CASE WHEN kind = 'hom' THEN 'hom' WHEN size > 0 OR pos % 10 = 5 THEN 'report' ELSE 'phase' END AS use
 FROM found WHERE NOT (CASE WHEN size > 0 THEN pos % 5 = 0 OR size >= 25 ELSE pos % 5 = 0 AND alt = 'A' END) AND (kind = 'hom' OR NOT (pos % 1000 > 40 AND pos % 1000 < 60))),
ranked AS (SELECT *, count(*) OVER (PARTITION BY region, pos, use) AS several, pos % 3 = 0 AND alt <> 'A' AS other FROM usable),
placed AS (SELECT *, row_number() OVER (PARTITION BY region, pos, use ORDER BY CASE WHEN use = 'report' THEN n WHEN other THEN -n END ASC NULLS LAST, alt) = 1 AS top FROM ranked)"""


@query("SELECT region, pos, ref, alt, size, use FROM placed WHERE several = 1 OR (top AND (use <> 'phase' OR other))", (_PHASING,))
def sites_for_phasing(spark, d):
    """Parts are positions; those of a fifth are masked, of a third in the white list; spans of shifted clips come every thousand."""
    lines, part, kind = X.t(spark, d, "lineitem"), F.col("l_partkey"), F.col("l_suppkey") % 5
    alt = F.when(kind == 0, "A").when(kind == 1, "C").when(kind == 2, "G").when(kind == 3, "T+2AT").when(F.col("l_linenumber") > 3, "T-30NN").otherwise("T-1N")
    keys = [F.col("l_returnflag").alias("region"), part.alias("pos")]
    candidates = lines.groupBy(*keys, F.lit("T").alias("ref"), alt.alias("alt"), F.when(part % 7 == 0, "hom").otherwise("het").alias("kind")).agg(F.count("*").alias("n"))
    places = lines.select(*keys).distinct()
    masks = places.where("pos % 5 = 0").withColumn("bases", F.when(F.col("pos") % 10 == 0, "A,1").otherwise("A"))
    shifted = places.select("region", (F.floor(F.col("pos") / 1000) * 1000).alias("at")).distinct().select("region", (F.col("at") + 40).alias("first"), (F.col("at") + 60).alias("last"))
    return T.sites_for_phasing(candidates, masks, shifted, places.where("pos % 3 = 0").withColumn("base", F.lit("A")), K)


@query("""WITH n AS (SELECT l_returnflag AS region, l_partkey AS pos, CASE WHEN l_linenumber > 5 THEN '*' ELSE 'A' END AS token, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT * FROM n x WHERE (pos BETWEEN 20 AND 70) OR coalesce((SELECT sum(n) FROM n y WHERE y.region = x.region AND y.pos = x.pos AND y.token = '*'), 0) < 2""")
def without_deleted(spark, d):
    x = X.t(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("region"), F.col("l_partkey").alias("pos"), F.when(F.col("l_linenumber") > 5, "*").otherwise("A").alias("token")).agg(F.count("*").alias("n"))
    return T.without_deleted(x, K, x.select("region", F.lit(20).alias("first"), F.lit(70).alias("last")).distinct(), 2)


@query("SELECT DISTINCT l_returnflag AS region, l_orderkey AS hap, l_suppkey || '_A_C' AS code, name AS label FROM lineitem JOIN (SELECT s_suppkey // 2 AS s, max('v' || s_suppkey) AS name FROM supplier GROUP BY 1) ON l_suppkey = s")
def known_variant_labels(spark, d):
    code = lambda c: F.concat(c.cast("string"), F.lit("_A_C"))
    variants = X.t(spark, d, "lineitem").select(F.col("l_returnflag").alias("region"), F.col("l_orderkey").alias("hap"), code(F.col("l_suppkey")).alias("code"))
    known = X.t(spark, d, "supplier").select(code(F.floor(F.col("s_suppkey") / 2)).alias("code"), F.concat(F.lit("v"), F.col("s_suppkey").cast("string")).alias("label"))
    return T.known_labels(variants, known, K)
