"""Queries of calls by haplotype for one gene and for two, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from haplospark.operators import hap_rows as V
from haplospark.plans import analogues as X
from haplospark.plans.queries import K, query

_KIND = "CASE event_type WHEN 'click' THEN 'A' WHEN 'view' THEN 'C' WHEN 'purchase' THEN CASE WHEN value > 100 THEN 'G+2TT' ELSE 'G' END ELSE CASE WHEN value > 120 THEN '*' ELSE 'C-2NN' END END"
_CALLS = f"""tokens AS (SELECT user_id % 3 AS region, CASE WHEN event_id % 3 = 0 THEN 'h0' ELSE 'h1' END AS hap, user_id AS pos, event_id AS read, {_KIND} AS token, event_id % 2 = 0 AS u FROM events),
regions AS (SELECT region, max(pos) AS most FROM tokens GROUP BY 1),
haps AS (SELECT region, 'h0' AS hap, 3 AS first, 90 AS last, 10 AS sure_first, 70 AS sure_last, false AS two FROM regions UNION ALL SELECT region, 'h1', NULL, NULL, NULL, NULL, region = 0 FROM regions),
svs(region, hap, first, kind, last) AS (VALUES (1, 'h0', 20, 'DEL', 25), (0, 'h1', 30, 'INV', 45)),
places AS (SELECT region, hap, pos FROM (SELECT DISTINCT region, hap, pos FROM tokens WHERE hap = 'h1' UNION ALL SELECT region, 'h0', p FROM regions, (SELECT unnest(range(4, 90)) AS p)) x WHERE NOT EXISTS (SELECT 1 FROM svs s WHERE s.region = x.region AND s.hap = x.hap AND s.first = x.pos)),
based AS (SELECT p.region, p.hap, p.pos, substr('ACGT', (p.pos % 4 + 1)::INT, 1) AS base FROM places p JOIN regions r ON r.region = p.region AND p.pos <= r.most + 3),
counts AS (SELECT region, hap, pos, token, count(*) AS n, count(*) FILTER (u) AS nu FROM tokens GROUP BY ALL),
tops AS (SELECT b.region, b.hap, b.pos, b.base, coalesce(sum(n), 0) AS dp, coalesce(sum(nu), 0) AS dpu, coalesce(sum(n) FILTER (token = base), 0) AS rf, coalesce(sum(nu) FILTER (token = base), 0) AS rfu,
 list(row(-n, token) ORDER BY -n, length(token), token <> base, token) FILTER (n > 0) AS o, list(row(-nu, token) ORDER BY -nu, length(token), token <> base, token) FILTER (nu > 0) AS ou
 FROM based b LEFT JOIN counts c ON c.region = b.region AND c.hap = b.hap AND c.pos = b.pos GROUP BY 1, 2, 3, 4),
top AS (SELECT t.region, t.hap, t.pos, base, dp, rf, coalesce(-o[1][1], 0) AS ad, coalesce(o[1][2], base) AS token, dpu, rfu, coalesce(-ou[1][1], 0) AS adu, coalesce(ou[1][2], base) AS tokenu, h.first, sure_first, sure_last, two FROM tops t JOIN haps h ON h.region = t.region AND h.hap = t.hap),
picked AS (SELECT *, (first IS NULL OR pos < sure_first OR pos > sure_last OR ad < dp * 0.7) AND dpu >= 4 AND adu >= dpu * 0.7 AS alone FROM top),
won AS (SELECT region, hap, pos, base, two, CASE WHEN alone THEN tokenu ELSE token END AS token, CASE WHEN alone THEN dpu ELSE dp END AS dp, CASE WHEN alone THEN rfu ELSE rf END AS ad_ref, CASE WHEN alone THEN adu ELSE ad END AS ad FROM picked),
judged AS (SELECT *, CASE WHEN dp = 0 THEN '.' WHEN token = base THEN '0' ELSE '1' END AS raw, CASE WHEN dp < 4 THEN ['LowDP'] ELSE [] END || CASE WHEN dp > 0 AND ((token = base AND ad_ref < dp * 0.7) OR (token <> base AND ad < dp * 0.7)) THEN ['LowQual'] ELSE [] END AS why FROM won),
called AS (SELECT region, hap, pos, CASE WHEN contains(token, '-') THEN substr('ACGTACGT', (pos % 4 + 1)::INT, 3) ELSE base END AS ref, CASE WHEN contains(token, '-') THEN base WHEN contains(token, '+') THEN base || 'TT' ELSE token END AS alt,
 dp, ad_ref, ad, array_to_string(why, ';') AS filter, CASE WHEN len(why) = 0 THEN raw ELSE '.' END AS gt, two FROM judged
 UNION ALL SELECT s.region, s.hap, s.first, kind, s.last::VARCHAR, NULL, NULL, NULL, '', '1', two FROM svs s JOIN haps h ON h.region = s.region AND h.hap = s.hap),
named AS (SELECT * EXCLUDE (two) FROM called UNION ALL SELECT * EXCLUDE (two) REPLACE (hap || '_cp2' AS hap) FROM called WHERE two)"""


def _inputs(spark, d):
    """tokens, unique reads, haplotypes, reference bases and special variants: events by user are tokens by position."""
    kind, value = F.col("event_type"), F.col("value")
    token = F.when(kind == "click", "A").when(kind == "view", "C").when(kind == "purchase", F.when(value > 100, "G+2TT").otherwise("G")).otherwise(F.when(value > 120, "*").otherwise("C-2NN"))
    x = X.t(spark, d, "events")
    tokens = x.select((F.col("user_id") % 3).alias("region"), F.when(F.col("event_id") % 3 == 0, "h0").otherwise("h1").alias("hap"), F.col("user_id").alias("pos"), F.col("event_id").alias("read"), token.alias("token"))
    regions = tokens.groupBy("region").agg(F.max("pos").alias("most"))
    bounds = lambda h, *at: F.struct(F.lit(h).alias("hap"), *[F.lit(v).cast("long").alias(n) for n, v in zip(V.BOUNDS, at)], ((F.col("region") == 0) & F.lit(h == "h1")).alias("two_copies"))
    haps = regions.select("region", F.inline(F.array(bounds("h0", 3, 90, 10, 70), bounds("h1", None, None, None, None))))
    bases = regions.select("region", F.explode(F.sequence(F.lit(0).cast("long"), F.col("most") + 3)).alias("pos")).withColumn("base", F.substr(F.lit("ACGT"), (F.col("pos") % 4 + 1).cast("int"), F.lit(1)))
    svs = spark.createDataFrame([(1, "h0", 20, "DEL", 25), (0, "h1", 30, "INV", 45)], "region long, hap string, first long, kind string, last long")
    return tokens, tokens.where("read % 2 = 0").select("region", "read"), haps, bases, svs


@query("SELECT * FROM named", (_CALLS,))
def hap_call_rows(spark, d):
    tokens, unique, haps, bases, svs = _inputs(spark, d)
    return V.call_rows(tokens, unique, haps, bases, svs, K)


@query("""SELECT s_nationkey AS region, s_suppkey AS hap, CASE WHEN ok THEN least(a, b) END AS first, CASE WHEN ok THEN greatest(a, b) END AS last, CASE WHEN ok THEN least(c, e) END AS sure_first, CASE WHEN ok THEN greatest(c, e) END AS sure_last
 FROM (SELECT *, a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND e IS NOT NULL AS ok FROM (SELECT s_nationkey, s_suppkey, (SELECT arg_min(q, p) FROM m WHERE r = s_nationkey AND p BETWEEN f AND f + 199) AS a, (SELECT arg_min(q, p) FROM m WHERE r = s_nationkey AND p BETWEEN f + 3000 AND f + 3199) AS b,
  (SELECT arg_min(q, p) FROM m WHERE r = s_nationkey AND p BETWEEN f + 400 AND f + 599) AS c, (SELECT arg_min(q, p) FROM m WHERE r = s_nationkey AND p BETWEEN f + 2500 AND f + 2699) AS e FROM (SELECT *, s_suppkey * 37 % 5000 AS f FROM supplier)))""",
    ("m AS (SELECT c_nationkey AS r, c_custkey * 61 % 9000 AS p, min(CASE WHEN c_nationkey % 2 = 0 THEN 20000 - c_custkey * 61 % 9000 ELSE 20000 + c_custkey * 61 % 9000 END) AS q FROM customer GROUP BY 1, 2)",))
def bounds_in_other_gene(spark, d):
    """A nation is a region, its suppliers are haplotypes; customers give the matched positions, the other way round in even nations."""
    at = F.col("s_suppkey") * 37 % 5000
    haps = X.t(spark, d, "supplier").select(F.col("s_nationkey").alias("region"), F.col("s_suppkey").alias("hap"), at.alias("first"), (at + 3000).alias("last"), (at + 400).alias("sure_first"), (at + 2500).alias("sure_last"), F.lit(False).alias("two_copies"))
    p = F.col("c_custkey") * 61 % 9000
    match = X.t(spark, d, "customer").select(F.col("c_nationkey").alias("region"), p.alias("pos"), F.when(F.col("c_nationkey") % 2 == 0, 20000 - p).otherwise(20000 + p).alias("pos2"))
    return V.other_bounds(haps, match, K).drop("two_copies")
