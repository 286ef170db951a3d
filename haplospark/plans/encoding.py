"""Queries of reads encoded in two rounds and of deletions marked in them, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from haplospark.operators import encoding as E
from haplospark.plans import analogues as X
from haplospark.plans.analogues import READS, SITES
from haplospark.plans.queries import K, query
from haplospark.plans.regions import clip_of

_SITE = lambda s: F.struct(F.lit(s).alias("pos"), F.lit("A").alias("ref"), F.lit("C").alias("alt"))

_TWICE = """calls AS (SELECT o_custkey AS region, l_orderkey AS read, 100 * l_linenumber AS pos, CASE l_returnflag WHEN 'R' THEN 'A' WHEN 'A' THEN 'C' ELSE 'G' END AS base FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
regions AS (SELECT DISTINCT o_custkey AS region FROM orders),
ends AS (SELECT o_custkey AS region, o_orderkey AS read, o_orderkey % 4 = 0 AND 130 + o_orderkey % 50 BETWEEN 131 AND 169 AS left_cut, o_orderkey % 5 = 0 AND 430 + o_custkey % 50 BETWEEN 431 AND 469 AS right_cut FROM orders),
gone AS (SELECT e.region, read, pos FROM ends e, (SELECT unnest([100, 120, 200, 300, 400, 480, 500, 600, 700]) AS pos) WHERE (left_cut AND pos < 150) OR (right_cut AND pos > 450)),
called AS (SELECT region, read, pos, min(CASE WHEN base = 'A' OR (pos = 400 AND base = 'G') THEN '1' WHEN base = 'C' THEN '2' ELSE 'x' END) AS symbol FROM calls GROUP BY 1, 2, 3),
symbols AS (SELECT coalesce(c.region, g.region) AS region, coalesce(c.read, g.read) AS read, coalesce(c.pos, g.pos) AS pos, CASE WHEN g.read IS NOT NULL THEN '0' ELSE symbol END AS symbol FROM called c FULL JOIN gone g ON g.region = c.region AND g.read = c.read AND g.pos = c.pos),
counts AS (SELECT r.region, p.pos, count(*) FILTER (symbol = '1') AS refs, count(*) FILTER (symbol = '2') AS alts FROM regions r CROSS JOIN (SELECT unnest(range(100, 701, 100)) AS pos) p LEFT JOIN symbols s ON s.region = r.region AND s.pos = p.pos GROUP BY 1, 2),
judged AS (SELECT region, pos, pos = 300 AND alts <= 3 AS no_alts, pos = 300 AND refs <= 3 AS no_refs FROM counts WHERE (refs > 3 AND alts > 3) OR (pos IN (200, 300) AND (refs > 3 OR alts > 3))),
stay AS (SELECT region, pos, no_alts, no_refs FROM judged UNION ALL SELECT region, 600, false, false FROM regions r WHERE region % 3 = 0 AND NOT EXISTS (SELECT 1 FROM judged j WHERE j.region = r.region AND j.pos = 600)),
final AS (SELECT * FROM stay UNION ALL SELECT region, 120, false, false FROM regions r WHERE NOT EXISTS (SELECT 1 FROM stay s WHERE s.region = r.region AND pos < 150) UNION ALL SELECT region, 480, false, false FROM regions r WHERE NOT EXISTS (SELECT 1 FROM stay s WHERE s.region = r.region AND pos > 450)),
encoded AS (SELECT f.region, s.read, string_agg(CASE WHEN t.symbol IS NULL OR (t.symbol = '2' AND no_alts) OR (t.symbol = '1' AND no_refs AND NOT no_alts) THEN 'x' ELSE t.symbol END, '' ORDER BY f.pos) AS hap
 FROM final f JOIN (SELECT DISTINCT y.region, y.read FROM symbols y JOIN final USING (region, pos)) s ON s.region = f.region LEFT JOIN symbols t ON t.region = f.region AND t.read = s.read AND t.pos = f.pos GROUP BY 1, 2)"""


@query("SELECT region, read, hap FROM encoded", (_TWICE,))
def two_round_reads(spark, d):
    """A customer is a region, an order a read, its lines are calls at seven sites; sites 200 and 300 are kept, 300 is a hom site, at 400 G counts as reference."""
    lines, orders = X.t(spark, d, "lineitem"), X.t(spark, d, "orders")
    base = F.when(F.col("l_returnflag") == "R", "a").when(F.col("l_returnflag") == "A", "C").otherwise("G")
    calls = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("region"), F.col("l_orderkey").alias("read"), (F.col("l_linenumber") * 100).alias("pos"), base.alias("base"))
    key, owner = F.col("o_orderkey"), F.col("o_custkey")
    clip = lambda n: F.when(key % n == 0, 50).otherwise(49)
    reads = orders.select(owner.alias("region"), key.alias("read"), (130 + key % 50).alias("start"), (430 + owner % 50).alias("end"), clip(4).alias("clip_left"), clip(5).alias("clip_right"))
    regions = orders.select(owner.alias("region")).distinct()
    at = lambda *positions: regions.select("region", F.inline(F.array(*map(_SITE, positions))))
    clips = regions.select("region", F.inline(F.array(F.struct(F.lit("5p").alias("side"), F.lit(150).alias("pos")), F.struct(F.lit("3p").alias("side"), F.lit(450).alias("pos")))))
    bases = at(120, 480).select("region", "pos", F.col("ref").alias("base"))
    also = regions.select("region", F.lit(400).alias("pos"), F.lit("G").alias("base"))
    haps, _ = E.encode_twice(calls, reads, at(*range(100, 701, 100)), K, clips=clips, bases=bases, kept=at(200, 300), homs=at(300), added=at(600).where("region % 3 = 0"), also_ref=also)
    return haps


_DELETED = """where_at(region, n1, n2, first, second, symbol) AS (VALUES ('1-URGENT', 25, 45, 2, 4, '3'), ('2-HIGH', 55, 90, 5, NULL, '3'), ('3-MEDIUM', 80, 80, NULL, NULL, '4'), ('4-NOT SPECIFIED', 5, 5, 0, 0, '3'), ('5-LOW', 35, 35, 3, 3, '4')),
known AS (SELECT o_orderpriority AS region, CASE WHEN o_orderkey % 30 = 0 THEN -o_orderkey ELSE o_orderkey END AS read, o_orderkey % 5 = 0 AS partial, o_orderkey % 3 = 0 AS negative FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 3 = 0),
old AS (SELECT coalesce(r.region, k.region) AS region, coalesce(r.read, k.read) AS read, coalesce(hap, 'xxxxxxx') AS hap, coalesce(partial, false) AS partial, coalesce(negative, false) AS negative FROM reads r FULL JOIN known k ON k.region = r.region AND k.read = r.read)"""


@query("""SELECT region, read, CASE region WHEN '1-URGENT' THEN CASE WHEN partial THEN hap[1:2] || '33' || hap[5:7] ELSE hap END WHEN '2-HIGH' THEN CASE WHEN partial THEN hap[1:5] || '33' ELSE hap END
 WHEN '3-MEDIUM' THEN hap || CASE WHEN partial THEN symbol WHEN hap[7] = '0' THEN '0' WHEN negative THEN '1' ELSE 'x' END WHEN '4-NOT SPECIFIED' THEN CASE WHEN partial THEN symbol WHEN hap[1] = '0' THEN '0' WHEN negative THEN '1' ELSE 'x' END || hap
 ELSE hap[1:3] || CASE WHEN partial THEN symbol WHEN hap[3:4] = '00' THEN '0' WHEN NOT contains(hap[2:5], 'x') THEN '1' ELSE 'x' END || hap[4:7] END AS hap FROM old JOIN where_at USING (region)""", (READS, _DELETED))
def deletions_marked(spark, d):
    """Each order priority is a case of where the deletion lies among the seven sites."""
    ends = {"1-URGENT": (25, 45, "3"), "2-HIGH": (55, 90, "3"), "3-MEDIUM": (80, 80, "4"), "4-NOT SPECIFIED": (5, 5, "3"), "5-LOW": (35, 35, "4")}
    deletions = spark.createDataFrame([(r, a, b, f"{a}_del", s) for r, (a, b, s) in ends.items()], "region string, n1 int, n2 int, name string, symbol string")
    orders = X.t(spark, d, "orders")
    key = F.col("o_orderkey")
    evidence = orders.select(F.col("o_orderpriority").alias("region"), F.when(key % 30 == 0, -key).otherwise(key).alias("read"), (key % 5 == 0).alias("partial"), (key % 3 == 0).alias("negative"))
    site = lambda s: F.struct(F.lit(10 * s).alias("pos"), F.lit(f"{10 * s}_A_C").alias("code"))
    sites = orders.select(F.col("o_orderpriority").alias("region")).distinct().select("region", F.inline(F.array(*map(site, SITES))))
    return E.mark_deletions(X.reads(spark, d), sites, deletions, evidence, K)[0]


@query("""SELECT region, hap, coalesce(clip, CASE WHEN NOT absent THEN 0 END) AS clip FROM (SELECT region, hap, bool_or(s = '0') AS absent FROM called GROUP BY 1, 2) LEFT JOIN found USING (region, hap)""", (READS,
    "called AS (SELECT *, lead(s) OVER w AS \"then\", lead(pos) OVER w AS next_pos FROM (SELECT region, hap, 10 * i AS pos, replace(hap[i], '2', '0') AS s FROM (SELECT DISTINCT region, hap FROM reads), (SELECT unnest(range(1, 8)) AS i)) WHERE s <> 'x' WINDOW w AS (PARTITION BY region, hap ORDER BY pos))",
    "found AS (SELECT region, hap, min(clip) AS clip FROM called, (VALUES (15), (35), (55)) c(clip) WHERE s = '0' AND \"then\" <> '0' AND clip BETWEEN pos AND next_pos AND next_pos - pos <= 20 GROUP BY 1, 2)"))
def clips_of_haps(spark, d):
    """Distinct strings of reads are haplotypes, 2 stands for absence; each region has three clips."""
    reads = X.reads(spark, d).select("region", "hap").distinct()
    at = reads.select("region", "hap", F.posexplode(F.split(F.replace("hap", F.lit("2"), F.lit("0")), "")).alias("i", "symbol")).select("region", "hap", ((F.col("i") + 1) * 10).alias("pos"), "symbol")
    clips = reads.select("region").distinct().select("region", F.explode(F.array(F.lit(15), F.lit(35), F.lit(55))).alias("clip"))
    return clip_of(at, K, clips, "5p", 10)
