"""Queries of genotypes, directed links, phased alleles and haplogroups, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haplospark.operators import alleles as A
from haplospark.operators import copies as O
from haplospark.operators import haplogroups as N
from haplospark.operators import pileup as P
from haplospark.operators.spread import dealt
from haplospark.plans import analogues as X
from haplospark.plans.queries import K, query


def _segments(spark, d) -> DataFrame:
    """An order's lines are the segments of a read, a customer a region; a line matches one haplotype or two."""
    lines, orders = X.t(spark, d, "lineitem"), X.t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("region"))
    h = lambda c: F.concat(F.lit("h"), (F.col(c) % 4).cast("string"))
    haps = F.when(F.col("l_quantity").cast("int") % 3 == 0, F.array_sort(F.array_distinct(F.array(h("l_partkey"), h("l_suppkey"))))).otherwise(F.array(h("l_partkey")))
    start, end = F.when(F.col("l_returnflag") == "N", "x").otherwise("1"), F.when(F.col("l_linestatus") == "O", "x").otherwise("2")
    x = dealt(lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus"), "l_orderkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("region", F.col("l_orderkey").alias("read"), F.col("l_linenumber").alias("line"), haps.alias("haps"), F.concat(start, F.lit("1"), end).alias("hap")).distinct()
    return x.withColumn("seq", F.row_number().over(Window.partitionBy("region", "read").orderBy("line", "haps", "hap")))


_SEGMENTS = """segs AS (SELECT *, row_number() OVER (PARTITION BY region, read ORDER BY line, haps, hap) AS seq FROM (SELECT DISTINCT o_custkey AS region, l_orderkey AS read, l_linenumber AS line,
  CASE WHEN l_quantity::INT % 3 = 0 THEN list_sort(list_distinct(['h' || l_partkey % 4, 'h' || l_suppkey % 4])) ELSE ['h' || l_partkey % 4] END AS haps,
  CASE l_returnflag WHEN 'N' THEN 'x' ELSE '1' END || '1' || CASE l_linestatus WHEN 'O' THEN 'x' ELSE '2' END AS hap FROM lineitem JOIN orders ON l_orderkey = o_orderkey)),
met AS (SELECT a.region, a.read, a.haps AS haps1, b.haps AS haps2, len(a.haps) = 1 AND len(b.haps) = 1 AS sure,
  CASE WHEN a.region % 2 = 1 THEN CASE WHEN (a.hap[1] <> 'x' AND b.hap[1] <> 'x') OR (a.hap[3] <> 'x' AND b.hap[3] <> 'x') THEN '0-0' END WHEN a.hap[3] <> 'x' AND b.hap[1] <> 'x' THEN '1-2' WHEN a.hap[1] <> 'x' AND b.hap[3] <> 'x' THEN '2-1' END AS way
  FROM segs a JOIN segs b ON a.region = b.region AND a.read = b.read AND a.seq < b.seq WHERE len(a.haps) = 1 OR len(b.haps) = 1),
each_one AS (SELECT region, read, sure, way, h1, h2 FROM (SELECT region, read, sure, way, h1, unnest(haps2) AS h2 FROM (SELECT *, unnest(haps1) AS h1 FROM met)) WHERE h1 <> h2),
turned AS (SELECT region, sure, CASE way WHEN '2-1' THEN h2 ELSE h1 END AS a, CASE way WHEN '2-1' THEN h1 ELSE h2 END AS b FROM each_one WHERE way IS NOT NULL),
links AS (SELECT region, 'undirected' AS kind, h1 AS a, h2 AS b, count(DISTINCT read) AS n FROM each_one WHERE sure GROUP BY ALL UNION ALL SELECT region, 'directed', a, b, count(*) FROM turned WHERE sure GROUP BY ALL UNION ALL SELECT region, 'loose', a, b, count(*) FROM turned GROUP BY ALL)"""


@query("SELECT * FROM links", (_SEGMENTS,))
def directed_links(spark, d):
    return A.directed_links(_segments(spark, d), K, F.col("region") % 2 == 1)


@query("""SELECT e.region, CASE WHEN n = 2 AND placed = size THEN alleles WHEN n = 1 AND placed = size THEN alleles WHEN n = 1 AND placed = size - 1 AND size IN (3, 4) THEN list_append(alleles, list_filter(every, lambda h: NOT list_contains(flatten(alleles), h))) END AS alleles
 FROM (SELECT region, list(DISTINCT h ORDER BY h) AS every, count(DISTINCT h) AS size FROM (SELECT region, unnest(haps) AS h FROM segs) WHERE h <> 'h3' GROUP BY 1) e
 LEFT JOIN (SELECT region, list(members ORDER BY members) AS alleles, count(*) AS n, sum(len(members)) AS placed FROM (SELECT region, least_one, list(h ORDER BY h) AS members FROM (SELECT region, h, min(r) AS least_one FROM reach GROUP BY 1, 2) GROUP BY 1, 2) GROUP BY 1) s ON s.region = e.region""",
    ("RECURSIVE " + _SEGMENTS.replace("segs AS (SELECT *, row_number()", "raw AS (SELECT *, row_number()", 1).replace("met AS (", "segs AS (SELECT * REPLACE (list_filter(haps, lambda h: h <> 'h3') AS haps) FROM raw),\nmet AS (", 1),
     "strong AS (SELECT DISTINCT region, a, b FROM links WHERE kind = 'undirected' AND n >= 2)", "steps AS (SELECT region, a AS h, b AS r FROM strong UNION SELECT region, b, a FROM strong)",
     "reach AS (SELECT region, h, h AS r FROM steps UNION SELECT e.region, s.h, e.r FROM reach e JOIN steps s ON s.region = e.region AND s.r = e.h)"),
)
def phased_alleles(spark, d):
    """Alleles of each region's haplotypes but h3, from links of two reads."""
    segments = _segments(spark, d)
    haps = segments.select("region", F.explode("haps").alias("hap")).distinct()
    return A.phase_alleles(segments, haps, K, F.col("region") % 2 == 1, 2, haps.where("hap = 'h3'"))[0]


def _variants(spark, d) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Suppliers are haplotypes; known ones are a nation's customers by order priority, which is the group."""
    lines = X.t(spark, d, "lineitem").select("l_orderkey", "l_suppkey", ((F.col("l_partkey") % 150) * 300).alias("pos"), F.col("l_returnflag").alias("variant"))
    sold = lines.join(X.t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(X.t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    name = F.concat(F.col("c_nationkey").cast("string"), F.lit(" "), "o_orderpriority").alias("name")
    queries = lines.select(F.col("l_suppkey").alias("hap")).distinct().select("hap", ((F.col("hap") % 9) * 3000).alias("start"), ((F.col("hap") % 9) * 3000 + 15_000).alias("end"))
    known = sold.select(name, F.col("o_orderpriority").alias("haplogroup"), (F.col("c_nationkey") * 1000).alias("start")).distinct().withColumn("end", F.col("start") + 16_000)
    return queries, known, lines.select(F.col("l_suppkey").alias("hap"), "pos", "variant"), sold.select(name, "pos", "variant")


_DISTANCES = """lines AS (SELECT l_orderkey, l_suppkey AS hap, (l_partkey % 150) * 300 AS pos, l_returnflag AS variant FROM lineitem),
sold AS (SELECT c_nationkey || ' ' || o_orderpriority AS name, o_orderpriority AS haplogroup, c_nationkey * 1000 AS start, pos, variant FROM lines JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
spans AS (SELECT q.hap, k.name, k.haplogroup, greatest(q.start, k.start) AS first, least(q.start + 15000, k.start + 16000) AS last FROM (SELECT DISTINCT hap, hap % 9 * 3000 AS start FROM lines) q, (SELECT DISTINCT name, haplogroup, start FROM sold) k),
mine AS (SELECT DISTINCT hap, pos, variant FROM lines), theirs AS (SELECT DISTINCT name, pos, variant FROM sold),
distances AS (SELECT hap, name, haplogroup, sum(part)::BIGINT AS distance FROM (
  SELECT s.hap, s.name, haplogroup, 1 AS part FROM spans s JOIN mine m ON m.hap = s.hap AND pos BETWEEN first AND last WHERE last - first >= 12000
  UNION ALL SELECT s.hap, s.name, haplogroup, 1 FROM spans s JOIN theirs t ON t.name = s.name AND pos BETWEEN first AND last WHERE last - first >= 12000
  UNION ALL SELECT s.hap, s.name, haplogroup, -2 FROM spans s JOIN mine m ON m.hap = s.hap AND pos BETWEEN first AND last JOIN theirs t ON t.name = s.name AND t.pos = m.pos AND t.variant = m.variant WHERE last - first >= 12000
  UNION ALL SELECT hap, name, haplogroup, 0 FROM spans WHERE last - first >= 12000) GROUP BY ALL)"""


@query("SELECT * FROM distances", (_DISTANCES,))
def haplogroup_distances(spark, d):
    return N.haplogroup_distances(*_variants(spark, d))


@query("""SELECT hap, CASE WHEN (d1 <= 40 OR d0 <= 2) AND d0 < next - 2 AND d1 < next THEN haplogroup END AS haplogroup FROM (
 SELECT *, row_number() OVER (PARTITION BY hap ORDER BY d0, haplogroup) AS place, lead(d0) OVER (PARTITION BY hap ORDER BY d0, haplogroup) AS next FROM (SELECT hap, haplogroup, list_sort(list(distance))[1] AS d0, list_sort(list(distance))[2] AS d1 FROM distances GROUP BY 1, 2)) WHERE place = 1""", (_DISTANCES,))  # fmt: skip
def best_haplogroup(spark, d):
    return N.best_haplogroup(N.haplogroup_distances(*_variants(spark, d)), 40)


@query("""SELECT region, hap, site, CASE WHEN total >= 3 AND second <= least(0.15 * n, 2) AND call <> 'other' THEN CASE call WHEN 'alt' THEN '1' ELSE '0' END ELSE '.' END AS genotype FROM (
 SELECT *, row_number() OVER o AS place, coalesce(lead(n) OVER o, 0) AS second, sum(n) OVER (PARTITION BY region, hap, site) AS total FROM (
  SELECT region, hap, site, call, CASE WHEN sum(alone) OVER (PARTITION BY region, hap, site) < 3 THEN alone + shared ELSE alone END AS n FROM (
   SELECT l_linestatus AS region, l_partkey AS hap, l_linenumber AS site, CASE WHEN l_quantity::INT % 8 = 0 THEN 'other' WHEN (l_partkey % 2 = 0) = (l_quantity::INT % 5 <> 0) THEN 'alt' ELSE 'ref' END AS call,
    count(*) FILTER (l_suppkey % 2 = 0) AS alone, count(*) FILTER (l_suppkey % 2 = 1) AS shared FROM lineitem GROUP BY ALL)) WINDOW o AS (PARTITION BY region, hap, site ORDER BY n DESC, call)) WHERE place = 1""")  # fmt: skip
def genotypes_in_haps(spark, d):
    """A part is a haplotype; lines of suppliers with an even number match it alone."""
    q = F.col("l_quantity").cast("int")
    call = F.when(q % 8 == 0, "other").when((F.col("l_partkey") % 2 == 0) == (q % 5 != 0), "alt").otherwise("ref")
    x = X.t(spark, d, "lineitem").select(F.col("l_linestatus").alias("region"), F.col("l_partkey").alias("hap"), F.col("l_linenumber").alias("site"), call.alias("call"), (F.col("l_suppkey") % 2 == 0).alias("alone"))
    return P.genotype_in_haps(x.groupBy("region", "hap", "site", "call").agg(F.count_if("alone").alias("unique_reads"), F.count_if(~F.col("alone")).alias("shared_reads")), K)


_COPIES = """lines AS (SELECT l_orderkey AS region, 'h' || l_linenumber AS hap, l_returnflag = 'R' AS is_last, l_quantity < 10 AS is_middle, l_partkey AS p, l_suppkey AS s, l_quantity::INT AS q, l_discount AS c, l_linestatus AS t FROM lineitem),
every AS (SELECT region, hap, bool_or(is_last) AS is_last, bool_or(is_middle) AS is_middle FROM lines GROUP BY 1, 2), firsts AS (SELECT region, min(hap) AS first FROM every GROUP BY 1),
links AS (SELECT DISTINCT region, hap AS a, 'h' || (s % 4 + 1) AS b FROM lines WHERE c > 0.03), directed AS (SELECT DISTINCT region, hap AS a, 'h' || (p % 5 + 1) AS b FROM lines),
loose AS (SELECT DISTINCT region, 'h' || (s % 3 + 1) AS a, hap AS b FROM lines WHERE q % 6 >= 3), placed AS (SELECT DISTINCT region, t AS allele, hap FROM lines WHERE p % 3 = 0),
places AS (SELECT f.region, first, (SELECT list(hap ORDER BY hap) FROM every e WHERE e.region = f.region AND hap <> first) AS others, coalesce((SELECT list(hap ORDER BY hap) FROM every e WHERE e.region = f.region AND is_last), []) AS lasts,
 (SELECT list(hap) FROM every e WHERE e.region = f.region AND is_middle AND hap <> first) AS middles, (SELECT list(DISTINCT hap) FROM placed p WHERE p.region = f.region) AS onset, (SELECT count(DISTINCT allele) FROM placed p WHERE p.region = f.region) AS sets,
 coalesce((SELECT list(a || '-' || b) FROM directed d WHERE d.region = f.region), []) AS ways, (SELECT list(b) FROM loose l WHERE l.region = f.region AND a = first) AS after FROM firsts f),
sided AS (SELECT *, list_filter(others, lambda h: NOT list_contains(lasts, h)) AS inner_ones, (SELECT list(b) FROM links l WHERE l.region = places.region AND l.a = lasts[1]) AS before, list_filter(coalesce(after, []), lambda h: NOT list_contains(lasts, h)) AS next FROM places WHERE others IS NOT NULL),
freed AS (SELECT *, list_filter(inner_ones, lambda h: NOT list_contains(coalesce(before, []), h)) AS bare, list_filter(inner_ones, lambda h: NOT list_contains(coalesce(onset, []), h)) AS free, sets = 1 AND len(lasts) > 0 AND list_contains(onset, lasts[1]) AS ends FROM sided),
led AS (SELECT *, CASE WHEN list_contains(ways, inner_ones[1] || '-' || inner_ones[2]) <> list_contains(ways, inner_ones[2] || '-' || inner_ones[1]) THEN CASE WHEN list_contains(ways, inner_ones[1] || '-' || inner_ones[2]) THEN inner_ones[1] ELSE inner_ones[2] END END AS lead1,
 CASE WHEN list_contains(ways, free[1] || '-' || free[2]) <> list_contains(ways, free[2] || '-' || free[1]) THEN CASE WHEN list_contains(ways, free[1] || '-' || free[2]) THEN free[1] ELSE free[2] END END AS lead2 FROM freed),
ruled AS (SELECT *, CASE WHEN len(others) = 1 THEN 'only' WHEN len(inner_ones) = 1 THEN 'inner' WHEN len(others) = 2 AND len(middles) = 1 THEN 'middle' WHEN len(lasts) = 1 AND len(before) = 1 AND len(bare) = 1 THEN 'before_last' WHEN len(inner_ones) = 2 AND lead1 IS NOT NULL THEN 'order'
 WHEN ends AND len(free) = 1 THEN 'unplaced' WHEN ends AND len(free) = 2 AND lead2 IS NOT NULL THEN 'unplaced_order' WHEN len(next) = 1 AND list_contains(others, next[1]) THEN 'loose' END AS rule FROM led)"""


@query("""SELECT f.region, f.first, CASE rule WHEN 'only' THEN others[1] WHEN 'inner' THEN inner_ones[1] WHEN 'middle' THEN middles[1] WHEN 'before_last' THEN bare[1] WHEN 'order' THEN lead1 WHEN 'unplaced' THEN free[1] WHEN 'unplaced_order' THEN lead2 WHEN 'loose' THEN next[1] END AS second, rule
 FROM firsts f LEFT JOIN ruled r ON r.region = f.region""", (_COPIES,))
def second_copies(spark, d):
    """An order is an allele, its line numbers are copies, the least one comes first."""
    h = lambda c: F.concat(F.lit("h"), c.cast("string"))
    lines = X.t(spark, d, "lineitem").withColumns({"region": F.col("l_orderkey"), "hap": h(F.col("l_linenumber"))})
    haps = lines.select("region", "hap", (F.col("l_returnflag") == "R").alias("is_last"), (F.col("l_quantity") < 10).alias("is_middle"))
    links = lines.where("l_discount > 0.03").select("region", F.col("hap").alias("a"), h(F.col("l_suppkey") % 4 + 1).alias("b"))
    directed = lines.select("region", F.col("hap").alias("a"), h(F.col("l_partkey") % 5 + 1).alias("b"))
    loose = lines.select("region", h(F.col("l_suppkey") % 3 + 1).alias("a"), F.col("hap").alias("b"), (F.col("l_quantity").cast("int") % 6).alias("n"))
    placed = lines.where("l_partkey % 3 = 0").select("region", F.col("l_linestatus").alias("allele"), "hap")
    return O.second_copy(haps, haps, links, directed, loose, placed, K)
