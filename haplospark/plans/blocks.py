"""Queries of the joins of blocks, with their SQL. Blocks of a region: its three most frequent strings over sites 0-2, 3-4 and 5-6."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haplospark.operators import blocks as B
from haplospark.plans import analogues as X
from haplospark.plans.analogues import READS
from haplospark.plans.queries import _EDGES, K, _edges, query

CUTS = ((0, 3), (3, 2), (5, 2))


def _blocks(spark, d) -> DataFrame:
    """region, pos, hap."""
    cuts = F.explode(F.array(*[F.struct(F.lit(p).alias("pos"), F.substr("hap", F.lit(p + 1), F.lit(n)).alias("part")) for p, n in CUTS]))
    seen = X.reads(spark, d).select("region", cuts.alias("c")).select("region", "c.*").where(~F.contains("part", F.lit("x"))).groupBy("region", "pos", "part").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("region", "pos").orderBy(F.desc("n"), "part"))
    return seen.withColumn("place", place).where("place <= 3").select("region", "pos", F.col("part").alias("hap"))


_CUTS = ", ".join(f"({p}, {n})" for p, n in CUTS)
_BLOCKS = f"""blocks AS (SELECT region, pos, part AS hap FROM (
 SELECT region, pos, part, row_number() OVER (PARTITION BY region, pos ORDER BY count(*) DESC, part) AS place FROM (SELECT region, pos, substr(hap, pos + 1, size) AS part FROM reads, (VALUES {_CUTS}) c(pos, size)) WHERE part NOT LIKE '%x%' GROUP BY 1, 2, 3) WHERE place <= 3)"""
_STRINGS = "strings AS (SELECT region, hap AS read_hap, count(*) AS n FROM reads GROUP BY 1, 2)"


def _agree(a: str, b: str, equal: str = "=") -> str:
    """Sites called in both texts that are equal, or not."""
    return f"len(list_filter(range(1, len({a}) + 1), lambda i: ({a})[i] <> 'x' AND ({b})[i] <> 'x' AND ({a})[i] {equal} ({b})[i]))"


def _matching(name: str, candidates: str, by: str) -> str:
    """A CTE: strings with their best candidates of each ``by``."""
    part = "substr(s.read_hap, c.pos + 1, len(c.hap))"
    return f"""{name} AS (SELECT * FROM (SELECT s.region, s.read_hap, s.n, c.* EXCLUDE (region), {_agree("c.hap", part)} AS match FROM strings s JOIN {candidates} c ON c.region = s.region WHERE {_agree("c.hap", part, "<>")} = 0 AND {_agree("c.hap", part)} > 0)
 QUALIFY match = max(match) OVER (PARTITION BY region, read_hap, {by}))"""


@query("SELECT region, read_hap, n, pos, hap, match FROM best", (READS, _STRINGS, _BLOCKS, _matching("best", "blocks", "pos")))
def matching_blocks(spark, d):
    return B.matching_haps(B.distinct_strings(X.reads(spark, d), K), _blocks(spark, d), K)


_PAIRS = "pairs AS (SELECT * FROM (VALUES (0, 3), (3, 5)) p(left_pos, right_pos))"
_LINKS = f"""{_matching("best", "blocks", "pos")}, told AS (SELECT *, count(*) OVER (PARTITION BY region, read_hap, pos) AS found FROM best), {_PAIRS},
links AS (SELECT l.region, left_pos, right_pos, l.hap AS a, r.hap AS b, sum(CASE WHEN l.found = 1 AND r.found = 1 THEN l.n ELSE 0 END)::BIGINT AS reads
 FROM pairs JOIN told l ON l.pos = left_pos JOIN told r ON r.pos = right_pos AND r.region = l.region AND r.read_hap = l.read_hap GROUP BY ALL)"""


def _pairs(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    pairs = spark.createDataFrame([(0, 3), (3, 5)], "left_pos int, right_pos int")
    side = lambda name: pairs.join(_blocks(spark, d).withColumnRenamed("pos", name), name).select("region", "left_pos", "right_pos", F.col(name).alias("pos"), "hap")
    left, right = side("left_pos"), side("right_pos")
    return left, right, B.block_links(B.distinct_strings(X.reads(spark, d), K), left, right, K, ("left_pos", "right_pos"))


@query("SELECT * FROM links", (READS, _STRINGS, _BLOCKS, _LINKS))
def linked_blocks(spark, d):
    return _pairs(spark, d)[2]


@query("""SELECT l.region, l.left_pos, l.right_pos, l.a, l.b FROM (SELECT *, count(*) OVER (PARTITION BY region, left_pos, a) AS outs, count(*) OVER (PARTITION BY region, left_pos, b) AS ins FROM thin) l
 JOIN (SELECT region, left_pos, count(*) FILTER (side = 'left') AS lefts, count(*) FILTER (side = 'right') AS rights FROM missing GROUP BY 1, 2) m ON m.region = l.region AND m.left_pos = l.left_pos
 LEFT JOIN missing ma ON ma.region = l.region AND ma.left_pos = l.left_pos AND ma.side = 'left' AND ma.hap = l.a LEFT JOIN missing mb ON mb.region = l.region AND mb.left_pos = l.left_pos AND mb.side = 'right' AND mb.hap = l.b
 WHERE (ma.hap IS NOT NULL AND ((lefts = 1 AND rights = 1 AND mb.hap IS NOT NULL) OR (outs = 1 AND (rights = 0 OR (rights = 1 AND mb.hap IS NOT NULL)))))
    OR (mb.hap IS NOT NULL AND ((lefts = 1 AND rights = 1 AND ma.hap IS NOT NULL) OR (ins = 1 AND (lefts = 0 OR (lefts = 1 AND ma.hap IS NOT NULL)))))""",
    (READS, _STRINGS, _BLOCKS, _LINKS, """thin AS (SELECT * FROM links QUALIFY row_number() OVER (PARTITION BY region, left_pos ORDER BY reads DESC, a, b) <= 3),
 strong AS (SELECT * FROM thin QUALIFY row_number() OVER (PARTITION BY region, left_pos ORDER BY reads DESC, a, b) <= 2),
 missing AS (SELECT DISTINCT region, left_pos, right_pos, 'left' AS side, a AS hap FROM thin t WHERE NOT EXISTS (SELECT 1 FROM strong s WHERE s.region = t.region AND s.left_pos = t.left_pos AND s.a = t.a)
 UNION ALL SELECT DISTINCT region, left_pos, right_pos, 'right', b FROM thin t WHERE NOT EXISTS (SELECT 1 FROM strong s WHERE s.region = t.region AND s.left_pos = t.left_pos AND s.b = t.b))"""),
)
def rescued_links(spark, d):
    """Of the three strongest links of a pair of blocks, two are made; whether the third rescues what they leave."""
    task = ["region", "left_pos", "right_pos"]
    place = F.row_number().over(Window.partitionBy("region", "left_pos").orderBy(F.desc("reads"), "a", "b"))
    thin = _pairs(spark, d)[2].withColumn("place", place).where("place <= 3")
    strong = thin.where("place <= 2")
    lost = lambda c, side: thin.select(*task, c).distinct().join(strong.select(*task, c).distinct(), [*task, c], "left_anti").select(*task, F.lit(side).alias("side"), F.col(c).alias("hap"))
    return B.rescued(thin, lost("a", "left").unionByName(lost("b", "right")), task)


def _round(i: int, pad: bool) -> str:
    """CTEs of the i-th round over frontier f{i - 1}(region, start, stop, at, ok, hap)."""
    live = f"""l{i} AS (SELECT f.*, x.next, count(*) OVER (PARTITION BY f.region, f.start) AS lefts, (SELECT count(*) FROM blocks b WHERE b.region = f.region AND b.pos = x.next) AS rights FROM f{i - 1} f JOIN (SELECT region, pos, min(pos) OVER (PARTITION BY region ORDER BY pos RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM (SELECT DISTINCT region, pos FROM blocks)) x ON x.region = f.region AND x.pos = f."at" WHERE f.ok AND f."at" < f.stop)"""
    left = f"cl{i} AS (SELECT region, start, start AS pos, hap FROM l{i})"
    right = f"cr{i} AS (SELECT DISTINCT l.region, l.start, b.pos, b.hap FROM l{i} l JOIN blocks b ON b.region = l.region AND b.pos = l.next)"
    told = lambda s: f"t{s}{i} AS (SELECT *, count(*) OVER (PARTITION BY region, read_hap, start) AS found FROM b{s}{i})"
    made = f"""k{i} AS (SELECT l.region, l.start, l.hap AS a, r.hap AS b FROM tl{i} l JOIN tr{i} r ON r.region = l.region AND r.start = l.start AND r.read_hap = l.read_hap GROUP BY 1, 2, 3, 4
  HAVING sum(CASE WHEN l.found = 1 AND r.found = 1 THEN l.n ELSE 0 END) >= CASE WHEN least(len(a), len(b)) > 2 OR (least(len(a), len(b)) = 2 AND greatest(len(a), len(b)) >= 10) THEN 1 ELSE 2 END),
m{i} AS (SELECT l.region, l.start, l.hap AS a, r.hap AS b FROM l{i} l JOIN cr{i} r ON r.region = l.region AND r.start = l.start WHERE lefts = 1 OR rights = 1
  UNION SELECT k.* FROM k{i} k WHERE NOT EXISTS (SELECT 1 FROM l{i} l WHERE l.region = k.region AND l.start = k.start AND (lefts = 1 OR rights = 1)))"""
    if pad:
        made += f""", w{i} AS (SELECT * FROM m{i} UNION SELECT region, start, hap, repeat('x', (SELECT max(len(hap)) FROM cr{i} r WHERE r.region = l.region AND r.start = l.start)::INT) FROM l{i} l WHERE NOT EXISTS (SELECT 1 FROM m{i} m WHERE m.region = l.region AND m.start = l.start AND m.a = l.hap)
  UNION SELECT region, start, repeat('x', (SELECT max(len(hap)) FROM l{i} l WHERE l.region = r.region AND l.start = r.start)::INT), hap FROM cr{i} r WHERE NOT EXISTS (SELECT 1 FROM m{i} m WHERE m.region = r.region AND m.start = r.start AND m.b = r.hap))"""
        fate = f"fate{i} AS (SELECT DISTINCT region, start, stop, next, true AS good FROM l{i})"
    else:
        made += f", w{i} AS (SELECT * FROM m{i})"
        fate = f"""fate{i} AS (SELECT l.region, l.start, l.stop, l.next, coalesce((SELECT count(DISTINCT a) FROM m{i} m WHERE m.region = l.region AND m.start = l.start) = max(lefts) AND (SELECT count(DISTINCT b) FROM m{i} m WHERE m.region = l.region AND m.start = l.start) = max(rights), false) AS good FROM l{i} l GROUP BY 1, 2, 3, 4)"""
    after = f"""f{i} AS MATERIALIZED (SELECT * FROM f{i - 1} WHERE NOT ok OR "at" >= stop
  UNION ALL SELECT w.region, w.start, t.stop, t.next, true, w.a || w.b FROM w{i} w JOIN fate{i} t ON t.region = w.region AND t.start = w.start WHERE t.good
  UNION ALL SELECT l.region, l.start, l.stop, l."at", false, l.hap FROM l{i} l JOIN fate{i} t ON t.region = l.region AND t.start = l.start WHERE NOT t.good)"""
    return ", ".join([live, left, right, _matching(f"bl{i}", f"cl{i}", "start"), _matching(f"br{i}", f"cr{i}", "start"), told("l"), told("r"), made, fate, after])


_SPANS = 'f0 AS (SELECT region, pos AS start, 5 AS stop, pos AS "at", true AS ok, hap FROM blocks WHERE pos < 5)'
_JOINED = lambda pad: (READS, _STRINGS, _BLOCKS, _SPANS, _round(1, pad), _round(2, pad))


def _spans(spark, d) -> DataFrame:
    return _blocks(spark, d).where("pos < 5").select("region", F.col("pos").alias("start"), F.lit(5).alias("stop")).distinct()


@query("SELECT * FROM f2", _JOINED(False))
def joined_blocks(spark, d):
    """Each region's spans from block 0 and from block 3 to the last; whether they join whole, and how far."""
    return B.join_blocks(X.reads(spark, d), _blocks(spark, d), _spans(spark, d), K)[0]


@query("SELECT * FROM f2", _JOINED(True))
def padded_blocks(spark, d):
    """The same spans; what nothing links is padded with x."""
    return B.join_blocks(X.reads(spark, d), _blocks(spark, d), _spans(spark, d), K, allow_x=True)[0]


@query("""SELECT DISTINCT e.region, CASE WHEN idx IN (3, 4) THEN 3 ELSE idx END AS pos, coalesce(o.hap, src) AS src, CASE WHEN idx + 1 IN (3, 4) THEN 3 ELSE idx + 1 END AS dst_pos, coalesce(i.hap, dst) AS dst,
  CASE WHEN o.hap IS NULL AND i.hap IS NULL THEN n END AS n FROM edges e LEFT JOIN blocks o ON o.region = e.region AND o.pos = 3 AND idx IN (3, 4) LEFT JOIN blocks i ON i.region = e.region AND i.pos = 3 AND idx + 1 IN (3, 4)
 WHERE idx <> 3 AND (o.hap IS NULL OR right(o.hap, 1) = src) AND (i.hap IS NULL OR left(i.hap, 1) = dst)""", (READS, _EDGES, _BLOCKS))  # fmt: skip
def contracted_edges(spark, d):
    """The graph's edges when sites 3 and 4 of each region have given way to the block's strings."""
    edges = _edges(spark, d).select("region", F.col("idx").alias("pos"), "src", (F.col("idx") + 1).alias("dst_pos"), "dst", "n")
    nodes = edges.select("region", "pos", F.col("src").alias("hap")).unionByName(edges.select("region", F.col("dst_pos").alias("pos"), F.col("dst").alias("hap"))).distinct()
    haps = _blocks(spark, d).where("pos = 3").select("region", F.col("pos").alias("start"), "hap")
    return B.contract(nodes, edges, haps.select("region", "start", F.lit(4).alias("last")).distinct(), haps, K)[1]


@query("""SELECT DISTINCT region, start, path AS hap FROM (WITH RECURSIVE p AS (SELECT region, idx AS start, idx, src || dst AS path, dst FROM edges WHERE idx IN (0, 3) UNION ALL
  SELECT e.region, p.start, e.idx, p.path || e.dst, e.dst FROM p JOIN edges e ON e.region = p.region AND e.idx = p.idx + 1 AND e.src = p.dst WHERE e.idx < p.start + 3) SELECT * FROM p WHERE idx = start + 2)""", (READS, _EDGES))  # fmt: skip
def span_paths(spark, d):
    edges = _edges(spark, d).select("region", F.col("idx").alias("pos"), "src", "dst")
    spans = edges.select("region", F.explode(F.array(F.lit(0), F.lit(3))).alias("start")).distinct().withColumn("stop", F.col("start") + 3)
    return B.span_paths(edges, spans, K)


_REACH = f"""cand AS (SELECT region, 'after' AS side, a || 'xxxx' AS hap, b AS candidate, 'xxx' || b || 'xx' AS placed FROM links WHERE left_pos = 0 UNION ALL SELECT region, 'before', 'xxxxx' || b, a, 'xxx' || a || 'xx' FROM links WHERE left_pos = 3),
counted AS (SELECT *, count(*) OVER (PARTITION BY region, hap) AS of FROM cand),
support AS (SELECT c.region, c.hap, c.candidate, least({_agree("c.hap", "s.read_hap")}, {_agree("c.placed", "s.read_hap")}) AS m, s.n FROM counted c JOIN strings s ON s.region = c.region WHERE c.of > 1 AND {_agree("c.hap", "s.read_hap", "<>")} = 0 AND {_agree("c.placed", "s.read_hap", "<>")} = 0 AND {_agree("c.hap", "s.read_hap")} > 0 AND {_agree("c.placed", "s.read_hap")} > 0),
judged AS (SELECT region, hap, candidate, quantile_cont(m, 0.5) AS median, max(m) AS most, count(*) AS reads, count(*) OVER (PARTITION BY region, hap) AS supported FROM (SELECT *, unnest(range(n)) FROM support) GROUP BY 1, 2, 3),
won AS (SELECT region, hap, candidate FROM judged j WHERE supported = 1 OR (median >= 4 AND reads >= 4 AND median > (SELECT max(most) FROM judged o WHERE o.region = j.region AND o.hap = j.hap AND o.candidate <> j.candidate))),
chosen AS (SELECT c.* FROM counted c WHERE of = 1 OR EXISTS (SELECT 1 FROM won w WHERE w.region = c.region AND w.hap = c.hap AND w.candidate = c.candidate)
 OR (EXISTS (SELECT 1 FROM judged j WHERE j.region = c.region AND j.hap = c.hap) AND NOT EXISTS (SELECT 1 FROM won w WHERE w.region = c.region AND w.hap = c.hap))),
agreed AS (SELECT region, side, hap, min(candidate) AS one, count(DISTINCT CASE side WHEN 'after' THEN candidate[1] ELSE candidate[2] END) AS near, count(DISTINCT candidate) AS variants FROM chosen GROUP BY 1, 2, 3)"""


@query("""SELECT h.region, h.hap, CASE WHEN a.near IS NULL OR near > 1 THEN h.hap WHEN a.side = 'after' AND variants = 1 THEN left(h.hap, 3) || one || 'xx' WHEN a.side = 'after' THEN left(h.hap, 3) || left(one, 1) || 'xxx'
  WHEN variants = 1 THEN 'xxx' || one || right(h.hap, 2) ELSE 'xxxx' || right(one, 1) || right(h.hap, 2) END AS extended
 FROM (SELECT region, hap || 'xxxx' AS hap FROM blocks WHERE pos = 0 UNION SELECT region, 'xxxxx' || hap FROM blocks WHERE pos = 5) h LEFT JOIN agreed a ON a.region = h.region AND a.hap = h.hap""", (READS, _STRINGS, _BLOCKS, _LINKS, _REACH))  # fmt: skip
def extended_haps(spark, d):
    """First blocks extended to the right and last blocks to the left, by what their linked neighbours agree on."""
    nodes = _blocks(spark, d)
    first = nodes.where("pos = 0").select("region", F.concat("hap", F.lit("xxxx")).alias("hap"))
    last = nodes.where("pos = 5").select("region", F.concat(F.lit("xxxxx"), "hap").alias("hap"))
    gaps = nodes.select("region").distinct().select("region", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("idx"), F.lit(10).alias("cls"), F.lit(2).alias("least"))
    return B.extended(first.unionByName(last), X.reads(spark, d), nodes, gaps, K)
