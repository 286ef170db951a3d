"""One query for each operator over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haplospark.functions import stats
from haplospark.functions import strings as S
from haplospark.operators import alleles as A
from haplospark.operators import copynumber as C
from haplospark.operators import depth as D
from haplospark.operators import graph as G
from haplospark.operators import haplotypes as H
from haplospark.operators import intervals as I
from haplospark.operators import pileup as P
from haplospark.operators import runs as R
from haplospark.operators import variants as V
from haplospark.operators.rounds import written
from haplospark.operators.spread import dealt
from haplospark.plans import analogues as X
from haplospark.plans.analogues import CONTROLS, DEPTHS, HAPS, HISTOGRAM, LONG_HAPS, READS, SPANS, TOKENS

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
K = ["region"]


def query(sql: str | None = None, ctes: tuple[str, ...] = ()):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = (f"WITH {', '.join(ctes)} " if ctes else "") + sql
        return f

    return add


# Depth


def _depths(spark, d) -> DataFrame:
    return I.depth_at_positions(X.spans(spark, d), X.controls(spark, d), K, 365)


@query("SELECT region, pos, depth FROM depths", (SPANS, CONTROLS, DEPTHS))
def depth_at_positions(spark, d):
    return _depths(spark, d)


@query("SELECT region, median(depth)::DOUBLE AS median_depth, quantile_cont(depth, 0.8)::DOUBLE AS p80_depth FROM depths GROUP BY 1", (SPANS, CONTROLS, DEPTHS))
def depth_summary_p80(spark, d):
    return D.depth_summary(_depths(spark, d), K)


_MAD = """middle AS (SELECT region, median(depth)::DOUBLE AS m FROM depths GROUP BY 1),
mad AS (SELECT region, m AS median_depth, round(median(abs(depth - m)) / nullif(m, 0), 6) AS mad_ratio FROM depths JOIN middle USING (region) GROUP BY 1, 2)"""


@query("SELECT region, median_depth, mad_ratio FROM mad", (SPANS, CONTROLS, DEPTHS, _MAD))
def depth_median_mad(spark, d):
    return D.median_mad(_depths(spark, d), K).withColumn("mad_ratio", F.round("mad_ratio", 6))


@query("SELECT region, CASE WHEN median_depth >= 10 AND mad_ratio <= 0.25 THEN median_depth END AS usable_depth FROM mad", (SPANS, CONTROLS, DEPTHS, _MAD))
def genome_depth_gate(spark, d):
    return D.genome_gate(D.median_mad(_depths(spark, d), K)).select("region", "usable_depth")


@query("SELECT region, NOT (median(depth) IS NULL OR (median(depth) <= 8 AND quantile_cont(depth, 0.8) < 50)) AS callable FROM depths GROUP BY 1", (SPANS, CONTROLS, DEPTHS))
def coverage_gate(spark, d):
    return D.coverage_gate(D.depth_summary(_depths(spark, d), K)).select("region", "callable")


_SEX = """SELECT s, x_depth, y_depth, CASE WHEN x_depth = 0 THEN NULL WHEN y_depth / x_depth < 0.05 THEN 'female'
 WHEN y_depth / x_depth > 0.1 THEN CASE WHEN x_depth > 1.95 * y_depth THEN 'female' ELSE 'male' END END AS sex
FROM (SELECT l_suppkey % 100 AS s, median(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS x_depth, median(CASE WHEN l_returnflag = 'A' THEN l_quantity * l_discount * 10 END) AS y_depth FROM lineitem WHERE l_returnflag IN ('R', 'A') GROUP BY 1)"""


@query(_SEX.replace("x_depth, y_depth, CASE", "round(x_depth, 6) AS x_depth, round(y_depth, 6) AS y_depth, CASE"))
def ratio_class(spark, d):
    flag = F.col("l_returnflag")
    x = X.t(spark, d, "lineitem").where(flag.isin("R", "A")).select((F.col("l_suppkey") % 100).alias("s"), F.when(flag == "R", "X").otherwise("Y").alias("chrom"), F.when(flag == "R", F.col("l_quantity")).otherwise(F.col("l_quantity") * F.col("l_discount") * 10).alias("depth"))
    return D.sex(x, ["s"]).withColumns({c: F.round(c, 6) for c in ("x_depth", "y_depth")})


# Interval joins


@query("""SELECT l_orderkey, l_linenumber, pos, CASE WHEN p < pos + 5 THEN mapped END AS mapped FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey * 5 + l_linenumber AS pos FROM lineitem) l
 ASOF LEFT JOIN (SELECT p_partkey * 7 AS p, min(p_size) AS mapped FROM part GROUP BY 1) r ON l.pos <= r.p""")
def as_of_forward(spark, d):
    left = X.t(spark, d, "lineitem").select(F.lit(0).alias("chrom"), (F.col("l_partkey") * 5 + F.col("l_linenumber")).alias("pos"), "l_orderkey", "l_linenumber").distinct()
    right = X.t(spark, d, "part").select(F.lit(0).alias("chrom"), (F.col("p_partkey") * 7).alias("pos"), F.col("p_size").alias("mapped"))
    return left.join(I.as_of_forward(left, right, ["chrom"], 5, "mapped"), ["chrom", "pos"]).select("l_orderkey", "l_linenumber", "pos", "mapped")


_NOISY = "noisy AS (SELECT s_nationkey % 3 AS region, s_suppkey * 4 AS a, s_suppkey * 4 + 2 AS b FROM supplier)"


def _noisy(spark, d):
    return X.t(spark, d, "supplier").select((F.col("s_nationkey") % 3).alias("region"), (F.col("s_suppkey") * 4).alias("start"), (F.col("s_suppkey") * 4 + 2).alias("end"))


@query("SELECT region, pos, read FROM tokens x WHERE NOT EXISTS (SELECT 1 FROM noisy n WHERE n.region = x.region AND x.pos BETWEEN n.a AND n.b)", (TOKENS, _NOISY))
def noisy_anti_join(spark, d):
    return I.outside(X.tokens(spark, d), _noisy(spark, d), K, 50).select("region", "pos", "read")


@query("SELECT region, pos, read FROM tokens x WHERE NOT EXISTS (SELECT 1 FROM noisy n WHERE n.region = x.region AND x.pos > n.a AND x.pos < n.b)", (TOKENS, _NOISY))
def breakpoint_exclusion(spark, d):
    return I.outside(X.tokens(spark, d), _noisy(spark, d), K, 50, closed=False).select("region", "pos", "read")


@query("""SELECT DISTINCT region AS chrom, read, "start", "end" FROM spans s WHERE "end" > "start" AND EXISTS (SELECT 1 FROM (SELECT CASE s_suppkey % 5 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' WHEN 2 THEN '3-MEDIUM' ELSE '5-LOW' END AS region, 1830 + s_suppkey * 37 % 2400 AS a FROM supplier) r
 WHERE r.region = s.region AND s."start" < r.a + 3 AND s."end" > r.a)""", (SPANS,))
def multi_region_extract(spark, d):
    reads = X.spans(spark, d).where(F.col("end") > F.col("start")).withColumnRenamed("region", "chrom")
    n = F.col("s_suppkey")
    chrom = F.when(n % 5 == 0, "1-URGENT").when(n % 5 == 1, "2-HIGH").when(n % 5 == 2, "3-MEDIUM").otherwise("5-LOW")
    regions = X.t(spark, d, "supplier").select(chrom.alias("chrom"), (1830 + n * 37 % 2400).alias("start"), (1833 + n * 37 % 2400).alias("end"))
    return I.overlapping(reads, regions, 400).select("chrom", "read", "start", "end")


@query("""SELECT region, read, CASE WHEN "end" < 2500 OR "start" > 3000 THEN 'no_overlap' WHEN "start" <= 2500 AND "end" >= 3000 THEN 'fully_contained' WHEN "start" > 2500 AND "end" < 3000 THEN 'partial' ELSE 'truncated' END AS cls, count(*) AS n FROM spans GROUP BY ALL""", (SPANS,))
def transcript_overlap_class(spark, d):
    x = X.spans(spark, d)
    return x.select("region", "read", S.overlap_class(F.col("start"), F.col("end"), F.lit(2500), F.lit(3000)).alias("cls")).groupBy("region", "read", "cls").agg(F.count("*").alias("n"))


# Pile-up


def _histogram(spark, d):
    return P.token_histogram(X.tokens(spark, d).withColumn("r", F.col("ref")), K).withColumn("ref", F.lit("C"))


@query("SELECT region, pos, token, n FROM histogram", (TOKENS, HISTOGRAM))
def token_histogram(spark, d):
    return P.token_histogram(X.tokens(spark, d), K)


@query("SELECT region, pos, token, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY region, pos ORDER BY n DESC, token)::INT AS rank FROM histogram) WHERE rank <= 3", (TOKENS, HISTOGRAM))
def top3_tokens(spark, d):
    return P.top_tokens(_histogram(spark, d), K).select("region", "pos", "token", "n", "rank")


@query("""SELECT region, pos, token AS call, dp, ad_ref, n AS ad, (token <> ref)::INT AS gt FROM (
 SELECT *, row_number() OVER (PARTITION BY region, pos ORDER BY n DESC, length(token), token <> ref, token) AS r, sum(n) OVER (PARTITION BY region, pos)::BIGINT AS dp,
 coalesce(sum(CASE WHEN token = ref THEN n END) OVER (PARTITION BY region, pos), 0)::BIGINT AS ad_ref FROM histogram) WHERE r = 1""", (TOKENS, HISTOGRAM))
def consensus_4key(spark, d):
    return P.consensus(_histogram(spark, d), K)


_SITES = """sites AS (
 SELECT region, pos, ref, token AS alt, CASE WHEN sure THEN 'hom' ELSE 'het' END AS kind, n FROM (
  SELECT *, kinds = 1 OR top_n > greatest(depth - gone - 5, 0.85 * (depth - gone)) AS sure FROM (
   SELECT *, row_number() OVER (PARTITION BY region, pos ORDER BY n DESC, token) AS rank, count(*) OVER (PARTITION BY region, pos) AS kinds,
          max(n) OVER (PARTITION BY region, pos) AS top_n, bool_or(token = ref) OVER (PARTITION BY region, pos) AS has_ref FROM (
    SELECT *, sum(n) OVER (PARTITION BY region, pos) AS depth, coalesce(sum(CASE WHEN token = '*' THEN n END) OVER (PARTITION BY region, pos), 0) AS gone FROM histogram)
   WHERE depth >= 5 AND gone < LIMIT_GONE AND token <> '*'))
 WHERE token <> ref AND ((sure AND rank = 1) OR (NOT sure AND rank <= 3 AND has_ref AND ((n >= 5 AND n >= depth * 0.11) OR n >= 20))))"""


@query("SELECT region, pos, ref, alt, kind, n FROM sites", (TOKENS, HISTOGRAM, _SITES.replace("LIMIT_GONE", "5")))
def candidate_sites(spark, d):
    return P.candidate_sites(_histogram(spark, d), K)


def _plain_sites(spark, d):
    return P.candidate_sites(_histogram(spark, d).where("token <> '*'"), K)


_PLAIN = HISTOGRAM.replace("FROM tokens", "FROM tokens WHERE token <> '*'")


@query("SELECT region, pos, ref, alt, kind, n FROM (SELECT *, count(*) OVER (PARTITION BY region, pos) AS alts, row_number() OVER (PARTITION BY region, pos ORDER BY alt) AS f FROM sites) WHERE alts = 1 OR (pos IN (3, 5, 7) AND f = 1)", (TOKENS, _PLAIN, _SITES.replace("LIMIT_GONE", "5")))
def multiallelic_having(spark, d):
    return P.drop_multiallelic(_plain_sites(spark, d), K, [3, 5, 7])


@query("""SELECT region, pos, alt, CASE WHEN m.bases IS NULL THEN 'phase' WHEN list_contains(string_split(m.bases, ','), alt) THEN NULL WHEN list_contains(string_split(m.bases, ','), '1') THEN 'phase' ELSE 'report' END AS "use"
 FROM sites LEFT JOIN (SELECT DISTINCT user_id % 3 AS region, user_id AS pos, CASE user_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'G,1' ELSE 'T' END AS bases FROM events WHERE user_id % 2 = 0 OR user_id % 4 = 1) m USING (region, pos)""", (TOKENS, _PLAIN, _SITES.replace("LIMIT_GONE", "5")))
def homopolymer_site_split(spark, d):
    u = F.col("user_id")
    masks = X.t(spark, d, "events").where("user_id % 2 = 0 OR user_id % 4 = 1").select((u % 3).alias("region"), u.alias("pos"), F.when(u % 4 == 0, "A").when(u % 4 == 1, "G,1").otherwise("T").alias("bases")).distinct()
    return P.split_homopolymer_sites(_plain_sites(spark, d), masks, K).select("region", "pos", "alt", "use")


@query("""SELECT region, pos, read, token FROM (SELECT *, lag(token) OVER (PARTITION BY region, pos % 10 ORDER BY read) AS before FROM tokens) WHERE before IS NULL OR NOT regexp_matches(before, '^[*+-]')""", (TOKENS,))
def previous_column_flag(spark, d):
    x = X.tokens(spark, d).select("region", (F.col("pos") % 10).alias("r"), F.col("read").alias("at"), F.col("pos").alias("p"), "token")
    return P.previous_flag(x.withColumnsRenamed({"r": "read", "at": "pos"}), K).select("region", F.col("p").alias("pos"), F.col("pos").alias("read"), "token")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_quantity >= 20 AND l_extendedprice >= 800 AND l_tax < l_discount * 0.5")
def read_quality_filter(spark, d):
    x = X.t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("mapq"), F.col("l_extendedprice").alias("aligned"), F.col("l_tax").alias("nm"), F.col("l_discount").alias("ref_length"))
    return P.read_quality(x, mapq=20, mismatch=0.5).select("l_orderkey", "l_linenumber", "l_partkey")


_CIGAR = "concat(l_linenumber * 100, 'S', l_quantity::INT, 'M', l_linenumber * 90, 'D', l_partkey % 50, 'M', l_suppkey % 400, 'I', l_quantity::INT, 'M')"


def _cigars(spark, d):
    i = lambda c: F.col(c).cast("int").cast("string")
    n = lambda c: F.expr(c).cast("string")
    cigar = F.concat(n("l_linenumber * 100"), F.lit("S"), i("l_quantity"), F.lit("M"), n("l_linenumber * 90"), F.lit("D"), n("l_partkey % 50"), F.lit("M"), n("l_suppkey % 400"), F.lit("I"), i("l_quantity"), F.lit("M"))
    return X.t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", cigar.alias("cigar"))


@query(f"SELECT l_orderkey, l_linenumber, {_CIGAR} AS cigar, (l_linenumber * 90)::BIGINT AS deleted, (l_suppkey % 400)::BIGINT AS inserted, (l_linenumber * 100)::BIGINT AS clipped, (1000 - CASE WHEN l_linenumber * 90 > 300 THEN l_linenumber * 90 ELSE 0 END - CASE WHEN l_suppkey % 400 > 300 THEN l_suppkey % 400 ELSE 0 END)::BIGINT AS nm FROM lineitem")
def cigar_sums(spark, d):
    c = F.col("cigar")
    return _cigars(spark, d).select("l_orderkey", "l_linenumber", "cigar", S.cigar_sum(c, "D").alias("deleted"), S.cigar_sum(c, "I").alias("inserted"), S.clip_size(c, "left").alias("clipped"), S.nm_adjusted(F.lit(1000), c).alias("nm"))


# Strings


def _pairs(spark, d):
    x = X.reads(spark, d).select("region", "hap").distinct()
    return x.join(X.haps(spark, d).withColumnRenamed("hap", "b"), "region")


_PAIR_SQL = "pairs AS (SELECT r.region, r.hap, h.hap AS b FROM (SELECT DISTINCT region, hap FROM reads) r JOIN haps h USING (region))"
_each = lambda test: "(" + " + ".join(f"({test.format(i=i)})::INT" for i in range(1, 8)) + ")"
_A, _B = "hap[{i}]", "b[{i}]"
_MATCH = _each(f"{_A} <> 'x' AND {_B} <> 'x' AND {_A} = {_B}")
_MISMATCH = _each(f"{_A} <> 'x' AND {_B} <> 'x' AND {_A} <> {_B}")
_EXTRA = _each(f"{_A} <> 'x' AND {_B} = 'x'")


@query(f"SELECT region, hap, b, {_MATCH} AS match, {_MISMATCH} AS mismatch, {_EXTRA} AS extra FROM pairs", (READS, HAPS, _PAIR_SQL))
def compare_haps(spark, d):
    return _pairs(spark, d).select("region", "hap", "b", S.compare_haps(F.col("hap"), F.col("b")).alias("c")).select("region", "hap", "b", "c.*")


@query("SELECT DISTINCT hap, CASE WHEN hap = 'xxxxxxx' THEN 6 ELSE 7 - length(ltrim(hap, 'x')) END::INT AS first, CASE WHEN hap = 'xxxxxxx' THEN 0 ELSE length(rtrim(hap, 'x')) - 1 END::INT AS last FROM reads", (READS,))
def start_end(spark, d):
    return X.reads(spark, d).select("hap", S.start_end(F.col("hap")).alias("s")).select("hap", "s.*").distinct()


@query("SELECT DISTINCT token, CASE WHEN token[1] = '-' THEN 'C' || repeat('N', regexp_extract(token, '^[+-](\\d+)', 1)::INT) ELSE 'C' END AS ref, CASE WHEN token[1] = '+' THEN 'C' || regexp_extract(token, '^[+-]\\d+(.*)$', 1) WHEN token[1] = '-' THEN 'C' ELSE token END AS alt, CASE WHEN token[1] IN ('+', '-') THEN regexp_extract(token, '^[+-](\\d+)', 1)::INT ELSE 0 END AS size FROM (SELECT CASE l_linenumber WHEN 1 THEN 'A' WHEN 2 THEN '+' || 2 || 'AT' WHEN 3 THEN '-' || 3 || 'NNN' ELSE '+' || l_linenumber || repeat('G', l_linenumber) END AS token FROM lineitem)")
def indel_decode(spark, d):
    n = F.col("l_linenumber")
    token = F.when(n == 1, "A").when(n == 2, "+2AT").when(n == 3, "-3NNN").otherwise(F.concat(F.lit("+"), n.cast("string"), F.repeat(F.lit("G"), n)))
    return X.t(spark, d, "lineitem").select(token.alias("token")).distinct().select("token", S.indel_decode(F.lit("C"), F.col("token")).alias("x")).select("token", "x.*")


_VARIANTS = "variants AS (SELECT DISTINCT l_linenumber AS chrom, l_partkey AS pos, CASE l_returnflag WHEN 'R' THEN 'ATG' ELSE 'A' END AS ref, CASE l_returnflag WHEN 'N' THEN 'ACC' ELSE CASE WHEN l_linestatus = 'O' THEN 'A' ELSE 'G' END END AS alt FROM lineitem)"


def _variants(spark, d):
    flag = F.col("l_returnflag")
    return X.t(spark, d, "lineitem").select(F.col("l_linenumber").alias("chrom"), F.col("l_partkey").alias("pos"), F.when(flag == "R", "ATG").otherwise("A").alias("ref"), F.when(flag == "N", "ACC").when(F.col("l_linestatus") == "O", "A").otherwise("G").alias("alt")).distinct()


@query("""SELECT chrom, pos, ref, alt, CASE WHEN length(ref) = 1 AND length(alt) = 1 THEN chrom || ':g.' || pos || ref || '>' || alt WHEN length(ref) = 1 THEN chrom || ':g.' || pos || '_' || (pos + 1) || 'ins' || substr(alt, 2)
 WHEN length(alt) = 1 THEN chrom || ':g.' || (pos + 1) || '_' || (pos + length(ref) - 1) || 'del' END AS hgvs,
 CASE WHEN length(alt) > length(ref) THEN ref || '+' || (length(alt) - length(ref)) || substr(alt, length(ref) + 1) WHEN length(alt) < length(ref) THEN ref[1] || '-' || (length(ref) - length(alt)) || repeat('N', (length(ref) - length(alt))::INT) ELSE alt END AS token, pos || '_' || ref || '_' || alt AS site FROM variants""", (_VARIANTS,))
def hgvs_and_codes(spark, d):
    ref, alt, pos = F.col("ref"), F.col("alt"), F.col("pos")
    return _variants(spark, d).select("chrom", "pos", "ref", "alt", S.hgvs(F.col("chrom").cast("string"), pos, ref, alt).alias("hgvs"), S.indel_encode(ref, alt).alias("token"), S.site_code(pos, ref, alt).alias("site"))


@query("""SELECT region, read, min("start") || CASE WHEN count(*) > 2 THEN 'truncated' ELSE '' END || '-' || max("end") || CASE WHEN count(*) > 3 THEN 'truncated' ELSE '' END AS bound FROM spans GROUP BY 1, 2""", (SPANS,))
def hap_bound(spark, d):
    x = X.spans(spark, d).groupBy("region", "read").agg(F.min("start").alias("a"), F.max("end").alias("b"), F.count("*").alias("n"))
    return x.select("region", "read", S.hap_bound(F.col("a"), F.col("b"), F.col("n") > 2, F.col("n") > 3).alias("bound"))


_ENDS = "ends AS (SELECT region, read, replace(hap, 'x', '0') AS z, hap FROM reads)"


@query("""SELECT region, read, CASE WHEN z[1] = '0' AND z[-1] <> '0' THEN 'duplication' WHEN z[-1] = '0' AND z[1] <> '0' THEN 'deletion' END AS f5, CASE WHEN z[1] = '0' AND z[-1] <> '0' THEN 'deletion' WHEN z[-1] = '0' AND z[1] <> '0' THEN 'duplication' END AS f3,
 CASE WHEN z[1] = '0' AND z[-1] = '0' THEN 'gene2' WHEN z[1] = '0' OR z[-1] = '0' THEN 'fusion' ELSE 'gene1' END AS cls FROM ends""", (READS, _ENDS))
def fusion_type_and_class(spark, d):
    x = X.reads(spark, d).withColumn("z", F.replace("hap", F.lit("x"), F.lit("0")))
    return x.select("region", "read", S.fusion_type(F.col("z"), "5p").alias("f5"), S.fusion_type(F.col("z"), "3p").alias("f3"), S.hap_class(F.col("z")).alias("cls"))


@query("""SELECT DISTINCT hap, b, CASE WHEN hap[-1] <> 'x' AND b[1] <> 'x' THEN '1-2' WHEN hap[1] <> 'x' AND b[-1] <> 'x' THEN '2-1' END AS same,
 CASE WHEN (hap[1] <> 'x' AND b[1] <> 'x') OR (hap[-1] <> 'x' AND b[-1] <> 'x') THEN '0-0' END AS turned FROM (SELECT a.hap, c.hap AS b FROM reads a JOIN reads c ON a.region = c.region AND c.read = a.read + 1)""", (READS,))
def link_direction(spark, d):
    x = X.reads(spark, d)
    later = x.select("region", (F.col("read") - 1).alias("read"), F.col("hap").alias("b"))
    a, b = F.col("hap"), F.col("b")
    return x.join(later, ["region", "read"]).select("hap", "b", S.link_direction(a, b, F.lit(False)).alias("same"), S.link_direction(a, b, F.lit(True)).alias("turned")).distinct()


# Statistics


@query("""SELECT k, h, round(p1 / s, 6) AS p1, round(p2 / s, 6) AS p2, round(p3 / s, 6) AS p3, round(p4 / s, 6) AS p4 FROM (SELECT *, p1 + p2 + p3 + p4 AS s FROM (
 SELECT k, h, exp(l1 - m) AS p1, exp(l2 - m) AS p2, exp(l3 - m) AS p3, exp(l4 - m) AS p4 FROM (SELECT *, greatest(l1, l2, l3, l4) AS m FROM (
 SELECT k, h, k * ln(1.0::DOUBLE) - h AS l1, k * ln(2.0::DOUBLE) - 2 * h AS l2, k * ln(3.0::DOUBLE) - 3 * h AS l3, k * ln(4.0::DOUBLE) - 4 * h AS l4 FROM (SELECT l_suppkey AS s, count(*) AS k, round(avg(l_quantity) / 2, 3)::DOUBLE AS h FROM lineitem GROUP BY 1)))))""")
def poisson_posterior(spark, d):
    x = X.t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("k"), F.round(F.avg("l_quantity") / 2, 3).alias("h"))
    return x.withColumn("p", stats.depth_posterior(F.col("k"), F.col("h"))).select("k", "h", *[F.round(F.element_at("p", i), 6).alias(f"p{i}") for i in range(1, 5)])


@query("""SELECT region, CASE WHEN m > 10 THEN least(5, greatest(2, floor(m / 25)))::INT WHEN m > 5 THEN 1 ELSE 0 END AS edge_limit FROM (SELECT region, list_min(list_filter(c, lambda v: v > list_min(c))) AS m FROM (SELECT region, list(n) AS c FROM (SELECT region, hap, count(*) AS n FROM reads GROUP BY 1, 2) GROUP BY 1))""", (READS,))
def edge_threshold(spark, d):
    x = X.reads(spark, d).groupBy("region", "hap").agg(F.count("*").alias("n")).groupBy("region").agg(F.collect_list("n").alias("c"))
    return x.select("region", stats.edge_threshold(F.col("c")).cast("int").alias("edge_limit"))


# Haplotypes

_HITS = f"hits AS (SELECT r.region, r.read, p.hap AS read_hap, p.b AS hap, {_MATCH.replace('hap[', 'p.hap[').replace('b[', 'p.b[').replace('p.p.', 'p.')} AS match FROM pairs p JOIN reads r ON r.region = p.region AND r.hap = p.hap WHERE {_MISMATCH.replace('hap[', 'p.hap[').replace(' b[', ' p.b[')} = 0)"


@query("SELECT region, read, hap FROM reads", (READS,))
def encode_reads(spark, d):
    return X.reads(spark, d).select("region", "read", "hap")


@query("SELECT region, read, read_hap, hap, match FROM hits WHERE match >= 1", (READS, HAPS, _PAIR_SQL, _HITS))
def hap_match(spark, d):
    reads = written(X.reads(spark, d), "reads")
    return H.match_reads(reads, X.haps_of(reads), K)


_SHARE = " OR ".join(f"(x.hap[{i}] <> 'x' AND y.hap[{i}] <> 'x')" for i in range(1, 8))


@query(f"SELECT region, read, hap FROM hits x WHERE match >= 1 AND NOT EXISTS (SELECT 1 FROM hits y WHERE y.match >= 1 AND y.region = x.region AND y.read = x.read AND y.hap <> x.hap AND ({_SHARE}))", (READS, HAPS, _PAIR_SQL, _HITS))
def unique_support(spark, d):
    reads = X.reads(spark, d)
    return H.of_reads(reads, H.sole_matches(H.string_matches(reads, X.haps(spark, d), K), K), K).select("region", "read", "hap")


@query("SELECT region, read, array_to_string(list(hap ORDER BY hap), ',') AS haps FROM hits WHERE match >= 1 GROUP BY 1, 2 HAVING count(*) > 1", (READS, HAPS, _PAIR_SQL, _HITS))
def nonunique_reads(spark, d):
    reads = X.reads(spark, d)
    shared = H.shared_reads(H.string_matches(reads, X.haps(spark, d), K), K, "read_hap").withColumn("haps", F.array_join("haps", ","))
    return H.of_reads(reads, shared, K).select("region", "read", "haps")


_LONE = lambda hits: f"NOT EXISTS (SELECT 1 FROM {hits} y WHERE y.region = x.region AND y.read = x.read AND y.hap <> x.hap AND ({_SHARE}))"


@query(f"SELECT region, hap FROM second x WHERE {_LONE('second')} GROUP BY 1, 2 HAVING count(DISTINCT read) >= 4",
    (READS, LONG_HAPS, _PAIR_SQL, _HITS, "first AS (SELECT * FROM hits WHERE match >= 1)", f"second AS (SELECT f.* FROM first f JOIN (SELECT DISTINCT region, hap FROM first x WHERE {_LONE('first')}) USING (region, hap))"))
def low_support_filter(spark, d):
    return H.low_support(X.reads(spark, d), X.haps(spark, d, 5), K, 4)


_KNOWN = "known AS (SELECT region, hap FROM (SELECT DISTINCT o_orderpriority AS region FROM orders), (SELECT unnest(['1111111', '2222222', '1212121']) AS hap))"


def _known(spark, d):
    """Three haplotypes of every region, far apart."""
    return X.t(spark, d, "orders").select(F.col("o_orderpriority").alias("region")).distinct().select("region", F.explode(F.array(*map(F.lit, ("1111111", "2222222", "1212121")))).alias("hap"))


@query(f"""SELECT region, read, b AS hap, mismatch FROM (SELECT *, row_number() OVER (PARTITION BY region, read ORDER BY mismatch, b) AS r, lead(mismatch) OVER (PARTITION BY region, read ORDER BY mismatch, b) AS next FROM (
 SELECT r.region, r.read, p.b, p.mismatch FROM reads r JOIN (SELECT region, hap, b, {_MISMATCH} AS mismatch FROM pairs) p ON r.region = p.region AND r.hap = p.hap)) WHERE r = 1 AND mismatch BETWEEN 1 AND 2 AND (next IS NULL OR next >= mismatch + 2)""", (READS, _KNOWN, _PAIR_SQL.replace("haps h", "known h")))
def closest_hap_margin(spark, d):
    return H.closest_hap(X.reads(spark, d), _known(spark, d), K)


@query("""SELECT sample, idx, refs, alts, others, why FROM (SELECT *, CASE WHEN others = 0 AND refs + alts = 0 THEN 'empty' WHEN others = 0 AND refs <= 3 AND alts <= 3 THEN 'rare' WHEN others = 0 AND (refs <= 3 OR alts <= 3) THEN 'one_sided' END AS why FROM (
 SELECT sample, idx, count_if(s = '1') AS refs, count_if(s = '2') AS alts, count_if(s NOT IN ('1', '2', 'x', '0')) AS others FROM (SELECT sample, i - 1 AS idx, hap[i] AS s FROM (SELECT o_custkey AS sample, hap, unnest(range(1, 8)) AS i FROM reads JOIN orders ON o_orderkey = read)) GROUP BY 1, 2)) WHERE why IS NOT NULL""", (READS,))
def remove_sites(spark, d):
    owners = X.t(spark, d, "orders").select(F.col("o_orderkey").alias("read"), F.col("o_custkey").alias("sample"))
    return H.drop_sites(X.reads(spark, d).join(owners, "read").select("sample", "read", "hap"), ["sample"])


@query("SELECT region, hap, 'gene_hap' || row_number() OVER (PARTITION BY region ORDER BY hap) AS name FROM haps", (READS, HAPS))
def hap_naming(spark, d):
    return H.name_haps(X.haps(spark, d), K, F.lit("gene"))


@query()
def tag_hash_assign(spark, d):
    reads, haps = X.reads(spark, d), X.haps(spark, d)
    m = H.string_matches(reads, haps, K)
    return H.tag_reads(reads, H.sole_matches(m, K), H.closest_strings(reads, haps, K), H.shared_reads(m, K, "read_hap"), K, "read_hap")


# Windows


@query("""SELECT region, s AS symbol, min(site) AS first, max(site) AS last, count(*) AS size FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY site) - row_number() OVER (PARTITION BY region, s ORDER BY site) AS g FROM (
 SELECT region, read AS site, hap[1] AS s FROM reads)) GROUP BY region, s, g""", (READS,))
def run_length_islands(spark, d):
    x = X.reads(spark, d).select("region", F.col("read").alias("site"), F.substring("hap", 1, 1).alias("symbol"))
    return R.islands(x, K, "site", "symbol")


_CLS = "cls AS (SELECT region, row_number() OVER (PARTITION BY region ORDER BY read) AS pos, CASE hap[2] WHEN '1' THEN 2 WHEN '2' THEN 10 ELSE -1 END AS cls FROM reads)"


@query("""SELECT region, min(pos) AS first, max(pos) + 1 AS last, c AS cls FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY pos) - row_number() OVER (PARTITION BY region, c ORDER BY pos) AS g FROM (
 SELECT region, pos, CASE WHEN cls = 2 AND lag(cls) OVER w = 10 AND lead(cls) OVER w = 10 THEN 10 ELSE cls END AS c FROM cls WINDOW w AS (PARTITION BY region ORDER BY pos))) GROUP BY region, c, g""", (READS, _CLS))
def segment_rewrite(spark, d):
    s = F.substring("hap", 2, 1)
    x = X.reads(spark, d).select("region", F.row_number().over(Window.partitionBy("region").orderBy("read")).cast("long").alias("pos"), F.when(s == "1", 2).when(s == "2", 10).otherwise(-1).alias("cls"))
    return R.segments(x, K)


_GAPS = """het AS (SELECT DISTINCT o_orderpriority AS region, date_diff('day', DATE '1990-01-01', o_orderdate::DATE) AS pos FROM orders WHERE o_custkey % 40 = 0),
hom AS (SELECT DISTINCT o_orderpriority AS region, date_diff('day', DATE '1990-01-01', o_orderdate::DATE) AS pos FROM orders WHERE o_custkey % 40 <> 0)"""


def _days(spark, d, where):
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date"))
    return X.t(spark, d, "orders").where(where).select(F.col("o_orderpriority").alias("region"), day.alias("pos")).distinct()


@query("""SELECT region, pos, gap_start, gap_end FROM (SELECT *, row_number() OVER (PARTITION BY region, gap_start ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY region, gap_start) AS n FROM (
 SELECT h.region, h.pos, g.pos AS gap_start, g.nxt AS gap_end FROM hom h JOIN (SELECT region, pos, lead(pos) OVER (PARTITION BY region ORDER BY pos) AS nxt FROM (SELECT region, pos FROM het UNION SELECT DISTINCT region, unnest([1800, 4300]) FROM hom)) g
 ON h.region = g.region AND g.nxt - g.pos > 60 AND h.pos > g.pos AND h.pos < g.nxt)) WHERE i % ceil(n / 4) = 0""", (_GAPS,))
def gap_fill_sites(spark, d):
    regions = _days(spark, d, "true").select("region").distinct().select("region", F.lit(1800).alias("start"), F.lit(4300).alias("end"))
    return R.gap_fill(_days(spark, d, "o_custkey % 40 = 0"), _days(spark, d, "o_custkey % 40 <> 0"), regions, K, 60, 4)


@query("""SELECT region, pos + 30 AS pos FROM (SELECT *, lead(c) OVER (PARTITION BY region ORDER BY pos, c) AS n FROM (SELECT region, pos, true AS c FROM het UNION SELECT region, pos, false FROM hom)) WHERE c AND coalesce(n, true)""", (_GAPS,))
def clip_anchor(spark, d):
    return R.clip_anchors(_days(spark, d, "o_custkey % 40 = 0"), _days(spark, d, "o_custkey % 40 <> 0"), K)


@query("""SELECT region, read, CASE WHEN b.idx NOT IN (0, 6) THEN b.idx END AS split FROM (SELECT region, read, max({'score': score, 'm': -idx}) AS x, arg_max(idx, score * 100 - idx) AS idx FROM (
 SELECT region, read, idx, coalesce(sum((s = '1')::INT) OVER (PARTITION BY region, read ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + sum((s = '2')::INT) OVER (PARTITION BY region, read ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS score FROM (
 SELECT region, read, (i - 1)::INT AS idx, hap[i] AS s FROM (SELECT region, read, hap, unnest(range(1, 8)) AS i FROM reads))) GROUP BY 1, 2) b""", (READS,))
def breakpoint_argmax(spark, d):
    return R.breakpoint(H.explode_haps(X.reads(spark, d), ["region", "read"]), ["region", "read"], "1", "2")


@query("SELECT doc_id, sum(length(r)) AS bases, count(*) AS runs FROM (SELECT doc_id, unnest(list_concat(regexp_extract_all(lower(text), '(a{2,})', 1), list_concat(regexp_extract_all(lower(text), '(e{2,})', 1), regexp_extract_all(lower(text), '(o{2,})', 1)))) AS r FROM documents) GROUP BY 1")
def homopolymer_runs(spark, d):
    x = X.t(spark, d, "documents").select("doc_id", F.explode(R.letter_runs(F.lower("text"), "aeo", 2)).alias("r"))
    return x.groupBy("doc_id").agg(F.sum("r.size").alias("bases"), F.count("*").alias("runs"))


# Graph

_EDGES = """edges AS (SELECT region, (i - 1)::INT AS idx, hap[i] AS src, hap[i + 1] AS dst, count(*) AS n FROM (SELECT region, hap, unnest(range(1, 7)) AS i FROM reads) WHERE hap[i] <> 'x' AND hap[i + 1] <> 'x' GROUP BY 1, 2, 3, 4)"""


def _edges(spark, d):
    return G.edge_counts(X.reads(spark, d), K)


@query("SELECT region, idx, src, dst, n FROM edges", (READS, _EDGES))
def edge_counts(spark, d):
    return _edges(spark, d)


_PRUNED = """pruned AS (SELECT region, idx, src, dst, n, outs > 1 AND ins > 1 AND n <= CASE WHEN m > 10 THEN least(5, greatest(2, floor(m / 25))) WHEN m > 5 THEN 1 ELSE 0 END AS weak FROM (
 SELECT e.*, count(*) OVER (PARTITION BY region, idx, src) AS outs, count(*) OVER (PARTITION BY region, idx, dst) AS ins, (SELECT min(n) FROM edges f WHERE f.region = e.region AND f.idx = e.idx AND f.n > (SELECT min(n) FROM edges g WHERE g.region = e.region AND g.idx = e.idx)) AS m FROM edges e))"""


@query("SELECT region, idx, src, dst, n, weak FROM pruned", (READS, _EDGES, _PRUNED))
def edge_prune(spark, d):
    return G.prune_edges(_edges(spark, d), K)


@query("""SELECT h.region, h.idx, CASE WHEN e.n IS NULL OR least_n < 2 OR most_n <= 2 OR srcs <> h.here OR dsts <> t.here THEN -1 WHEN e.n = srcs THEN 2 ELSE 10 END AS cls FROM nodes h JOIN nodes t ON t.region = h.region AND t.idx = h.idx + 1 LEFT JOIN (
 SELECT region, idx, count(*) AS n, min(n) AS least_n, max(n) AS most_n, count(DISTINCT src) AS srcs, count(DISTINCT dst) AS dsts FROM edges GROUP BY 1, 2) e ON e.region = h.region AND e.idx = h.idx""", (READS, _EDGES, "nodes AS (SELECT region, (i - 1)::INT AS idx, count(DISTINCT hap[i]) AS here FROM (SELECT region, hap, unnest(range(1, 8)) AS i FROM reads) WHERE hap[i] <> 'x' GROUP BY 1, 2)"))
def gap_classify(spark, d):
    nodes = H.explode_haps(X.reads(spark, d), K).where("symbol <> 'x'").select("region", "idx", "symbol").distinct()
    return G.classify_gaps(_edges(spark, d), nodes, K)


@query("""SELECT DISTINCT region, path FROM (WITH RECURSIVE p AS (SELECT region, idx, src || dst AS path, dst FROM edges WHERE idx = 1 UNION ALL SELECT e.region, e.idx, p.path || e.dst, e.dst FROM p JOIN edges e ON e.region = p.region AND e.idx = p.idx + 1 AND e.src = p.dst WHERE e.idx < 5) SELECT region, path FROM p WHERE length(path) = 5)""", (READS, _EDGES))
def path_enumeration(spark, d):
    return G.paths(_edges(spark, d), K, 1, 5)


@query("""SELECT * FROM (SELECT r.region, read, array_to_string(list_transform(range(1, 8), lambda i: CASE WHEN (i < 7 AND list_contains(coalesce(gone, []), (i - 1) || hap[i] || hap[i + 1])) OR (i > 1 AND list_contains(coalesce(gone, []), (i - 2) || hap[i - 1] || hap[i])) THEN 'x' ELSE hap[i] END), '') AS hap
 FROM reads r LEFT JOIN (SELECT region, list(idx || src || dst) AS gone FROM pruned WHERE weak GROUP BY 1) g ON g.region = r.region) WHERE length(replace(hap, 'x', '')) > 1""", (READS, _EDGES, _PRUNED))  # fmt: skip
def mask_weak_reads(spark, d):
    return G.mask_reads(X.reads(spark, d), G.prune_edges(_edges(spark, d), K), K)


@query()
def assemble_haplotypes(spark, d):
    return G.assemble(X.reads(spark, d), K)


# Alleles and copy numbers

_LINK = """segs AS (SELECT DISTINCT o_custkey AS region, l_orderkey AS read, l_linenumber AS seq, 'h' || (l_partkey % 12) AS hap FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
seg_pairs AS (SELECT a.region, a.read, a.hap AS a, b.hap AS b FROM segs a JOIN segs b ON a.region = b.region AND a.read = b.read AND a.seq < b.seq AND a.hap <> b.hap)"""


def _segments(spark, d):
    x = dealt(X.t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey").join(X.t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return x.select(F.col("o_custkey").alias("region"), F.col("l_orderkey").alias("read"), F.col("l_linenumber").alias("seq"), F.concat(F.lit("h"), (F.col("l_partkey") % 12).cast("string")).alias("hap")).distinct()


@query("SELECT region, read, a, b FROM seg_pairs", (_LINK,))
def read_links(spark, d):
    return A.read_pairs(_segments(spark, d), K)


_LINKS = "links AS (SELECT region, a, b, count(DISTINCT read) AS n FROM seg_pairs GROUP BY 1, 2, 3 HAVING count(DISTINCT read) >= 2)"


@query("SELECT region, a, b, n FROM links", (_LINK, _LINKS))
def hap_links_min2(spark, d):
    return A.hap_links(A.read_pairs(_segments(spark, d), K), K, directed=True)


_COMPONENTS = """WITH RECURSIVE segs AS (SELECT DISTINCT o_custkey AS region, l_orderkey AS read, l_linenumber AS seq, 'h' || (l_partkey % 12) AS hap FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
seg_pairs AS (SELECT a.region, a.read, a.hap AS a, b.hap AS b FROM segs a JOIN segs b ON a.region = b.region AND a.read = b.read AND a.seq < b.seq AND a.hap <> b.hap),
links AS (SELECT region, a, b FROM seg_pairs GROUP BY 1, 2, 3 HAVING count(DISTINCT read) >= 2),
both_ways AS (SELECT region, a, b FROM links UNION SELECT region, b, a FROM links),
reach AS (SELECT region, a, a AS b FROM both_ways UNION SELECT r.region, r.a, w.b FROM reach r JOIN both_ways w ON w.region = r.region AND w.a = r.b)
"""


def _alleles(spark, d):
    return A.alleles(A.hap_links(A.read_pairs(_segments(spark, d), K), K), K)


@query(_COMPONENTS + "SELECT region, a AS hap, min(b) AS allele FROM reach GROUP BY 1, 2")
def alleles_components(spark, d):
    return _alleles(spark, d)


@query(_COMPONENTS + """, sets AS (SELECT region, list_sort(list(DISTINCT hap)) AS members FROM (SELECT region, a AS hap, min(b) AS allele FROM reach GROUP BY 1, 2) GROUP BY region, allele),
grouped AS (SELECT region, list_sort(list(members)) AS alleles FROM sets GROUP BY 1), every_hap AS (SELECT region, list_sort(list(DISTINCT hap)) AS every_one FROM segs GROUP BY 1),
state AS (SELECT e.region, alleles, every_one, list_sort(list_filter(every_one, lambda h: NOT list_contains(coalesce(flatten(alleles), []), h))) AS rest FROM every_hap e LEFT JOIN grouped g ON g.region = e.region)
SELECT region, to_json(CASE WHEN len(alleles) IN (1, 2) AND len(rest) = 0 THEN alleles WHEN len(alleles) = 1 AND len(rest) = 1 AND len(every_one) BETWEEN 2 AND 4 THEN list_append(alleles, rest) END)::VARCHAR AS alleles FROM state""")
def filter_alleles(spark, d):
    return A.filter_alleles(_alleles(spark, d), _segments(spark, d), K).withColumn("alleles", F.to_json("alleles"))


_COUNTS = "counts AS (SELECT region, hap, count(*) AS n FROM reads WHERE hap IN (SELECT hap FROM haps) GROUP BY 1, 2)"


@query("""SELECT region, hap, n, second, round(p1, 6) AS p1, coalesce(p1 < 0.9 AND second >= 10, false) AS two_copies FROM (SELECT *, e1 / (e1 + e2 + e3 + e4) AS p1 FROM (SELECT *, exp(0 - second - m) AS e1, exp(n * ln(2.0::DOUBLE) - 2 * second - m) AS e2, exp(n * ln(3.0::DOUBLE) - 3 * second - m) AS e3, exp(n * ln(4.0::DOUBLE) - 4 * second - m) AS e4 FROM (
 SELECT *, greatest(0.0::DOUBLE - second, n * ln(2.0::DOUBLE) - 2 * second, n * ln(3.0::DOUBLE) - 3 * second, n * ln(4.0::DOUBLE) - 4 * second) AS m FROM (SELECT *, lead(n) OVER (PARTITION BY region ORDER BY n DESC, hap) AS second, row_number() OVER (PARTITION BY region ORDER BY n DESC, hap) AS r FROM counts) WHERE r = 1)))""", (READS, HAPS, _COUNTS))
def two_copy_test(spark, d):
    haps = X.haps(spark, d).select("hap").distinct()
    counts = X.reads(spark, d).join(haps, "hap", "left_semi").groupBy("region", "hap").agg(F.count("*").alias("n"))
    return C.two_copies_by_reads(counts, K, 0.9).withColumn("p1", F.round("p1", 6))


@query("""SELECT c, haps, two_copy_haps, CASE WHEN doubled > 1 THEN doubled END AS copies FROM (SELECT *, CASE WHEN copies = 2 AND NOT exempt AND 1 / (1 + exp(depth * ln(2.0::DOUBLE) - 15) + exp(depth * ln(3.0::DOUBLE) - 30) + exp(depth * ln(4.0::DOUBLE) - 45)) < 0.75 THEN 4 ELSE copies END AS doubled FROM (
 SELECT *, CASE WHEN haps = 1 THEN 2 ELSE haps + two_copy_haps END AS copies FROM (SELECT o_custkey AS c, count(DISTINCT o_orderstatus) AS haps, count(DISTINCT CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' THEN o_orderstatus END) AS two_copy_haps, 2 * count(*) AS depth, bool_or(o_orderstatus = 'P') AS exempt FROM orders GROUP BY 1)))""")
def copy_number_table(spark, d):
    status = F.col("o_orderstatus")
    x = X.t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c")).agg(F.count_distinct(status).alias("haps"), F.count_distinct(F.when((F.col("o_orderpriority") == "1-URGENT") & (status == "F"), status)).alias("two_copy_haps"), (2 * F.count("*")).alias("depth"), F.bool_or(status == "P").alias("exempt"))
    return C.total_copies(x.withColumn("genome_depth", F.lit(15.0))).select("c", "haps", "two_copy_haps", "copies")


@query("""SELECT o_custkey AS sample, o_orderpriority AS region, CASE WHEN o_orderpriority = '2-HIGH' THEN coalesce(max(CASE WHEN o_orderpriority = '5-LOW' THEN v END) OVER (PARTITION BY o_custkey), v) ELSE v END AS v FROM (SELECT o_custkey, o_orderpriority, count(*) AS v FROM orders GROUP BY 1, 2)""")
def cross_region_update(spark, d):
    x = X.t(spark, d, "orders").groupBy(F.col("o_custkey").alias("sample"), F.col("o_orderpriority").alias("region")).agg(F.count("*").alias("v"))
    return C.update_from_region(x, ["sample"], "2-HIGH", "5-LOW", "v")


# Sets


@query("SELECT l_orderkey AS read FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A'")
def del_intersect(spark, d):
    x = X.t(spark, d, "lineitem")
    return x.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("read")).intersect(x.where("l_returnflag = 'A'").select("l_orderkey"))


@query("SELECT a, b, len(list_filter(x, lambda v: NOT list_contains(y, v))) + len(list_filter(y, lambda v: NOT list_contains(x, v))) AS apart, len(list_filter(x, lambda v: NOT list_contains(y, v))) = 0 AS inside FROM (SELECT * FROM (SELECT p.n AS a, q.n AS b, p.v AS x, q.v AS y FROM (SELECT s_nationkey AS n, list(DISTINCT s_suppkey % 20) AS v FROM supplier GROUP BY 1) p JOIN (SELECT s_nationkey AS n, list(DISTINCT s_suppkey % 20) AS v FROM supplier GROUP BY 1) q ON p.n < q.n) WHERE len(list_intersect(x, y)) > 0)")
def symmetric_difference(spark, d):
    x = X.t(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("a")).agg(F.collect_set(F.col("s_suppkey") % 20).alias("x"))
    member = x.withColumn("m", F.explode("x"))
    both = member.join(member.withColumnsRenamed({"a": "b", "x": "y"}), "m").where("a < b").drop("m").dropDuplicates(["a", "b"])
    return both.select("a", "b", S.symmetric_difference(F.col("x"), F.col("y")).alias("apart"), S.contains_all(F.col("y"), F.col("x")).alias("inside"))


# Output

_CALLS = "calls AS (SELECT o_orderpriority AS region, 'h' || (l_linenumber % 3) AS hap, l_partkey % 200 AS pos, 'C' AS ref, CASE l_returnflag WHEN 'R' THEN 'A' WHEN 'A' THEN '*' ELSE 'C' END AS alt, CASE WHEN avg(l_quantity) > 25 THEN '1' ELSE '.' END AS gt FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3, 4, 5)"


@query("SELECT region, pos, ref, alt, 'PASS' AS filter, coalesce(max(CASE WHEN hap = 'h0' THEN gt END), '.') AS h0, coalesce(max(CASE WHEN hap = 'h1' THEN gt END), '.') AS h1, coalesce(max(CASE WHEN hap = 'h2' THEN gt END), '.') AS h2 FROM calls WHERE alt NOT IN ('*', '.') AND alt <> ref GROUP BY 1, 2, 3, 4 HAVING bool_or(gt = '1')", (_CALLS,))
def merged_variants(spark, d):
    x = X.t(spark, d, "lineitem").join(X.t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    flag = F.col("l_returnflag")
    calls = x.groupBy(F.col("o_orderpriority").alias("region"), F.concat(F.lit("h"), (F.col("l_linenumber") % 3).cast("string")).alias("hap"), (F.col("l_partkey") % 200).alias("pos"), F.lit("C").alias("ref"), F.when(flag == "R", "A").when(flag == "A", "*").otherwise("C").alias("alt")).agg(F.when(F.avg("l_quantity") > 25, "1").otherwise(".").alias("gt"))
    return V.merged(calls, K, ["h0", "h1", "h2"])


@query("""SELECT region, "start", "end", n, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY n DESC, "start", "end")::INT AS r FROM (SELECT region, "start" // 100 AS "start", "end" // 100 AS "end", count(DISTINCT read) AS n FROM spans GROUP BY 1, 2, 3) WHERE n >= 3) WHERE r <= 2""", (SPANS,))
def big_event_top2(spark, d):
    x = X.spans(spark, d).withColumns({"start": F.floor(F.col("start") / 100), "end": F.floor(F.col("end") / 100)})
    return V.recurrent_events(x, K, 3).select("region", "start", "end", "n", "rank")


@query("SELECT region, count(*) AS n_haps, count_if(bad) AS n_nonfunctional, count(*) - count_if(bad) AS n_functional FROM (SELECT o_orderpriority AS region, o_orderstatus = 'F' AS bad FROM orders WHERE o_totalprice > 1000) GROUP BY 1")
def region_report(spark, d):
    x = X.t(spark, d, "orders").select(F.col("o_orderpriority").alias("region"), F.lit("h").alias("hap"), (F.col("o_totalprice") > 1000).alias("overlaps"), (F.col("o_orderstatus") == "F").alias("nonfunctional"))
    return V.region_report(x, K)
