"""Queries of candidate choices, ranges and names, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from haplospark.functions import calls as C
from haplospark.operators import candidates as N
from haplospark.plans import analogues as X
from haplospark.plans.analogues import HAPS, READS, SITES
from haplospark.plans.queries import K, query

_RANGES = """ranges AS (SELECT region, read, CASE WHEN f = 0 THEN 5 ELSE 10 * f + 1 END AS first, CASE WHEN l = 6 THEN 75 ELSE 10 * (l + 2) - 1 END AS last FROM (
 SELECT region, read, CASE WHEN replace(hap, 'x', '') = '' THEN 6 ELSE length(hap) - length(ltrim(hap, 'x')) END AS f, CASE WHEN replace(hap, 'x', '') = '' THEN 0 ELSE length(rtrim(hap, 'x')) - 1 END AS l FROM reads))"""


def _ranges(spark, d):
    positions = F.array(*[F.lit(10 * s) for s in SITES])
    return X.reads(spark, d).select("region", "read", C.hap_range(F.col("hap"), positions, F.lit(5), F.lit(75)).alias("r")).select("region", "read", "r.first", "r.last")


@query("SELECT region, read, first, last FROM ranges", (READS, _RANGES))
def hap_ranges(spark, d):
    return _ranges(spark, d)


_AT = "[10, 20, 30, 40, 50, 60, 70]"


@query(f"""SELECT region, read, CASE WHEN first = 5 OR read % 7 = 0 THEN first ELSE coalesce(list_min(list_filter({_AT}, lambda v: v > first)), 70) END AS first,
 CASE WHEN last = 75 OR read % 5 = 0 THEN last ELSE coalesce(list_max(list_filter({_AT}, lambda v: v < last)), 10) END AS last FROM ranges""", (READS, _RANGES))
def confident_ranges(spark, d):
    positions = F.array(*[F.lit(10 * s) for s in SITES])
    at = C.confident_range(F.col("first"), F.col("last"), positions, F.lit(5), F.lit(75), F.col("read") % 7 == 0, F.col("read") % 5 == 0)
    return _ranges(spark, d).select("region", "read", at.alias("r")).select("region", "read", "r.first", "r.last")


@query("""SELECT region, side, hap FROM (SELECT DISTINCT region, 'left' AS side, substr(hap, 1, 4) AS hap FROM reads UNION ALL SELECT DISTINCT region, 'right', substr(hap, 5, 3) FROM reads) c
 WHERE NOT EXISTS (SELECT 1 FROM haps h WHERE h.region = c.region AND CASE side WHEN 'left' THEN substr(h.hap, 1, 4) ELSE substr(h.hap, 5, 3) END = c.hap)""", (READS, HAPS))
def missing_candidates(spark, d):
    reads = X.reads(spark, d)
    part = lambda a, n: reads.select("region", F.substring("hap", a, n).alias("hap"))
    return N.missing(X.haps(spark, d), part(1, 4), part(5, 3), K)


_SITES = """called AS (SELECT region, i, count(*) AS n, sum(length(hap) - length(replace(hap, 'x', ''))) AS unknown FROM haps, (SELECT unnest(range(1, 8)) AS i) WHERE substr(hap, i, 1) <> 'x' GROUP BY 1, 2),
best AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY n DESC, unknown, i DESC) AS r FROM called)"""


@query("SELECT h.region, hap, n AS highest_cn FROM haps h JOIN best b ON h.region = b.region AND r = 1 WHERE substr(hap, i, 1) <> 'x'", (READS, HAPS, _SITES))
def highest_copy_number(spark, d):
    return N.highest_copy_number(X.haps(spark, d), K)


@query("SELECT c_nationkey AS nation, c_custkey AS id, n AS at_pivot, done AS represented, urgent AS called FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, done DESC, urgent DESC, c_custkey) AS r FROM (SELECT c_nationkey, c_custkey, count(*) AS n, count_if(o_orderstatus = 'F') AS done, count_if(o_orderpriority = '1-URGENT') AS urgent FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2)) WHERE r = 1")
def best_main_set(spark, d):
    x = X.t(spark, d, "customer").join(X.t(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    sets = x.groupBy(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("id")).agg(F.count("*").alias("at_pivot"), F.count_if(F.col("o_orderstatus") == "F").alias("represented"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("called"))
    return N.best_set(sets, ["nation"])


_SUPPORT = """lines AS (SELECT l_suppkey AS s, l_linenumber AS l, l_returnflag AS candidate, l_quantity + CASE l_returnflag WHEN 'R' THEN 25 ELSE 0 END AS matches, l_discount > 0.02 AS used FROM lineitem),
each_one AS (SELECT s, l, candidate, median(matches) AS m, max(matches) AS most, count(*) AS n FROM lines WHERE used GROUP BY 1, 2, 3),
won AS (SELECT s, l, candidate FROM each_one e WHERE (SELECT count(*) FROM each_one o WHERE o.s = e.s AND o.l = e.l) = 1 OR (m >= 4 AND n >= 4 AND m > (SELECT max(most) FROM each_one o WHERE o.s = e.s AND o.l = e.l AND o.candidate <> e.candidate)))"""


@query("SELECT * FROM won UNION ALL SELECT DISTINCT s, l, candidate FROM lines x WHERE EXISTS (SELECT 1 FROM each_one e WHERE e.s = x.s AND e.l = x.l) AND NOT EXISTS (SELECT 1 FROM won w WHERE w.s = x.s AND w.l = x.l)", (_SUPPORT,))
def reduce_candidates(spark, d):
    flag = F.col("l_returnflag")
    x = X.t(spark, d, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_linenumber").alias("l"), flag.alias("candidate"), (F.col("l_quantity") + F.when(flag == "R", 25).otherwise(0)).alias("matches"), "l_discount")
    return N.reduce_candidates(x, x.where("l_discount > 0.02"), ["s", "l"])


@query("SELECT user_id AS pos, count_if(event_type = 'click') AS gene_reads, count_if(event_type = 'view') AS pseudo_reads FROM events GROUP BY 1")
def pivot_tokens(spark, d):
    kind = F.col("event_type")
    x = X.t(spark, d, "events").select(F.col("user_id").alias("pos"), F.when(kind == "click", "g").when(kind == "view", "G-2NN").otherwise("A").alias("token"))
    return N.pivot_tokens(x, ["pos"], "G", "G-2NN")


@query("""SELECT o_orderkey AS sample, coalesce(n1, 0) AS n1, coalesce(n2, 0) AS n2, coalesce(n1, 0) >= 2 AS has1, coalesce(n2, 0) + o_custkey % 3 >= 2 AS has2 FROM orders LEFT JOIN (
 SELECT l_orderkey, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_linenumber END) AS n1, count(DISTINCT CASE WHEN l_returnflag = 'A' AND l_partkey % 2 = 0 THEN l_linenumber END) AS n2 FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def splice_presence(spark, d):
    flag, part = F.col("l_returnflag"), F.col("l_partkey")
    bases = X.t(spark, d, "lineitem").select(F.col("l_orderkey").alias("sample"), F.col("l_linenumber").alias("read"), F.when(flag == "R", "c").when(flag == "A", "T").otherwise("A").alias("base"), F.when(part % 2 == 1, "C").when(part % 4 == 0, "G").alias("next"))
    gone = X.t(spark, d, "orders").select(F.col("o_orderkey").alias("sample"), (F.col("o_custkey") % 3).cast("long").alias("n"))
    return N.splice_presence(bases, gone, ["sample"])


_NAMES = """alignments AS (SELECT l_orderkey::VARCHAR AS name, l_linenumber > 1 AS supplementary, l_partkey AS "start", l_linenumber AS size, l_returnflag = 'R' AS gone FROM lineitem),
own AS (SELECT *, CASE WHEN supplementary THEN concat(name, '_sup_', "start", '_', size) ELSE name END AS own FROM alignments),
partial AS (SELECT DISTINCT own AS name FROM own WHERE gone UNION SELECT o_orderkey::VARCHAR FROM orders WHERE o_orderstatus = 'F')"""


@query('SELECT name, "start", size, own AS "as" FROM own UNION ALL SELECT name, "start", size, name FROM own WHERE supplementary AND own IN (SELECT name FROM partial) AND name IN (SELECT name FROM partial)', (_NAMES,))
def supplementary_read_names(spark, d):
    lines = X.t(spark, d, "lineitem")
    name = F.col("l_orderkey").cast("string")
    x = lines.select(name.alias("name"), (F.col("l_linenumber") > 1).alias("supplementary"), F.col("l_partkey").alias("start"), F.col("l_linenumber").alias("size"), "l_returnflag")
    gone = x.where("l_returnflag = 'R'").select(C.read_name(F.col("name"), F.col("supplementary"), F.col("start"), F.col("size")).alias("name"))
    done = X.t(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("name"))
    return N.read_names(x.drop("l_returnflag"), gone.union(done)).select("name", "start", "size", "as")


@query("SELECT l_orderkey AS o, coalesce(list_position(list(l_partkey ORDER BY l_partkey), max(CASE WHEN l_returnflag = 'R' THEN l_partkey ELSE -1 END)), 0)::BIGINT - 1 AS at FROM lineitem GROUP BY 1")
def pivot_site_index(spark, d):
    x = X.t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o")).agg(F.sort_array(F.collect_list("l_partkey")).alias("p"), F.max(F.when(F.col("l_returnflag") == "R", F.col("l_partkey")).otherwise(-1)).alias("pivot"))
    return x.select("o", C.pivot_index(F.transform("p", lambda v: F.concat(v.cast("string"), F.lit("_A_C"))), F.col("pivot")).cast("long").alias("at"))


@query("SELECT o, CASE WHEN list_has_all(v, ['R1', 'A2']) THEN 'S' ELSE 'Y' END || CASE WHEN list_contains(v, 'N3') THEN 'A' ELSE 'T' END AS code FROM (SELECT l_orderkey AS o, list(DISTINCT l_returnflag || l_linenumber) AS v FROM lineitem GROUP BY 1)")
def variant_code(spark, d):
    x = X.t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o")).agg(F.collect_set(F.concat("l_returnflag", F.col("l_linenumber").cast("string"))).alias("v"))
    return x.select("o", C.variant_code(F.col("v"), [(["R1", "A2"], "S", "Y"), (["N3"], "A", "T")]).alias("code"))


@query("SELECT o_orderkey AS variant, o_orderstatus IN ('F', 'P') AND (o_orderpriority = '1-URGENT' OR o_custkey % 10 = 0) AS pathogenic FROM orders")
def reviewed_pathogenic(spark, d):
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    review = F.when(priority == "1-URGENT", "multiple submitters, no conflicts").when(priority == "2-HIGH", "multiple submitters").when(priority == "3-MEDIUM", "single submitter, no conflicts")
    significance = F.when(status == "F", "Pathogenic").when(status == "P", "Likely pathogenic").otherwise("Benign")
    return X.t(spark, d, "orders").select(F.col("o_orderkey").alias("variant"), C.reviewed_pathogenic(significance, review, F.col("o_custkey") % 10 == 0).alias("pathogenic"))


@query("SELECT o_orderkey AS variant, EXISTS (SELECT 1 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND s_nationkey < 10) AS high FROM orders")
def high_impact(spark, d):
    lines = X.t(spark, d, "lineitem").select(F.col("l_orderkey").alias("variant"), F.col("l_suppkey").alias("transcript"), F.when(F.col("l_returnflag") == "R", "HIGH").otherwise("LOW").alias("impact"))
    listed = X.t(spark, d, "supplier").where("s_nationkey < 10").select(F.col("s_suppkey").alias("transcript"))
    return N.high_impact(X.t(spark, d, "orders").select(F.col("o_orderkey").alias("variant")), lines, listed)


@query("SELECT c_custkey AS sample, c_acctbal AS depth, copies, urgent FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS copies, count_if(o_orderpriority = '1-URGENT') AS urgent FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON o_custkey = c_custkey")
def default_calls(spark, d):
    calls = X.t(spark, d, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("sample")).agg(F.count("*").alias("copies"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    return N.with_default_calls(X.t(spark, d, "customer").select(F.col("c_custkey").alias("sample"), F.col("c_acctbal").alias("depth")), calls, ["sample"])


@query("SELECT l_orderkey AS read FROM lineitem WHERE l_returnflag = 'R' UNION SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A' UNION SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def del_union(spark, d):
    x = X.t(spark, d, "lineitem").where("l_returnflag IN ('R', 'A')").select(F.col("l_orderkey").alias("read"))
    return x.union(X.t(spark, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey")).distinct()
