"""The operators' inputs drawn from the driver's tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haplospark.operators.haplotypes import encode_reads
from haplospark.operators.spread import dealt

SITES = list(range(1, 8))


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region, read, site, symbol: an order's lines; return flag R is 1, A is 2."""
    lines = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("read"), F.col("l_linenumber").alias("site"), F.when(F.col("l_returnflag") == "R", "1").when(F.col("l_returnflag") == "A", "2").otherwise("x").alias("symbol"))
    orders = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("read"), F.col("o_orderpriority").alias("region"))
    return dealt(lines, "read").join(orders, "read").select("region", "read", "site", "symbol")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region, read, hap."""
    return encode_reads(symbols(spark, sf_dir), ["region"], SITES)


_site = lambda s: f"coalesce(min(CASE WHEN l_linenumber = {s} THEN CASE l_returnflag WHEN 'R' THEN '1' WHEN 'A' THEN '2' ELSE 'x' END END), 'x')"
READS = f"""reads AS (
  SELECT o_orderpriority AS region, l_orderkey AS read, {' || '.join(map(_site, SITES))} AS hap
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""


def haps(spark: SparkSession, sf_dir: str, calls: int = 3) -> DataFrame:
    """region, hap: strings with ``calls`` calls or more that two reads hold."""
    return haps_of(reads(spark, sf_dir), calls)


def haps_of(reads: DataFrame, calls: int = 3) -> DataFrame:
    """The ``haps`` of given reads."""
    full = reads.where(F.length(F.replace("hap", F.lit("x"), F.lit(""))) >= calls)
    return full.groupBy("region", "hap").agg(F.count("*").alias("n")).where("n >= 2").select("region", "hap")


_haps = lambda calls: f"haps AS (SELECT region, hap FROM reads WHERE length(replace(hap, 'x', '')) >= {calls} GROUP BY region, hap HAVING count(*) >= 2)"
HAPS, LONG_HAPS = _haps(3), _haps(5)


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region, read, start, end: from order to shipping in days, either way round."""
    day = lambda c: F.datediff(F.col(c).cast("date"), F.lit("1990-01-01").cast("date")).cast("long")
    lines = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
    orders = t(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    x = dealt(lines, "l_orderkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return x.select(F.col("o_orderpriority").alias("region"), F.col("l_orderkey").alias("read"), F.least(day("o_orderdate"), day("l_shipdate")).alias("start"), F.greatest(day("o_orderdate"), day("l_shipdate")).alias("end"))


SPANS = """spans AS (
  SELECT o_orderpriority AS region, l_orderkey AS read,
         least(date_diff('day', DATE '1990-01-01', o_orderdate::DATE), date_diff('day', DATE '1990-01-01', l_shipdate::DATE)) AS "start",
         greatest(date_diff('day', DATE '1990-01-01', o_orderdate::DATE), date_diff('day', DATE '1990-01-01', l_shipdate::DATE)) AS "end"
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region, pos: every 30th day."""
    regions = t(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("region")).distinct()
    return regions.select("region", F.explode(F.sequence(F.lit(1830).cast("long"), F.lit(4290).cast("long"), F.lit(30).cast("long"))).alias("pos"))


CONTROLS = "controls AS (SELECT region, pos FROM (SELECT DISTINCT o_orderpriority AS region FROM orders), (SELECT unnest(range(1830, 4291, 30)) AS pos))"
DEPTHS = """depths AS (
  SELECT c.region, c.pos, count(s.read) AS depth FROM controls c LEFT JOIN spans s ON s.region = c.region AND s."start" < c.pos AND s."end" >= c.pos AND s."start" < s."end" GROUP BY 1, 2)"""


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region, pos, read, token, ref: events by user; three kinds are bases, one a deletion, others an indel."""
    base = F.when(F.col("event_type") == "click", "A").when(F.col("event_type") == "view", "C").when(F.col("event_type") == "purchase", "G").when(F.col("value") > 120, "*").otherwise("C+2AT")
    return t(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("region"), F.col("user_id").alias("pos"), F.col("event_id").alias("read"), base.alias("token"), F.lit("C").alias("ref"))


TOKENS = """tokens AS (
  SELECT user_id % 3 AS region, user_id AS pos, event_id AS read,
         CASE event_type WHEN 'click' THEN 'A' WHEN 'view' THEN 'C' WHEN 'purchase' THEN 'G' ELSE CASE WHEN value > 120 THEN '*' ELSE 'C+2AT' END END AS token, 'C' AS ref
  FROM events)"""
HISTOGRAM = "histogram AS (SELECT region, pos, token, ref, count(*) AS n FROM tokens GROUP BY ALL)"
