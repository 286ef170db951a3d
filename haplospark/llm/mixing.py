"""Mixing sources to target weights by hash-threshold histograms.

Sizes are summed by source and hash bucket; in each source the bucket where its
budget ends is the boundary, and only that bucket is refined, until it is a
single hash value, that of a row's id and text. Then each document is kept or
left by comparing its hash with its source's boundary: documents are never
sorted. Rows equal in id and text share the boundary's hash; as many of them as
the budget holds are taken, found by the same search over their rows' numbers.

A source that may give more than its own size is first taken whole as often as
fits (``passes``), and the threshold serves what is left of its target.

Hot sources: sums are pre-aggregated before the shuffle and spread over the
buckets; plans per source are joined by broadcast while they are few.
Defined cases: null or empty texts have size 0 and follow the boundary; a null
source is a source, last in order; a null doc_id hashes as ''; rows of equal id
and other texts are documents of their own; of rows equal in both, which ones
are taken is open, how many is not; no row is taken more than ``most`` times;
texts of any length are one row's work; columns of any name pass through; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haplospark.llm.common import drop_staged, fresh, staged, table

WORD = r"[^\x20\x09-\x0D]+"
HASH_BITS, LEVEL_BITS = 60, 15
#: So many plans by source are broadcast; beyond, sources are joined by a shuffle whose skewed parts Spark splits.
BROADCAST_SOURCES = 100_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_of(doc_id: Column, text: Column) -> Column:
    """60 bits of the md5 of id and text."""
    whole = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("\x1f"), F.coalesce(text.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, 15), 16, 10).cast("long")


def row_hash(row: Column) -> Column:
    """60 bits of a row number's hash."""
    return F.call_function("shiftrightunsigned", F.xxhash64(row), F.lit(64 - HASH_BITS))


def targets(by_source: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """by_source(source, source_size), one row for each source -> also target: shares
    by weight of all sizes, stopped at ``most`` times the source's size, the excess
    dealt again by weight. Ordered by size per weight, the stopped sources come
    first, so one running sum finds them."""
    wide = "decimal(38,0)"
    ranked = by_source.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighted = ranked.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long"))
    order = Window.orderBy(F.col("source_size") / F.col("w"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    zero = F.lit(0).cast(wide)
    x = weighted.select(
        "source", "source_size", "w",
        (F.sum("source_size").over(everything).cast(wide) - most * F.coalesce(F.sum("source_size").over(before).cast(wide), zero)).alias("num"),
        (F.sum("w").over(everything).cast(wide) - F.coalesce(F.sum("w").over(before).cast(wide), zero)).alias("den"),
        F.row_number().over(order).alias("at"),
    )
    open_ = F.col("num").cast("double") * F.col("w") <= most * F.col("source_size").cast("double") * F.col("den").cast("double")
    x = x.withColumn("level", F.min(F.when(open_, F.struct("at", "num", "den"))).over(everything))
    share = F.col("w").cast("double") * F.col("level.num").cast("double") / F.col("level.den").cast("double")
    capped = F.col("level").isNull() | (F.col("at") < F.col("level.at"))
    return x.select("source", "source_size", F.when(capped, (most * F.col("source_size")).cast("double")).otherwise(share).alias("target"))


def _plans(df: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(df) if few else df


def boundaries(sizes: DataFrame, plan: DataFrame, few: bool) -> DataFrame:
    """sizes(source, size, h), plan(source, rest) -> source, boundary, rows, wanted: rows with h < boundary fit into ``rest``, those of the boundary itself do not all;
    of these, ``rows`` in number and equal in size, ``wanted`` bring the sum nearest to ``rest``. A source that ``rest`` holds whole has no row."""
    state = plan.select(F.col("source").alias("s"), F.lit(0).cast("long").alias("prefix"), F.col("rest"), F.lit(0).cast("long").alias("below"))
    for level in range(1, HASH_BITS // LEVEL_BITS + 1):
        shift = HASH_BITS - LEVEL_BITS * level
        bucket = F.shiftright("h", shift)
        inside = sizes.join(_plans(state.select("s", "prefix"), few), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", shift + LEVEL_BITS) == F.col("prefix")))
        histogram = inside.groupBy("s", bucket.alias("bucket")).agg(F.sum("size").alias("here"), F.count("*").alias("rows"))
        summed = histogram.select("s", "bucket", "here", "rows", F.sum("here").over(Window.partitionBy("s").orderBy("bucket")).alias("upto"))
        joined = summed.join(_plans(state.select(F.col("s").alias("t"), "rest", "below"), few), F.col("s").eqNullSafe(F.col("t")))
        found = joined.where(F.col("below") + F.col("upto") > F.col("rest")).groupBy("s").agg(F.min(F.struct("bucket", "upto", "here", "rows", "rest", "below")).alias("b"))
        state = staged(found.select("s", F.col("b.bucket").alias("prefix"), F.col("b.rest").alias("rest"), (F.col("b.below") + F.col("b.upto") - F.col("b.here")).alias("below"), F.col("b.here").alias("here"), F.col("b.rows").alias("rows")), "mix-level")
    wanted = F.ceil((F.col("rest") - F.col("below")) / (F.col("here") / F.col("rows")) - 0.5).cast("long")
    return state.select(F.col("s").alias("source"), F.col("prefix").alias("boundary"), "rows", F.greatest(F.lit(0), F.least(wanted, "rows")).alias("wanted"))


def mix_plan(df: DataFrame, doc_id: str, text: str, source: str, weights: tuple[int, ...], most: int) -> tuple[DataFrame, DataFrame, bool]:
    """Written sizes (doc_id, source, size, h, row) of all rows; the plan by source: p, source_size, target, passes, boundary, rows, wanted; whether there are few."""
    at = F.col(doc_id), F.col(text)
    sizes = staged(df.select(at[0].alias("doc_id"), F.col(source).alias("source"), size_of(at[1]).alias("size"), hash_of(*at).alias("h"), F.monotonically_increasing_id().alias("row")), "mix-sizes")
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(by_source, weights, most)
    passes = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long")
    plan = staged(plan.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")), "mix-plan")
    few = plan.count() <= BROADCAST_SOURCES
    at = boundaries(sizes, plan.where(F.col("passes") < most), few)  # a source at its cap has nothing left to take, empty texts neither
    plan = plan.join(_plans(at.withColumnRenamed("source", "s"), few), F.col("source").eqNullSafe(F.col("s")), "left")
    plan = staged(plan.select(F.col("source").alias("p"), "source_size", "target", "passes", F.coalesce("boundary", F.lit(-1)).alias("boundary"), F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("wanted", F.lit(0)).alias("wanted")), "mix-boundaries")
    return sizes, plan, few


def _some_equal(edge: DataFrame, plan: DataFrame, few: bool, h2: str) -> DataFrame:
    """Of the boundary's equal rows, edge(source, h2), those taken: source, last, a bound on ``h2``."""
    part = plan.where("wanted > 0 AND wanted < rows").select(F.col("p").alias("source"), F.col("wanted").cast("double").alias("rest"))
    found = boundaries(edge.select("source", F.lit(1).cast("long").alias("size"), F.col(h2).alias("h")), part, few)
    return found.select(F.col("source").alias("q"), F.col("boundary").alias("last"))


def mix(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """-> doc_id, source, size, source_size, target, copies, taken: the mix holds ``copies`` of a document, ``taken`` = copies * size words."""
    sizes, plan, few = mix_plan(df, doc_id, text, source, weights, most)
    x = sizes.join(_plans(plan, few), F.col("source").eqNullSafe(F.col("p")))
    whole = (F.col("h") < F.col("boundary")) | ((F.col("h") == F.col("boundary")) & (F.col("wanted") == F.col("rows")))
    if plan.where("wanted > 0 AND wanted < rows").limit(1).count():
        x = x.withColumn("h2", row_hash(F.col("row")))
        last = _some_equal(x.where("h = boundary AND wanted < rows").select("source", "h2"), plan, few, "h2")
        x = x.join(_plans(last, few), F.col("source").eqNullSafe(F.col("q")), "left")
        whole = whole | ((F.col("h") == F.col("boundary")) & F.coalesce(F.col("h2") < F.col("last"), F.lit(False)))
    copies = F.col("passes") + whole.cast("long")
    return x.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed_rows(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """The rows of ``df`` as often as the mix takes them, with the columns of ``df``, whatever their names. Only equal rows at a boundary that are taken in part
    are written once more, to be told apart."""
    sizes, plan, few = mix_plan(df, doc_id, text, source, weights, most)
    drop_staged(sizes)
    names = {c: fresh(df, f"mix_{c}") for c in ("p", "passes", "boundary", "rows", "wanted", "h", "copy", "h2", "q", "last")}
    of = lambda c: F.col(names[c])
    mine = _plans(plan.select("p", "passes", "boundary", "rows", "wanted").toDF(*[names[c] for c in ("p", "passes", "boundary", "rows", "wanted")]), few)
    x = df.withColumn(names["h"], hash_of(F.col(doc_id), F.col(text))).join(mine, F.col(source).eqNullSafe(of("p")))
    edge = (of("h") == of("boundary")) & (of("wanted") > 0) & (of("wanted") < of("rows"))
    whole = (of("h") < of("boundary")) | ((of("h") == of("boundary")) & (of("wanted") == of("rows")))
    times = lambda x, copies: x.withColumn(names["copy"], F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).select(*df.columns)
    if not plan.where("wanted > 0 AND wanted < rows").limit(1).count():
        return times(x, of("passes") + whole.cast("long"))
    equal = staged(x.where(edge).withColumn(names["h2"], F.monotonically_increasing_id()), "mix-equal").withColumn(names["h2"], row_hash(of("h2")))
    last = _some_equal(equal.select(F.col(source).alias("source"), of("h2").alias("h2")), plan, few, "h2").toDF(names["q"], names["last"])
    equal = equal.join(_plans(last, few), F.col(source).eqNullSafe(of("q")))
    return times(x.where(~edge), of("passes") + whole.cast("long")).unionByName(times(equal, of("passes") + (of("h2") < of("last")).cast("long")))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || chr(31) || coalesce(text, '')), 1, 15))::BIGINT AS h,
         row_number() OVER (PARTITION BY source, doc_id, text) AS copy
  FROM documents
), by_source AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source
), ranked AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w,
         row_number() OVER (ORDER BY source NULLS LAST) AS place
  FROM by_source
), running AS (
  SELECT *, row_number() OVER o AS pos,
         sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS num,
         sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS den
  FROM ranked WINDOW o AS (ORDER BY source_size::DOUBLE / w, place)
), opened AS (
  SELECT min_by(num, pos) AS num, min_by(den, pos) AS den, min(pos) AS pos
  FROM running WHERE num::DOUBLE * w <= 3 * source_size::DOUBLE * den::DOUBLE
), plan AS (
  SELECT source, source_size,
         CASE WHEN o.pos IS NULL OR r.pos < o.pos THEN (3 * source_size)::DOUBLE
              ELSE w::DOUBLE * o.num::DOUBLE / o.den::DOUBLE END AS target
  FROM running r, opened o
), passed AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(3, floor(target / source_size)) ELSE 0 END::BIGINT AS passes FROM plan
), summed AS (
  SELECT s.*, p.source_size, p.target, p.passes, p.target - p.passes * p.source_size AS rest,
         sum(size) OVER (PARTITION BY s.source ORDER BY h, copy ROWS UNBOUNDED PRECEDING) AS upto
  FROM sizes s JOIN passed p ON s.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target,
       ((passes + CASE WHEN passes < 3 AND (upto <= rest OR (upto - size <= rest AND upto - rest < rest - (upto - size))) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM summed
"""
