"""Calls of each haplotype at each position, as rows keyed by haplotype, for one gene or two."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haplospark.operators.intervals import as_of_forward

BOUNDS = ["first", "last", "sure_first", "sure_last"]
_CALL = "struct<token:string,dp:bigint,ad_ref:bigint,ad:bigint>"


def call_rows(tokens: DataFrame, unique: DataFrame, haps: DataFrame, bases: DataFrame, svs: DataFrame, keys: list[str], least: int = 4, share: float = 0.7, spans: bool = False) -> DataFrame:
    """tokens(keys, hap, pos, read, token) of reads by haplotype, unique(keys, read), haps(keys, hap, first, last, sure_first, sure_last, two_copies), bases(keys, pos, base) of the
    reference, svs(keys, hap, first, kind, last) -> keys, hap, pos, ref, alt, dp, ad_ref, ad, filter, gt.

    A haplotype has a row at each position between its bounds, covered or not, or, without bounds, at each covered one. The call is the most common token; of
    equals the shorter one, then the reference, then the least. Outside the sure bounds, or where the call has less than ``share`` of the reads, the unique
    reads alone decide, if they are ``least`` or more and agree so far. filter: LowDP, LowQual, both or empty; gt is 1, 0, or '.' if filtered or not
    covered. A special variant has a row of its own in place of the calls at its first position (``spans``: along all of it), its kind and end as
    ref and alt. Two copies give each row a second time, the name with _cp2. Positions without a reference base have no row, bases
    that are missing along a deletion are N; null tokens count for nothing. Tokens are counted before any join with positions."""
    at, call = [*keys, "hap", "pos"], lambda n: (F.col("base").isNotNull()) & (F.col(n) > 0)
    marked = tokens.where("token IS NOT NULL").join(unique.select(*keys, "read", F.lit(1).alias("u")).distinct(), [*keys, "read"], "left")
    count = marked.groupBy(*at, F.upper("token").alias("token")).agg(F.count("*").alias("n"), F.count("u").alias("n_unique"))
    own = haps.select(*keys, "hap", *BOUNDS, "two_copies")
    bounded = F.col("first").isNotNull() & F.col("last").isNotNull()
    inside = own.where(bounded & (F.col("last") - F.col("first") >= 2)).select(*keys, "hap", F.explode(F.sequence(F.col("first") + 1, F.col("last") - 1)).alias("pos"))
    covered = count.select(*at).distinct().join(own.where(~bounded).select(*keys, "hap"), [*keys, "hap"], "left_semi")
    places = inside.select(*keys, "hap", F.col("pos").cast("long").alias("pos")).unionByName(covered.select(*keys, "hap", F.col("pos").cast("long").alias("pos")))
    if spans:
        taken = svs.select(*keys, "hap", F.explode(F.sequence("first", "last")).alias("pos"))
    else:
        taken = svs.select(*keys, "hap", F.col("first").alias("pos"))
    places = places.join(taken, at, "left_anti").join(bases.select(*keys, "pos", F.upper("base").alias("base")), [*keys, "pos"])
    x = places.join(count, at, "left")

    def best(n: str):
        rank = F.struct((-F.col(n)).alias("a"), F.length("token").alias("b"), (F.col("token") != F.col("base")).alias("c"), "token")
        top = F.min(F.when(call(n), rank))
        return F.struct(F.coalesce(top["token"], F.first("base")).alias("token"), F.coalesce(F.sum(n), F.lit(0)).alias("dp"), F.coalesce(F.sum(F.when(F.col("token") == F.col("base"), F.col(n))), F.lit(0)).alias("ad_ref"), F.coalesce(-top["a"], F.lit(0)).alias("ad")).cast(_CALL)

    both = x.groupBy(*at, "base").agg(best("n").alias("every"), best("n_unique").alias("alone")).join(own, [*keys, "hap"])
    weak = lambda c: F.col(f"{c}.ad") < F.col(f"{c}.dp") * share
    edge = ~bounded | F.coalesce(F.col("pos") < F.col("sure_first"), F.lit(False)) | F.coalesce(F.col("pos") > F.col("sure_last"), F.lit(False)) | weak("every")
    chosen = F.when(edge & ~((F.col("alone.dp") < least) | weak("alone")), F.col("alone")).otherwise(F.col("every"))
    y = both.withColumn("c", chosen).select(*at, "base", "two_copies", "c.*")
    size = F.regexp_extract("token", r"-(\d+)", 1).cast("int")
    gone = y.where(F.contains("token", F.lit("-"))).select(*at, F.posexplode(F.sequence(F.col("pos"), F.col("pos") + size)).alias("i", "p"))
    known = bases.select(*keys, F.col("pos").cast("long").alias("p"), F.upper("base").alias("letter"))
    longer = gone.join(known, [*keys, "p"], "left").groupBy(*at).agg(F.array_join(F.sort_array(F.collect_list(F.struct("i", F.coalesce("letter", F.lit("N")).alias("letter"))))["letter"], "").alias("longer"))
    y = y.join(longer, at, "left")
    alt = F.when(F.contains("token", F.lit("+")), F.concat("base", F.regexp_extract("token", r"\+\d+(.*)$", 1))).when(F.contains("token", F.lit("-")), F.col("base")).otherwise(F.col("token"))
    raw = F.when(F.col("dp") == 0, ".").when(F.col("token") == F.col("base"), "0").otherwise("1")
    low = ((raw == "1") & (F.col("ad") < F.col("dp") * share)) | ((raw == "0") & (F.col("ad_ref") < F.col("dp") * share))
    why = F.concat_ws(";", F.when(F.col("dp") < least, "LowDP"), F.when(low, "LowQual"))
    plain = y.select(*at, F.coalesce("longer", "base").alias("ref"), alt.alias("alt"), "dp", "ad_ref", "ad", why.alias("filter"), F.when(why == "", raw).otherwise(".").alias("gt"), "two_copies")
    none = F.lit(None).cast("bigint")
    special = svs.join(own.select(*keys, "hap", "two_copies"), [*keys, "hap"]).select(*keys, "hap", F.col("first").cast("long").alias("pos"), F.col("kind").alias("ref"), F.col("last").cast("string").alias("alt"), none.alias("dp"), none.alias("ad_ref"), none.alias("ad"), F.lit("").alias("filter"), F.lit("1").alias("gt"), "two_copies")
    rows = plain.unionByName(special)
    names = F.when(F.col("two_copies"), F.array(F.col("hap"), F.concat("hap", F.lit("_cp2")))).otherwise(F.array("hap"))
    return rows.withColumn("hap", F.explode(names)).drop("two_copies")


def other_bounds(haps: DataFrame, match: DataFrame, keys: list[str], reach: int = 200) -> DataFrame:
    """haps as in ``call_rows`` with bounds in a second gene, by match(keys, pos, pos2): a bound's match, or that of the next position within ``reach``, the lower
    one first, as the genes may lie on opposite strands. If one of the four has none, all are null."""
    asked = haps.select(*keys, F.explode(F.array(*[F.col(c).cast("long") for c in BOUNDS])).alias("pos")).where("pos IS NOT NULL")
    other = as_of_forward(asked, match.select(*keys, F.col("pos").cast("long").alias("pos"), F.col("pos2").cast("long").alias("pos2")), keys, reach, "pos2")
    x = haps
    for c in BOUNDS:
        x = x.withColumn(c, F.col(c).cast("long")).join(other.select(*keys, F.col("pos").alias(c), F.col("pos2").alias(f"{c}_2")), [*keys, c], "left")
    found = F.greatest(*[F.col(f"{c}_2").isNull() for c in BOUNDS])
    pick = lambda f, a, b: F.when(~found, f(f"{a}_2", f"{b}_2"))
    return x.select(
        *keys, "hap", pick(F.least, "first", "last").alias("first"), pick(F.greatest, "first", "last").alias("last"),
        pick(F.least, "sure_first", "sure_last").alias("sure_first"), pick(F.greatest, "sure_first", "sure_last").alias("sure_last"), "two_copies",
    )


def two_gene_rows(gene1: tuple, gene2: tuple, unique: DataFrame, match: DataFrame, svs: DataFrame, keys: list[str], **options) -> DataFrame:
    """(tokens, haps, bases) of each gene, bounds of both given in the first one -> rows of ``call_rows`` with ``gene`` 1 or 2; positions and
    bases of gene 2 are its own. svs(keys, gene, hap, first, kind, last)."""
    rows = []
    for gene, (tokens, haps, bases) in ((1, gene1), (2, gene2)):
        bounds = other_bounds(haps, match, keys) if gene == 2 else haps
        rows.append(call_rows(tokens, unique, bounds, bases, svs.where(F.col("gene") == gene).drop("gene"), keys, **options).withColumn("gene", F.lit(gene)))
    return rows[0].unionByName(rows[1])
