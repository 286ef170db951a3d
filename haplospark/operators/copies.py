"""Order of gene copies on an allele: the copy that follows the first one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haplospark.operators.spread import dealt


def second_copy(haps: DataFrame, first: DataFrame, links: DataFrame, directed: DataFrame, loose: DataFrame, placed: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """The copy behind a known first one. haps(keys, hap, is_last, is_middle): copies that may be on the allele; first(keys, hap); links(keys, a, b): b is linked with a;
    directed(keys, a, b): a comes before b; loose(keys, a, b, n): perhaps; placed(keys, allele, hap): sets already found -> keys, first, second, rule; second is null if no
    rule settles it. Rules, the first that fits: ``only`` one other copy; one other that isn't a last one (``inner``); of two others, one is known as a middle one
    (``middle``); all inner ones but one are linked with the only last copy (``before_last``); of two inner ones, one comes before the other (``order``); the same two for
    those not on the only set found, if that holds the first of the last copies by name (``unplaced``, ``unplaced_order``); one inner copy follows the first by
    ``least`` loose links (``loose``).

    What the tables say of a key is dealt by key once, and windows and aggregations by key follow without another shuffle: no row holds a key, but a task does. A copy named
    twice counts once, last or middle if any row says so; nulls are neither; links to copies that aren't among ``haps`` decide nothing but how many follow."""
    known = reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys])
    fact = lambda df, kind, **c: df.select(*keys, F.lit(kind).alias("kind"), *[F.col(v).alias(k) for k, v in c.items()])
    facts = [
        fact(first, "first", a="hap"), fact(haps.where("hap IS NOT NULL").where(known), "copy", a="hap", is_last="is_last", is_middle="is_middle"), fact(links.where(known), "link", a="a", b="b"),
        fact(directed.where("a <> b").where(known), "way", a="a", b="b"), fact(loose.where(F.col("n") >= least).where(known), "loose", a="a", b="b"), fact(placed.where(known), "set", a="hap", allele="allele"),
    ]
    every, by = dealt(reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), facts), *keys), Window.partitionBy(*keys)
    kind = F.col("kind")
    every = every.withColumns({"first": F.min(F.when(kind == "first", F.col("a"))).over(by), "one_set": F.min("allele").over(by) == F.max("allele").over(by)})
    # a row for each copy with its marks, one for each link; of loose links only the copy that they lead to is left, of first copies the least
    every = every.where("kind NOT IN ('first', 'loose') OR a = first OR (kind = 'first' AND first IS NULL)")
    edge, follows, any_of = kind.isin("link", "way"), kind == "loose", lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    row = every.groupBy(*keys, F.when(edge, kind).when(kind == "first", "first").otherwise("copy").alias("row"), F.when(follows, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(edge, F.col("b")).alias("b"))
    x = row.agg(
        any_of((kind == "copy") & (F.col("a") != F.col("first"))).alias("other"), any_of(F.col("is_last")).alias("is_last"), any_of(F.col("is_middle")).alias("is_middle"), any_of(kind == "set").alias("on_set"), any_of(F.col("one_set") & (kind == "set")).alias("on_only_set"),
        any_of(follows).alias("follows"),
    )

    a, b = F.col("a"), F.col("b")
    x = x.withColumn("inner", F.col("other") & ~F.col("is_last")).withColumn("free", F.col("inner") & ~F.col("on_set"))
    ends = lambda c: (F.min(F.when(F.col(c), a)).over(by), F.max(F.when(F.col(c), a)).over(by))
    (inner1, inner2), (free1, free2) = ends("inner"), ends("free")
    x = x.withColumns({"n_last": F.count_if("is_last").over(by), "last": F.min(F.when(F.col("is_last"), a)).over(by), "inner1": inner1, "inner2": inner2, "free1": free1, "free2": free2})

    # which of two copies comes before the other: of the ways between them there is just one
    between = lambda one, two: (F.col("row") == "way") & (((a == F.col(one)) & (b == F.col(two))) | ((a == F.col(two)) & (b == F.col(one))))
    before = (F.col("row") == "link") & (F.col("n_last") == 1) & (a == F.col("last"))
    on, free_on, behind = between("inner1", "inner2"), between("free1", "free2"), F.col("follows") & ~F.col("is_last")
    n, name = (lambda c: F.count_if(c)), (lambda c, v=a: F.min(F.when(c, v)))
    all_of = x.groupBy(*keys).agg(
        F.bool_or(F.col("row") == "first").alias("given"), name(F.col("row") == "first").alias("first"), n(F.col("other")).alias("n"), name(F.col("other")).alias("any"), n(F.col("inner")).alias("n_inner"), F.min("inner1").alias("inner1"), F.min("inner2").alias("inner2"),
        n(F.col("other") & F.col("is_middle")).alias("n_middle"), name(F.col("other") & F.col("is_middle")).alias("middle"), n(before).alias("n_before"), name(before, b).alias("before"), n(on).alias("n_on"), name(on).alias("leads"),
        n(F.col("free")).alias("n_free"), F.min("free1").alias("free1"), n(free_on).alias("n_free_on"), name(free_on).alias("free_leads"), n(behind).alias("n_behind"), name(behind & F.col("other")).alias("behind"),
        F.bool_or(F.col("on_only_set") & (a == F.col("last"))).alias("ends"),
    )
    # of one inner copy the rule is ``inner``, so all but one are linked with the last one where that leaves one of two
    bare = F.when(F.col("before") == F.col("inner1"), F.col("inner2")).when(F.col("before") == F.col("inner2"), F.col("inner1"))
    all_of = all_of.withColumn("bare", F.when((F.col("n_before") == 1) & (F.col("n_inner") == 2), bare))
    rules: list[tuple[str, Column, str]] = [
        ("only", F.col("n") == 1, "any"), ("inner", F.col("n_inner") == 1, "inner1"), ("middle", (F.col("n") == 2) & (F.col("n_middle") == 1), "middle"), ("before_last", F.col("bare").isNotNull(), "bare"),
        ("order", (F.col("n_inner") == 2) & (F.col("n_on") == 1), "leads"), ("unplaced", F.col("ends") & (F.col("n_free") == 1), "free1"),
        ("unplaced_order", F.col("ends") & (F.col("n_free") == 2) & (F.col("n_free_on") == 1), "free_leads"), ("loose", (F.col("n_behind") == 1) & F.col("behind").isNotNull(), "behind"),
    ]
    rule = F.coalesce(*[F.when(c, F.lit(r)) for r, c, _ in rules])
    second = F.coalesce(*[F.when(c, F.col(v)) for _, c, v in rules])
    return all_of.where("given").select(*keys, "first", second.alias("second"), rule.alias("rule"))
