"""Masks of low-complexity sequence: runs of one base and of two alternating bases, with what lies between near ones.

Rows are bases (keys, pos, base). What a position needs to know stands within a few positions: windows go over tiles of positions that overlap by as
many, so that no chromosome is one window, and growth is a join on single positions, repeated until nothing grows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haplospark.operators.rounds import written

#: Positions of a tile, and how far each sees.
TILE, SIGHT = 1 << 12, 15
#: Rows that a join in the growth broadcasts at most. Files of marks take a fraction of a byte a row, so Spark would broadcast many more by their size.
BROADCAST_ROWS = 50_000


def surroundings(bases: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pos, base, seen: the text from SIGHT positions before to SIGHT after, '-' where there is no base or positions are missing."""
    tiles = F.array_distinct(F.transform(F.array(F.lit(-SIGHT), F.lit(0), F.lit(SIGHT)), lambda d: F.floor((F.col("pos") + d) / TILE)))
    near = bases.select(*keys, "pos", F.upper("base").alias("base")).withColumn("tile", F.explode(tiles))
    at = Window.partitionBy(*keys, "tile").orderBy("pos")
    one = lambda d: F.coalesce(F.when(F.lag("pos", -d).over(at) == F.col("pos") + d, F.lag("base", -d).over(at)), F.lit("-"))
    seen = near.withColumn("seen", F.concat(*[one(d) for d in range(-SIGHT, SIGHT + 1)]))
    return seen.where(F.col("tile") == F.floor(F.col("pos") / TILE)).drop("tile")


def _text(first: int, size: int) -> Column:
    """``size`` bases from the position at ``first`` from here."""
    return F.substr("seen", F.lit(SIGHT + 1 + first), F.lit(size))


def _without_last(bases: DataFrame, keys: list[str]) -> DataFrame:
    """The reference's windows never reach the last base of a sequence."""
    last = bases.groupBy(*keys).agg(F.max("pos").alias("last"))
    return bases.join(last, keys).where("pos < last").drop("last")


def _grown(marks: DataFrame, claims: DataFrame, keys: list[str], once: bool) -> DataFrame:
    """marks(keys, pos, label) and all that claims(keys, label, near, p, first, last) add: a claim holds once p has the label ``near``, and marks first to
    last. ``once``: a position keeps its first label; in a round the claim that begins first has it. Each round looks at what the last one marked."""
    rounds, latest, n = [marks], marks, marks.count()
    names = [*keys, "pos", *(() if once else ("label",))]
    while n:
        reached = latest.select(*keys, F.col("pos").alias("p"), F.col("label").alias("near")).distinct()
        held = claims.join(reached.hint(_way(n)), [*keys, "p", "near"], "left_semi")
        each = held.select(*keys, F.explode(F.sequence("first", "last")).alias("pos"), "label", "first")
        if once:
            each = each.groupBy(*keys, "pos").agg(F.min(F.struct("first", "label")).alias("m")).select(*keys, "pos", "m.label")
        each, known = written(each.select(*keys, "pos", "label").distinct(), "reached"), reduce(DataFrame.unionByName, rounds)
        way = _way(each.count())
        if way == "broadcast":  # of what is known, no more than these then meets them
            known = known.join(F.broadcast(each), names, "left_semi")
        latest = written(each.join(known.hint(way), names, "left_anti"), "marks")
        n = latest.count()
        rounds += [latest] * (n > 0)
    return reduce(DataFrame.unionByName, rounds)


def _way(rows: int) -> str:
    return "broadcast" if rows <= BROADCAST_ROWS else "merge"


def _claims(seen: DataFrame, keys: list[str], at: Column, label: Column, reach: list[tuple[Column, Column, Column, Column]]) -> DataFrame:
    """keys, label, p, first, last: where ``at`` holds, each of ``reach`` (its condition, p, first, last)."""
    wanted = F.filter(F.array(*[F.struct(ok.alias("ok"), p.alias("p"), first.alias("first"), last.alias("last")) for ok, p, first, last in reach]), lambda r: r.ok)
    return seen.where(at).select(*keys, label.alias("label"), F.explode(wanted).alias("r")).select(*keys, "label", "r.p", "r.first", "r.last")


def _seen(bases: DataFrame, keys: list[str]) -> DataFrame:
    return written(surroundings(_without_last(bases, keys).where("upper(base) IN ('A', 'C', 'G', 'T')"), keys), "seen")


def homopolymers(bases: DataFrame, keys: list[str], seen: DataFrame | None = None) -> DataFrame:
    """-> keys, pos, label: runs of five or more of one base; then four of a base within one to four equal bases of a position with its label, and
    what lies between, until nothing grows."""
    seen = seen or _seen(bases, keys)
    pos, base = F.col("pos"), F.col("base")
    run = reduce(lambda a, b: a | b, [_text(-k, 5) == F.repeat(base, F.lit(5)) for k in range(5)])
    marks = written(seen.where(run).select(*keys, "pos", base.alias("label")), "marks")
    same = lambda first, n: _text(first, n) == F.repeat(_text(first, 1), F.lit(n))
    ahead = [(same(1, j), pos + 1 + j, pos - 3, pos + j) for j in range(1, 5)]
    back = [(same(-j, j), pos - 1 - j, pos - j, pos + 3) for j in range(1, 5)]
    right = _claims(seen, keys, (_text(-3, 4) == F.repeat(base, F.lit(4))) & (_text(1, 1) != base), base, ahead)
    left = _claims(seen, keys, (_text(0, 4) == F.repeat(base, F.lit(4))) & (_text(-1, 1) != base), base, back)
    return _grown(marks, written(right.unionByName(left).withColumn("near", F.col("label")), "claims"), keys, once=True)


def dinucleotides(bases: DataFrame, keys: list[str], seen: DataFrame | None = None) -> DataFrame:
    """-> keys, pos, label (the two bases; a position may have several): four copies of a dimer; then two copies of it within seven bases of a position
    that has it or its reverse, if these bases are none or one, or two kinds that alternate or are the dimer's own, until nothing grows."""
    seen = seen or _seen(bases, keys)
    pos = F.col("pos")
    start = seen.where((_text(0, 8) == F.repeat(_text(0, 2), F.lit(4))) & (_text(0, 1) != _text(1, 1)))
    marks = start.select(*keys, F.explode(F.sequence(pos, pos + 7)).alias("pos"), _text(0, 2).alias("label")).distinct()

    def bridge(first: int, j: int) -> Column:
        if j <= 1:
            return F.lit(True)
        text = _text(first, j)
        kinds = F.array_sort(F.array_distinct(F.split(text, "")))
        alternate = ~reduce(lambda a, b: a | b, [F.contains(text, F.lit(c + c)) for c in "ACGT"])
        return (F.size(kinds) == 2) & ~F.contains(text, F.lit("-")) & (alternate | (kinds == F.array_sort(F.split(_text(0, 2), ""))))

    twice = (_text(0, 4) == F.repeat(_text(0, 2), F.lit(2))) & (_text(0, 1) != _text(1, 1))
    reach = [(bridge(4, j), pos + 4 + j, pos, pos + 3 + j) for j in range(8)] + [(bridge(-j, j), pos - 1 - j, pos - j, pos + 3) for j in range(8)]
    claims = _claims(seen, keys, twice, _text(0, 2), reach)
    return _grown(written(marks, "marks"), written(claims.withColumn("near", F.explode(F.array("label", F.reverse("label")))), "claims"), keys, once=False)


def sequence_masks(bases: DataFrame, keys: list[str]) -> DataFrame:
    """-> keys, pos, mask: the bases that an alternative at a position may not be. Inside a homopolymer stretch its base; at its first position any; the one
    before has the base, the one after base,1; elsewhere the bases of its dinucleotides."""
    seen = _seen(bases, keys)
    marks = written(homopolymers(bases, keys, seen), "marks")
    way = _way(marks.count())
    at = lambda d, name: marks.select(*keys, (F.col("pos") + d).alias("pos"), F.lit(True).alias(name)).hint(way)
    x = marks.join(at(1, "before"), [*keys, "pos"], "left").join(at(-1, "after"), [*keys, "pos"], "left")
    first, last = F.col("before").isNull(), F.col("after").isNull()
    say = lambda rank, d, mask: F.struct(F.lit(rank).alias("rank"), (F.col("pos") + d).alias("at"), mask.alias("mask"))
    label = F.col("label")
    given = F.when(last, F.array(say(1, 0, label), say(0, 1, F.concat(label, F.lit(",1"))))).when(first, F.array(say(2, -1, label), say(1, 0, F.lit("A,C,G,T")))).otherwise(F.array(say(1, 0, label)))
    homo = x.select(*keys, F.explode(given).alias("g")).groupBy(*keys, F.col("g.at").alias("pos")).agg(F.min(F.struct("g.rank", "g.mask")).alias("m")).select(*keys, "pos", F.col("m.mask").alias("mask"))
    pairs = dinucleotides(bases, keys, seen).select(*keys, "pos", F.explode(F.split("label", "")).alias("b")).groupBy(*keys, "pos").agg(F.array_join(F.array_sort(F.collect_set("b")), ",").alias("mask"))
    return homo.unionByName(pairs.join(homo.hint(way), [*keys, "pos"], "left_anti"))
