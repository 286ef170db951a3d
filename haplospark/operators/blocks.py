"""Blocks of sites: partial haplotypes joined by the reads that span them, for all regions at once.

Nodes are rows (keys, pos, hap): a candidate string that begins at site ``pos``.
Reads count once a distinct string. A join of neighbouring blocks is two
arg-max joins (each string with its best candidates on either side); a join
over many blocks is a frontier (keys, start, hap) that grows by one block a
round, for every span of every region in the same job, and is written between
rounds: there are as many rounds as a span has blocks, whatever the reads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haplospark.functions.strings import compare_haps, start_end
from haplospark.operators.candidates import reduce_candidates
from haplospark.operators.haplotypes import row_reads
from haplospark.operators.rounds import forget, written


def distinct_strings(reads: DataFrame, keys: list[str]) -> DataFrame:
    """reads(keys, hap), counted (``row_reads``) or not -> keys, read_hap, n."""
    return reads.groupBy(*keys, F.col("hap").alias("read_hap")).agg(row_reads(reads).alias("n"))


def matching_haps(strings: DataFrame, candidates: DataFrame, keys: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """strings(keys, read_hap, n), candidates(keys, by, pos, hap) -> also match: for each string and pos (and ``by``) the candidates without a mismatch that
    agree at most sites, one at least; all of equals."""
    part = F.substr("read_hap", F.col("pos") + 1, F.length("hap"))
    pairs = strings.join(candidates.select(*keys, *by, "pos", "hap"), keys).withColumn("c", compare_haps(F.col("hap"), part))
    hits = pairs.where("c.mismatch = 0 AND c.match > 0").select(*keys, *by, "read_hap", "n", "pos", "hap", F.col("c.match").alias("match"))
    most = F.max("match").over(Window.partitionBy(*keys, *by, "read_hap", "pos"))
    return hits.withColumn("most", most).where("match = most").drop("most")


def block_links(strings: DataFrame, left: DataFrame, right: DataFrame, keys: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """left and right(keys, by, pos, hap), one pos each -> keys, by, a, b, reads: pairs that some read matches best on both sides; ``reads`` counts those
    for which either side has one best candidate. A string meets both sides in one join and gathers its matches: as many as a block has candidates."""
    task = [*keys, *by]
    sides = left.select(*task, "pos", "hap", F.lit(True).alias("left")).unionByName(right.select(*task, "pos", "hap", F.lit(False).alias("left")))
    part = F.substr("read_hap", F.col("pos") + 1, F.length("hap"))
    hits = strings.join(sides, keys).withColumn("c", compare_haps(F.col("hap"), part)).where("c.mismatch = 0 AND c.match > 0")
    met = hits.groupBy(*task, "read_hap").agg(F.max("n").alias("n"), F.collect_set(F.struct("left", F.col("c.match").alias("match"), "hap")).alias("found"))
    mine = lambda side: F.filter("found", lambda v: v.left if side else ~v.left)
    best = lambda side: F.transform(F.filter(mine(side), lambda v: v.match == F.array_max(F.transform(mine(side), lambda w: w.match))), lambda v: v.hap)
    both = met.select(*task, "n", best(True).alias("lefts"), best(False).alias("rights"))
    both = both.select(*task, F.when((F.size("lefts") == 1) & (F.size("rights") == 1), F.col("n")).otherwise(0).alias("n"), F.explode("lefts").alias("a"), "rights")
    return both.select(*task, "n", "a", F.explode("rights").alias("b")).groupBy(*task, "a", "b").agg(F.sum("n").alias("reads"))


def rescued(links: DataFrame, missing: DataFrame, task: list[str]) -> DataFrame:
    """links(task, a, b), missing(task, side, hap) -> task, a, b to join though reads do not single them out. A missing candidate with
    at most one uncalled site joins its only link if nothing else is missing on the other side; or it joins the one that is missing there, if both are
    the only missing ones of their sides."""
    count = missing.groupBy(*task).agg(F.count_if(F.col("side") == "left").alias("lefts"), F.count_if(F.col("side") == "right").alias("rights"))
    is_missing = lambda side, name: missing.where(F.col("side") == side).select(*task, F.col("hap").alias(name), F.lit(True).alias(f"{name}_missing"))
    x = links.select(*task, "a", "b").distinct().withColumn("outs", F.count("*").over(Window.partitionBy(*task, "a"))).withColumn("ins", F.count("*").over(Window.partitionBy(*task, "b")))
    x = x.join(count, task).join(is_missing("left", "a"), [*task, "a"], "left").join(is_missing("right", "b"), [*task, "b"], "left").fillna(False, ["a_missing", "b_missing"])
    called = lambda c: F.length(c) - F.length(F.replace(c, F.lit("x"), F.lit(""))) <= 1
    pair = (F.col("lefts") == 1) & (F.col("rights") == 1) & F.col("a_missing") & F.col("b_missing")
    onward = F.col("a_missing") & called("a") & (pair | ((F.col("outs") == 1) & ((F.col("rights") == 0) | ((F.col("rights") == 1) & F.col("b_missing")))))
    back = F.col("b_missing") & called("b") & (pair | ((F.col("ins") == 1) & ((F.col("lefts") == 0) | ((F.col("lefts") == 1) & F.col("a_missing")))))
    return x.where(onward | back).select(*task, "a", "b")


def least_support(a: Column, b: Column) -> Column:
    """Reads that a join of two blocks needs: 2, or 1 for long ones."""
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    return F.when((short > 2) | ((short == 2) & (long >= 10)), 1).otherwise(2)


def join_blocks(reads: DataFrame, nodes: DataFrame, spans: DataFrame, keys: list[str], gaps: DataFrame | None = None, allow_x: bool = False) -> tuple[DataFrame, DataFrame]:
    """spans(keys, start, stop) over blocks of nodes(keys, pos, hap) -> (state, links).

    state(keys, start, stop, at, ok, hap): the joined strings from ``start`` on; ``at`` is the last block taken in. A block with one candidate, or met by one,
    joins with all. Else a pair needs ``least_support`` reads, and every candidate of both sides a partner: if not, the span ends
    there and ``ok`` is false; with ``allow_x``, candidates left over are first rescued (blocks of 3 sites or more, where
    gaps(keys, idx, cls, least) has a class and 2 reads for each edge), then padded with x. links(keys, start, a, b) are the linked pairs of a span's last
    round. A span whose start has no block has no rows; where blocks end before ``stop``, it ends there."""
    strings, task = written(distinct_strings(reads, keys), "strings"), [*keys, "start"]
    along = Window.partitionBy(*keys).orderBy("at")
    order = nodes.groupBy(*keys, F.col("pos").alias("at")).agg(F.count_distinct("hap").alias("here"), F.max(F.length("hap")).alias("size"))
    order = written(order.select(*keys, "at", F.lead("at").over(along).alias("next"), F.lead("here").over(along).alias("rights"), F.lead("size").over(along).alias("size_b")), "order")
    state = spans.join(nodes.withColumnRenamed("pos", "start"), task).select(*task, "stop", F.col("start").alias("at"), F.lit(True).alias("ok"), "hap", F.lit(0).alias("round"), (F.col("start") < F.col("stop")).alias("open"))
    state, found = written(state.distinct(), "frontier"), []
    blocks = nodes.select(*keys, F.col("pos").alias("next"), F.col("hap").alias("b")).distinct()
    while state.where("open").limit(1).count():
        left = state.where("open").select(*task, "stop", "at", "round", F.col("hap").alias("a")).join(order, [*keys, "at"]).withColumn("lefts", F.count("*").over(Window.partitionBy(*task)))
        info = left.select(*task, "stop", "round", "next", "lefts", "rights", "size_b").distinct()
        right = info.join(blocks, [*keys, "next"])
        crossed = left.where("lefts = 1 OR rights = 1").select(*task, "next", "a").join(blocks, [*keys, "next"]).select(*task, "a", "b")  # one row on one of the sides
        many = lambda df, pos, name: df.where("lefts > 1 AND rights > 1").select(*task, F.col(pos).alias("pos"), F.col(name).alias("hap"))
        links = written(block_links(strings, many(left, "start", "a"), many(right, "next", "b"), keys, ("start",)), "links")
        made = crossed.unionByName(links.where(F.col("reads") >= least_support(F.col("a"), F.col("b"))).select(*task, "a", "b"))
        if allow_x:
            made = _completed(made.distinct(), left, right, links, task, keys, gaps)
        joined = made.groupBy(*task).agg(F.count_distinct("a").alias("joined_a"), F.count_distinct("b").alias("joined_b"))
        fate = info.join(joined, task, "left").withColumn("ok", F.lit(allow_x) | (F.coalesce(F.col("joined_a") == F.col("lefts"), F.lit(False)) & F.coalesce(F.col("joined_b") == F.col("rights"), F.lit(False))))
        moved = fate.where("ok AND next IS NOT NULL").select(*task, "stop", "next", "round").join(made, task)
        moved = moved.select(*task, "stop", F.col("next").alias("at"), F.lit(True).alias("ok"), F.concat("a", "b").alias("hap"), (F.col("round") + 1).alias("round"), (F.col("next") < F.col("stop")).alias("open"))
        stays = left.select(*task, "stop", "at", "round", "a").join(fate.where("NOT ok OR next IS NULL").select(*task, "next"), task)
        stays = stays.select(*task, "stop", "at", F.col("next").isNull().alias("ok"), F.col("a").alias("hap"), (F.col("round") + 1).alias("round"), F.lit(False).alias("open"))
        before = state
        state = written(state.where("NOT open").unionByName(moved.distinct()).unionByName(stays), "frontier")
        found.append(links.select(*task, "a", "b").withColumn("round", F.lit(len(found) + 1)))
        forget(before)
    none = state.select(*task, F.col("hap").alias("a"), F.col("hap").alias("b"), "round").limit(0)
    last = reduce(DataFrame.unionByName, found, none).join(state.select(*task, "round").distinct(), [*task, "round"], "left_semi").drop("round")
    return state.select(*task, "stop", "at", "ok", "hap"), last


def _completed(made: DataFrame, left: DataFrame, right: DataFrame, links: DataFrame, task: list[str], keys: list[str], gaps: DataFrame | None) -> DataFrame:
    """made(task, a, b) with every candidate of both sides: rescued ones first, then padded with x."""
    side = lambda df, name, c: df.select(*task, F.lit(name).alias("side"), F.col(c).alias("hap"))
    every = side(left.where("next IS NOT NULL"), "left", "a").unionByName(side(right, "right", "b"))
    lost = lambda made: every.join(side(made, "left", "a").unionByName(side(made, "right", "b")).distinct(), [*task, "side", "hap"], "left_anti")
    sizes = left.groupBy(*task, "next").agg(F.max(F.length("a")).alias("size_a"), F.max("size_b").alias("size_b"))
    made = written(made, "made")
    missing = written(lost(made), "missing")
    if gaps is not None:
        good = gaps.where("cls <> -1 AND least >= 2").select(*keys, (F.col("idx") + 1).alias("next"))
        able = sizes.where("size_a >= 3 AND size_b >= 3").join(good, [*keys, "next"]).select(*task)
        made = made.unionByName(rescued(links, missing, task).join(able, task, "left_semi")).distinct()
        missing = lost(made)
    x = missing.join(sizes, task)
    pad = lambda size: F.repeat(F.lit("x"), F.col(size))
    is_left = F.col("side") == "left"
    return made.unionByName(x.select(*task, F.when(is_left, F.col("hap")).otherwise(pad("size_a")).alias("a"), F.when(is_left, pad("size_b")).otherwise(F.col("hap")).alias("b")))


def contract(nodes: DataFrame, edges: DataFrame, done: DataFrame, haps: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """nodes(keys, pos, hap), edges(keys, pos, src, dst_pos, dst, n), done(keys, start, last) spans that do not overlap, haps(keys, start, hap) -> new nodes and
    edges: a span's blocks give way to its haps at ``start``. An edge that leaves its last block now leaves the haps that end as its source began,
    one that enters it the haps that begin like its target; their counts are unknown. Edges inside a span go."""
    spans = lambda prefix: done.select(*keys, F.col("start").alias(f"{prefix}_start"), F.col("last").alias(f"{prefix}_last"))
    new = lambda prefix: haps.select(*keys, F.col("start").alias(f"{prefix}_start"), F.col("hap").alias(f"{prefix}_new")).distinct()
    same = lambda x, y: reduce(lambda a, b: a & b, [x[k].eqNullSafe(y[k]) for k in keys])

    def inside(df: DataFrame, at: str, prefix: str, how: str) -> DataFrame:
        s = spans(prefix)
        hit = same(df, s) & (df[at] >= s[f"{prefix}_start"]) & (df[at] <= s[f"{prefix}_last"])
        return df.join(s, hit, how) if how == "left_anti" else df.join(s, hit, how).select(*[df[c] for c in df.columns], f"{prefix}_start", f"{prefix}_last")

    kept = inside(nodes.select(*keys, "pos", "hap"), "pos", "gone", "left_anti").unionByName(haps.select(*keys, F.col("start").alias("pos"), "hap").distinct())
    x = inside(inside(edges, "pos", "out", "left"), "dst_pos", "into", "left")
    x = x.where("out_start IS NULL OR into_start IS NULL OR out_start <> into_start").where("out_start IS NULL OR pos = out_last")
    x = x.join(new("out"), [*keys, "out_start"], "left").join(new("into"), [*keys, "into_start"], "left")
    first = lambda c: F.substr(c, F.lit(1), F.lit(1))
    x = x.where((F.col("out_start").isNull() | (F.right("out_new", F.lit(1)) == first("src"))) & (F.col("into_start").isNull() | (first("into_new") == first("dst"))))
    changed = F.col("out_start").isNotNull() | F.col("into_start").isNotNull()
    out = x.select(*keys, F.coalesce("out_start", "pos").alias("pos"), F.coalesce("out_new", "src").alias("src"), F.coalesce("into_start", "dst_pos").alias("dst_pos"), F.coalesce("into_new", "dst").alias("dst"), F.when(~changed, F.col("n")).alias("n"))
    return kept, out.distinct()


def span_paths(edges: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """edges(keys, pos, src, dst) between neighbouring sites, spans(keys, start, stop) -> keys, start, hap: the strings of all paths from start to stop; a
    join a site, for all spans at once. Where sites branch, paths multiply: meant for spans in which each symbol has one successor."""
    task, at = [*keys, "start"], edges.select(*keys, "pos", "src", "dst")
    now = spans.join(at.withColumnRenamed("pos", "start"), task).where("stop > start").select(*task, "stop", (F.col("start") + 1).alias("pos"), F.concat("src", "dst").alias("hap")).distinct()
    now, done = written(now, "paths"), []
    while now.limit(1).count():
        done.append(now.where("pos = stop").select(*task, "hap"))
        step = now.where("pos < stop").join(at, [*keys, "pos"]).where(F.right("hap", F.length("src")) == F.col("src"))
        now = written(step.select(*task, "stop", (F.col("pos") + 1).alias("pos"), F.concat("hap", "dst").alias("hap")).distinct(), "paths")
    return reduce(DataFrame.unionByName, done, now.select(*task, "hap").limit(0))


def merge_by_size(reads: DataFrame, nodes: DataFrame, edges: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Joins neighbouring blocks, in each round one pair a region: of those that join whole, the one whose shorter block is longest, then the longer
    one, then the first. Regions without edges or with one pair left rest; the rounds end when no region changes."""
    while True:
        blocks = nodes.groupBy(*keys, "pos").agg(F.max(F.length("hap")).alias("size"))
        order = Window.partitionBy(*keys).orderBy("pos")
        pairs = blocks.select(*keys, F.col("pos").alias("start"), F.lead("pos").over(order).alias("stop"), "size", F.lead("size").over(order).alias("after")).where("stop IS NOT NULL")
        pairs = pairs.withColumn("pairs", F.count("*").over(Window.partitionBy(*keys))).where("pairs > 1").join(edges.select(*keys).distinct(), keys, "left_semi")
        pairs = written(pairs, "pairs")
        state, _ = join_blocks(reads, nodes, pairs.select(*keys, "start", "stop"), keys)
        joined = state.where("ok").select(*keys, "start").distinct().join(pairs, [*keys, "start"])
        first = Window.partitionBy(*keys).orderBy(F.desc(F.least("size", "after")), F.desc(F.greatest("size", "after")), "start")
        best = written(joined.withColumn("place", F.row_number().over(first)).where("place = 1").select(*keys, "start", F.col("stop").alias("last")), "best")
        if not best.limit(1).count():
            return nodes, edges
        nodes, edges = (written(x, "graph") for x in contract(nodes, edges, best, state.join(best, [*keys, "start"], "left_semi").select(*keys, "start", "hap"), keys))


def neighbour_links(strings: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """strings(keys, read_hap, n) -> keys, left_pos, right_pos, a, b: linked candidates of each two neighbouring blocks; blocks of one candidate have none."""
    sized = nodes.select(*keys, "pos", "hap").distinct().withColumn("n", F.count("*").over(Window.partitionBy(*keys, "pos")))
    order = sized.select(*keys, "pos", "n").distinct().withColumns({"next": F.lead("pos").over(Window.partitionBy(*keys).orderBy("pos")), "after": F.lead("n").over(Window.partitionBy(*keys).orderBy("pos"))})
    both = order.where("n > 1 AND after > 1").select(*keys, F.col("pos").alias("left_pos"), F.col("next").alias("right_pos"))
    left = both.join(nodes.withColumnRenamed("pos", "left_pos"), [*keys, "left_pos"]).select(*keys, "left_pos", "right_pos", F.col("left_pos").alias("pos"), "hap")
    right = both.join(nodes.withColumnRenamed("pos", "right_pos"), [*keys, "right_pos"]).select(*keys, "left_pos", "right_pos", F.col("right_pos").alias("pos"), "hap")
    return block_links(strings, left, right, keys, ("left_pos", "right_pos")).drop("reads")


def _agreed(candidates: DataFrame, keys: list[str], back: bool) -> DataFrame:
    """candidates(keys, hap, candidate) of equal length -> keys, hap, bases: the stretch on which all agree, from the near end on."""
    text = F.reverse("candidate") if back else F.col("candidate")
    each = candidates.select(*keys, "hap", F.posexplode(F.split(text, "")).alias("i", "base")).where("base <> ''")
    votes = each.groupBy(*keys, "hap", "i").agg(F.count_distinct("base").alias("bases"), F.min("base").alias("base"))
    open_ = F.max((F.col("bases") > 1).cast("int")).over(Window.partitionBy(*keys, "hap").orderBy("i"))
    agreed = votes.withColumn("open", open_).where("open = 0").groupBy(*keys, "hap").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "base"))), lambda v: v.base), "").alias("bases"))
    return agreed.withColumn("bases", F.reverse("bases")) if back else agreed


def extended(haps: DataFrame, reads: DataFrame, nodes: DataFrame, gaps: DataFrame, keys: list[str]) -> DataFrame:
    """haps(keys, hap), gaps(keys, idx, cls, least) -> keys, hap, extended. Where a haplotype ends before the last site but one or begins after the
    second, and the gap there has a class and 2 reads for each edge, the candidates that reads link to its outer block extend it as far as they
    agree; of several, reads that match the haplotype too may first choose one (``reduce_candidates``)."""
    n = F.length("hap")
    strings, nodes = written(distinct_strings(reads, keys), "strings"), written(nodes.select(*keys, "pos", "hap"), "nodes")
    ends = haps.select(*keys, "hap").distinct().withColumn("e", start_end(F.col("hap"))).select("*", F.col("e.first").alias("first"), F.col("e.last").alias("last")).drop("e")
    open_ = ends.where(F.contains("hap", F.lit("x")) & (F.col("first") <= F.col("last")))
    good, links = gaps.where("cls <> -1 AND least >= 2").select(*keys, "idx"), neighbour_links(strings, nodes, keys)
    right = open_.where(F.col("last") < n - 2).join(good.withColumnRenamed("idx", "last"), [*keys, "last"]).join(links, keys)
    right = right.where((F.col("left_pos") <= F.col("last")) & (F.col("right_pos") > F.col("last")) & (F.substr("hap", F.col("left_pos") + 1, F.col("last") - F.col("left_pos") + 1) == F.col("a")))
    right = right.select(*keys, "hap", F.col("b").alias("candidate"), F.concat(F.repeat(F.lit("x"), F.col("last") + 1), "b", F.repeat(F.lit("x"), F.greatest(F.lit(0), n - F.col("last") - 1 - F.length("b")))).alias("placed"), F.lit(False).alias("back"))
    left = open_.where("first >= 2").join(good.select(*keys, (F.col("idx") + 1).alias("first")), [*keys, "first"]).join(links, keys)
    left = left.where((F.col("left_pos") < F.col("first")) & (F.col("right_pos") == F.col("first")) & (F.substr("hap", F.col("first") + 1, F.length("b")) == F.col("b")))
    left = left.select(*keys, "hap", F.col("a").alias("candidate"), F.concat(F.repeat(F.lit("x"), F.greatest(F.lit(0), F.col("first") - F.length("a"))), "a", F.repeat(F.lit("x"), n - F.col("first"))).alias("placed"), F.lit(True).alias("back"))
    by = [*keys, "hap", "back"]
    all_ = written(left.unionByName(right), "candidates").withColumn("of", F.count("*").over(Window.partitionBy(*by)))
    c1, c2 = compare_haps(F.col("hap"), F.col("read_hap")), compare_haps(F.col("placed"), F.col("read_hap"))
    seen = all_.where("of > 1").join(strings, keys).withColumns({"c1": c1, "c2": c2}).where("c1.mismatch = 0 AND c2.mismatch = 0 AND c1.match > 0 AND c2.match > 0")
    support = seen.select(*by, "candidate", F.least("c1.match", "c2.match").alias("matches"), F.col("n").alias("reads"))
    chosen = written(reduce_candidates(all_.where("of > 1"), support, by).unionByName(all_.where("of = 1").select(*by, "candidate")), "chosen")
    grown = lambda back: _agreed(chosen.where(F.col("back") == back), keys, back).withColumnRenamed("bases", "before" if back else "after")
    x = ends.join(grown(True), [*keys, "hap"], "left").join(grown(False), [*keys, "hap"], "left").fillna("", ["before", "after"])
    size = lambda c: F.greatest(F.lit(0), c)
    core = F.substr("hap", F.col("first") + 1, size(F.col("last") - F.col("first") + 1))
    made = F.concat(F.repeat(F.lit("x"), size(F.col("first") - F.length("before"))), "before", core, "after", F.repeat(F.lit("x"), size(n - 1 - F.col("last") - F.length("after"))))
    return x.select(*keys, "hap", F.when(F.col("first") > F.col("last"), F.col("hap")).otherwise(made).alias("extended"))
