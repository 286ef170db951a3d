"""The graph over sites: nodes are (idx, symbol), edges count reads with two neighbouring symbols; haplotypes are assembled from it by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haplospark.functions.stats import edge_threshold
from haplospark.operators import blocks as B
from haplospark.operators.haplotypes import explode_haps, low_support, row_reads
from haplospark.operators.rounds import written
from haplospark.operators.runs import segments


def edge_counts(haps: DataFrame, keys: list[str]) -> DataFrame:
    """haps(keys, hap[, n reads]) -> keys, idx, src, dst, n: called symbols at idx and idx + 1. Strings are counted before they are cut, or come counted
    (``row_reads``)."""
    counted = haps.groupBy(*keys, "hap").agg(row_reads(haps).alias("reads"))
    pairs = F.transform(F.sequence(F.lit(1), F.length("hap") - 1), lambda i: F.struct((i - 1).alias("idx"), F.substr("hap", i, F.lit(1)).alias("src"), F.substr("hap", i + 1, F.lit(1)).alias("dst")))
    each = counted.where(F.length("hap") > 1).select(*keys, "reads", F.explode(pairs).alias("p")).select(*keys, "reads", "p.*")
    return each.where((F.col("src") != "x") & (F.col("dst") != "x")).groupBy(*keys, "idx", "src", "dst").agg(F.sum("reads").alias("n"))


def prune_edges(edges: DataFrame, keys: list[str]) -> DataFrame:
    """edges with ``weak``: the source has other ways out, the target other ways in, and the edge has few reads for its
    position; or a symbol other than 1 and 2 is there and the edge has one read."""
    at = Window.partitionBy(*keys, "idx")
    x = edges.withColumn("outs", F.count("*").over(Window.partitionBy(*keys, "idx", "src"))).withColumn("ins", F.count("*").over(Window.partitionBy(*keys, "idx", "dst")))
    x = x.withColumn("limit", edge_threshold(F.collect_list("n").over(at)))
    special = F.max(~F.col("src").isin("1", "2") | ~F.col("dst").isin("1", "2")).over(at)
    weak = (F.col("outs") > 1) & (F.col("ins") > 1) & ((F.col("n") <= F.col("limit")) | (special & (F.col("n") == 1)))
    return x.withColumn("weak", weak).select(*keys, "idx", "src", "dst", "n", "weak")


def mask_reads(haps: DataFrame, pruned: DataFrame, keys: list[str]) -> DataFrame:
    """haps(keys, read, hap): both ends of a removed edge become x; reads with one call or none go."""
    weak = pruned.where("weak").groupBy(*keys).agg(F.collect_set(F.struct("idx", "src", "dst")).alias("gone"))
    n = F.length("hap")
    at = lambda i: F.substr("hap", i, F.lit(1))
    hit = lambda i: F.array_contains("gone", F.struct((i - 1).alias("idx"), at(i).alias("src"), at(i + 1).alias("dst")))
    masked = F.transform(F.sequence(F.lit(1), n), lambda i: F.when(F.coalesce(hit(i), F.lit(False)) | F.coalesce((i > 1) & hit(i - 1), F.lit(False)), "x").otherwise(at(i)))
    out = haps.join(weak, keys, "left").withColumn("hap", F.array_join(masked, "")).drop("gone")
    return out.where(F.length(F.regexp_replace("hap", "x", "")) > 1)


def classify_gaps(edges: DataFrame, nodes: DataFrame, keys: list[str], pivot: int = -1) -> DataFrame:
    """kept edges and nodes(keys, idx, symbol) -> keys, idx, cls: -1 if weak (all edges of 2 reads or less, or one of fewer than 2, or
    nodes without an edge), 2 if each source has one target, else 10; the gap before the ``pivot`` site is no 2, so that the graph breaks there."""
    e = edges.groupBy(*keys, "idx").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.count_distinct("src").alias("srcs"), F.count_distinct("dst").alias("dsts"), F.count("*").alias("edges"))
    here = nodes.groupBy(*keys, "idx").agg(F.count_distinct("symbol").alias("here"))
    after = here.select(*keys, (F.col("idx") - 1).alias("idx"), F.col("here").alias("there"))
    x = here.join(after, [*keys, "idx"]).join(e, [*keys, "idx"], "left")
    weak = F.col("edges").isNull() | (F.col("least") < 2) | (F.col("most") <= 2) | (F.col("srcs") != F.col("here")) | (F.col("dsts") != F.col("there"))
    return x.select(*keys, "idx", F.when(weak, -1).when((F.col("edges") == F.col("srcs")) & (F.col("idx") != pivot - 1), 2).otherwise(10).alias("cls"))


def paths(edges: DataFrame, keys: list[str], first: int, last: int) -> DataFrame:
    """All paths from site ``first`` to site ``last`` as strings: a join for each step; the number of steps is the number of sites."""
    now = edges.where(F.col("idx") == first).select(*keys, F.concat("src", "dst").alias("path"), F.col("dst").alias("end"))
    for i in range(first + 1, last):
        step = edges.where(F.col("idx") == i).select(*keys, "src", "dst")
        now = now.join(step, keys).where(F.col("end") == F.col("src")).select(*keys, F.concat("path", "dst").alias("path"), F.col("dst").alias("end"))
    return now.select(*keys, "path").distinct()


def initial_nodes(edges: DataFrame, reads: DataFrame, keys: list[str]) -> DataFrame:
    """kept edges, reads(keys, hap), counted (``row_reads``) or not -> keys, pos, hap of one symbol: ends of edges, and symbols that two reads hold; at a site with neither,
    those of one."""
    ends = edges.select(*keys, F.col("idx").alias("pos"), F.col("src").alias("hap")).unionByName(edges.select(*keys, (F.col("idx") + 1).alias("pos"), F.col("dst").alias("hap"))).distinct()
    counted = reads.groupBy(*keys, "hap").agg(row_reads(reads).alias("reads"))
    held = explode_haps(counted, [*keys, "reads"]).where("symbol IN ('0', '1', '2', '3', '4')").groupBy(*keys, F.col("idx").alias("pos"), "symbol").agg(F.sum("reads").alias("n")).withColumnRenamed("symbol", "hap")
    x = held.join(ends.withColumn("end", F.lit(True)), [*keys, "pos", "hap"], "full")
    good = F.col("end").isNotNull() | (F.col("n") > 1)
    some = F.max(good.cast("int")).over(Window.partitionBy(*keys, "pos"))
    return x.withColumn("some", some).where(good | (F.col("some") == 0)).select(*keys, "pos", "hap")


def assemble(reads: DataFrame, keys: list[str], least: int = 4, pivot: int = -1) -> DataFrame:
    """reads(keys, hap), equally long in a region of two sites or more -> keys, hap, extended: haplotypes with ``least`` reads of their
    own, and how far linked candidates extend each.

    Reads are read once and counted by string; all that follows grows with the distinct strings alone. Every step is a join over all regions: weak edges go and reads are masked; runs of sites in which each symbol has one successor become blocks by paths,
    branching ones by the reads that span them; then blocks are scanned from the left, merged by size, and at last joined with
    x where nothing links them. A region of one such run is its paths alone. Only the count of rounds depends on the data: by the number of sites."""
    keys_of = lambda df: df.select(*keys).distinct()
    reads = written(reads.groupBy(*keys, "hap").agg(row_reads(reads).alias("reads")), "reads")
    widths = written(reads.groupBy(*keys).agg(F.max(F.length("hap")).alias("width")).where("width > 1"), "widths")
    pruned = written(prune_edges(edge_counts(reads, keys), keys), "edges")
    kept = pruned.where("NOT weak").drop("weak")
    masked = written(mask_reads(reads, pruned, keys).groupBy(*keys, "hap").agg(F.sum("reads").alias("reads")), "masked")
    nodes = written(initial_nodes(kept, reads, keys), "nodes")
    edges = kept.select(*keys, F.col("idx").alias("pos"), "src", (F.col("idx") + 1).alias("dst_pos"), "dst", "n")
    known = classify_gaps(kept, nodes.select(*keys, F.col("pos").alias("idx"), F.col("hap").alias("symbol")), keys, pivot)
    counts = kept.groupBy(*keys, "idx").agg(F.min("n").alias("least"))
    every = widths.select(*keys, F.explode(F.sequence(F.lit(0), F.col("width") - 2)).alias("idx"))
    gaps = written(every.join(known, [*keys, "idx"], "left").join(counts, [*keys, "idx"], "left").fillna(-1, ["cls"]).fillna(0, ["least"]), "gaps")

    order = Window.partitionBy(*keys)
    parts = segments(gaps.select(*keys, F.col("idx").alias("pos"), "cls"), keys).withColumn("end", F.col("last") - 1).drop("last")
    parts = parts.withColumn("i", F.row_number().over(order.orderBy("first"))).withColumn("parts", F.count("*").over(order))
    parts = written(parts.join(widths, keys), "segments")
    simple = parts.where("parts = 1 AND cls = 2").select(*keys, F.lit(0).alias("start"), (F.col("width") - 1).alias("stop"))
    walked = B.span_paths(edges, simple, keys).select(*keys, "hap")
    rest = parts.join(keys_of(simple), keys, "left_anti")
    alone = rest.where("cls = 2").select(*keys, (F.col("first") + F.when((F.col("i") == 1) | (F.col("i") == F.col("parts")), 0).otherwise(1)).alias("start"), (F.col("end") + F.when(F.col("end") == F.col("width") - 2, 1).otherwise(0)).alias("last")).where("last > start")
    open_nodes, open_edges = (x.join(keys_of(rest), keys, "left_semi") for x in (nodes, edges))
    by_path = B.span_paths(edges, alone.withColumnRenamed("last", "stop"), keys)
    nodes, edges = (written(x, "graph") for x in B.contract(open_nodes, open_edges, alone, by_path, keys))

    branching = rest.where("cls > 2").select(*keys, F.col("first").alias("start"), (F.col("end") + 1).alias("stop"))
    state, _ = B.join_blocks(masked, nodes, branching, keys)
    whole = state.where("ok AND at = stop")
    nodes, edges = (written(x, "graph") for x in B.contract(nodes, edges, whole.select(*keys, "start", F.col("stop").alias("last")).distinct(), whole.select(*keys, "start", "hap"), keys))

    now = written(nodes.groupBy(*keys).agg(F.min("pos").alias("start"), F.max("pos").alias("stop")).where("start < stop - 1"), "scan")
    while now.limit(1).count():  # what joins from the left on becomes a block; the scan goes on behind it
        state, _ = B.join_blocks(masked, nodes, now, keys)
        grown = state.where("at > start")
        nodes, edges = (written(x, "graph") for x in B.contract(nodes, edges, grown.select(*keys, "start", F.col("at").alias("last")).distinct(), grown.select(*keys, "start", "hap"), keys))
        behind = state.where("NOT ok").groupBy(*keys, "stop").agg(F.max(F.col("start") + F.length("hap")).alias("start"))
        now = written(behind.where("start < stop - 1").select(*keys, "start", "stop"), "scan")

    nodes, edges = B.merge_by_size(masked, nodes, edges, keys)
    spans = nodes.groupBy(*keys).agg(F.min("pos").alias("start"), F.max("pos").alias("stop"))
    state, _ = B.join_blocks(masked, nodes, spans, keys, gaps, allow_x=True)
    found = written(state.join(widths, keys).where(F.length("hap") == F.col("width")).select(*keys, "hap").unionByName(walked).distinct(), "haplotypes")
    good = written(low_support(reads, found, keys, least), "supported")
    grown = B.extended(good, masked, nodes, gaps, keys)
    return good.join(grown, [*keys, "hap"], "left").select(*keys, "hap", F.coalesce("extended", "hap").alias("extended"))
