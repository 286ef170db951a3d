"""URL verdicts: rules first, then trust and distrust over the link graph, in DataFrame functions only.

Hosts and all domains above them are nodes, also those that own no page. A page
that names another host in an absolute or protocol-relative link gives an edge
to it; a domain and its parent (one label less, up to the last label) link to
each other, so hosts of one domain reach each other through it. Personalised
PageRank carries trust from seeds along the edges, and distrust from blocked
seeds against them. A host's seed is the share of its pages that a rule allows
or blocks. A host is blocked if its distrust exceeds its trust by THRESHOLD.

Scale: links are counted by (host, host) before anything is joined, so a hot
host is small after the map side; while edges are below a bound, they are
broadcast and CUT_EVERY rounds are one task, else each is a shuffle whose skewed
parts Spark splits. Rounds go on until the ranks' summed change over CUT_EVERY
rounds shows every rank to be within TOLERANCE of its limit: the number of
rounds grows with the logarithm of the seeds' sum. Lineage is cut
every CUT_EVERY rounds by a written table.

Defined cases: a url that is null or lacks '://' has host and path '' and fits
no rule; the empty host is no node and is allowed; null html has no links;
a host with a user or a port has the bare host as its parent; addresses and
hosts beyond the 253 characters of a domain name have no parent;
repeated pages each count and each get a row; without rules all is allowed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haplospark.llm.common import drop_staged, staged, table

LINK = r"""(?i)(?:href|src)\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""
#: In one task, each round holds pages of memory for its sums until the task ends: CUT_EVERY must be small.
DAMPING, TOLERANCE, CUT_EVERY, THRESHOLD = 0.85, 1e-3, 3, 0.05
BROADCAST_ROWS = 100_000
#: (verdict, host, path); a rule's name is host + path.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def lower_az(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.coalesce(lower_az(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, or null. rules: a driver-side list."""
    fit = lambda r: ((host == r[1]) | host.endswith("." + r[1])) & path.startswith(r[2])
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    pick = lambda value: F.coalesce(*[F.when(fit(r), F.lit(value(r))) for r in ordered]) if ordered else F.lit(None).cast("string")
    return pick(lambda r: r[1] + r[2]), pick(lambda r: r[0])


def line_of(host: Column) -> Column:
    """The host and the domains above it, lowest first."""
    bare = F.regexp_extract(host, r"(?s)^(?:.*@)?(.*?)(?::\d*)?$", 1)
    labels = F.split(bare, r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    alone = bare.rlike(r"^(?:\d+(?:\.\d+){3}|\[.*\])$") | (F.length(bare) > 253)
    return F.array_distinct(F.filter(F.concat(F.array(host), F.when(alone, F.array(bare)).otherwise(above)), lambda d: d != ""))


def host_edges(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """pages(host, html), hosts(host) -> src, dst, weight (pages that link, 1 for parent and child)."""
    targets = F.array_distinct(F.transform(F.regexp_extract_all(F.col("html"), F.lit(LINK), F.lit(1)), lower_az))
    links = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(targets).alias("dst"))
    links = staged(links.where("src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight")), "links")
    lines = hosts.select("host").union(links.select("dst")).distinct().select(line_of(F.col("host")).alias("line")).where(F.size("line") > 1)
    pairs = F.transform(F.sequence(F.lit(1), F.size("line") - 1), lambda i: F.struct(F.get("line", i - 1).alias("child"), F.get("line", i).alias("parent")))
    family = lines.select(F.explode(pairs).alias("f")).select("f.child", "f.parent").distinct()
    both = F.explode(F.array(F.struct(F.col("child").alias("src"), F.col("parent").alias("dst")), F.struct(F.col("parent").alias("src"), F.col("child").alias("dst"))))
    return links.unionByName(family.select(both.alias("e")).select("e.src", "e.dst", F.lit(1.0).alias("weight"))).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, tolerance: float = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """edges(kind, src, dst, share), seeds(kind, host, seed) -> kind, host, r, the limit of
    r = (1 - damping) * seed + damping * inflow, up to ``tolerance``. A host without edges keeps no inflow to pass on."""
    few = max(seeds.count(), edges.count()) <= BROADCAST_ROWS
    one = lambda df: df.coalesce(1) if few else df
    base = one(seeds).select("kind", "host", ((1 - damping) * F.col("seed")).alias("r"))
    edges, last = F.broadcast(edges) if few else edges, base
    left = damping**CUT_EVERY / (1 - damping**CUT_EVERY)  # of a change over so many rounds, at most, still to come
    while True:
        rank = last
        for _ in range(CUT_EVERY):
            known = rank.select(F.col("kind").alias("k"), F.col("host").alias("h"), "r")
            moved = known.join(edges, (F.col("kind") == F.col("k")) & (F.col("src") == F.col("h")))
            inflow = moved.select("kind", F.col("dst").alias("host"), (damping * F.col("r") * F.col("share")).alias("r"))
            rank = one(base.unionByName(inflow)).groupBy("kind", "host").agg(F.sum("r").alias("r"))
        both = rank.withColumn("was", F.lit(0.0)).unionByName(last.select("kind", "host", F.lit(0.0).alias("r"), F.col("r").alias("was")))
        ranks = staged(one(both).groupBy("kind", "host").agg(F.sum("r").alias("r"), F.sum("was").alias("was")), "ranks")
        change = ranks.agg(F.coalesce(F.sum(F.abs(F.col("r") - F.col("was"))), F.lit(0.0))).first()[0]
        if last is not base:
            drop_staged(last)
        last = one(ranks.select("kind", "host", "r"))
        if change * left < tolerance:
            return last


def host_scores(pages: DataFrame) -> DataFrame:
    """pages(host, html, rule_verdict) -> host, trust, distrust."""
    hosts = staged(pages.where("host <> ''").groupBy("host").agg(F.count("*").alias("n"), F.count(F.when(F.col("rule_verdict") == "allow", 1)).alias("good"), F.count(F.when(F.col("rule_verdict") == "block", 1)).alias("bad")), "hosts")
    edges = staged(host_edges(pages, hosts.select("host")), "edges")
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "weight").unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    out = both.groupBy("kind", "src").agg(F.sum("weight").alias("total")).withColumnsRenamed({"kind": "k", "src": "s"})
    both = staged(both.join(out, (F.col("kind") == F.col("k")) & (F.col("src") == F.col("s"))).select("kind", "src", "dst", (F.col("weight") / F.col("total")).alias("share")), "shares")
    seeds = staged(hosts.select("host", F.explode(F.array(F.struct(F.lit("trust").alias("kind"), (F.col("good") / F.col("n")).alias("seed")), F.struct(F.lit("distrust").alias("kind"), (F.col("bad") / F.col("n")).alias("seed")))).alias("x")).select("x.kind", "host", "x.seed").where("seed > 0"), "seeds")
    sum_of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("r"))), F.lit(0.0))
    return propagate(both, seeds).groupBy("host").agg(sum_of("trust").alias("trust"), sum_of("distrust").alias("distrust"))


def url_verdicts(pages: DataFrame, keep: list[str], rules: list[tuple[str, str, str]] | None = None, url: str = "url", html: str = "html") -> DataFrame:
    """keep, host, path, rule, verdict. Columns of ``keep`` must not have these names."""
    rules = RULES if rules is None else rules
    x = pages.select(*keep, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.col(html).alias("__html"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    x = x.withColumn("rule", name).withColumn("rule_verdict", verdict)
    scores = host_scores(x.select("host", F.col("__html").alias("html"), "rule_verdict"))
    blocked = staged(scores.where(F.col("distrust") - F.col("trust") > THRESHOLD).select(F.col("host").alias("b")), "blocked-hosts")
    few = blocked.count() <= BROADCAST_ROWS
    judged = x.join(F.broadcast(blocked) if few else blocked, F.col("host") == F.col("b"), "left")
    return judged.select(*keep, "host", "path", "rule", F.coalesce("rule_verdict", F.when(F.col("b").isNotNull(), "block").otherwise("allow")).alias("verdict"))


def op7_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"), ["page_id"])
