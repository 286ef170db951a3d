"""Equal reads count once: operators over rows that stand for several reads, and an assembly whose tables do not grow with reads."""

from haplospark.operators import blocks as B
from haplospark.operators import candidates as N
from haplospark.operators import graph, haplotypes, rounds


def of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_counted_rows_are_as_good_as_reads(spark):
    given = {"1112": 3, "2221": 2, "x112": 4, "xxx1": 1, "12xx": 1}
    counted = spark.createDataFrame([("r", h, n) for h, n in given.items()], "r string, hap string, reads long")
    each = spark.createDataFrame([("r", i, h) for i, h in enumerate(h for h, n in given.items() for _ in range(n))], "r string, read int, hap string")
    haps = spark.createDataFrame([("r", "1112"), ("r", "2221")], "r string, hap string")
    edges = graph.edge_counts(each, ["r"])
    assert of(graph.edge_counts(counted, ["r"])) == of(edges)
    assert of(graph.initial_nodes(edges.limit(0), counted, ["r"])) == of(graph.initial_nodes(edges.limit(0), each, ["r"]))
    assert of(B.distinct_strings(counted, ["r"])) == of(B.distinct_strings(each, ["r"]))
    assert of(haplotypes.low_support(counted, haps, ["r"], 4)) == of(haplotypes.low_support(each, haps, ["r"], 4)) == [("r", "1112")]


def test_candidates_by_counted_support(spark):
    candidates = spark.createDataFrame([(0, "a"), (0, "b")], "k int, candidate string")
    counted = [(0, "a", 9, 5), (0, "a", 2, 4), (0, "b", 3, 7)]  # the median of a is 9, or 5.5 if rows were reads
    each = spark.createDataFrame([r[:3] for r in counted for _ in range(r[3])], "k int, candidate string, matches int")
    support = spark.createDataFrame(counted, "k int, candidate string, matches int, reads long")
    assert of(N.reduce_candidates(candidates, support, ["k"])) == of(N.reduce_candidates(candidates, each, ["k"])) == [(0, "a")]


def test_assembly_holds_distinct_strings(spark, monkeypatch):
    sizes = {}

    def kept(df, name):
        out = rounds.written(df, name)
        sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    monkeypatch.setattr(graph, "written", kept)
    monkeypatch.setattr(B, "written", kept)
    given = ["11xx", "x11x", "xx12", "22xx", "x22x", "xx21"]
    reads = spark.createDataFrame([("r", i, given[i % 6]) for i in range(600)], "r string, read int, hap string")
    assert {x.hap for x in graph.assemble(reads, ["r"]).collect()} == {"1112", "2221"}
    assert max(sizes.values()) <= 12, sizes
