"""Joins of blocks on small rows; expected values worked out by hand."""

import pytest

from haplospark.operators import blocks as B

R = "region string, read int, hap string"
LEFT, RIGHT = ["212", "112"], ["122", "211"]


def of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def reads(spark, *strings):
    return spark.createDataFrame([("r", i, h) for i, h in enumerate(strings)], R)


def nodes(spark, **at):
    return spark.createDataFrame([("r", int(p[1:]), h) for p, haps in at.items() for h in haps], "region string, pos int, hap string")


def joined(spark, given, stop=3, blocks=None, **more):
    spans = spark.createDataFrame([("r", 0, stop)], "region string, start int, stop int")
    state, links = B.join_blocks(reads(spark, *given), blocks or nodes(spark, p0=LEFT, p3=RIGHT), spans, ["region"], **more)
    return {(x.ok, x["at"], x.hap) for x in state.collect()}, {(x.a, x.b) for x in links.collect()}


def test_matching_haps_and_links(spark):
    strings = B.distinct_strings(reads(spark, "x12122", "x12122", "2xxxxx", "xxx1x1", "xxxxxx", "x22122"), ["region"])
    found = B.matching_haps(strings, nodes(spark, p0=LEFT, p3=[*RIGHT, "x22"]), ["region"])
    assert of(found.select("read_hap", "n", "pos", "hap", "match")) == [("2xxxxx", 1, 0, "212", 1), ("x12122", 2, 0, "112", 2), ("x12122", 2, 0, "212", 2), ("x12122", 2, 3, "122", 3), ("x22122", 1, 3, "122", 3)]
    side = lambda **at: nodes(spark, **at)
    assert of(B.block_links(strings, side(p0=LEFT), side(p3=RIGHT), ["region"])) == [("r", "112", "122", 0), ("r", "212", "122", 0)]


def test_join_of_two_blocks(spark):
    given = ["212122", "x12211", "112xxx", "1122xx"]
    assert joined(spark, given) == ({(True, 3, "212122"), (True, 3, "112211")}, {("212", "122"), ("212", "211"), ("112", "211")})


def test_join_that_fails_is_padded_or_rescued(spark):
    given = ["212122", "x12211", "112xxx"]
    links = {("212", "122"), ("212", "211"), ("112", "211")}
    assert joined(spark, given) == ({(False, 0, "212"), (False, 0, "112")}, links)
    assert joined(spark, given, allow_x=True)[0] == {(True, 3, "212122"), (True, 3, "112xxx"), (True, 3, "xxx211")}
    gaps = lambda cls, least: spark.createDataFrame([("r", 2, cls, least)], "region string, idx int, cls int, least int")
    assert joined(spark, given, gaps=gaps(10, 2), allow_x=True)[0] == {(True, 3, "212122"), (True, 3, "112211")}
    for cls, least in ((-1, 5), (10, 1)):  # a weak gap: no rescue
        assert len(joined(spark, given, gaps=gaps(cls, least), allow_x=True)[0]) == 3


def test_join_over_three_blocks_and_one_candidate(spark):
    three = nodes(spark, p0=["1", "2"], p1=["1"], p2=["12", "21"])
    given = ["1112"] * 2 + ["2121"] * 2 + ["x1xx"]
    assert joined(spark, given, 2, three) == ({(True, 2, "1112"), (True, 2, "2121")}, {("11", "12"), ("21", "21")})
    assert joined(spark, given[1:4], 2, three)[0] == {(False, 1, "11"), (False, 1, "21")}  # one read is too few for short blocks
    assert joined(spark, given, 9, three)[0] == {(True, 2, "1112"), (True, 2, "2121")}  # blocks end before the span
    assert joined(spark, given, 2, three.where("pos > 0")) == (set(), set())


def test_rescue_by_pairs(spark):
    links = spark.createDataFrame([("r", a, b) for a in ("112", "122") for b in ("221", "211")], "region string, a string, b string")
    missing = lambda *m: spark.createDataFrame([("r", s, h) for s, h in m], "region string, side string, hap string")
    found = lambda m: of(B.rescued(links, m, ["region"]).select("a", "b"))
    assert found(missing(("left", "112"), ("right", "211"))) == [("112", "211")]
    assert found(missing(("left", "112"), ("left", "122"), ("right", "211"))) == []
    assert found(missing(("left", "112"))) == []
    one = links.where("a = '112' AND b = '221'")
    assert of(B.rescued(one, missing(("left", "112")), ["region"]).select("a", "b")) == [("112", "221")]
    assert of(B.rescued(one, missing(("left", "112"), ("right", "999")), ["region"])) == []
    dim = spark.createDataFrame([("r", "xx2", "221")], "region string, a string, b string")
    assert of(B.rescued(dim, missing(("left", "xx2")), ["region"])) == []


@pytest.fixture
def graph(spark):
    at = spark.createDataFrame([("r", p, s) for p in range(4) for s in "12"], "region string, pos int, hap string")
    edges = [(0, "1", "1"), (0, "2", "2"), (1, "1", "2"), (1, "2", "1"), (2, "2", "2"), (2, "1", "1")]
    return at, spark.createDataFrame([("r", p, a, p + 1, b, 7) for p, a, b in edges], "region string, pos int, src string, dst_pos int, dst string, n int")


def contracted(spark, graph, *spans):
    done = spark.createDataFrame([("r", s, last) for s, last, _ in spans], "region string, start int, last int")
    haps = spark.createDataFrame([("r", s, h) for s, _, haps in spans for h in haps], "region string, start int, hap string")
    found = B.contract(*graph, done, haps, ["region"])
    return [of(x.drop("region")) for x in found]


def test_contract(spark, graph):
    found, edges = contracted(spark, graph, (1, 2, ["12", "21"]))
    assert found == [(0, "1"), (0, "2"), (1, "12"), (1, "21"), (3, "1"), (3, "2")]
    assert edges == [(0, "1", 1, "12", None), (0, "2", 1, "21", None), (1, "12", 3, "2", None), (1, "21", 3, "1", None)]
    found, edges = contracted(spark, graph, (0, 1, ["11", "22"]), (2, 3, ["22", "11"]))
    assert found == [(0, "11"), (0, "22"), (2, "11"), (2, "22")] and edges == [(0, "11", 2, "22", None), (0, "22", 2, "11", None)]
    found, edges = contracted(spark, graph, (0, 1, ["11"]))
    assert edges == [(0, "11", 2, "2", None), (2, "1", 3, "1", 7), (2, "2", 3, "2", 7)]


def test_span_paths(spark, graph):
    spans = spark.createDataFrame([("r", 0, 3), ("r", 1, 2), ("r", 2, 2)], "region string, start int, stop int")
    assert of(B.span_paths(graph[1], spans, ["region"]).drop("region")) == [(0, "1122"), (0, "2211"), (1, "12"), (1, "21")]


def test_merge_by_size(spark):
    given = reads(spark, *["xx12111"] * 2, *["xx21222"] * 2, *["1112xxx"] * 3, *["2221xxx"] * 3)
    at = nodes(spark, p0=["11", "22"], p2=["12", "21"], p4=["111", "222"])
    edges = spark.createDataFrame([("r", 0, "11", 2, "12", None)], "region string, pos int, src string, dst_pos int, dst string, n int")
    found, _ = B.merge_by_size(given, at, edges, ["region"])
    assert of(found.drop("region")) == [(0, "11"), (0, "22"), (2, "12111"), (2, "21222")]  # the longer pair first; one pair left rests
    found, _ = B.merge_by_size(given, at, edges.limit(0), ["region"])
    assert found.count() == 6


def test_extended(spark):
    gaps = spark.createDataFrame([("r", 2, 10, 2)], "region string, idx int, cls int, least int")
    haps = spark.createDataFrame([("r", h) for h in ("212xxx", "xxx122", "xxxxxx", "112211", "x12xxx")], "region string, hap string")
    at = nodes(spark, p0=LEFT, p3=["122", "121"])
    given = reads(spark, "x12122", "x12121", "xx2xxx")
    expect = {"212xxx": "21212x", "xxx122": "x12122", "xxxxxx": "xxxxxx", "112211": "112211", "x12xxx": "x12xxx"}
    assert {x.hap: x.extended for x in B.extended(haps, given, at, gaps, ["region"]).collect()} == expect
    weak = gaps.selectExpr("region", "idx", "cls", "1 AS least")
    assert all(x.hap == x.extended for x in B.extended(haps, given, at, weak, ["region"]).collect())
