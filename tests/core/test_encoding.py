"""Two rounds of encoding and deletions in strings, on small rows worked out by hand."""

from haplospark.operators import encoding as E

K = ["region"]
SITES = [100, 110, 150, 200, 300, 400]


def of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def marked(spark, hap, n1, n2, partial=("r1",), negative=(), positions=SITES):
    haps = spark.createDataFrame([("g", r, h) for r, h in hap.items()], "region string, read string, hap string")
    sites = spark.createDataFrame([("g", p, f"{p}_A_C") for p in positions], "region string, pos int, code string")
    known = [("g", r, True, None) for r in partial] + [("g", r, None, True) for r in negative]
    evidence = spark.createDataFrame(known, "region string, read string, partial boolean, negative boolean")
    deletion = spark.createDataFrame([("g", n1, n2, f"{n1}_del", "3")], "region string, n1 int, n2 int, name string, symbol string")
    found, now = E.mark_deletions(haps, sites, deletion, evidence, K)
    return {x.read: x.hap for x in found.collect()}, [x.code.split("_")[-1] == "del" for x in now.orderBy("pos").collect()]


def test_sites_inside_a_deletion(spark):
    found, sites = marked(spark, {"r1": "111111", "r2": "222222", "r3": "xx"}, 199, 201, negative=("r4",))
    assert found == {"r1": "111311", "r2": "222222", "r3": "xx", "r4": "xxxxxx"} and not any(sites)
    assert marked(spark, {"r1": "111111"}, 110, 250)[0] == {"r1": "113311"}
    assert marked(spark, {"r1": "111111", "r2": "222222"}, 250, 900)[0] == {"r1": "111133", "r2": "222222"}
    assert marked(spark, {"r1": "111111"}, 900, 150)[0] == {"r1": "111111"}  # ends the wrong way round
    assert marked(spark, {"r1": "111111"}, 350, 150)[0] == {"r1": "111111"}


def test_a_deletion_between_sites(spark):
    reads = {"r1": "111111", "zero": "0x1110", "through": "x11111", "both": "100111", "near": "11112x", "far": "x1211x", "cut": "1x1111"}
    first, sites = marked(spark, reads, 99, 99, negative=("through", "new"))
    assert first == {"r1": "3111111", "zero": "00x1110", "through": "1x11111", "both": "x100111", "near": "x11112x", "far": "xx1211x", "cut": "x1x1111", "new": "1xxxxxx"} and sites == [True] + [False] * 6
    last, sites = marked(spark, reads, 500, 600, negative=("through", "zero"))
    assert last == {"r1": "1111113", "zero": "0x11100", "through": "x111111", "both": "100111x", "near": "11112xx", "far": "x1211xx", "cut": "1x1111x"} and sites == [False] * 6 + [True]
    inside, sites = marked(spark, reads, 120, 120, negative=("through",))
    assert inside == {"r1": "1131111", "zero": "0xx1110", "through": "x1x1111", "both": "1000111", "near": "111112x", "far": "x1x211x", "cut": "1xx1111"} and sites == [False, False, True, False, False, False, False]


def test_deletions_in_turn_and_keys_without_one(spark):
    haps = spark.createDataFrame([("g", "r1", "12"), ("g", "r2", "21"), ("h", "r1", "1")], "region string, read string, hap string")
    sites = spark.createDataFrame([("g", 10, "a"), ("g", 20, "b"), ("h", 10, "c")], "region string, pos int, code string")
    step = lambda n1, n2, read, s: (spark.createDataFrame([("g", n1, n2, f"d{s}", s)], "region string, n1 int, n2 int, name string, symbol string"), spark.createDataFrame([("g", read, True, False)], "region string, read string, partial boolean, negative boolean"))
    found, now = E.deletions_in_turn(haps, sites, [step(15, 15, "r1", "3"), step(12, 18, "r2", "4")], K)
    assert of(found) == [("g", "r1", "132"), ("g", "r2", "241"), ("h", "r1", "1")]
    assert of(now) == [("g", 10, "a"), ("g", 15, "d3"), ("g", 20, "b"), ("h", 10, "c")]
    assert E.mark_deletions(haps.limit(0), sites, *step(15, 15, "r1", "3"), K)[0].collect()[0].hap == "x3x"


def rounds(spark, calls, reads=(), clips=(), kept=(), homs=(), added=(), bases=(), also=(), sites=((100, "A", "C"), (200, "A", "C"), (300, "A", "C"))):
    site = lambda rows: spark.createDataFrame([("g", *r) for r in rows], "region string, pos int, ref string, alt string")
    frame = lambda rows, columns: spark.createDataFrame([("g", *r) for r in rows], "region string, " + columns)
    haps, final = E.encode_twice(
        frame(calls, "read string, pos int, base string"), frame(reads, "read string, start int, end int, clip_left int, clip_right int"), site(sites), K, clips=frame(clips, "side string, pos int"),
        bases=frame(bases, "pos int, base string"), kept=site(kept), homs=site(homs), added=site(added), also_ref=frame(also, "pos int, base string"))
    return {x.read: x.hap for x in haps.collect()}, [tuple(x)[1:] for x in final.orderBy("pos", "ref", "alt").collect()]


def test_sites_of_one_kind_go(spark):
    both = [(f"r{i}", 100, "AC"[i % 2]) for i in range(8)]
    one = [(f"r{i}", 200, "c" if i < 3 else "a") for i in range(8)] + [("r7", 200, None), ("r7", 100, "G")]
    rare = [(f"r{i}", 300, "AC"[i % 2]) for i in range(6)]
    found, sites = rounds(spark, both + one + rare)
    assert sites == [(100, "A", "C", None)] and found == {f"r{i}": "12"[i % 2] for i in range(8)}
    # a kept site stays; a hom one loses the symbol that it should not have; both rare, it goes though kept
    found, sites = rounds(spark, both + one + rare, kept=[(200, "A", "C"), (300, "A", "C")], homs=[(200, "A", "C"), (300, "A", "C")])
    assert sites == [(100, "A", "C", None), (200, "A", "C", "2")] and found["r0"] == "1x" and found["r7"] == "21"
    found, sites = rounds(spark, both + one, added=[(300, "T", "G"), (100, "A", "C")])
    assert [s[:3] for s in sites] == [(100, "A", "C"), (300, "T", "G")] and found["r0"] == "1x"
    found, _ = rounds(spark, both + [("g1", 100, "g")], also=[(100, "G")])
    assert found["g1"] == "1"
    assert rounds(spark, []) == ({}, [])


def test_clips_make_reads_absent(spark):
    calls = [(f"r{i}", p, "AC"[i % 2]) for i in range(12) for p in (100, 200, 300)]
    reads = [("r0", 0, 240, 0, 50), ("r1", 0, 230, 0, 49), ("r2", 131, 900, 60, 0), ("r3", 130, 900, 60, 0), ("only", 0, 255, 0, 99), ("r4", 160, 250, 70, 70)]
    found, _ = rounds(spark, calls, reads, [("3p", 250), ("5p", 150)], bases=[(120, "A"), (280, "g")])
    assert found == {"r0": "110", "r1": "222", "r2": "011", "r3": "222", "r4": "010", "only": "xx0"} | {f"r{i}": "12"[i % 2] * 3 for i in range(5, 12)}
    # without sites beyond the clips, anchors stand in for them
    found, sites = rounds(spark, [c for c in calls if c[1] == 200], reads, [("3p", 250), ("5p", 150)], bases=[(120, "A"), (280, "g")], sites=[(200, "A", "C")])
    assert sites == [(120, "A", "C", None), (200, "A", "C", None), (280, "G", "A", None)]
    assert found["r0"] == "x10" and found["r2"] == "01x" and found["r4"] == "010" and found["r5"] == "x2x"
