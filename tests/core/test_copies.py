"""The copy behind the first one, on small alleles worked out by hand."""

from haplospark.operators import copies as O

K = ["region"]


def test_rules_in_turn(spark):
    cases = {  # haps, lasts, middles, links, directed, loose, sets -> second, rule
        "only": ("12", "2", "", "", "", "", [], "2", "only"),
        "last": ("123", "3", "", "", "", "", [], "2", "inner"),
        "mid": ("123", "", "3", "", "", "", [], "3", "middle"),
        "before": ("1234", "4", "", "42", "", "", [], "3", "before_last"),
        "two before": ("1234", "4", "", "42 43", "", "", [], None, None),
        "two last": ("12345", "45", "", "42", "", "", [], None, None),
        "order": ("1234", "4", "", "", "23", "", [], "2", "order"),
        "back": ("1234", "4", "", "", "32 34 13", "", [], "3", "order"),
        "circle": ("1234", "4", "", "", "23 32", "", [], None, None),
        "placed": ("1234", "4", "", "", "", "", ["24"], "3", "unplaced"),
        "elsewhere": ("1234", "4", "", "", "", "", ["23"], None, None),
        "two sets": ("1234", "4", "", "", "", "", ["24", "3"], None, None),
        "left": ("12345", "5", "", "", "43 23", "", ["25"], "4", "unplaced_order"),
        "loose": ("1234", "4", "", "", "", "123 132 143", [], "2", "loose"),
        "both": ("1234", "4", "", "", "", "123 133", [], None, None),
        "foreign": ("1234", "4", "", "", "", "193", [], None, None),
        "alone": ("1", "1", "", "", "", "", [], None, None),
        "none": ("12345", "", "", "", "", "", [], None, None),
    }
    named, rows = (lambda c: f"h{c}"), {n: [] for n in ("haps", "links", "directed", "loose", "placed")}
    for r, (haps, lasts, middles, links, directed, loose, sets, _, _) in cases.items():
        rows["haps"] += [(r, named(h), h in lasts, h in middles) for h in haps] + [(r, named("1"), None, None), (r, None, True, True)]
        rows["links"] += [(r, named(x[0]), named(x[1])) for x in links.split()] * 2
        rows["directed"] += [(r, named(x[0]), named(x[1])) for x in directed.split()] * 2
        rows["loose"] += [(r, named(x[0]), named(x[1]), int(x[2])) for x in loose.split()]
        rows["placed"] += [(r, s, named(h)) for s in sets for h in s] * 2
    pair = "region string, a string, b string"
    types = {"haps": "region string, hap string, is_last boolean, is_middle boolean", "links": pair, "directed": pair, "loose": pair + ", n int", "placed": "region string, allele string, hap string"}
    frames = {n: spark.createDataFrame(v, types[n]) for n, v in rows.items()}
    first = spark.createDataFrame([(r, "h1") for r in cases], "region string, hap string")
    args = [frames[n] for n in ("links", "directed", "loose", "placed")]
    found = {x.region: (x.second, x.rule) for x in O.second_copy(frames["haps"], first, *args, K).collect()}
    assert found == {r: (c[7] and named(c[7]), c[8]) for r, c in cases.items()}
    assert O.second_copy(frames["haps"].limit(0), first.limit(0), *args, K).count() == 0


def test_tables_are_dealt_once(spark):
    """What the tables say of a key meets in one shuffle; keys that are null, and first copies that are, have no second."""
    haps = spark.createDataFrame([(k, f"h{c}", False, False) for k in ("a", "b", None) for c in "12"] + [("c", "h1", True, False)], "region string, hap string, is_last boolean, is_middle boolean")
    first = spark.createDataFrame([("a", "h1"), ("a", "h2"), ("b", None), (None, "h1"), ("d", "h1")], "region string, hap string")
    pair = spark.createDataFrame([("a", "h1", "h2")], "region string, a string, b string")
    loose, placed = pair.selectExpr("*", "9 AS n"), pair.selectExpr("region", "a AS allele", "b AS hap")
    found = O.second_copy(haps, first, pair, pair, loose, placed, K)
    assert found._jdf.queryExecution().sparkPlan().toString().count("Join") == 0
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {(x.region, x.first, x.second, x.rule) for x in found.collect()} == {("a", "h1", "h2", "only"), ("b", None, None, None), (None, "h1", None, None), ("d", "h1", None, None)}
