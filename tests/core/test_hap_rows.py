"""Rows of calls by haplotype, worked out by hand."""

from haplospark.operators import hap_rows as V

K = ["region"]
HAPS = "hap string, first long, last long, sure_first long, sure_last long, two_copies boolean"


def rows(spark, columns, values):
    return spark.createDataFrame([("r", *v) for v in values], "region string, " + columns)


def called(spark, tokens, haps, unique=(), svs=(), letters="ACGTACGTAC", **options):
    """tokens: {(hap, pos): tokens}, reads named by their place; -> {(hap, pos): (ref, alt, dp, ad_ref, ad, filter, gt)}"""
    t = [(h, p, f"{h}{i}", x) for (h, p), some in tokens.items() for i, x in enumerate(some)]
    x = V.call_rows(
        rows(spark, "hap string, pos long, read string, token string", t), rows(spark, "read string", [(u,) for u in unique]), rows(spark, HAPS, haps),
        rows(spark, "pos long, base string", list(enumerate(letters.lower()))), rows(spark, "hap string, first long, kind string, last long", svs), K, **options)
    return {(v.hap, v.pos): (v.ref, v.alt, v.dp, v.ad_ref, v.ad, v.filter, v.gt) for v in x.collect()}


def test_calls_of_a_haplotype(spark):
    free = ("h", None, None, None, None, False)
    tokens = {("h", 0): ["a"] * 10, ("h", 1): ["T"] * 2, ("h", 2): ["*"] * 4, ("h", 3): ["C", "C", "C", "T", "A"], ("h", 4): ["A+2TG"] * 4 + ["A"], ("h", 8): ["A-3NNN"] * 4, ("h", 5): ["A", "C", "A", "C", None], ("h", 99): ["A"] * 9, ("other", 1): ["A"] * 9}
    assert called(spark, tokens, [free]) == {
        ("h", 0): ("A", "A", 10, 10, 10, "", "0"), ("h", 1): ("C", "T", 2, 0, 2, "LowDP", "."), ("h", 2): ("G", "*", 4, 0, 4, "", "1"), ("h", 3): ("T", "C", 5, 1, 3, "LowQual", "."), ("h", 4): ("A", "ATG", 5, 1, 4, "", "1"),
        ("h", 8): ("ACNN", "A", 4, 0, 4, "", "1"), ("h", 5): ("C", "C", 4, 2, 2, "LowQual", "."),
    }
    assert called(spark, {}, [free]) == {}


def test_bounds_and_unique_reads(spark):
    deep = ["T"] * 4 + ["A"] * 4
    tokens = {("h", p): deep for p in (1, 2, 4, 6)} | {("h", 7): ["A"] * 9 + ["C"]}
    unique = [f"h{i}" for i in range(4)] + ["h9"]
    found = called(spark, tokens, [("h", 1, 8, 3, 6, True)], unique)
    assert sorted(p for h, p in found if h == "h") == [2, 3, 4, 5, 6, 7] and {k[0] for k in found} == {"h", "h_cp2"}
    assert all(found["h", p] == found["h_cp2", p] for p in range(2, 8))
    assert found["h", 2] == ("G", "T", 4, 0, 4, "", "1") == found["h", 6]  # unique reads settle it
    assert found["h", 3] == ("T", "T", 0, 0, 0, "LowDP", ".")  # not covered
    assert found["h", 7] == ("T", "A", 5, 0, 4, "", "1")  # outside the sure bounds
    assert found["h", 4] == ("A", "T", 4, 0, 4, "", "1")
    assert called(spark, tokens, [("h", 1, 8, 3, 6, False)], unique[:3])["h", 2] == ("G", "A", 8, 0, 4, "LowQual", ".")


def test_special_variants(spark):
    h = ("h", 0, 6, 0, 6, True)
    found = called(spark, {("h", 3): ["T"] * 5}, [h], svs=[("h", 2, "DEL", 4), ("none", 1, "DEL", 2)])
    assert found["h", 2] == ("DEL", "4", None, None, None, "", "1") == found["h_cp2", 2] and found["h", 3][2] == 5 and len(found) == 10
    assert sorted(p for n, p in called(spark, {}, [h], svs=[("h", 2, "DEL", 4)], spans=True) if n == "h") == [1, 2, 5]


def test_two_genes(spark):
    match = rows(spark, "pos long, pos2 long", [(0, 9), (8, 1), (3, 7), (6, 4)])
    haps = rows(spark, HAPS, [("h", 0, 8, 2, 5, False), ("g", 0, 300, 2, 5, True)])
    assert sorted(tuple(v)[1:] for v in V.other_bounds(haps, match, K).collect()) == [("g", None, None, None, None, True), ("h", 1, 9, 4, 7, False)]
    t = lambda *v: rows(spark, "hap string, pos long, read string, token string", v)
    bases = lambda text: rows(spark, "pos long, base string", list(enumerate(text)))
    svs = rows(spark, "gene int, hap string, first long, kind string, last long", [(2, "h", 5, "DEL", 6)])
    one, two = rows(spark, HAPS, [("k", 0, 3, 0, 3, False)]), haps.where("hap = 'h'")
    x = V.two_gene_rows((t(("k", 1, "r", "C")), one, bases("AAAA")), (t(("h", 2, "r", "C")), two, bases("C" * 10)), rows(spark, "read string", [("r",)]), match, svs, K)
    found = {(v.gene, v.hap, v.pos): (v.ref, v.alt, v.dp) for v in x.collect()}
    assert {k for k in found} == {(1, "k", 1), (1, "k", 2)} | {(2, "h", p) for p in range(2, 9)}
    assert found[1, "k", 1] == ("A", "C", 1) and found[2, "h", 2] == ("C", "C", 1) and found[2, "h", 5] == ("DEL", "6", None)
