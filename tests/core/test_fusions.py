"""Fusions on small rows worked out by hand."""

from pyspark.sql import functions as F

from haplospark.operators import fusions as U

K = ["region"]


def rows(spark, columns, *values):
    return spark.createDataFrame(list(values), "region string, " + columns)


def named(spark, *haps):
    x = U.name_classes(rows(spark, "hap string, name string, rank int", *[("r", h, f"gene_hap{i}", i) for i, h in enumerate(haps, 1)]), K)
    found = {v.hap: (v.name, v.two_copies) for v in x.collect()}
    return [found[h][0].removeprefix("gene_") for h in haps], [h for h in haps if found[h][1]]


def test_classes_and_copies(spark):
    assert named(spark, "1212", "0120", "2121", "0210") == (["gene1hap1", "gene2hap1", "gene1hap2", "gene2hap2"], [])
    assert named(spark, "1212", "0120", "2121") == (["gene1hap1", "gene2hap1", "gene1hap2"], ["0120"])
    assert named(spark, "1212", "0120")[1] == ["1212", "0120"]
    assert named(spark, "012x", "2121", "0210")[1] == [] and named(spark, "1212", "0121")[1] == []
    assert named(spark, "0121") == (["fusionhap1"], ["0121"])
    assert U.name_classes(rows(spark, "hap string, name string, rank int", ("r", "1", "g", 1)).limit(0), K).count() == 0


def sequence(spark, hap, homs, hets, defining=(), clips=()):
    site = lambda positions: rows(spark, "pos int, code string", *[("r", p, f"{p}_A_T") for p in positions])
    x = U.breakpoint_symbols(rows(spark, "hap string", ("r", hap), ("r", hap)), site(hets), site(homs), K, site(defining), rows(spark, "side string, pos int", *[("r", *c) for c in clips]))
    found = x.orderBy("idx").collect()
    return "".join(v.symbol for v in found), [v.pos for v in found]


def test_symbols_between_the_genes(spark):
    assert sequence(spark, "212", [7], [11, 1, 3], [1, 3, 5, 7, 9, 11]) == ("211212", [1, 3, 5, 7, 9, 11])
    assert sequence(spark, "212", [7], [1, 3, 11]) == ("2122", [1, 3, 7, 11])
    assert sequence(spark, "212", [7], [1, 3, 11], clips=[("3p", 10), ("3p", 12)]) == ("212", [1, 3, 7])
    assert sequence(spark, "212", [7], [1, 3, 11], clips=[("3p", 10), ("5p", 1), ("5p", 0)]) == ("12", [3, 7])


def test_switches(spark):
    def at(hap, text):
        x = rows(spark, "hap string, idx int, symbol string", *[("r", hap, i, c) for i, c in enumerate(text)])
        found = U.switch_index(x, K).collect()
        return found[0].split if found else None

    assert at("121210", "111111122222") == 7 and at("012121", "2222211111111") == 5
    assert at("121210", "2222211111111") is None and at("012121", "111111122222") is None
    assert at("112121", "111111122222") is None and at("0120", "1122") is None


def test_breakpoints_in_both_genes(spark):
    site = lambda positions: rows(spark, "pos int, code string", *[("r", p, f"{p}_A_T") for p in positions])
    haps = rows(spark, "hap string", ("r", "11220"), ("r", "02211"), ("r", "1122x"), ("r", "12121"), ("r", "01110"), ("r", "1x220"))
    none = rows(spark, "side string, pos int", ("q", "5p", 1))

    def found(match, mode="5p"):
        x = U.fusions(haps, site([100, 200, 300, 400, 500]), site([]).limit(0), rows(spark, "pos int, pos2 int", *[("r", *m) for m in match]), K, mode=mode, defining=site([]).limit(0), clips=none)
        return sorted(tuple(v)[1:] for v in x.collect())

    rows_ = [(100, 9100), (250, 9250), (300, 9300), (400, 9400)]
    assert found(rows_) == [("02211", "duplication", "02211", 300, 400, 9300, 9400), ("11220", "deletion", "11220", 200, 300, 9250, 9300), ("1x220", "deletion", "1x220", 100, 200, 9100, 9250)]
    lower = [(p, q - 9090) for p, q in rows_]
    assert found(lower, "3p")[0] == ("02211", "deletion", "02211", 210, 310, 300, 400)
    assert found([(1399, 7)]) == [("02211", "duplication", "02211", None, 7, 300, 400)]  # the next match counts up to 999 behind
    assert found([(1400, 7)]) == []
