"""Sites for phasing on small rows worked out by hand."""

from haplospark.operators import sites as T
from haplospark.sources import text

K = ["region"]


def rows(spark, columns, *values):
    return spark.createDataFrame([("r", *v) for v in values], "region string, " + columns)


def test_sites_for_phasing(spark):
    het = lambda pos, alt, n=9: (pos, "T", alt, "het", n)
    candidates = rows(
        spark, "pos long, ref string, alt string, kind string, n long",
        het(1, "A"), het(2, "A"), het(2, "C"), het(3, "A", 20), het(3, "C", 8), het(3, "G", 8), het(4, "T+24AC"), het(5, "T+25AC"), het(6, "T-2NN"), het(7, "A"), het(8, "C"), het(9, "C"), het(10, "T+1A"),
        het(20, "A"), het(21, "A"), het(30, "A"), (25, "T", "G", "hom", 9), (7, "T", "A", "hom", 9), (31, "T", "T+9A", "hom", 9), het(40, "T+1A", 9), het(40, "T-1N", 8), het(41, "A"))
    masks = rows(spark, "pos long, bases string", (7, "A"), (8, "A"), (9, "A,1"), (9, "G"), (10, "C"), (41, None))
    shifted = rows(spark, "first long, last long", (20, 30), (9, 3))
    white = rows(spark, "pos long, base string", (3, "A"), (1, "A"))
    found = sorted(tuple(v)[1:] for v in T.sites_for_phasing(candidates, masks, shifted, white, K).collect())
    assert found == [
        (1, "T", "A", 0, "phase"), (3, "T", "C", 0, "phase"), (4, "T", "TAC", 24, "report"), (6, "TNN", "T", 2, "report"), (8, "T", "C", 0, "report"), (9, "T", "C", 0, "phase"), (20, "T", "A", 0, "phase"),
        (25, "T", "G", 0, "hom"), (30, "T", "A", 0, "phase"), (31, "T", "TA", 9, "hom"), (40, "TN", "T", 1, "report"), (41, "T", "A", 0, "phase"),
    ]
    assert T.sites_for_phasing(candidates.limit(0), masks, shifted, white, K).count() == 0


def test_deleted_positions(spark):
    x = rows(spark, "pos long, token string, n long", (1, "A", 9), (1, "*", 4), (2, "*", 5), (2, "A", 3), (1000, "*", 5), (2001, "*", 7), (None, "*", 9))
    allowed = rows(spark, "first long, last long", (1000, 2000))
    assert sorted(tuple(v)[1:] for v in T.without_deleted(x, K, allowed).where("pos IS NOT NULL").collect()) == [(1, "*", 4), (1, "A", 9), (1000, "*", 5)]


def test_known_variants(spark, tmp_path):
    (tmp_path / "known.txt").write_text("chr 12 A C x I173N\nchr\t13\tG\tT\tlast\n\nshort 1\nchr 12 A C x Z9\n")
    known = text.read_known_variants(spark, str(tmp_path / "known.txt"))
    variants = rows(spark, "hap string, code string", ("h1", "12_A_C"), ("h1", "12_A_C"), ("h2", "13_G_T"), ("h2", "14_G_T"), ("h3", None))
    assert sorted(tuple(v)[1:] for v in T.known_labels(variants, known, K).collect()) == [("h1", "12_A_C", "Z9"), ("h2", "13_G_T", "last")]


def test_vcf_names_by_file(spark, tmp_path):
    for name, haps in (("a", "x\ty"), ("b", "z")):
        calls = "\t".join("1" for _ in haps.split("\t"))
        (tmp_path / f"{name}.vcf").write_text(f"#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t{haps}\nc\t5\t.\tA\tC\t.\tPASS\t.\tGT\t{calls}\n")
    (tmp_path / "c.vcf").write_text("c\t6\t.\tA\tC\t.\tPASS\t.\tGT\t0:3\n")
    assert sorted(((v.pos, v.hap, v.gt) for v in text.read_vcf(spark, str(tmp_path / "*.vcf")).collect()), key=repr) == [(5, "x", "1"), (5, "y", "1"), (5, "z", "1"), (6, None, "0")]
